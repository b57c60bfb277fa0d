"""Functions of the document analytics package."""
