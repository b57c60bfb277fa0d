"""Sources of the document analytics package."""
