"""Plans of the document analytics package."""
