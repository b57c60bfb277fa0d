"""Operators of the document analytics package."""
