"""Streaming of the document analytics package."""
