"""Structured Streaming forms of the manifest and image plans."""
