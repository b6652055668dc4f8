"""Structured Streaming forms of the labor analyses."""
