"""Structured Streaming forms of the pattern operators."""
