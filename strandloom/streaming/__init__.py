"""Structured Streaming forms of the depth and session operators."""
