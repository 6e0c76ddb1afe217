"""Structured Streaming forms of the live-progress operators."""
