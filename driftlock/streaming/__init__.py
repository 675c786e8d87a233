"""Structured Streaming gates."""
