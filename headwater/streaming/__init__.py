"""Structured Streaming versions of the per-document operators."""
