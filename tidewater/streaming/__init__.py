"""Structured Streaming versions of the velocity features and of routing."""
