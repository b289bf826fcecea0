"""Structured Streaming jobs over the case event history."""
