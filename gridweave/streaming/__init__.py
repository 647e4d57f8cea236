"""Structured Streaming jobs over file events."""
