"""Structured Streaming forms of the event-driven jobs."""
