"""Structured Streaming forms of the event-side operators."""
