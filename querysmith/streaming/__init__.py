"""Interaction rounds as a Structured Streaming job."""
