"""Streaming of the event engine."""
