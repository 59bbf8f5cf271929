"""Operators of the event engine."""
