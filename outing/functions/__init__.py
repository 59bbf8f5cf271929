"""Functions of the event engine."""
