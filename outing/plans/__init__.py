"""Plans of the event engine."""
