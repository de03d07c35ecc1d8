"""Change feeds: events in, a fresh chunk table out."""
