"""Structured Streaming forms (extensions: no unbounded source is asked for)."""
