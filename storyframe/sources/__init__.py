"""Readers and writers, and the binding of entities to the driver tables."""
