"""Readers of relations and sinks for results."""
