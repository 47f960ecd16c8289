"""Incremental evaluation over streams of new edges."""
