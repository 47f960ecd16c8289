"""Relational operators, choice resolution and ready-made recursive queries."""
