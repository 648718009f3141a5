"""Relational, back-testing, statistical and selection operators."""
