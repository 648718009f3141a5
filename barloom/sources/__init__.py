"""Bars and side series from files, events and exchanges; sinks for results."""
