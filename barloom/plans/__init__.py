"""The strategy language, pattern modules and evolutionary search."""
