"""Indicators, predicates and scalar functions on ordered bars."""
