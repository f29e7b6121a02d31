"""Operators of a profiling capture."""
