"""Readers of captures."""
