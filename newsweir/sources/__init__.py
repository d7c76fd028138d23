"""Readers of the raw and cleaned tables."""
