"""Operators on frames and units."""
