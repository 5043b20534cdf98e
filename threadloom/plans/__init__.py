"""Whole runs and views."""
