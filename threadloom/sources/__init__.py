"""Readers and message shapes."""
