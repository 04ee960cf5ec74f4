"""Lessons as they arrive."""
