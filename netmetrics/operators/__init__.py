"""Operators on graphs."""
