"""Operators on tables of papers."""
