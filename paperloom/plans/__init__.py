"""Composed reports, jobs and the driver's queries."""
