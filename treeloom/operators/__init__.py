"""Operators on ordered relations that scale past one task."""
