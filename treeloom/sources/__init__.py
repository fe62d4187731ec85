"""Readers and writers."""

from .files import documents, json_lines, json_text, read, rows, write  # noqa: F401
