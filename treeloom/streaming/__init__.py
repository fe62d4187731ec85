"""Queries over streams."""

from .stream import query_stream, sessions, windowed  # noqa: F401
