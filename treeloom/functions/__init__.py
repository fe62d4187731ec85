"""Builtins on values inside a row: Column expressions with their types."""

from . import arrays, numbers, objects, paths, regexes, strings  # noqa: F401
from .values import BUILTINS, C, QueryError  # noqa: F401
