"""The query language: tokens, syntax tree and parser."""
