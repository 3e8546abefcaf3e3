"""Column functions built from Spark's own expressions."""

from .text import after_first, after_key, default_if_empty, split_lines, strip_quotes, strip_space

__all__ = ["after_first", "after_key", "default_if_empty", "split_lines", "strip_quotes", "strip_space"]
