"""Sinks: results and errors of one pass, which appear together."""

from .split import read_sink, write_split

__all__ = ["read_sink", "write_split"]
