"""Identity files as a stream: the row-wise plans take streaming frames too."""

from .watch import watch_identities

__all__ = ["watch_identities"]
