"""Readers: identity files by pattern or by table of places, probes of files and folders, Parquet tables."""

from .files import found_paths, probe, readable, scan, scan_errors
from .tables import table
from .trees import locate, nearest_root, read_identity_files

__all__ = ["found_paths", "locate", "nearest_root", "probe", "read_identity_files", "readable", "scan", "scan_errors", "table"]
