"""Text functions with Unicode-aware line breaks and trimming.

Spark's ``trim`` removes only U+0020 and its text reader breaks lines only at
CR and LF, so both rules are spelt out here as Java patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line separators and the white space that are recognised.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
EDGE_SPACE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"
END_SPACE = "(?U)[\\s\\x1c-\\x1f]+$"


def split_lines(text: Column) -> Column:
    """Array of lines; a separator at the very end opens no further line, null and empty text give no lines."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def strip_space(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def rstrip_space(text: Column) -> Column:
    """Remove Unicode white space at the end."""
    return F.regexp_replace(text, END_SPACE, "")


def strip_quotes(text: Column) -> Column:
    """Remove any run of single and double quotes at both ends."""
    return F.btrim(text, F.lit("'\""))


def default_if_empty(text: Column, default: str) -> Column:
    """``default`` where the text is null or empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(default)).otherwise(text)


def after_first(text: Column, separator: str) -> Column:
    """What follows the first separator, empty if there is none; null stays null."""
    return F.when(F.contains(text, F.lit(separator)), F.substring(text, F.locate(separator, text) + F.length(F.lit(separator)), F.length(text))).when(text.isNotNull(), F.lit(""))


def after_key(line: Column, key: str, default: str = "unknown") -> Column:
    """Value behind the first ``key:`` of a line, trimmed and unquoted; empty gives the default, null stays null."""
    tail = after_first(line, f"{key}:")
    return F.when(line.isNotNull(), default_if_empty(strip_quotes(strip_space(tail)), default))
