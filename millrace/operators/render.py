"""Records as text or JSON, one row in and one string out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import rstrip_space


def json_record(*fields: Column | str) -> Column:
    """A JSON object of the fields in the given order; nulls are kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def checks_text(title: str, healthy: Column, checks: Column) -> Column:
    """Title and status, blank line, then a line for each check and a hint below a failed one."""
    line = lambda c: F.concat(F.when(c["passed"], F.lit("[ok] ")).otherwise(F.lit("[FAIL] ")), c["id"], F.lit(": "), c["message"])
    hint = lambda c: F.when(~c["passed"] & (F.length(c["remediation"]) > 0), F.concat(F.lit("\n  hint: "), c["remediation"])).otherwise(F.lit(""))
    status = F.when(healthy, F.lit("healthy")).otherwise(F.lit("unhealthy"))
    return F.concat(F.lit(f"{title}: "), status, F.lit("\n\n"), F.array_join(F.transform(checks, lambda c: F.concat(line(c), hint(c))), "\n"))


def sections_text(subject: Column, sections: Column) -> Column:
    """``# subject``, then ``## title`` and ``- item`` lines for sections array<struct<title,items>>."""
    one = lambda s: F.array_join(F.concat(F.array(F.concat(F.lit("## "), s["title"])), F.transform(s["items"], lambda i: F.concat(F.lit("- "), i)), F.array(F.lit(""))), "\n")
    return rstrip_space(F.array_join(F.concat(F.array(F.concat(F.lit("# "), subject), F.lit("")), F.transform(sections, one)), "\n"))
