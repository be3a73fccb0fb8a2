"""Names of sources, written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_name(column: Column) -> Column:
    """Lower case, white space at the ends gone, inner blanks and hyphens as underscores; blank is null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s\u00a0]+|[\s\u00a0]+$", "")), r"[\s\u00a0-]+", "_")
    return F.when(name != "", name)
