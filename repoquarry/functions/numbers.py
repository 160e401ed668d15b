"""Sizes as text, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the mark of a file above the size limit.
OVERSIZE = "file too large (>1MB)"


def kib(size: Column, digits: int = 1) -> Column:
    return F.bround(size / F.lit(1024.0), digits)


def kib_text(size: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f", kib(size, digits))


def mib_text(size: Column) -> Column:
    return F.format_string("%.2f", F.bround(size.cast("double") / F.lit(1048576.0), 2))
