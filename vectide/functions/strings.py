"""Helpers on option and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delimiter_end(s: Column | str, delimiter: str) -> Column:
    """Number of leading delimiters; 0 if that leaves one character or none."""
    s = F.col(s) if isinstance(s, str) else s
    n = F.length(s) - F.length(F.ltrim(s, F.lit(delimiter)))
    return F.when(n >= F.length(s) - 1, F.lit(0)).otherwise(n)


def file_extension(s: Column | str) -> Column:
    """What follows the last dot; null without a dot."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(F.contains(s, F.lit(".")), F.substring_index(s, ".", -1))
