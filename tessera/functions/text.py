"""Text helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_upper(c: Column) -> Column:
    return F.upper(strip(c))


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9]")


def accession(name: Column) -> Column:
    """The leading letters and digits of a file name."""
    return F.regexp_extract(name, "^[A-Za-z0-9]+", 0)


def uniform(*parts: Column | str | int) -> Column:
    """A repeatable integer in [0, 2^32) from the MD5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, int) else (F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
