"""Draws keyed by what they are for: free of order, partitioning and retries, and the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: Column | int, *tags: Column | str | int) -> Column:
    """A uniform number in [0, 1) from the md5 of seed and tags (strings are literals)."""
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[t.cast("string") if isinstance(t, Column) else F.lit(str(t)) for t in tags]]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def pick(seed: Column | int, n: Column, *tags: Column | str | int) -> Column:
    """A uniform integer from 0 to n - 1."""
    return F.floor(uniform(seed, *tags) * n).cast("long")


def uniform_sql(seed: int, *tags: str) -> str:
    """The same in DuckDB; tags are SQL expressions."""
    joined = ", ".join([f"'{seed}'", *[f"({t})::VARCHAR" for t in tags]])
    return f"(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8))::BIGINT / 4294967296.0)"
