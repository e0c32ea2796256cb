"""Standardising numbers and one-hot encoding of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def standardize_onehot(df: DataFrame, passthrough: list[str] | None = None, max_categories: int = 10_000) -> DataFrame:
    """z-scores (sample deviation; a deviation of 0 counts as 1), then booleans col_value without each column's first category."""
    keep = list(passthrough or [])
    nums = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keep]
    cats = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    rest = [c for c in df.columns if c not in nums and c not in cats]
    out = []
    if nums:
        stats = df.agg(*[g(c).alias(f"{p}{c}") for c in nums for p, g in (("m", F.avg), ("s", F.stddev_samp))]).first()
        for c in nums:
            sd = stats[f"s{c}"] or 1.0
            out.append(((F.col(c) - F.lit(float(stats[f"m{c}"] or 0))) / F.lit(float(sd))).alias(c))
    for c in cats:
        values = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(max_categories + 1).collect()]
        if len(values) > max_categories:
            raise ValueError(f"{c} has more than {max_categories} categories")
        out += [F.coalesce(F.col(c) == v, F.lit(False)).alias(f"{c}_{v}") for v in values[1:]]
    return df.select(*out, *rest)
