"""Quantile repair: move each group's distribution of a column towards the groups' median distribution.

With B buckets (the smallest group's size) and r the last tied rank of a value among the n of its group,
its bucket is min(B - 1, floor(r B / (n - 1))): exact integer arithmetic for "number of inner quantile
edges at most v". A bucket's value is its median, or the middle of its edges if it is empty; the target
of a bucket is the median of the groups' values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.ranks import binned, last_ranks, numbered, ranked


def _bucketed(df: DataFrame, sens: str, col: str) -> tuple[DataFrame, int]:
    """(df with _last, _n and _bucket, B)."""
    sizes = df.groupBy(sens).agg(F.count("*").alias("_n"))
    least = sizes.agg(F.min("_n")).first()[0]
    if least is None or least < 2:
        raise ValueError("each group needs two rows at least")
    r = last_ranks(df, [sens], col).join(sizes, sens)
    bucket = F.least(F.lit(least - 1), F.expr(f"(_last * {least}) div (_n - 1)")).cast("long")
    return r.withColumn("_bucket", bucket), int(least)


def quantile_edges(df: DataFrame, sens: str, col: str, buckets: int, key: str) -> DataFrame:
    """(sens, j, q) for j from 0 to B: linearly interpolated quantiles, by joins on the rank."""
    at = ranked(df.select(sens, key, F.col(col).cast("double").alias("_v")), [sens], "_v", key).select(F.col(sens).alias("_g"), "_rank", "_v")
    sizes = df.groupBy(sens).agg(F.count("*").alias("n"))
    grid = numbered(sizes, F.lit(buckets + 1), "j").withColumn("j", F.col("j").cast("int")).withColumn("lo", F.expr(f"((n - 1) * j) div {buckets}"))
    grid = grid.withColumn("frac", F.expr(f"((n - 1) * j) % {buckets}") / F.lit(float(buckets))).withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1))
    lo = at.select(F.col("_g").alias("g1"), F.col("_rank").alias("r1"), F.col("_v").alias("v1"))
    hi = at.select(F.col("_g").alias("g2"), F.col("_rank").alias("r2"), F.col("_v").alias("v2"))
    j = grid.join(lo, (F.col(sens) == F.col("g1")) & (F.col("lo") == F.col("r1"))).join(hi, (F.col(sens) == F.col("g2")) & (F.col("hi") == F.col("r2")))
    return j.select(sens, "j", (F.col("v1") + F.col("frac") * (F.col("v2") - F.col("v1"))).alias("q"))


def repair_targets(df: DataFrame, sens: str, col: str, key: str) -> DataFrame:
    """(bucket, target)."""
    rows, b = _bucketed(df.select(sens, key, F.col(col).cast("double").alias("_v")), sens, "_v")
    med = rows.groupBy(sens, F.col("_bucket").alias("bucket")).agg(F.median("_v").alias("m"))
    groups = df.select(sens).distinct()
    grid = numbered(groups, F.lit(b), "bucket")
    filled = grid.join(med, [sens, "bucket"], "left")
    edges = quantile_edges(df, sens, col, b, key)
    q0 = edges.select(sens, F.col("j").cast("long").alias("bucket"), F.col("q").alias("q0"))
    q1 = edges.select(sens, (F.col("j") - 1).cast("long").alias("bucket"), F.col("q").alias("q1"))
    filled = filled.join(q0, [sens, "bucket"]).join(q1, [sens, "bucket"])
    return filled.groupBy("bucket").agg(F.median(F.coalesce("m", (F.col("q0") + F.col("q1")) / 2)).alias("target"))


@dataclass
class RepairModel:
    sens: str
    lam: float
    key: str
    tables: dict[str, tuple[DataFrame, DataFrame, int]]
    unseen: str = "keep"

    @property
    def edges(self) -> dict[str, DataFrame]:
        return {c: t[0] for c, t in self.tables.items()}

    @property
    def targets(self) -> dict[str, DataFrame]:
        return {c: t[1] for c, t in self.tables.items()}

    def release(self) -> None:
        """Let go of the tables that ``fit`` made and keeps; a later transform makes them again."""
        for edges, targets, _ in self.tables.values():
            edges.unpersist(), targets.unpersist()

    def transform(self, df: DataFrame) -> DataFrame:
        """Repair rows, also new ones: clip to the group's range, look the bucket up, move by ``lam``.

        Rows of groups that weren't there at fit keep their value, or become 0 with unseen='zero'.
        """
        if self.lam == 0:
            return df
        for col, (edges, targets, b) in self.tables.items():
            df = self._one(df, col, edges, targets, b)
        return df

    def _one(self, df: DataFrame, col: str, edges: DataFrame, targets: DataFrame, b: int) -> DataFrame:
        s = self.sens
        ends = edges.where((F.col("j") == 0) | (F.col("j") == b)).groupBy(s).agg(F.min("q").alias("_lo"), F.max("q").alias("_hi")).withColumnRenamed(s, "_s")
        rows = df.join(ends, F.col(s) == F.col("_s"), "left").withColumn("_v", F.least(F.greatest(F.col(col).cast("double"), "_lo"), "_hi"))
        values = rows.where(F.col("_v").isNotNull()).select(F.col(s).alias("_g"), F.col("_v").alias("_at")).distinct()
        inner = edges.where((F.col("j") > 0) & (F.col("j") < b)).select(F.col(s).alias("_g"), F.col("q").alias("_at"), F.col("j"))
        # as-of: the last inner edge at most v, over edges and probes in bins of v
        both = binned(inner.select("_g", "_at", F.col("j").cast("long").alias("j"), F.lit(0).alias("probe")).union(values.select("_g", "_at", F.lit(None).cast("long"), F.lit(1))), "_at")
        top = both.groupBy("_g", "_bin").agg(F.max("j").alias("top"))
        before = F.max("top").over(Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        offset = top.select("_g", "_bin", F.coalesce(before, F.lit(0)).alias("below"))
        here = F.max("j").over(Window.partitionBy("_g", "_bin").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
        found = both.join(offset, ["_g", "_bin"]).withColumn("bucket", F.coalesce(here, "below")).where("probe = 1").select("_g", "_at", "bucket").join(targets, "bucket")
        out = rows.join(found.select("_g", "_at", F.col("target").alias("_target")), (F.col(s) == F.col("_g")) & (F.col("_v") == F.col("_at")), "left")
        moved = (1 - self.lam) * F.col("_v") + self.lam * F.col("_target")
        other = F.lit(0.0) if self.unseen == "zero" else F.col(col).cast("double")
        return out.withColumn(col, F.when(F.col("_s").isNull(), other).otherwise(moved)).select(*df.columns)


class QuantileRepair:
    """Estimator: ``fit`` makes the edges and targets of each column, ``fit_transform`` repairs the training rows."""

    def __init__(self, sens: str, columns: list[str], key: str, lam: float = 1.0, unseen: str = "keep"):
        if not 0 <= lam <= 1:
            raise ValueError("lam must lie between 0 and 1")
        self.sens, self.columns, self.key, self.lam, self.unseen = sens, list(columns), key, lam, unseen

    def _check(self, df: DataFrame) -> None:
        absent = [c for c in (self.sens, *self.columns) if c not in df.columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}")

    def fit(self, df: DataFrame) -> RepairModel:
        self._check(df)
        tables = {}
        for c in self.columns:
            _, b = _bucketed(df.select(self.sens, F.col(c).cast("double").alias("_v")), self.sens, "_v")
            edges, targets = quantile_edges(df, self.sens, c, b, self.key).persist(), repair_targets(df, self.sens, c, self.key).persist()
            edges.count(), targets.count()  # made once, not at each transform
            tables[c] = (edges, targets, b)
        return RepairModel(self.sens, self.lam, self.key, tables, self.unseen)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        if self.lam == 0:
            return df
        for c in self.columns:
            kind = df.withColumn("_v", F.col(c).cast("double"))
            rows, _ = _bucketed(kind, self.sens, "_v")
            moved = (1 - self.lam) * F.col("_v") + self.lam * F.col("target")
            df = rows.join(repair_targets(df, self.sens, c, self.key), F.col("_bucket") == F.col("bucket")).withColumn(c, moved).select(*df.columns)
        return df
