"""Ranks and prefix sums over large groups in two steps: bins of the order, then inside a bin.

A plain window over a group sorts all of it in one task. Here the order column is cut into bins, whose
number follows the session's shuffle partitions (that is, the size of the job); bins are summed (one row
a bin and group), and only rows of one bin meet in a task. Even draws are cut evenly; other columns at
quantiles of a sketch, MOST_BINS at most. Rows that tie on the order column share a bin, so a column with
few distinct values gets no more bins than values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.names import free_name

BINS, MOST_BINS, WIDTH = 64, 4096, 64
#: Rows that ``numbered`` makes of one row in one task.
CHUNK = 1 << 16


def bins_of(df: DataFrame) -> int:
    return max(BINS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _below(cut: list[float], by: str) -> Column:
    """How many of the sorted edges are at most ``by``; in two steps where there are many."""
    within = lambda part: F.size(F.filter(part, lambda e: e <= F.col(by)))
    if len(cut) <= WIDTH:
        return within(F.array(*[F.lit(e) for e in cut]))
    parts = [cut[i : i + WIDTH] for i in range(0, len(cut), WIDTH)]
    whole = within(F.array(*[F.lit(p[0]) for p in parts]))
    fine = F.get(F.array(*[F.array(*[F.lit(e) for e in p]) for p in parts]), whole - 1)
    return F.when(whole == 0, 0).otherwise((whole - 1) * WIDTH + within(fine))


def binned(df: DataFrame, by: str, bins: int | None = None, out: str = "_bin", even: bool = False) -> DataFrame:
    """``df`` with a bin number that grows with column ``by``; ``even``: by is an even draw from 0 to 1."""
    bins = bins or bins_of(df)
    if even:
        return df.withColumn(out, F.least(F.floor(F.col(by) * bins), F.lit(bins - 1)).cast("int"))
    bins = min(bins, MOST_BINS)
    probs = [i / bins for i in range(1, bins)]
    edges = sorted(set(df.select(F.col(by).cast("double").alias("v")).approxQuantile("v", probs, min(0.002, 0.25 / bins))))
    return df.withColumn(out, _below(edges, by) if edges else F.lit(0))


def _offsets(df: DataFrame, groups: list[str], bin_: str, n: str, before: str, order: Column) -> DataFrame:
    """``df`` with the number of rows of its group in earlier bins."""
    counts = df.groupBy(*groups, bin_).agg(F.count("*").alias(n))
    run = F.sum(n).over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.join(counts.select(*groups, bin_, F.coalesce(run, F.lit(0)).alias(before)), [*groups, bin_])


def ranked(df: DataFrame, groups: list[str], by: str, ties: str, ascending: bool = True, out: str = "_rank", even: bool = False) -> DataFrame:
    """``df`` with 0-based rank by ``by``, then key ``ties`` (always ascending), inside ``groups``."""
    bin_, n, before = (free_name(df, base=x) for x in ("_bin", "_n", "_before"))
    order = F.col(bin_) if ascending else F.col(bin_).desc()
    b = _offsets(binned(df, by, out=bin_, even=even), groups, bin_, n, before, order)
    inner = Window.partitionBy(*groups, bin_).orderBy(F.col(by) if ascending else F.col(by).desc(), ties)
    return b.withColumn(out, F.col(before) + F.row_number().over(inner) - 1).drop(bin_, before)


def last_ranks(df: DataFrame, groups: list[str], by: str, out: str = "_last") -> DataFrame:
    """``df`` with the 0-based rank of the last row that ties with each row on ``by``."""
    bin_, n, before = (free_name(df, base=x) for x in ("_bin", "_n", "_before"))
    b = _offsets(binned(df, by, out=bin_), groups, bin_, n, before, F.col(bin_))
    inner = Window.partitionBy(*groups, bin_).orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
    return b.withColumn(out, F.col(before) + F.count("*").over(inner) - 1).drop(bin_, before)


def indexed(df: DataFrame, groups: list[str], key: str, out: str = "idx") -> DataFrame:
    """``df`` with a 0-based index inside ``groups``, in the order of md5(key), then key."""
    bin_, n, before, h = (free_name(df, base=x) for x in ("_bin", "_n", "_before", "_h"))
    digits = next(d for d in range(2, 9) if 16**d >= bins_of(df) or d == 8)
    b = df.withColumn(h, F.md5(F.col(key).cast("string"))).withColumn(bin_, F.substring(h, 1, digits))
    b = _offsets(b, groups, bin_, n, before, F.col(bin_))
    inner = Window.partitionBy(*groups, bin_).orderBy(h, key)
    return b.withColumn(out, F.col(before) + F.row_number().over(inner) - 1).drop(bin_, before, h)


def first_by(df: DataFrame, m: int, by: Column, ties: str, ascending: bool = True) -> DataFrame:
    """The ``m`` first rows by ``by``, then ``ties``, without sorting all rows in one task."""
    if m <= 0:
        return df.limit(0)
    value, all_, rank = (free_name(df, base=x) for x in ("_by", "_all", "_rank"))
    marked = df.withColumn(value, by.cast("double")).withColumn(all_, F.lit(0))
    return ranked(marked, [all_], value, ties, ascending, out=rank).where(F.col(rank) < m).drop(rank, value, all_)


def numbered(df: DataFrame, count: Column, out: str, first: int = 0) -> DataFrame:
    """Each row ``count`` times with ``out`` counting from ``first``; no task makes more than CHUNK rows of a row.

    A null count, or one below 1, gives none.
    """
    chunk, most = free_name(df, base="_chunk"), free_name(df, base="_most")
    rows = df.withColumn(most, count.cast("long")).where(F.col(most) > 0)
    rows = rows.withColumn(chunk, F.explode(F.expr(f"sequence(0L, (`{most}` - 1) div {CHUNK})"))).repartition(F.col(chunk), *df.columns)
    begin, end = f"`{chunk}` * {CHUNK} + {first}L", f"least(`{most}`, (`{chunk}` + 1) * {CHUNK}) + ({first - 1}L)"
    return rows.withColumn(out, F.explode(F.expr(f"sequence({begin}, {end})"))).drop(chunk, most)
