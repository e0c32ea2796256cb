"""Near-duplicate embeddings by an exact metric range join.

Vectors of one label (and length) are compared by cosine in double precision. On unit vectors a cosine
of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Pivots, a bounded sample, partition
the vectors: each has its home in the cell of its nearest pivot h. A vector x also goes to the cell of p
as a guest if it may be within r of a vector at home there; by the triangle inequality that needs
d(x, p) <= d(x, h) + 2r and d(x, p) <= radius(p) + r. Then every pair within r meets in the home cell of
either of the two, and cells join independently: each home vector against all homes and guests.

Equal vectors collapse first. A large cell is cut into blocks of homes and blocks of others, so a task's
memory is bounded, and a block pair returns counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import drop_written, min_labels, run_starts, runs, ship, table, written
from evenhand.llm.components import components

#: Above the rounding error of sqrt(2 - 2 * x.p), which is about 2e-8 near 0.
SLACK = 1e-7


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    with np.errstate(over="ignore", invalid="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(classes: DataFrame, cell: int, most: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit vectors of at most ``most`` pivots in all, for labels that have more than ``cell`` classes.

    Their number follows the label's size until the bound; then cells grow and are cut into blocks.
    """
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    each = F.ceil(F.col("n") / F.greatest(F.lit(cell), F.lit(total / most))).cast("int")
    wanted = sizes.select("label", "dim", "n", each.alias("k")).where("k > 1").orderBy(F.desc("n"), "label", "dim").limit(most)
    # draws by hash, then exactly k of each label by rank among few
    drawn = classes.join(F.broadcast(wanted), ["label", "dim"]).where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.col("k") * 8 / F.col("n") * (1 << 30))
    picked = drawn.groupBy("label", "dim", "k").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("rep").alias("h"), "v"))).alias("all")).select("label", "dim", F.slice("all", 1, F.col("k")).alias("some"))
    return {(r[0], r[1]): _units(pa.array([s["v"] for s in r[2]], pa.list_(pa.float64()))) for r in picked.collect() if len(r[2]) > 1}


def vector_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    cell: int = 4000,
    most_pivots: int = 2048,
    block: int = 1024,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts the other rows whose cosine is at least ``cosine`` and whose label and length are the
    same. A null label, and a vector that is null, empty, zero or holds a null or non-finite component,
    links with nothing. component_id is the least id reachable by links; kept is vec_id = component_id.
    A null id has a null component_id and is kept, but counts as another row. Rows that share an id count
    each for the others, and their components are one. Other columns are ignored; an empty table gives
    none.
    """
    spark = vectors.sparkSession
    ship(spark)
    radius = float(np.sqrt(2 - 2 * cosine)) + SLACK
    double = vectors.schema[vector_col].dataType.simpleString() == "array<double>"
    kind = "array<double>" if double else "array<float>"
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), (v if double else v.cast("array<float>")).alias("v"), F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False)).alias("good"))
    rows = rows.withColumn("key", F.when(F.col("good") & F.col("label").isNotNull(), F.col("v")))
    keyed = written(rows.select("id", "label", "key"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("low"), F.count("*").alias("times"))
    # rep: a number of its own for each class, fixed by the written table
    classes = written(classes.select("label", F.col("key").alias("v"), "low", "times", F.size("key").alias("dim"), F.monotonically_increasing_id().alias("rep")), "classes")
    pivots = spark.sparkContext.broadcast(_pivots(classes, cell, most_pivots))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_label(batch):
                p = pivots.value.get(_label(part))
                d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T)) if p is not None else np.zeros((len(x), 1))
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["label", "dim", "cell", "d"])

    slim_classes = classes.select("label", "dim", "rep", "times", "v")
    homes = slim_classes.mapInArrow(nearest, "label long, dim int, cell int, d double")
    sized = pivots.value and {
        (r[0], r[1], r[2]): (r[3], r[4])
        for r in homes.join(F.broadcast(spark.createDataFrame([k for k in pivots.value], "label long, dim int")), ["label", "dim"]).groupBy("label", "dim", "cell").agg(F.max("d"), F.count("*")).collect()
    }
    radii = spark.sparkContext.broadcast(sized or {})  # one entry a pivot

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _by_label(batch):
                key = _label(part)
                p = pivots.value.get(key)
                if p is None:
                    row, to, home = np.arange(len(x)), np.zeros(len(x), np.int32), np.ones(len(x), bool)
                else:
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                    own = d.argmin(axis=1)
                    reach = np.array([radii.value.get((*key, c), (-9.0, 0))[0] for c in range(len(p))])
                    near = (d <= d[np.arange(len(d)), own][:, None] + 2 * radius + SLACK) & (d <= reach + radius + SLACK)
                    near[np.arange(len(d)), own] = True
                    row, to = np.nonzero(near)
                    home = own[row] == to
                yield pa.RecordBatch.from_arrays([part.column(i).take(pa.array(row)) for i in range(5)] + [pa.array(to.astype(np.int32)), pa.array(home)], names=["label", "dim", "rep", "times", "v", "cell", "home"])

    dealt = written(slim_classes.mapInArrow(deal, "label long, dim int, rep long, times long, v " + kind + ", cell int, home boolean"), "cells")
    counts = dealt.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("nh"), F.count("*").alias("na")).where("na > 1")
    k = counts.select("label", "dim", "cell", F.ceil(F.col("nh") / block).cast("int").alias("kh"), F.ceil(F.col("na") / block).cast("int").alias("ka")).where("kh > 0")
    placed = dealt.join(k, ["label", "dim", "cell"])
    h = F.pmod(F.xxhash64("rep"), F.col("kh")).cast("int")
    o = F.pmod(F.xxhash64("rep"), F.col("ka")).cast("int")
    keep = ["label", "dim", "cell", "rep", "times", "v"]
    as_home = placed.where("home").withColumn("i", h).withColumn("j", F.explode(F.expr("sequence(0, ka - 1)"))).select(*keep, "i", "j", F.lit(True).alias("home"))
    as_other = placed.withColumn("j", o).withColumn("i", F.explode(F.expr("sequence(0, kh - 1)"))).select(*keep, "i", "j", F.lit(False).alias("home"))
    unit = ["label", "dim", "cell", "i", "j"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in runs(batches, unit):
            starts = [*run_starts(tab, unit).tolist(), tab.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = tab.slice(s, e - s)
                x, rep, home = _units(part.column("v")), part.column("rep").to_numpy(), part.column("home").to_numpy()
                times = part.column("times").to_numpy()
                a, b = np.flatnonzero(home), np.flatnonzero(~home)
                if not len(a) or not len(b):
                    continue
                near = x[a] @ x[b].T >= cosine
                near &= rep[a][:, None] != rep[b]
                yield from _found(rep[a], rep[b], times[b], near)

    def _found(ra, rb, times, near) -> Iterator[pa.RecordBatch]:
        n = near @ times
        r, c = np.nonzero(near)
        every, at = np.unique(np.concatenate([ra, rb]), return_inverse=True)
        low = every[min_labels(len(every), at[r], at[len(ra) + c])]
        lonely = low == every
        node, root = every[~lonely], low[~lonely]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ra[some], node])), pa.array(np.concatenate([n[some], np.zeros(len(node), np.int64)]).astype(np.int64)), pa.array(np.concatenate([ra[some], root]))],
            names=["rep", "n", "root"],
        )

    both = as_home.union(as_other).repartition(*unit).sortWithinPartitions(*unit)
    found = written(both.mapInArrow(join, "rep long, n long, root long"), "found")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    least = classes.select("rep", "low").join(comps, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("low").alias("least"))
    in_comp = comps.join(least, "component").select("node", "least")
    per_class = (
        classes.select(F.col("v").alias("class_key"), F.col("label").alias("class_label"), "rep", "low", "times")
        .join(linked, "rep", "left")
        .join(in_comp, F.col("rep") == F.col("node"), "left")
        .select("class_key", "class_label", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "low").alias("least"))
    )
    drop_written(dealt)
    out = keyed.join(per_class, (F.col("key") == F.col("class_key")) & (F.col("label") == F.col("class_label")), "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _label(part) -> tuple[int, int]:
    return part.column("label")[0].as_py(), part.column("dim")[0].as_py()


def _by_label(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, np.ndarray]]:
    tab = pa.Table.from_batches([batch]).sort_by([("label", "ascending"), ("dim", "ascending")]).combine_chunks()
    starts = [*run_starts(tab, ["label", "dim"]).tolist(), tab.num_rows]
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        part = tab.slice(s, e - s).combine_chunks().to_batches()[0]
        yield part, _units(part.column("v"))


def op4_metric_join(spark, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.93. Vectors that aren't whole link with nothing; see vector_links."""
    return vector_links(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN (SELECT n, min(m) AS m FROM r GROUP BY n) c ON c.n = e.vec_id
"""
