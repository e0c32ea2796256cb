"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts only; labels, language, source and id are never inputs. Trees of
one depth are grown on the driver over a bounded, documented sample of labelled rows (``max_labels``,
taken in hash order), then flattened into arrays: a batch of documents goes down all trees at once by
index arithmetic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.llm.common import bin_texts, ship, table

_CLASS = np.zeros((8, 256))
for _c in range(256):
    _ch = chr(_c)
    _k = 0 if _ch.islower() and _c < 128 else 1 if _ch.isupper() and _c < 128 else 2 if _ch.isdigit() and _c < 128 else 3 if _ch == " " else 4 if _c < 32 else 5 if _ch in ".,;:'\"()-?" else 6 if _c < 128 else 7
    _CLASS[_k, _c] = 1
_MARKS = [ord(x) for x in "!#$%&*@/_"]
_FIXED = 8 + len(_MARKS)
FEATURES = _FIXED + 14


def statistics(text: bytes | None) -> np.ndarray:
    """Statistics of one text; all zero where there is none."""
    x = np.zeros(FEATURES)
    if not text:
        return x
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    x[:8] = _CLASS @ counts / n
    x[8:_FIXED] = counts[_MARKS] / n
    words, lines = text.split(), text.split(b"\n")
    k = len(words)
    sizes = np.fromiter(map(len, words), np.int64, k)
    same = sum(map(bytes.__eq__, words[1:], words)) if k > 1 else 0
    step = sum(map(bytes.__eq__, words[2:], words)) if k > 2 else 0
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    x[_FIXED:] = [
        np.log1p(n),
        np.log1p(k),
        sizes.mean() if k else 0,
        sizes.std() if k else 0,
        sizes.max() if k else 0,
        len(set(words)) / k if k else 0,
        len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 1,
        same / k if k else 0,
        step / k if k else 0,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        lengths.mean(),
        lengths.max() / n,
        len(zlib.compress(text, 1)) / n,
    ]
    return x


@dataclass
class Trees:
    """Complete trees of one depth: feature and limit of each inner node, value of each leaf."""

    depth: int
    base: float
    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, trees = np.full(len(x), self.base), np.arange(len(self.leaf))
        if len(trees) and len(x):
            at = np.zeros((len(x), len(trees)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
            total = total + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for the log loss; each split is the best over histograms of gradients."""
    none = np.empty((0, 2**depth - 1), np.int64)
    p = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < p < 1:
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Trees(depth, float(np.log(p / (1 - p))), none, none.astype(float), np.empty((0, 2**depth)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(p / (1 - p)))
    raw, feats, limits, leaves = np.full(n, base), [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        feature, limit = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = node - first
            best = np.full(width, 1e-9)
            cells = width * bins
            for j in range(f):
                key = slot * bins + binned[:, j]
                sums = [np.bincount(key, weights=w, minlength=cells).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(n))]
                gl, hl, cl = (s[:, :-1] for s in sums)
                gt, ht, ct = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(cl < least) | (ct - cl < least)] = 0
                gain[:, len(edges[j]) :] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                for s in np.flatnonzero(value > best):
                    best[s], feature[first + s], limit[first + s] = value[s], j, edges[j][top[s]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > limit[node])
        slot = node - (2**depth - 1)
        value = rate * np.bincount(slot, g, 2**depth) / (np.bincount(slot, h, 2**depth) + l2)
        raw += value[slot]
        feats.append(feature), limits.append(limit), leaves.append(value)
    return Trees(depth, base, np.array(feats), np.array(limits), np.array(leaves))


def held_out(id_col) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 20_000, **options) -> Trees:
    """Trees fitted on at most ``max_labels`` labelled rows outside the hold-out, in hash order of the id.

    An id with several labels takes the majority (ties: 1); null labels and ids are left out. Without
    labels, or with one class only, the model is a constant.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y")).dropna().where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("double").alias("_y"))
    some = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text")).join(F.broadcast(some), "_id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t).tolist() for t in bin_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.select("_y", "_text").mapInArrow(describe, "y double, x array<double>").collect()
    got.sort(key=lambda r: (r[1], r[0]))
    return grow(np.array([r[1] for r in got]).reshape(-1, FEATURES), np.array([r[0] for r in got], float), **options)


def scored(docs: DataFrame, model: Trees, text_col: str = "text", out: str = "score", least: float | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``out``; with ``least``, only rows that reach it, without the column.

    Null and empty texts are scored as texts whose statistics are all zero. All other columns pass
    through; an existing column named ``out`` is an error.
    """
    if least is None and out in docs.columns:
        raise ValueError(f"column {out} exists already")
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in bin_texts(batch.column(at))]).reshape(-1, FEATURES)
            s = model.score(x)
            if least is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, out])
            else:
                yield batch.filter(pa.array(s >= least))

    schema = docs.schema if least is not None else T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(apply, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
