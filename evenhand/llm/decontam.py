"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of bytes other than ASCII non-letters and non-digits, with A-Z in lower case; bytes
above 0x7F belong to words. The strings searched for are the windows of ``window`` consecutive words of
the benchmark items; an item of fewer words, but not none, is one window.

The alphabet of the search is the benchmark's vocabulary. For all strings of one length m a shift
table over blocks of two words says how far the window's end may move: a block that no string holds
moves it by m - 1 words at once. Where the shift is 0, the bucket of the block that ends the window,
narrowed by the block that begins it, selects strings, and comparing all words confirms them. The
cursors of many stretches of text move together as numpy arrays.

Windows aren't stored: a string is a place in its item's words, so the tables take some 35 bytes a word
besides the vocabulary. The benchmark is read in parts of at most ``part_bytes`` of text. One part is
searched in a single pass; several are searched one after the other, so that only one part's tables are
held anywhere, and their hits meet by text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import bin_texts, free_name, mix64, ship, slices, slim, table, written

_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
LANE = 512
END = -2  # between texts
#: Bytes of text that are searched together.
SLICE = 4 << 20
#: Bytes of benchmark text whose tables are held at once.
PART = 8 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO).split() if text else []


class _Length:
    """Shift table and buckets of the strings of m words. words: of all items; item, start: of each string."""

    def __init__(self, words: np.ndarray, base: int, m: int, first: np.ndarray, sizes: np.ndarray, items: np.ndarray):
        self.m, self.base, self.words = m, np.int64(base), words
        self.block = block = min(2, m)
        # places of blocks, and how far into its item each is
        count = sizes - block + 1
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        code = self.codes(words, np.repeat(first, count) + inner)
        # windows begin at each word, so a block is m - block words from a window's begin, or nearer to its item's
        shift = np.maximum(m - block - inner, 0).astype(np.int32)
        order = np.argsort(code, kind="stable")
        self.keys, at = np.unique(code[order], return_index=True)
        self.shifts = np.minimum.reduceat(shift[order], at)
        del code, shift, order, inner
        count = sizes - m + 1
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = (np.repeat(first, count) + inner).astype(np.int32)
        both = self.both(words, start)
        order = np.argsort(both, kind="stable")
        self.bucket, self.start, self.item = both[order], start[order], np.repeat(items, count).astype(np.int32)[order]

    def codes(self, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        a = w[at].astype(np.int64)
        return a * self.base + w[at + 1] if self.block == 2 else a

    def both(self, w: np.ndarray, start: np.ndarray) -> np.ndarray:
        """One number of the blocks that end and begin a window; equal for equal windows."""
        last = self.codes(w, start + (self.m - self.block)).astype(np.uint64)
        return mix64(last * np.uint64(0x9E3779B97F4A7C15) + self.codes(w, start).astype(np.uint64))

    def shift(self, w: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far windows that end at ``end`` may move; 0: look closer."""
        first = end - self.block + 1
        known, code = (w[end] >= 0) & (w[first] >= 0), self.codes(w, first)
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        return np.where(known & (self.keys[at] == code), self.shifts[at], self.m - self.block + 1)

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first word) of each occurrence in the word ids w."""
        m = self.m
        lo = np.arange(m - 1, len(w), LANE)
        hi, pos, lookups = np.minimum(lo + LANE, len(w)), lo.copy(), []
        while len(pos):
            s = self.shift(w, pos)
            lookups.append(pos[s == 0])
            pos = pos + np.maximum(s, 1)
            live = pos < hi
            pos, hi = pos[live], hi[live]
        end = np.concatenate(lookups) if lookups else np.empty(0, np.int64)
        first = end - m + 1
        first = first[(w[first] >= 0) & (w[first + self.block - 1] >= 0)]
        both = self.both(w, first)
        a, b = np.searchsorted(self.bucket, both), np.searchsorted(self.bucket, both, "right")
        owner = np.repeat(np.arange(len(a)), b - a)
        string = np.arange(len(owner)) - np.repeat(np.cumsum(b - a) - b, b - a)
        first = first[owner]
        for j in range(m):  # few are left after the first words
            same = w[first + j] == self.words[self.start[string] + j]
            first, string = first[same], string[same]
        return self.item[string], first


class Patterns:
    """All windows of some benchmark items, ready for search."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        each = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in words_of(text)], np.int32) for _, text in items]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        words = np.concatenate(each) if each else np.empty(0, np.int32)
        first, m = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
        self.lengths = []
        for k in np.unique(m[m > 0]).tolist():
            mine = np.flatnonzero(m == k)
            self.lengths.append(_Length(words, len(self.vocabulary), k, first[mine], sizes[mine], mine))

    def search(self, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words of a string, items, first words) of the occurrences of the strings of each length."""
        for tables in self.lengths:
            yield tables.m, *tables.search(w)


def _parts(benchmark: DataFrame, item_col: str, text_col: str, part_bytes: int) -> tuple[DataFrame, int]:
    bench = slim(benchmark, item_col, text_col).select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bench, max(1, math.ceil(size / part_bytes))


def _patterns(bench: DataFrame, part: int, parts: int, window: int):
    mine = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
    return bench.sparkSession.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in mine.collect()], window))


def _numbered(texts: list[bytes | None], known: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all texts with END after each, where each text begins)."""
    get, ids, counts = known.vocabulary.get, [], [0]
    for text in texts:
        words = words_of(text)
        counts.append(len(words) + 1)
        ids.extend(map(get, words, [-1] * len(words)))
        ids.append(END)
    return np.array(ids, np.int32), np.cumsum(counts)


def _look(texts: list[bytes | None], known: Patterns) -> tuple[list[int], list[list[list[int]]], list[list[str]]]:
    """(words, merged spans, sorted items) of each text."""
    flat, starts = _numbered(texts, known)
    spans: list[list[list[int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for m, item, at in known.search(flat):
        doc = np.searchsorted(starts, at, "right") - 1
        for d, i, p in zip(doc.tolist(), item.tolist(), (at - starts[doc]).tolist(), strict=True):
            spans[d].append([p, m])
            if known.names[i] is not None:
                items[d].add(known.names[i])
    return (np.diff(starts) - 1).tolist(), [_merged(s) for s in spans], [sorted(x) for x in items]


def _keys(text: str) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(29)).alias("t2")]


_FOUND = "n_words long, spans array<array<int>>, items array<string>"


def _pass(patterns, keep: list[int], only_hit: bool):
    """Rows (columns ``keep`` of the input, then _FOUND) of a table whose first column is the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = patterns.value
        for batch in batches:
            for i, j in slices(batch.column(0), SLICE):
                part = batch.slice(i, j - i)
                n, spans, items = _look(bin_texts(part.column(0)), known)
                out = pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                    names=[*(part.schema.names[k] for k in keep), "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_())) if only_hit else out

    return find


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    part_bytes: int = PART,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted distinct item ids as strings), spans.

    spans holds [first word, words] of the merged hit stretches. A null or empty text has no words. A
    benchmark item without words is never found; one with a null id hits words but isn't listed. Items or
    documents that repeat, or share an id, are treated row by row. Without benchmark rows nothing is hit;
    an empty ``docs`` gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    bench, parts = _parts(benchmark, item_col, item_text_col, part_bytes)
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"), F.col(f"`{id_col}`").cast("string").alias("id"))
    if parts == 1:
        out = rows.mapInArrow(_pass(_patterns(bench, 0, 1, window), [1], False), f"id string, {_FOUND}")
    else:
        rows = rows.select("text", "id", *_keys("text"))
        hits = _each_part(rows.select("text", "t1", "t2"), bench, parts, window)
        # copies of a text have the same hits: one row of each part stays
        hits = hits.groupBy("t1", "t2", "part").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
        hits = hits.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        none = _patterns(bench.limit(0), 0, 1, window)
        counted = rows.mapInArrow(_pass(none, [1, 2, 3], False), f"id string, t1 long, t2 long, {_FOUND}").select("id", "t1", "t2", "n_words")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = pa.array([_merged(x or []) for x in b.column(2).to_pylist()], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans, b.column(3)], names=["id", "n_words", "spans", "items"])

        empty = F.array().cast("array<string>")
        joined = counted.join(hits, ["t1", "t2"], "left").select("id", "n_words", "spans", F.coalesce("items", empty).alias("items"))
        out = joined.mapInArrow(merge, f"id string, {_FOUND}")
    first = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1])
    return out.select(F.col("id").cast(kind).alias("doc_id"), "n_words", first.alias("n_hit"), "items", "spans")


def _each_part(rows: DataFrame, bench: DataFrame, parts: int, window: int) -> DataFrame:
    """(t1, t2, part, spans, items) of the hit rows; rows: (text, t1, t2). One part's tables are held at a time."""
    found: DataFrame | None = None
    for part in range(parts):
        patterns = _patterns(bench, part, parts, window)
        mine = rows.mapInArrow(_pass(patterns, [1, 2], True), f"t1 long, t2 long, {_FOUND}")
        mine = written(mine.select("t1", "t2", F.lit(part).alias("part"), "spans", "items"), "hits")
        patterns.destroy()
        found = mine if found is None else found.union(mine)
    return found


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, m in sorted(spans):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], s + m - out[-1][0])
        else:
            out.append([s, m])
    return out


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    part_bytes: int = PART,
) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs; clean rows stay with all columns, whatever their names.

    Null and empty texts hold no window and stay; rows that repeat go or stay together. Items: see
    ``benchmark_hits``. Without benchmark rows all stay; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    bench, parts = _parts(benchmark, item_col, item_text_col, part_bytes)
    if parts > 1:
        rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).select("text", *_keys("text"))
        hits = _each_part(rows, bench, parts, window)
        names = [free_name(docs, base=x) for x in ("hit_t1", "hit_t2")]
        hits = hits.select(F.col("t1").alias(names[0]), F.col("t2").alias(names[1])).distinct()
        text = F.col(f"`{text_col}`").cast("binary")
        return docs.join(hits, (F.xxhash64(text) == F.col(names[0])) & (F.xxhash64(text, F.lit(29)) == F.col(names[1])), "left_anti")
    at, patterns = docs.columns.index(text_col), _patterns(bench, 0, 1, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = patterns.value
        for batch in batches:
            column = batch.column(at)
            for i, j in slices(column, SLICE):
                flat, starts = _numbered(bin_texts(column.slice(i, j - i)), known)
                keep = np.ones(j - i, bool)
                for _, _, first in known.search(flat):
                    keep[np.searchsorted(starts, first, "right") - 1] = False
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op10_decontam(spark, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents. Null texts have no words; nulls, ties and repeats: see ``benchmark_hits``."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lens WHERE len(w) >= m)),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, m, s, item_id FROM dw JOIN iw USING (m, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
