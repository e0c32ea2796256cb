"""Removal of repeated byte strings by sparse, distributed prefix doubling.

Every byte covered by a string of ``length`` bytes that also starts anywhere else (same text included)
goes. Ranking every position of the corpus at each offset would move many times the input, so ranks are
kept only for positions that the text itself chooses: of the prefixes of ``length // 4`` bytes inside a
string, the one with the least hash (leftmost on ties). Equal strings choose equal relative positions,
so nothing is lost.

1. First offset, ``length // 4``: Spark groups the chosen positions by the hash of their prefix; a
   position whose prefix is unique in the corpus is done.
2. Last offset, ``length``: the others are sorted by that rank, and all strings around them, split by
   their distance from the chosen position, are ranked again inside each group; those that are still
   not unique are past the threshold, hence repeated.
3. The spans found are joined to the texts.

Groups with more than ``hot`` members aren't gathered: their equal surroundings collapse first, then
single strings are counted with a map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import bin_texts, mix64, run_starts, runs, ship, table, written

BUFFER = 1 << 19
#: Bits that hold any place in a buffer of less than 2 * BUFFER + length bytes.
PLACE_BITS = 22
HOT_BLOCK = 2000
_ODD = 0x9E3779B97F4A7C15 | 1
_INV = pow(_ODD, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POW:
        with np.errstate(over="ignore"):
            p, q = np.full(size, np.uint64(_ODD)), np.full(size, np.uint64(_INV))
            p[0] = q[0] = 1
            _POW[size] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POW[size]


class Rolling:
    """Hashes of all strings of a length inside one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, k: int) -> np.ndarray:
        return mix64((self.sums[start + k] - self.sums[start]) * self.down[start])


def _pieces(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) of about BUFFER bytes; long texts overlap by length - 1 bytes."""
    held, size = [], 0
    for d, text in enumerate(texts):
        for s in range(0, max(0, len(text or b"") - length + 1), BUFFER):
            part = text[s : s + BUFFER + length - 1]
            held.append((d, s, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


class Chosen:
    """Chosen positions of one buffer: ``pos`` with the first and last string start that chooses each."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], length: int, k: int):
        self.pieces = pieces
        data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        # as many bits in every buffer, so that equal strings decide ties alike wherever they are
        bits = np.uint64(PLACE_BITS)
        if len(data) >> PLACE_BITS:
            raise ValueError("a buffer holds too many bytes")
        low = (np.uint64(1) << bits) - np.uint64(1)
        self.rank = Rolling(data).all(k)
        m = (self.rank & ~low) | np.arange(len(self.rank), dtype=np.uint64)
        step, w = 1, length - k + 1
        while 2 * step <= w:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if w > step:
            m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
        choice = (m & low).astype(np.int64)
        valid = np.zeros(len(data) + 1, np.int32)
        np.add.at(valid, np.concatenate([[0], ends[:-1]]), 1)
        np.add.at(valid, ends - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(valid[: len(choice)]) > 0)
        choice = choice[starts]
        new = np.ones(len(choice), bool)
        new[1:] = choice[1:] != choice[:-1]
        first = np.flatnonzero(new)
        self.pos = choice[first]
        self.lo, self.hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        self.piece = np.searchsorted(ends, self.pos, "right")
        self.base = ends - [len(p[2]) for p in pieces]


def _scan(texts: list[bytes | None], length: int, k: int) -> Iterator[Chosen]:
    for pieces in _pieces(texts, length):
        yield Chosen(pieces, length, k)


def _ranked(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(id, th, rank, cnt): the distinct ranks of each text at the first offset."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in _scan(bin_texts(batch.column(2)), length, k):
                doc = np.array([p[0] for p in c.pieces])[c.piece]
                order = np.lexsort((c.rank[c.pos], doc))
                d, g = doc[order], c.rank[c.pos][order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
                at = np.flatnonzero(new)
                take = pa.array(d[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(g[at].view(np.int64)), pa.array(np.diff(np.append(at, len(d))).astype(np.int32))],
                    names=["id", "th", "rank", "cnt"],
                )

    return rows.mapInArrow(find, "id long, th long, rank long, cnt int")


def _surroundings(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(id, th, rank, back, ctx, hot, pos) of positions whose rank is in ``ranks``; equal ones of a text collapse.

    ctx has all strings that choose the position; it begins ``back`` bytes before it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bin_texts(batch.column(2))
            wanted = [np.sort(np.array(x, np.int64)) for x in batch.column(3).to_pylist()]
            hot = [set(x) for x in batch.column(4).to_pylist()]
            seen: dict[tuple, list[int]] = {}
            doc_done = -1
            for c in _scan(texts, length, k):
                ranks = c.rank[c.pos].view(np.int64)
                bounds = np.searchsorted(c.piece, np.arange(len(c.pieces) + 1))
                for p, (d, offset, part) in enumerate(c.pieces):
                    if d != doc_done and seen:
                        yield _context_batch(batch, doc_done, seen, hot)
                        seen = {}
                    doc_done = d
                    s, e = bounds[p], bounds[p + 1]
                    mine = wanted[d]
                    at = np.minimum(np.searchsorted(mine, ranks[s:e]), len(mine) - 1)
                    for i in (s + np.flatnonzero(mine[at] == ranks[s:e])).tolist():
                        lo, hi, pos = (int(x[i]) - int(c.base[p]) for x in (c.lo, c.hi, c.pos))
                        seen.setdefault((int(ranks[i]), pos - lo, part[lo : hi + length]), []).append(offset + lo)
            if seen:
                yield _context_batch(batch, doc_done, seen, hot)

    return rows.mapInArrow(find, "id long, th long, rank long, back int, ctx binary, hot boolean, pos array<int>")


def _context_batch(batch: pa.RecordBatch, d: int, seen: dict, hot: list[set]) -> pa.RecordBatch:
    n = len(seen)
    take = pa.array(np.full(n, d))
    rank, back, ctx = zip(*seen, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(take),
            batch.column(1).take(take),
            pa.array(rank, pa.int64()),
            pa.array(back, pa.int32()),
            pa.array(ctx, pa.binary()),
            pa.array([r in hot[d] for r in rank], pa.bool_()),
            pa.array(list(seen.values()), pa.list_(pa.int32())),
        ],
        names=["id", "th", "rank", "back", "ctx", "hot", "pos"],
    )


def _string_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place in it, hash) of each string of ``length`` bytes in the contexts."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(sizes) - sizes)[owner] + place
    return owner, place, Rolling(data).at(start, length)


def _stretches(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of runs of consecutive places; both inputs in order."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    return owner[at], place[at], place[np.append(at[1:], len(owner)) - 1]


def _repeated_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(id, th, spans) of repeated strings inside the groups of one rank; no group is hot. spans is start, end, start, ..."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for tab in runs(batches, ["rank"]):
            starts = [*run_starts(tab, ["rank"]).tolist(), tab.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                held.append(tab.slice(s, e - s))
                size += e - s
                if size >= 1000:
                    yield from spans(pa.concat_tables(held))
                    held, size = [], 0
        if held:
            yield from spans(pa.concat_tables(held))

    def spans(tab: pa.Table) -> Iterator[pa.RecordBatch]:
        where: dict[tuple, int] = {}
        ctx, back, pos = tab.column("ctx").to_pylist(), tab.column("back").to_pylist(), tab.column("pos").to_pylist()
        rank = tab.column("rank").to_pylist()
        which = np.array([where.setdefault(key, len(where)) for key in zip(rank, back, ctx, strict=True)])
        times = np.bincount(which, [len(p) for p in pos], len(where))
        owner, place, h = _string_hashes([key[2] for key in where], length)
        # a string's count: over all distinct surroundings that hold it, how often each occurs
        _, group = np.unique(h, return_inverse=True)
        repeated = np.bincount(group, times[owner])[group] >= 2
        o, first, last = _stretches(owner[repeated], place[repeated])
        begin, end = np.searchsorted(o, which), np.searchsorted(o, which, "right")
        rows, flat = np.flatnonzero(end > begin).tolist(), []
        for r in rows:
            ends = [(int(first[j]), int(last[j]) + length) for j in range(begin[r], end[r])]
            flat.append([p + x for p in pos[r] for se in ends for x in se])
        take = pa.array(rows, pa.int64())
        yield from pa.Table.from_arrays([tab.column("id").take(take), tab.column("th").take(take), pa.array(flat, pa.list_(pa.int32()))], names=["id", "th", "spans"]).to_batches()

    return contexts.repartition("rank").sortWithinPartitions("rank").mapInArrow(rerank, "id long, th long, spans array<int>")


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot groups.

    Equal surroundings collapse; the others of a group are dealt over blocks. A string that repeats inside
    its block is known there, and one row stands for it outside; all strings are then counted over blocks.
    """
    keyed = contexts.withColumn("key", F.md5(F.concat(F.encode(F.concat_ws("|", "rank", "back", F.lit("")), "utf-8"), F.col("ctx"))))
    distinct = written(keyed.groupBy("rank", "key", "ctx").agg(F.sum(F.size("pos")).alias("times")), "surroundings")
    sizes = distinct.groupBy("rank").agg(F.count("*").alias("n")).withColumnRenamed("rank", "r")
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / HOT_BLOCK)).cast("int")
    dealt = distinct.join(sizes, F.col("rank") == F.col("r")).select("rank", block.alias("block"), "key", "ctx", "times")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in runs(batches, ["rank", "block"]):
            starts = [*run_starts(tab, ["rank", "block"]).tolist(), tab.num_rows]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = tab.slice(s, e - s).combine_chunks()
                owner, place, h = _string_hashes(part.column("ctx").to_pylist(), length)
                every, first, group = np.unique(h, return_index=True, return_inverse=True)
                times = np.bincount(group, part.column("times").to_numpy()[owner]).astype(np.int64)
                again = times[group] >= 2
                where = np.split(place[again], np.cumsum(np.bincount(owner[again], minlength=e - s))[:-1])
                some = [i for i, x in enumerate(where) if len(x)]
                key = part.column("key").combine_chunks() if isinstance(part.column("key"), pa.ChunkedArray) else part.column("key")
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(some, pa.int64())), pa.array([where[i].tolist() for i in some], pa.list_(pa.int32())), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())],
                    names=["key", "places", "h", "times"],
                )
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(owner[first])), pa.array([[x] for x in place[first].tolist()], pa.list_(pa.int32())), pa.array(every.view(np.int64)), pa.array(times)],
                    names=["key", "places", "h", "times"],
                )

    dealt = dealt.repartition("rank", "block").sortWithinPartitions("rank", "block")
    single = written(dealt.mapInArrow(strings, "key string, places array<int>, h long, times long"), "strings")
    counted = single.where("h IS NOT NULL")
    repeated = counted.groupBy("h").agg(F.sum("times").alias("n"), F.max("times").alias("most")).where("n > 1 AND most < n").select(F.col("h").alias("same"))
    outside = counted.where("times = 1").join(repeated, F.col("h") == F.col("same")).select("key", "places")
    places = single.where("h IS NULL").select("key", "places").union(outside)
    places = places.groupBy("key").agg(F.array_distinct(F.sort_array(F.flatten(F.collect_list("places")))).alias("places"))
    hit = keyed.select("id", "th", "key", "pos").join(places, "key").select("id", "th", "pos", "places")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for pos, places_ in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = np.array(places_)
                _, first, last = _stretches(np.zeros(len(x), np.int64), x)
                flat.append([p + x for p in pos for f, t in zip(first.tolist(), last.tolist(), strict=True) for x in (f, t + length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int32()))], names=["id", "th", "spans"])

    return hit.mapInArrow(unfold, "id long, th long, spans array<int>")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the texts as (id, th, text) and, for each with repeated strings, its spans as start, end, start, ..."""
    if not 4 <= length <= 1 << 20:
        raise ValueError("length must be from 4 to 2**20")
    ship(docs.sparkSession)
    k = length // 4
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text")).select(
        "id", F.xxhash64("text").alias("th"), "text"
    )
    ranks = written(_ranked(rows, length, k), "ranks")
    shared = written(ranks.groupBy("rank").agg(F.sum("cnt").alias("n")).where("n > 1").select("rank", (F.col("n") > hot).alias("hot")), "shared")
    wanted = (
        ranks.select("id", "th", "rank")
        .join(shared, "rank")
        .groupBy("id", "th")
        .agg(F.collect_set("rank").alias("ranks"), F.collect_set(F.when(F.col("hot"), F.col("rank"))).alias("hot"))
        .withColumnsRenamed({"id": "wid", "th": "wth"})
    )
    both = rows.join(wanted, _same(F.col("id"), F.col("wid")) & (F.col("th") == F.col("wth")))
    contexts = _surroundings(both.select("id", "th", "text", "ranks", "hot"), length, k)
    if shared.where("hot").isEmpty():
        spans = _repeated_spans(contexts, length)
    else:
        contexts = written(contexts, "contexts")
        spans = _repeated_spans(contexts.where("NOT hot"), length).union(_hot_spans(contexts.where("hot"), length))
    return rows, spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    kept has the bytes that no repeated string covers, in order; n_spans counts maximal removed runs.
    Texts are judged as UTF-8 bytes, on the input; null is empty. Strings never cross texts. Rows that
    repeat (same id and text) are each other's copies and lose all bytes in strings of ``length``. Other
    columns are ignored; an empty table gives none.
    """
    rows, spans = repeated_spans(docs, id_col, text_col, length, hot)
    spans = spans.withColumnsRenamed({"id": "sid", "th": "sth"})
    joined = rows.join(spans, _same(F.col("id"), F.col("sid")) & (F.col("th") == F.col("sth")), "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, count, kept = [], [], [], []
            for text, found in zip(bin_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                found = found or []
                for x in sorted(zip(found[::2], found[1::2], strict=True)):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                edges = [0, *(x for m in merged for x in m), len(text)]
                sizes.append(len(text)), removed.append(sum(e - s for s, e in merged)), count.append(len(merged))
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings of 200 bytes. Null texts are empty; see without_repeats."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
