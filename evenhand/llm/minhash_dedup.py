"""Near-duplicate documents: many universal hash minima, banding, verification, components.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A document's set holds
its distinct ``width``-word shingles; a text of fewer words is one shingle, and a text without words
(or null) has an empty set, which links with nothing. Sets are held as 64-bit hashes.

1. One pass over the texts makes, for each document, the digest of its set, ``bands * rows`` minima
   of multiply-add permutations and the hash of each band.
2. Documents with equal sets collapse to the least id (pre-aggregated, so thousands of copies cost
   one row a task). Only these representatives go on.
3. Each bucket of a band links its members to its least id: a star, never all pairs. Stars whose
   signatures can't reach the threshold go; the others are confirmed on full sets.
4. Buckets of three or more that still hold two components go on in blocks of bounded size. First each
   member meets its nearest and the block's most central member, which joins what a star around the
   least id missed with a number of pairs linear in the bucket. What is still apart but near by
   signature forms families; in these all pairs of different components are compared on full sets
   inside their unit, which returns a spanning forest, so no link between different texts is lost.
5. Components by alternating large-star and small-star.

At similarity s the chance that a pair shares no band is (1 - s**rows)**bands: 5e-8 at 0.8 and 6e-11
at 0.85 with the default 32 bands of 4.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.llm.common import bin_texts, binary_rows, free_name, min_labels, mix64, run_starts, runs, ship, slim, table, written
from evenhand.llm.components import components

BLOCK = 1024
#: Ids that may be broadcast (8 bytes each) to pick the texts to compare; beyond, the texts are shuffled.
FEW_IDS = 500_000


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    h = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        h += w[i : n - k + 1 + i] * odd[i]
    return np.unique(mix64(h))


def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, count, dtype=np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each permutation over the set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512, None] * a + b).min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, n, digest, sig, bands) of every row; digest, sig and bands are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(bands * rows, seed)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(seed))
        odd = mix64(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            ns, digests, sigs, keys = [], [], [], []
            for text in bin_texts(batch.column(1)):
                h = shingle_set(text, width)
                ns.append(len(h))
                if not len(h):
                    digests.append(None), sigs.append(None), keys.append(None)
                    continue
                low = minima(h, a, b)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                band = (low.reshape(bands, rows).astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
                keys.append(mix64(band ^ salt).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "digest", "sig", "bands"],
            )

    rows_in = slim(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows_in.mapInArrow(sign, "id long, n long, digest binary, sig binary, bands array<long>")


def _similar_signatures(pairs: DataFrame, reps: DataFrame, threshold: int, hashes: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose signatures agree to within five deviations of it."""
    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    least = _least_agreement(threshold, hashes)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (binary_rows(batch.column(2), hashes) == binary_rows(batch.column(3), hashes)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(same >= least))

    joined = pairs.join(left, "a").join(right, "b")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold
    return joined.where(fits).select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _least_agreement(threshold: int, hashes: int) -> int:
    t = threshold / 100
    return math.floor(hashes * (t - 5 * math.sqrt(t * (1 - t) / hashes)))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= threshold * union. texts: (id, text as binary)."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    few = wanted.limit(FEW_IDS + 1).count() <= FEW_IDS
    found = texts.join(F.broadcast(wanted) if few else wanted, "id")
    joined = (
        pairs.join(found.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(found.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(text: bytes) -> np.ndarray:
            key = xxhash.xxh3_128_digest(text)
            if key not in known:
                known[key] = shingle_set(text, width)
                if len(known) > 128:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            keep = []
            for x, y in zip(bin_texts(batch.column(2)), bin_texts(batch.column(3)), strict=True):
                p, q = of(x), of(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(confirm, "a long, b long").distinct()


def _blocks(members: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """Units (group, p, q) of pairs of blocks of about BLOCK members, so memory is bounded whatever the group's size.

    members has group, cnt (its size) and id; each goes to all units of its block ``i``.
    """
    k = F.ceil(F.col("cnt") / BLOCK).cast("int")
    units = members.withColumn("k", k).withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
    units = units.select(group, F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "comp", "sig", *carried)
    return units.repartition(group, "p", "q").sortWithinPartitions(group, "p", "q")


def _sides(batches: Iterator[pa.RecordBatch], group: str, least: int, hashes: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(table, rows x, rows y, agreement) of each unit; agreement is 0 where too low or the component is the same."""
    for tab in runs(batches, [group, "p", "q"]):
        starts = [*run_starts(tab, [group, "p", "q"]), tab.num_rows]
        sig, side = binary_rows(tab.column("sig"), hashes), tab.column("i").to_numpy()
        comp, p, q = (tab.column(c).to_numpy() for c in ("comp", "p", "q"))
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            x = np.arange(s, e) if p[s] == q[s] else s + np.flatnonzero(side[s:e] == p[s])
            y = x if p[s] == q[s] else s + np.flatnonzero(side[s:e] == q[s])
            if len(x) and len(y):
                same = np.stack([(sig[y] == sig[r]).sum(axis=1) for r in x])
                same[(same < least) | (comp[x][:, None] == comp[y])] = 0
                yield tab, x, y, same


def _pair_batch(found: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        a, b = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _nearest(members: DataFrame, least: int, hashes: int) -> DataFrame:
    """For each member of a bucket its pair with the nearest member of another component and with the most central one."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for tab, x, y, same in _sides(batches, "key", least, hashes):
            ids = tab.column("id").to_numpy()
            hub = np.full(len(x), same.sum(axis=0).argmax())
            r = np.concatenate([np.arange(len(x)), same.argmax(axis=0), np.arange(len(x))])
            c = np.concatenate([same.argmax(axis=1), np.arange(len(y)), hub])
            r, c = r[same[r, c] > 0], c[same[r, c] > 0]
            a, b = ids[x[r]], ids[y[c]]
            found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            if len(found) > 50_000:
                yield from _pair_batch(found)
                found = set()
        yield from _pair_batch(found)

    return _blocks(members, "key", []).mapInArrow(near, "a long, b long").distinct()


def _families(members: DataFrame, least: int, hashes: int) -> DataFrame:
    """(id, family) of members whose signatures connect them to another component; from spanning forests of units."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, x, y, same in _sides(batches, "key", least, hashes):
            r, c = np.nonzero(same)
            low = np.unique(np.concatenate([x, y]))
            label = min_labels(len(low), np.searchsorted(low, x[r]), np.searchsorted(low, y[c]))
            ids = tab.column("id").to_numpy()[low]
            own = np.flatnonzero(label != np.arange(len(low)))
            yield from _pair_batch(set(zip(ids[own].tolist(), ids[label[own]].tolist(), strict=True)))

    edges = _blocks(members, "key", []).mapInArrow(forest, "a long, b long").distinct()
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("family"))


def _family_links(members: DataFrame, width: int, threshold: int, least: int, hashes: int) -> DataFrame:
    """Links that join components inside families, from full sets: all pairs are compared in their unit, a forest goes out.

    members: (family, cnt, id, comp, sig, text).
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab, x, y, same in _sides(batches, "family", least, hashes):
            ids, comp = tab.column("id").to_numpy(), tab.column("comp").to_numpy()
            text = tab.column("text")
            sets = {r: shingle_set(text[r].as_py(), width) for r in np.unique(np.concatenate([x, y])).tolist()}
            root = {c: c for c in np.unique(np.concatenate([comp[x], comp[y]])).tolist()}

            def find(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            links = set()
            for r, c in zip(*(z.tolist() for z in np.nonzero(same)), strict=True):
                u, v = find(int(comp[x[r]])), find(int(comp[y[c]]))
                if u == v:
                    continue
                p, q = sets[int(x[r])], sets[int(y[c])]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= threshold * (len(p) + len(q) - both):
                    root[max(u, v)] = min(u, v)
                    links.add((int(ids[x[r]]), int(ids[y[c]])))
            yield from _pair_batch(links)

    return _blocks(members, "family", ["text"]).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = 80,
    width: int = 5,
    bands: int = 32,
    rows: int = 4,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. ``threshold`` is in per cent.

    component_id is the least id reachable by links (itself included); kept is doc_id = component_id.
    Null or empty texts have n_shingles 0 and link with nothing. A null id has a null component_id and
    is kept. Rows that share an id count as one document: all get the least component of any of them,
    and copies of the row are all returned. Other columns are ignored; an empty table gives none.
    """
    ship(docs.sparkSession)
    hashes = bands * rows
    signed = written(signatures(docs, id_col, text_col, width, bands, rows, seed), "signatures")
    some = signed.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min("id").alias("rep"))
    # one row a class: the row of its least id carries the signature
    reps = written(
        some.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "reps",
    )
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).where("id IS NOT NULL")

    spread = reps.select("id", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"), F.count("*").alias("cnt")).where("last > leader")
    buckets = written(buckets.select("key", "leader", "cnt"), "buckets")
    members = written(spread.join(buckets, "key"), "members")
    stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    tested = written(_similar_signatures(stars, reps, threshold, hashes), "tested")
    links = written(_confirmed(tested, texts, width, threshold), "links")
    found = components(links)

    several, least = members.where("cnt > 2"), _least_agreement(threshold, hashes)

    def unsettled() -> DataFrame:
        placed = several.join(found, F.col("id") == F.col("node"), "left").select("key", "cnt", "id", F.coalesce("component", "id").alias("comp"))
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return placed.join(mixed, "key").join(reps.select("id", "sig"), "id")

    near = written(_nearest(unsettled(), least, hashes).join(tested, ["a", "b"], "left_anti"), "near")
    if not near.isEmpty():
        links = links.union(written(_confirmed(near, texts, width, threshold), "links"))
        found = components(links)
    # also where nothing new is near: a nearest line that was tested may hide a pair that wasn't
    rest = written(unsettled(), "rest")
    if not rest.isEmpty():
        families = _families(rest, least, hashes)
        sizes = families.groupBy("family").agg(F.count("*").alias("cnt"))
        comps = rest.groupBy("id").agg(F.min("comp").alias("comp"))
        wanted = written(families.join(sizes, "family").join(comps, "id").join(reps.select("id", "sig"), "id"), "families")
        if not wanted.isEmpty():
            few = wanted.limit(FEW_IDS + 1).count() <= FEW_IDS
            ids = wanted.select(F.col("id").alias("wanted"))
            some = texts.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("wanted"), "left_semi")
            last = written(_family_links(wanted.join(some, "id"), width, threshold, least, hashes), "links")
            if not last.isEmpty():
                links = links.union(last)
                found = components(links)

    # rows that share an id are one document: link the classes their texts fall in
    by_row = signed.select("id", "n", "digest").join(classes, "digest", "left").join(found, F.col("rep") == F.col("node"), "left")
    by_row = by_row.select("id", "n", F.coalesce("component", "rep", "id").alias("component_id"))
    twice = signed.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("c > 1 AND d0 <> d1")
    if not twice.isEmpty():
        joined = by_row.join(twice.select("id"), "id", "left_semi")
        same = components(joined.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(joined.select(F.col("component_id").alias("a"), F.col("component_id").alias("b"))))
        by_row = by_row.join(same, F.col("component_id") == F.col("node"), "left").select("id", "n", F.coalesce("component", "component_id").alias("component_id"))
    return by_row.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that with the least id; the columns of ``docs``, whatever their names.

    Rows that repeat an id stay once. Rows with a null id, and rows with a null or empty text, which link
    with nothing, all stay. An empty table gives an empty one.
    """
    name = free_name(docs, base="kept_id")
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    key = F.col(f"`{id_col}`")
    one = docs.join(kept, key.cast("long") == F.col(name), "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.where(key.isNull()))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents at 0.85. Null or empty texts link with nothing; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85)
