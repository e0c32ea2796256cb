"""Embeddings, pages, mixing, shards and the pipeline."""

import hashlib
import io
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import decontam, extendible_shards, line_dedup, metric_join, minhash_dedup, mixing, quality, warc
from evenhand.llm.common import scratch_path
from tests.llm.test_documents import SCHEMA, find, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_links_meet_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(160):
        v = centres[i % 6] + rng.normal(size=8) * [0.05, 0.4][i % 2]
        rows.append((i, v.astype(np.float32).tolist(), i % 3 if i % 11 else None))
    bad = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0]]
    rows += [(200 + i, v, 1) for i, v in enumerate(bad)]
    rows += [rows[4], (300, rows[4][1], rows[4][2]), (301, [1.0, 2.0], 1), (None, rows[5][1], rows[5][2])]
    t = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")

    def good(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = [0] * len(rows)
    parent = {r[0]: r[0] for r in rows}
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            (i, x, p), (j, y, q) = rows[a], rows[b]
            if good(x, p) and good(y, q) and p == q and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    pairs.append((i, j))
    for i, j in pairs:
        if i is not None and j is not None:
            p, q = find(parent, i), find(parent, j)
            parent[max(p, q)] = min(p, q)
    want = Counter((r[0], n[k], None if r[0] is None else find(parent, r[0])) for k, r in enumerate(rows))
    for cell, block in ((4000, 1024), (10, 7)):
        out = metric_join.vector_links(t, cell=cell, block=block).collect()
        assert Counter((r[0], r[1], r[2]) for r in out) == want, (cell, block)
        assert all(r["kept"] == (r[0] is None or r[0] == r[2]) for r in out)
    assert metric_join.vector_links(t.limit(0)).count() == 0


def pages():
    r = random.Random(2)
    big = "<html>é" + "x" * 1200
    rows = [(i, f"http://h/{i}", r.choice([big, big + "1", "small", "", None, f"<p>{i}" * 400])) for i in range(30)]
    return [*rows, rows[3], (None, None, big), (99, "http://x y/\n", "a\r\n\r\nb" * 300)]


def test_archives_round_trip(spark):
    rows = pages()
    t = spark.createDataFrame([(*x, "d", 1) for x in rows], "page_id long, url string, html string, digest string, payload int")
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, -1), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        ref = top.get(b) if len(b) >= 1000 and top.get(b) != i else None
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    for small in (100_000, 0):
        folder = scratch_path(spark, "t")
        warc._mkdir(spark, folder)
        mono = warc.write_monolithic(warc.revisits(t, small=small), folder)
        got = warc.read_archives(warc.normalise(mono, folder))
        assert Counter(tuple(r) for r in got.collect()) == want
    assert warc.read_archives(warc.normalise(warc.write_monolithic(warc.revisits(t.limit(0)), folder), folder)).count() == 0


def test_inflate_takes_members_and_breaks_off_loudly():
    import io

    a = warc.record(1, "u", b"x" * 50_000, "d", None)
    data = zlib.compress(a, wbits=31) + zlib.compress(a + a, wbits=31)
    assert [len(w) for _, w in warc.records(warc.inflate(io.BytesIO(data)))] == [len(a)] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(iter([a[:-20]])))


def test_shards_fit_and_meet_sql(spark, docs, none, tmp_path):
    rows = [(i, "é" * (i * 7 % 90)) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    for limit in (10**9, 5000, 300, 100):
        got = extendible_shards.sharded(d, limit).drop("bits").collect()
        want = c.execute(extendible_shards.shards_sql(limit)).fetchall()
        assert Counter(tuple(r) for r in got) == Counter(want), limit
    out = extendible_shards.sharded(docs, 200).collect()
    assert len(out) == docs.count()
    size = Counter()
    for r in out:
        assert r["bits"].startswith(r["shard"]) and (r["fits"] or r["shard_bytes"] > 200)
        size[r["shard"]] += 1
    assert all(size[r["shard"]] == r["shard_rows"] for r in out)
    shards = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    kept = extendible_shards.with_shards(docs.withColumn("shard", docs["key"]), 200)
    assert kept.count() == docs.count() and "shard_depth" in kept.columns
    assert extendible_shards.sharded(none).count() == 0 and extendible_shards.with_shards(none).count() == 0


def test_copies_share_a_shard_that_cannot_split(spark):
    t = spark.createDataFrame([(1, "abcd" * 50)] * 6 + [(2, "x")], "doc_id long, text string")
    out = extendible_shards.sharded(t, 100).collect()
    assert {(r["id"], r["shard_rows"], r["fits"]) for r in out} == {(1, 6, False), (2, 1, True)}


def fill(caps, weights, budget):
    """Water-filling by repeated passes."""
    got, open_ = dict.fromkeys(caps, 0), {k for k in caps if weights[k] > 0}
    while open_:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] * w <= weights[k] * budget}
        if not full:
            got |= {k: weights[k] * budget // w for k in open_}
            break
        for k in full:
            got[k] = caps[k]
            budget -= caps[k]
        open_ -= full
    return got


def test_budgets_follow_the_tree(spark):
    leaves = [("crawl", "en", "src0", 100), ("crawl", "en", "src1", 5), ("crawl", "de", "src0", 7), ("curated", "en", "src9", 40), ("curated", "fr", "src8", 11), ("curated", "fr", "zero", 50)]
    weights = {"domain": {"crawl": 60, "curated": 40}, "lang": {"en": 50, "de": 20, "fr": 15}, "source": {"src0": 3, "zero": 0}}
    t = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    w = lambda level, k: weights[level].get(k, 1)
    for total in (20, 90, 150, 10_000):
        cap = {x[:3]: 2 * x[3] * (x[2] != "zero") for x in leaves}
        dom = {d: sum(c for k, c in cap.items() if k[0] == d) for d in ("crawl", "curated")}
        got = fill(dom, {d: w("domain", d) for d in dom}, min(total, sum(dom.values())))
        want = {}
        for d, b in got.items():
            langs = {k[1]: sum(c for z, c in cap.items() if z[:2] == k[:2]) for k in cap if k[0] == d}
            for lang, g in fill(langs, {x: w("lang", x) for x in langs}, b).items():
                src = {k[2]: c for k, c in cap.items() if k[:2] == (d, lang)}
                want |= {(d, lang, s): v for s, v in fill(src, {s: w("source", s) for s in src}, g).items()}
        out = {(r[0], r[1], r[2]): r["budget"] for r in mixing.budgets(t, total, 2, weights).collect()}
        assert out == want, total


def test_mix_takes_prefixes_of_epochs(spark, docs, none):
    out = mixing.mixed(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    for leaf in by.values():
        rest = {r["epochs"] for r in leaf}
        assert max(rest) - min(rest) <= 1 and max(rest) <= mixing.EPOCHS
        full = min(rest)
        key = lambda r: hashlib.md5(f"{mixing.SEED}|{full}|{'~' if r['id'] is None else r['id']}".encode()).hexdigest()
        order = [r["epochs"] - full for r in sorted(leaf, key=key) if r["tokens"]]
        assert order == sorted(order, reverse=True)
    total = sum(r["tokens"] for r in out)
    assert sum(r["tokens"] * r["epochs"] for r in out) <= total * mixing.SHARE // 100
    once = mixing.mix(docs, max_epochs=1)
    assert once.columns == docs.columns and once.count() <= docs.count()
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == Counter({k: n for k, n in _times(out).items() if n})
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0


def _times(out):
    n = Counter()
    for r in out:
        n[r["id"]] += r["epochs"]
    return n


def test_pipeline_stages(spark, docs, none, tmp_path):
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    bench = [r["text"] for r in d.collect() if r["text"] and len(r["text"]) > 300][-1]
    folder = str(tmp_path)
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, folder)
        assert stage(spark, none.select(*d.columns), folder).count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns, name
            out.write.parquet(f"{folder}/{name}")
            at = spark.read.parquet(f"{folder}/{name}")
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in out.collect())
    assert got and all(bench not in (r["text"] or "") for r in got)


def test_temporary_names_do_not_clash(spark):
    """A table that has every name an operator may choose for itself keeps its columns and values."""
    names = ["kept_id", "kept_id_", "took_id", "took_domain", "took_lang", "took_source", "took_epochs", "took_copy", "own_bits", "found_bits", "bits", "id", "shard_", "hit_t1", "hit_t2", "t1", "removed", "removed_id", "removed_th", "_kept", "_id", "_copy", "_bits", "_own_bits", "rep", "node", "component", "epochs", "tokens", "domain_"]
    rows = [(i, f"text {i} of some words that differ {i * 7}", "en", "src1", *range(100 * i, 100 * i + len(names))) for i in range(6)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    bench = spark.createDataFrame([(1, "no such passage in any text here at all i am sure of it")], "item_id long, text string")
    for out in (
        minhash_dedup.deduplicated(t),
        mixing.mix(t, share=100, max_epochs=1),
        decontam.decontaminated(t, bench),
        decontam.decontaminated(t, bench.union(bench), part_bytes=60),
        line_dedup.deduplicated_lines(t),
        extendible_shards.with_shards(t).drop("shard", "shard_depth", "shard_bytes"),
    ):
        assert out.columns == t.columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(rows)


def test_archive_that_breaks_off_between_records_raises():
    whole = b"".join(warc.record(i, "http://a.b/", b"x" * 50, "d", None) for i in range(2))
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    first = warc.record(0, "http://a.b/", b"x" * 50, "d", None)
    cut = z.compress(first) + z.flush(zlib.Z_FULL_FLUSH)
    with pytest.raises(ValueError, match="gzip member"):
        list(warc.records(warc.inflate(io.BytesIO(cut))))
    one = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert len(list(warc.records(warc.inflate(io.BytesIO(one.compress(whole) + one.flush()))))) == 2
    assert warc.parse_header(b"WARC/1.0\r\nContent-Length:12\r\nWARC-Type:  response")["content-length"] == "12"


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors whose cosine is below the limit as doubles and reaches it as floats."""
    rng, limit = np.random.default_rng(8), 0.93

    def cosine(x, y):
        return x @ y / np.sqrt((x @ x) * (y @ y))

    for _ in range(200_000):
        x, y = rng.normal(size=3), rng.normal(size=3)
        y = y - x * (x @ y) / (x @ x)
        y = x / np.sqrt(x @ x) * limit + y / np.sqrt(y @ y) * (np.sqrt(1 - limit**2) + 1e-9)
        u, v = (z.astype(np.float32).astype(float) for z in (x, y))
        if cosine(x, y) < limit - 1e-12 <= cosine(u, v) and cosine(u, v) > limit + 1e-12:
            break
    else:
        raise AssertionError("no such vectors")
    rows = [(1, x.tolist(), 0), (2, y.tolist(), 0)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [r["n_links"] for r in metric_join.vector_links(t, cosine=limit).collect()] == [0, 0]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r["n_links"] for r in metric_join.vector_links(f, cosine=limit).collect()] == [1, 1]


def test_shards_are_written_and_read_back(spark, docs, tmp_path):
    extendible_shards.write_shards(docs, str(tmp_path / "s"), 200)
    back = spark.read.option("recursiveFileLookup", "false").parquet(str(tmp_path / "s"))
    want = extendible_shards.with_shards(docs, 200)
    assert back.count() == docs.count()
    assert len(list((tmp_path / "s").glob("shard=*"))) == want.select("shard").distinct().count() > 3


def test_first_split_is_the_best_by_brute_force():
    """One tree of depth one: the split with the largest gain over all features and limits."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, (200, 5)).astype(float)
    y = ((x[:, 3] > 6) ^ (rng.random(200) < 0.1)).astype(float)
    tree = quality.grow(x, y, trees=1, depth=1, least=10)
    g = y - y.mean()
    h = np.full(len(y), y.mean() * (1 - y.mean()))

    def gain(j, limit):
        left = x[:, j] <= limit
        if min(left.sum(), (~left).sum()) < 10:
            return 0
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left))

    best = max((gain(j, limit), j, limit) for j in range(5) for limit in np.unique(x[:, j])[:-1])
    left = x[:, best[1]] <= best[2]
    assert tree.feature[0, 0] == best[1]
    assert ((x[:, tree.feature[0, 0]] <= tree.limit[0, 0]) == left).all()
    assert np.allclose(tree.leaf[0], [0.15 * g[s].sum() / (h[s].sum() + 1.0) for s in (left, ~left)])


def test_held_out_quality_on_the_given_labels(spark):
    """Accuracy and rank order on the rows that the fit never sees."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = quality.scored(docs.select("doc_id", "text"), quality.fit(docs, labels)).join(labels, "doc_id")
    held = [(r["score"], r["quality"]) for r in out.where(quality.held_out(F.col("doc_id"))).collect()]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert len(held) > 50 and good and bad
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.95
    assert np.mean([g > b for g in good for b in bad]) > 0.97
