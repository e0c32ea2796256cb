"""Document operators against brute force, on small tables with every odd row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import decontam, line_dedup, minhash_dedup, quality, suffix_dedup, token_store
from evenhand.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, label string"
LOWER = {c: c + 32 for c in range(65, 91)}


def odd_rows(seed=1, n=40):
    """Texts with nulls, blanks, copies, near copies, repeated rows and clashing extra columns."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delté", "eps", "zeta", "eta-9", "theta", "iota", "kappa"]
    base = [r.choice(words) + str(r.randint(0, 9)) for _ in range(60)]
    texts = [None, "", "   ", "one", "two words", "\n\nline\n"]
    for _ in range(n):
        k = r.random()
        if k < 0.4:
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(60)] = "new%d" % r.randint(0, 99)
            texts.append(" ".join(t))
        elif k < 0.6:
            texts.append(" ".join(base[:30]) + "\n" + " ".join(r.choice(words) for _ in range(20)))
        else:
            texts.append(" ".join(r.choice(words) for _ in range(r.randint(1, 40))))
    rows = [(i, t, ["en", None, "de"][i % 3], ["src0", "src9", None, ""][i % 4], 0, "x", 1, "y") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[0], (None, "null id text", "en", "src1", 0, "x", 1, "y")]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components_of_a_random_graph(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    parent = {i: i for e in edges for i in e if i is not None}
    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    linked = {i for a, b in edges if a is not None and b is not None and a != b for i in (a, b)}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(parent, i) for i in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash_meets_brute_force(docs, rows, none, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)  # several blocks a bucket
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            x, y = sets[a][0], sets[b][0]
            if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    want = sorted((i if i is not None else -1, len(shingles(t)), find(parent, i) if i is not None else -1, i is None or find(parent, i) == i) for i, t, *_ in rows)
    out = minhash_dedup.near_duplicates(docs, threshold=85).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in out) == want
    assert len({find(parent, i) for i in parent}) < len(parent) - 3
    kept = minhash_dedup.deduplicated(docs, threshold=85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i in parent if find(parent, i) == i)
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    t = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert {(r[0], r[2]) for r in minhash_dedup.near_duplicates(t).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_token_round_trip_and_random_access(spark, docs, rows, none, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = ["a  b   c", " lead", "trail ", "tab\t x", "nl\n  y\n\n z ", "  nb 　 x", "x\x1c y", "don't 'll 123 456!!??", "漢字 かな", "🙂 👍🏽", "ab" * 3000, "end \x02", " "]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").union(more)
    out = str(tmp_path / "t")
    monkeypatch.setattr(token_store, "SLICE", 500)
    token_store.write_tokens(all_, out, path, shard_ids=700)
    got = token_store.read_tokens(spark, out, with_ids=True).orderBy("start").collect()
    texts = [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(odd)]
    want = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in texts)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    shard = token_store.Shard(max(spark.read.parquet(out).collect(), key=lambda r: r["n_ids"]).asDict())
    ids, n = shard.all()
    assert shard.ids(3, len(ids) - 2).tolist() == ids[3:-2].tolist()
    assert shard.document(1).tolist() == ids[n[0] : n[0] + n[1]].tolist()
    token_store.write_tokens(none, str(tmp_path / "e"), path)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_repair_shrinks_and_expands():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.tile(rng.integers(3, 50, 40), 60), rng.integers(3, 50000, 500), [7] * 301])
    ids[rng.integers(0, len(ids), 30)] = 2
    s, rules = token_store.compress(ids, 2, 50257)
    g = token_store.Grammar(rules, 50257)
    assert len(s) < len(ids) / 2 and len(rules)
    assert g.expand(s).tolist() == ids.tolist()
    assert not (rules == 2).any()
    # no pair is left that is frequent, and every rule is used
    left = Counter(p for p in zip(s[:-1].tolist(), s[1:].tolist(), strict=True) if 2 not in p)
    assert max(left.values()) < 12
    assert set(range(50257, 50257 + len(rules))) <= {*s.tolist(), *rules.ravel().tolist()}
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)


@pytest.mark.parametrize("first", [60, 50257, 1 << 30])
def test_repair_leaves_no_frequent_pair(first):
    """Few symbols, phrases that repeat, runs of one symbol; the largest ids don't fit beside their places in 64 bits."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        parts = [np.tile(rng.integers(3, 6 + 3 * seed, rng.integers(1, 40)), rng.integers(1, 60)) for _ in range(20)]
        ids = np.concatenate([*parts, rng.integers(3, 8, 4000), [first - 1] * 50]).astype(np.uint32)
        ids[rng.integers(0, len(ids), 25)] = 2
        s, rules = token_store.compress(ids, 2, first)
        assert token_store.Grammar(rules, first).expand(s).tolist() == ids.tolist()
        left = Counter(p for p in zip(s[:-1].tolist(), s[1:].tolist(), strict=True) if 2 not in p)
        assert max(left.values(), default=0) < 12
        assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    for few in ([], [2], [5], [5, 5]):
        s, rules = token_store.compress(np.array(few, np.uint32), 2, first)
        assert s.tolist() == few and not len(rules)


def test_encoding_by_pieces_is_that_of_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc, r = Tokenizer.from_file(path), token_store.Encoder(path, 2), random.Random(19)
    alphabet = list("aé漢🙂'stll19.,!?-") + [" "] * 6 + ["\n", "\t", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "\x0b", "\u200b", "\ufeff", "\u180e", "<|endoftext|>", "\x00", "\u0301", "\u0120"]
    texts = ["", " ", "a", " a", "a ", "a\n", "a <|endoftext|> b", "x<|endoftext|>y z"]
    texts += ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(4000)]
    texts += [" ".join("".join(r.choices("abcdé'.", k=r.randint(1, 9))) for _ in range(200)) for _ in range(50)]
    small = token_store.Encoder(path, 2, known=300)
    for enc, some in [(enc, x) for x in (texts, texts[:1], texts[:0], [" "], texts[-3:])] + [(small, texts[i : i + 25]) for i in range(0, len(texts), 25)]:
        ids, n = enc.encode(pa.array(some, pa.string()))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n))[: len(some)]]
        assert got == [tok.encode(t, add_special_tokens=False).ids + [2] for t in some]


def test_heads_of_words_are_encoded_once():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, seen = token_store.Encoder(path, 2), []
    plain = enc._ids
    enc._ids = lambda texts, **kind: (seen.extend(texts), plain(texts, **kind))[1]
    text = "x alphabet, alphabet. alphabet alphabet;\nbeta alphabet's alphabet9 alphabeté \u00e9alphabet, ,alphabet beta,"
    assert enc.encode(pa.array([text]))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
    assert sum(x.count(" alphabet ") + x.endswith(" alphabet") for x in seen) == 1
    assert not [x for x in seen if "alphabet," in x.split() or "alphabet." in x.split()]


@pytest.mark.parametrize(("hot", "buffer"), [(10**6, 1 << 19), (3, 64)])
def test_repeats_meet_brute_force(spark, docs, rows, none, monkeypatch, hot, buffer):
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCK", 5)
    n = 24
    texts = [(i, (t or "").encode()) for i, t, *_ in rows] + [(500, b"a" * 100), (501, "é".encode() * 30)]
    seen = Counter(b[k : k + n] for _, b in texts for k in range(len(b) - n + 1))
    want = []
    for i, b in texts:
        m = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                m[k : k + n] = b"\1" * n
        want.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(x for x, f in zip(b, m, strict=True) if not f)))
    t = docs.select("doc_id", "text").union(spark.createDataFrame([(500, "a" * 100), (501, "é" * 30)], "doc_id long, text string"))
    got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.without_repeats(t, length=n, hot=hot).collect()]
    assert Counter(got) == Counter(want)
    assert suffix_dedup.without_repeats(none).count() == 0


def test_decontamination_meets_brute_force(spark, docs, rows, none, monkeypatch):
    pick = [t for _, t, *_ in rows if t and len(t) > 200]
    items = [(1, pick[0][20:120]), (2, "two words"), (3, None), (4, ""), (5, "  "), (10, pick[1].upper()), (10, "one"), (None, "eps zeta eta 9"), (7, "absent from all of the documents here at least i hope so")]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, id string, n_words int")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    wins = []
    for i, t in items:
        w = words(t)
        wins += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    want = Counter()
    for i, t, *_ in rows:
        w, hit, names = words(t), set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    names |= {str(item)} if item is not None else set()
        want[(i, len(w), len(hit), tuple(sorted(names)))] += 1
    for part, stretch in ((1 << 20, 4 << 20), (1 << 20, 300), (100, 300)):  # one part, and several
        monkeypatch.setattr(decontam, "SLICE", stretch)
        out = decontam.benchmark_hits(docs, bench, part_bytes=part).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in out) == want
    for part in (1 << 20, 100):
        clean = decontam.decontaminated(docs, bench, part_bytes=part)
        assert clean.columns == docs.columns
        assert clean.count() == sum(n for k, n in want.items() if k[2] == 0)
    assert decontam.decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontam.benchmark_hits(none, bench).count() == 0


def test_tables_of_windows_are_small():
    """16 MB of benchmark: the tables' peak, besides the texts, stays below ten bytes a byte."""
    import tracemalloc

    r = random.Random(23)
    some = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(r.choices(some, k=1000)).encode()) for i in range(2500)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    known = decontam.Patterns(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 14 << 20 and peak < 14 * size
    held = sum(x.nbytes for t in known.lengths for x in (t.keys, t.shifts, t.bucket, t.start, t.item)) + known.lengths[0].words.nbytes
    assert held < 10 * size
    n, spans, names = decontam._look([b"x " + b" ".join(items[7][1].split()[100:115]), b" ".join(items[8][1].split()[:9])], known)
    assert (n, spans, names) == ([16, 9], [[[1, 15]], []], [["7"], []])


def test_lines_meet_brute_force(spark, docs, rows, none):
    texts = {i: t for i, t, *_ in rows if i is not None and t}
    long = " ".join(f"word{i}" for i in range(40))
    extra = {900: long + "\nshort", 901: long.replace("word20", "other") + "\n\nshort", 902: "x" * 300 + "\n" + "x" * 299 + "y"}
    texts |= extra
    occ = sorted((i, k, line.strip(" ")) for i, t in texts.items() for k, line in enumerate(t.split("\n")) if line.strip(" "))
    occ = [o for o in occ]
    sets = [{o[2][j : j + 8] for j in range(max(1, len(o[2]) - 7))} for o in occ]
    parent = {i: i for i in range(len(occ))}
    for a in range(len(occ)):
        for b in range(a):
            same = occ[a][2] == occ[b][2] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            if same:
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    want = {}
    for k, o in enumerate(occ):
        if find(parent, k) != k:
            want.setdefault(o[0], []).append(o[1])
    t = docs.select("doc_id", "text").where("doc_id IS NOT NULL").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    out = {r["doc_id"]: list(r["removed"]) for r in line_dedup.line_report(t).collect()}
    assert {i: x for i, x in out.items() if x} == want
    clean = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_lines(t).collect()}
    assert clean[901] == "" and clean[900] == long + "\nshort"
    assert line_dedup.line_report(docs).count() == len(rows)
    assert line_dedup.line_report(none).count() == 0


def test_quality_learns_and_holds_out(spark, docs, none):
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "tree", "house", "walks", "green", "over"]) + r.choice(["", ",", "."]) for _ in range(60))
    bad = lambda: " ".join(["SPAM!!", "buy$$$"][r.randint(0, 1)] for _ in range(60))
    table = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    d = spark.createDataFrame([x[:2] for x in table], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in table] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels, trees=10)
    out = quality.scored(d, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert [x["held"] for x in out] == [zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 for x in out]
    held = [x for x in out if x["held"]]
    assert held and all((x["score"] >= 0.3) == (x["doc_id"] % 4 > 0) for x in held)
    flipped = labels.selectExpr("doc_id", f"CASE WHEN crc32(cast(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = quality.fit(d, flipped, trees=10)
    assert np.array_equal(again.leaf, model.leaf)
    assert quality.scored(docs, model).count() == docs.count()
    assert quality.scored(docs, model, least=0.0).columns == docs.columns
    assert quality.fit(none, labels).score(np.zeros((1, quality.FEATURES)))[0] == 0.5
    assert quality.scored(none, model).count() == 0


def test_trees_meet_naive_traversal():
    rng = np.random.default_rng(2)
    x = rng.random((300, quality.FEATURES))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    t = quality.grow(x, y, trees=15, depth=3)
    for row, s in zip(x[:40], t.score(x[:40]), strict=True):
        z = t.base
        for f, lim, leaf in zip(t.feature, t.limit, t.leaf, strict=True):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[f[at]] > lim[at])
            z += leaf[at - 7]
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-12
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    assert hashlib.sha256(t.leaf.tobytes()).hexdigest() == hashlib.sha256(quality.grow(x, y, trees=15, depth=3).leaf.tobytes()).hexdigest()


def _pairs_found(spark, pairs):
    """How many of the pairs of lines (least similarity 0.8 each) are reduced to their first line."""
    for x, y in pairs:
        p, q = ({t[j : j + 8] for j in range(len(t) - 7)} for t in (x, y))
        assert 100 * len(p & q) >= 80 * len(p | q)
    t = spark.createDataFrame([(i, x + "\n" + y) for i, (x, y) in enumerate(pairs)], "doc_id long, text string")
    return sum(list(r["removed"]) == [1] for r in line_dedup.line_report(t).collect())


def test_lines_with_short_tokens_put_in_are_found(spark):
    r = random.Random(11)
    pairs = []
    for _ in range(60):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(20)]
        pairs.append((" ".join(words), " ".join(words[:10] + r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=12) + words[10:])))
    assert _pairs_found(spark, pairs) == 60


def test_lines_whose_blanks_differ_are_found(spark):
    r = random.Random(12)
    pairs = []
    for _ in range(20):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(9)]
        words.append("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=15)))
        pairs.append((" ".join(words), " ".join(words[:5]) + " " * 10 + " ".join(words[5:])))
    assert all(len(x) == 150 for x, _ in pairs)
    assert _pairs_found(spark, pairs) == 20


def test_bands_miss_no_more_than_the_first_banding_and_agreement_counts_bytes(spark):
    for s in (0.8, 0.85, 0.9):
        assert (1 - s**line_dedup.ROWS) ** line_dedup.BANDS <= (1 - s**4) ** 12
    n, lanes = line_dedup.ROWS * line_dedup.BANDS, line_dedup.LANES
    r = random.Random(13)
    rows = []
    for k in range(n + 1):
        x = [r.randrange(128) for _ in range(n)]
        y = [v if i >= k else v ^ r.choice([1, 2, 16, 64, 127]) for i, v in enumerate(x)]
        words = [[int.from_bytes(bytes(z[i : i + lanes]), "little") for i in range(0, n, lanes)] for z in (x, y)]
        rows.append((n - k, *words[0], *words[1]))
    names = [[p + c for c in line_dedup.PACKED] for p in ("x_", "y_")]
    t = spark.createDataFrame(rows, "want long, " + ", ".join(f"{c} long" for c in names[0] + names[1]))
    assert t.where(line_dedup._agreement(*names) != F.col("want")).count() == 0


def test_lines_of_null_negative_and_repeated_ids(spark):
    a, b, c = "the first line of them all", "quite another line is here", "and a third one to keep too"
    rows = [(None, a + "\n" + b), (None, c), (-1, b), (-1, a), (-7, c + "\n" + a), (5, "x\n" + a), (5, "x\n" + a), (-(2**63), "x"), (2**63 - 1, "x\n\ny")]
    t = spark.createDataFrame([(i, x, 1, "r") for i, x in rows], "doc_id long, text string, removed int, removed_id string")
    out = line_dedup.deduplicated_lines(t)
    assert out.columns == t.columns
    # -2**63 keeps "x"; -7 keeps c and a; -1 keeps b; of the others only "y" is left
    want = Counter([(None, ""), (None, ""), (-1, b), (-1, ""), (-7, c + "\n" + a), (5, ""), (5, ""), (-(2**63), "x"), (2**63 - 1, "\ny")])
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    got = Counter((r["doc_id"], r["n_lines"], tuple(r["removed"])) for r in line_dedup.line_report(t).collect())
    assert got == Counter([(None, 2, (0, 1)), (None, 1, (0,)), (-1, 1, ()), (-1, 1, (0,)), (-7, 2, ()), (5, 2, (0, 1)), (5, 2, (0, 1)), (-(2**63), 1, ()), (2**63 - 1, 2, (0,))])


def test_shingles_are_whole_characters(spark):
    text = "ab🙂cd漢🙂🙂efgh"
    got = spark.createDataFrame([(text,)], "t string").select(line_dedup.shingles(F.col("t"))).first()[0]
    assert got == [text[i : i + 8] for i in range(len(text) - 7)]


def test_long_lines_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 16)
    monkeypatch.setattr(line_dedup, "BIG_CHUNK", 50)
    r = random.Random(14)
    lines = ["".join(r.choices("abcdefghij ", k=n)) for n in (7, 8, 23, 24, 49, 50, 57, 58, 500)]
    whole = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    short = line_dedup._signed(whole, 3, 10, line_dedup.PACKED).collect()
    monkeypatch.undo()
    assert sorted(short) == sorted(line_dedup._signed(whole, 3, 10, line_dedup.PACKED).collect())


def test_signing_cuts_whole_characters_and_no_pattern(spark):
    a, b = "abc\U0001f642\U0001f643é漢 defg\U0001f642", "x\U0001f642y"
    lines = spark.createDataFrame([(0, a + a + a[:7]), (1, a + a + a + a[:7]), (2, b), (3, b), (4, b + " ")], "lid long, line string")
    signed = line_dedup._signed(lines, 3, 10, line_dedup.PACKED)
    assert "regexp" not in signed._jdf.queryExecution().optimizedPlan().toString()
    got = {r["lid"]: tuple(r[1:]) for r in signed.collect()}
    # the rotations of a are all shingles of the first two, which are one set
    assert got[0] == got[1] and got[2] == got[3] and got[3] != got[4] and got[0] != got[2]


@pytest.mark.parametrize("stretch", [1, 4, 7])
def test_minima_of_lines_take_no_checked_product_and_no_shingle_twice(spark, monkeypatch, stretch):
    """Rows of several shingles give the signatures of rows of one, and minima agree as often as sets are alike."""
    r = random.Random(16)
    abc = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(r.choices(abc, k=n)) for n in [1, 7, 8, 9, 10, 11, 12, 13, 40]]
    pairs = [("".join(r.choices(abc, k=200)), "".join(r.choices(abc, k=25))) for _ in range(300)]
    lines += [y for x, end in pairs for y in (x, x[:-25] + end)]
    whole = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    monkeypatch.setattr(line_dedup, "STRETCH", 1)
    want = sorted(line_dedup._signed(whole, 3, 10, line_dedup.PACKED).collect())
    monkeypatch.setattr(line_dedup, "STRETCH", stretch)
    signed = line_dedup._signed(whole, 3, 10, line_dedup.PACKED)
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert " * " not in plan.split("Aggregate")[1].split("Generate")[0]
    got = sorted(signed.collect())
    assert got == want
    # 193 shingles each, 168 or a few more in common: the similarity is 168 / 218 = 0.77
    bits = [[(row[2 + i // 7] >> 8 * (i % 7)) & 255 for i in range(30)] for row in got[9:]]
    per = [sum(a[i] == b[i] for a, b in zip(bits[::2], bits[1::2], strict=True)) / 300 for i in range(30)]
    assert max(y for row in bits for y in row) < 128 and abs(sum(per) / 30 - 168 / 218) < 0.03 and min(per) > 0.6
    both = [sum(a[i] == b[i] and a[j] == b[j] for a, b in zip(bits[::2], bits[1::2], strict=True)) / 300 for i in range(30) for j in range(i)]
    assert abs(sum(both) / len(both) - (168 / 218) ** 2) < 0.04


def test_joins_that_compare_sets_of_lines_keep_them_out_of_their_method(spark, monkeypatch):
    """With the sets a join's own method is too long for the JVM to compile; one with a lambda has none, and pairs don't come out."""
    r, seen, write = random.Random(3), {}, line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda df, name: (seen.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    base = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)]
    lines = [" ".join(w if r.random() > 0.06 else "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for w in base) for _ in range(60)]
    line_dedup.line_report(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    plans = [p for ps in seen.values() for p in ps]
    joins = [x for p in plans for x in p.splitlines() if "Join " in x and "array_intersect" in x]
    assert joins and all("lambdafunction" in x for x in joins)


@pytest.mark.parametrize("block", [1024, 3])
def test_line_pairs_are_recalled_and_groups_meet_brute_force(spark, monkeypatch, block):
    """Random edits around 0.8: the components are those of all links, in groups that no line is central in."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(15)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    lines = []
    for size in [12, 25, 40] * (12 if block == 1024 else 3):
        base = [word() for _ in range(size)]
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, max(2, size // 9))):
                t[r.randrange(size)] = word()
            lines.append(" ".join(t))
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines]
    parent, links = {i: i for i in range(len(lines))}, 0
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links += 1
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    t = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {x["doc_id"] for x in line_dedup.line_report(t).collect() if not x["removed"]}
    assert links > 20
    assert kept == {i for i in parent if find(parent, i) == i}


def test_a_rejected_leader_does_not_hide_a_pair(spark):
    """Two texts whose nearest by signature is the leader, which was tested and rejected, are linked nevertheless."""
    bands, rows, seed = 4, 2, 7
    a, b = minhash_dedup._permutations(bands * rows, seed)
    r = random.Random(17)

    def jaccard(p, q):
        return len(np.intersect1d(p, q)) / len(np.union1d(p, q))

    for _ in range(20000):
        base = [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts = [list(base) for _ in range(3)]
        texts[0][r.randrange(20, 40)] = "leader"
        texts[1][r.randrange(0, 3)] = "left"
        texts[2][r.randrange(57, 60)] = "right"
        texts = [" ".join(t) for t in texts]
        sets = [minhash_dedup.shingle_set(t.encode()) for t in texts]
        if jaccard(sets[1], sets[2]) < 0.85 or max(jaccard(sets[0], s) for s in sets[1:]) >= 0.85:
            continue
        low = [minhash_dedup.minima(s, a, b) for s in sets]
        same = [[(p == q).sum() for q in low] for p in low]
        band = [[tuple(x) for x in p.reshape(bands, rows)] for p in low]
        shared = [k for k in range(bands) if band[1][k] == band[2][k]]
        if shared and all(band[0][k] == band[1][k] for k in shared) and min(same[0][1], same[0][2]) > same[1][2]:
            break
    else:
        raise AssertionError("no such texts")
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {x["doc_id"]: x["component_id"] for x in minhash_dedup.near_duplicates(t, threshold=85, bands=bands, rows=rows, seed=seed).collect()}
    assert out == {0: 0, 1: 1, 2: 1}
