"""Near-duplicate lines by MinHash, with DataFrame functions only.

A text's lines are its stretches between newlines, with blanks at the ends cut off; blank lines are left
alone. Equal lines collapse first (pre-aggregated). The set of a line holds its distinct ``SHINGLE``-character
shingles, or the line itself if it is shorter.

All lines are signed in one way, by minima over all their shingles, so banding sees the similarity that is
tested, and no pair is outside it: two lines that share a shingle can meet in each band, whatever their
lengths, words and blanks. BANDS bands of ROWS minima give candidates: at similarity s a pair is missed with
(1 - s**ROWS)**BANDS, 8e-4 at 0.8 and 7e-5 at 0.85.

1. Each bucket links its members to its least line, after a look at signatures, by exact Jaccard similarity.
2. In buckets of more than two lines that still hold several components, a semi-join keeps the lines that
   have a partner of another component which may reach the threshold: a row a line, however many partners.
3. These few lines get FINE_BANDS bands of FINE_ROWS further minima. Each fine bucket links its members to
   one of them, drawn by hash, so that what is similar nearly always falls into one component.
4. Lines of buckets of step 1 that are still in different components are compared inside the join, by size,
   by all minima and by their sets as 32-bit hashes, which never count too few in common. Only links come
   out, and they are confirmed on the lines.

A bucket is cut into blocks of BLOCK lines for steps 2 and 4, so no task holds a bucket. Components come
from alternating large-star and small-star; of each the first line (least id, null last, then line
number) stays.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import drop_written, free_name, table, written
from evenhand.llm.components import components

SHINGLE, ROWS, BANDS = 8, 3, 10
FINE_ROWS, FINE_BANDS = 5, 16
LOW = (1 << 31) - 1
#: Shingles cut from one stretch of a line; stretches are cut from longer ones, as a substring walks from the beginning.
CHUNK, BIG_CHUNK = 4096, 1 << 20
#: Lines of a bucket that meet in one task.
BLOCK = 1024
#: Ids that may be broadcast to pick the lines to compare.
FEW_IDS = 500_000
COARSE, FINE = ROWS * BANDS, FINE_ROWS * FINE_BANDS


#: Where the 31 bits of a shingle's hash word begin that order shingles for one minimum. The highest bits, which nearly
#: always decide, belong to one minimum each. No product is needed, which Spark would check for overflow.
WINDOWS = (0, 17, 33)
#: Shingles of one row that reach the minima together, where a signature takes FEW_WORDS words at most; with more words
#: such rows were no faster.
STRETCH, FEW_WORDS = 4, 10
#: Minima are compared by their low seven bits, LANES of eight bits to a long, so that sums over lanes can't
#: overflow; minima that differ agree by chance once in 128.
LANES = 7


def _packed(prefix: str, count: int) -> list[str]:
    """Names of the columns of a signature of ``count`` minima."""
    return [f"{prefix}{i}" for i in range(-(-count // LANES))]


PACKED, FINE_PACKED = _packed("s", COARSE), _packed("t", FINE)
#: The keys of the bands, cut to 31 bits.
KEYS = [f"k{b}" for b in range(BANDS)]


def _wide(line: Column) -> Column:
    """A line in four bytes a character, so that a shingle is cut out without a walk from the beginning."""
    return F.encode(line, "UTF-32")


def _last(wide: str) -> str:
    """SQL of the byte from 1 where the last shingle of a wide line begins; a shorter line is its only one."""
    return f"greatest(length({wide}) - {4 * SHINGLE - 1}, 1)"


def shingles(line: Column) -> Column:
    """The set of a line, as an array that may repeat its members."""
    # a match takes one whole character, so none begins inside a surrogate pair
    every = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.when(F.length(line) < SHINGLE, F.array(line)).otherwise(every)


def _word(v: int) -> int:
    """The constant that makes a shingle's v-th hash word, as a signed long."""
    c = 0x9E3779B97F4A7C15 * (2 * v + 1) % (1 << 64)
    return c - (1 << 64) if c >> 63 else c


def _cut(of: str, size: int) -> str:
    """SQL of an array of stretches of ``of`` that hold all its shingles, ``size`` of them each."""
    return f"transform(sequence(1, greatest(length({of}) - {SHINGLE - 1}, 1), {size}), i -> substr({of}, i, {size + SHINGLE - 1}))"


def _signed(lines: DataFrame, rows: int, bands: int, names: list[str], first: int = 0) -> DataFrame:
    """(lid, keys, names) of each line: the keys of its bands and its minima in lanes, over all its shingles."""
    whole = lines.select("lid", F.explode(F.expr(f"CASE WHEN length(line) <= {BIG_CHUNK} THEN array(line) ELSE {_cut('line', BIG_CHUNK)} END")).alias("c"))
    chunks = whole.select("lid", F.explode(F.expr(f"CASE WHEN length(c) <= {CHUNK} THEN array(c) ELSE {_cut('c', CHUNK)} END")).alias("c"))
    count, aggs = rows * bands, []
    words = range(first // len(WINDOWS), -(-(first + count) // len(WINDOWS)))
    step = STRETCH if len(words) <= FEW_WORDS else 1
    wide = chunks.select("lid", _wide(F.col("c")).alias("w")).select("lid", "w", F.expr(_last("w")).alias("z"))
    each = wide.select("lid", "w", "z", F.explode(F.expr(f"sequence(1, z, {4 * step})")).alias("i"))
    # what a row has beyond the last shingle is that one again, which no minimum sees
    cut = each.select("lid", *[F.xxhash64(F.expr(f"substring(w, least(i + {4 * k}, z), {4 * SHINGLE})")).alias(f"x{k}") for k in range(step)])
    hashed = cut.select("lid", *[F.xxhash64(F.col(f"x{k}").bitwiseXOR(F.lit(_word(v)))).alias(f"w{v}_{k}") for v in words for k in range(step)])
    for i in range(first, first + count):
        v, shift = i // len(WINDOWS), WINDOWS[i % len(WINDOWS)]
        each_of = [F.shiftleft(f"w{v}_{k}", shift) if shift else F.col(f"w{v}_{k}") for k in range(step)]
        aggs.append(F.min(F.shiftright(F.least(*each_of) if step > 1 else each_of[0], 33)).alias(f"m{i - first}"))
    keys = F.array(*[F.xxhash64(F.lit(first + b), *[f"m{b * rows + r}" for r in range(rows)]) for b in range(bands)])
    packed = []
    for j, name in enumerate(names):
        word = F.lit(0).cast("long")
        for k in range(min(LANES, count - LANES * j)):
            word = word.bitwiseOR(F.shiftleft(F.col(f"m{LANES * j + k}").bitwiseAND(F.lit(127)), 8 * k))
        packed.append(word.alias(name))
    return hashed.groupBy("lid").agg(*aggs).select("lid", keys.alias("keys"), *packed)


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` (a written table of one or two longs a row), to be broadcast up to FEW_IDS rows; beyond, joins shuffle."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def _picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose lid is in ``ids`` (wanted)."""
    return rows.join(_few(ids), F.col("lid") == F.col("wanted"), "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "wanted")


def _agreement(x: list[str], y: list[str], count: int = COARSE) -> Column:
    """How many of ``count`` minima of two signatures agree; bits and sums only."""
    differ = F.lit(0)
    for p, q in zip(x, y, strict=True):
        # a lane that isn't zero carries into its highest bit; short, as the JVM doesn't compile long methods
        lanes = F.col(p).bitwiseXOR(F.col(q)) + F.lit(0x7F7F7F7F7F7F7F)
        differ = differ + F.bit_count(lanes.bitwiseAND(F.lit(0x80808080808080)))
    return F.lit(count) - differ


def _least_agreement(threshold: int, count: int = COARSE) -> int:
    """Four deviations below what is expected at the threshold."""
    t = threshold / 100
    return math.floor(count * t - 4 * math.sqrt(count * t * (1 - t)))


def _similar(pairs: DataFrame, signed: DataFrame, names: list[str], count: int, threshold: int) -> DataFrame:
    """(a, b) of pairs (a, b) whose signatures agree."""
    sigs = _picked(signed, _ends(pairs))
    both = pairs
    for side in ("a", "b"):
        both = both.join(sigs.select(F.col("lid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names]), side)
    return both.where(_agreement([f"a_{c}" for c in names], [f"b_{c}" for c in names], count) >= _least_agreement(threshold, count)).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= threshold * union on all shingles."""
    texts = _picked(lines.select("lid", "line"), _ends(pairs))
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    p, q = (F.transform(shingles(F.col(c)), lambda s: F.xxhash64(s)) for c in ("x", "y"))
    # the generator keeps the comparison out of the join's own condition, and makes each set once
    sets = both.select("a", "b", F.explode(F.array(F.struct(p.alias("p"), q.alias("q")))).alias("s"))
    near = F.size(F.array_intersect("s.p", "s.q")) * 100 >= F.size(F.array_union("s.p", "s.q")) * threshold
    return sets.where(near).select("a", "b")


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, lid, comp, n_key) of members of buckets that hold several components."""
    placed = members.join(found, F.col("lid") == F.col("node"), "left").select("key", "band", "lid", F.coalesce("component", "lid").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n_key")).where("lo < hi").select("key", "n_key")
    return placed.join(mixed, "key")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Two sides of a join of the rows of a bucket with each other, by blocks; the columns of the second end with _2."""
    k = F.ceil(F.col("n_key") / BLOCK).cast("int")
    one = rows.withColumn("block", F.explode(F.sequence(F.lit(0), k - 1)))
    two = rows.withColumn("block", F.pmod(F.xxhash64("lid"), k).cast("int"))
    two = two.select(*[F.col(c).alias(c + "_2") for c in two.columns])
    return one, two, (F.col("key") == F.col("key_2")) & (F.col("block") == F.col("block_2")) & (F.col("comp") != F.col("comp_2"))


def _partnered(rest: DataFrame, names: list[str], count: int, threshold: int, sized: bool = False) -> DataFrame:
    """(wanted): the lines of ``rest`` that have a partner of another component which may reach the threshold."""
    one, two, meet = _sides(rest)
    if sized:
        meet = meet & _sizes_fit(threshold)
    near = _agreement(names, [c + "_2" for c in names], count) >= _least_agreement(threshold, count)
    return written(one.join(two, meet & near, "left_semi").select(F.col("lid").alias("wanted")).distinct(), "partnered")


def _sizes_fit(threshold: int) -> Column:
    """At a similarity of t the smaller set has at least t of the larger one's members."""
    return F.least("n", "n_2") * 100 >= F.greatest("n", "n_2") * threshold


def _fine_pairs(cand: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): each member of a fine bucket with one drawn by hash, where their components differ."""
    spread = cand.select("lid", F.explode("keys").alias("key")).withColumn("h", F.xxhash64("key", "lid"))
    first = spread.groupBy("key").agg(F.min("h").alias("lead"), F.count("*").alias("cnt")).where("cnt > 1").select("key", "lead")
    placed = written(spread.join(first, "key").join(found, F.col("lid") == F.col("node"), "left").select("key", "lid", (F.col("h") == F.col("lead")).alias("leads"), F.coalesce("component", "lid").alias("comp")), "fine")
    leads = placed.where("leads").select("key", F.col("lid").alias("other"), F.col("comp").alias("other_comp"))
    return placed.where("NOT leads").join(leads, "key").where("comp <> other_comp").select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b")).distinct()


def _last_links(members: DataFrame, found: DataFrame, sigs: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between lines of one bucket and of different components; sigs has all minima, KEYS and n of the lines that count."""
    names, count = PACKED + FINE_PACKED, COARSE + FINE
    rest = written(_unsettled(members, found).join(sigs.select("lid", "n", F.array(*KEYS).alias("keys"), *names), "lid"), "rest")
    near = _partnered(rest, names, count, threshold, sized=True)
    rest = _picked(rest, near)
    hashes = _picked(lines, near).select(F.col("lid").alias("own"), F.array_distinct(F.transform(shingles(F.col("line")), lambda s: F.hash(s))).alias("set"))
    # a bucket's size is that of the lines that are left, or more
    one, two, meet = _sides(rest.join(hashes, F.col("lid") == F.col("own")).drop("own"))
    agreement = _agreement(names, [c + "_2" for c in names], count) >= _least_agreement(threshold, count)
    # a pair is looked at in the first band that it shares; written with a function of higher order, which keeps the
    # condition out of the join's own method: with the sets that is too long for the JVM to compile
    once = ~F.array_contains(F.slice(F.zip_with("keys", "keys_2", lambda x, y: x == y), F.lit(1), F.col("band")), True)
    # different shingles may share a hash, so that at most the lost members of the smaller loss are missing in common
    common = F.size(F.array_intersect("set", "set_2")) + F.least(F.col("n") - F.size("set"), F.col("n_2") - F.size("set_2"))
    similar = common * (100 + threshold) >= (F.col("n") + F.col("n_2")) * threshold
    both = one.join(two, meet & (F.col("lid") < F.col("lid_2")) & _sizes_fit(threshold) & agreement & once & similar)
    pairs = written(both.select(F.col("lid").alias("a"), F.col("lid_2").alias("b")).distinct(), "pairs")
    return _confirmed(pairs, lines, threshold)


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, pos, line) of each line that isn't blank.

    pos orders lines by id (null last), by 28 bits of a hash of the text, which tell rows of one id apart,
    and by number in the text; it is a decimal below 2**124, so no id overflows.
    """
    text, low = F.col(f"`{text_col}`").cast("string"), 1 << 28
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), _th(text).alias("th"), text.alias("text"))
    each = rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "raw")).select("id", "th", "no", F.trim("raw").alias("line")).where("line <> ''")
    place = F.coalesce(F.col("id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    pos = ((place * F.lit(low).cast("decimal(10,0)")).cast("decimal(30,0)") + F.col("th")).cast("decimal(30,0)")
    pos = ((pos * F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(38,0)") + F.col("no")).cast("decimal(38,0)")
    return each.withColumn("pos", pos)


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(occurrences, lines): (id, th, no, pos, h1, h2) of each line, and (h1, h2, keep) of each distinct line that has another.

    keep is the pos of the line that stays. Lines that occur once and are like no other are left out of
    the second.
    """
    each = _occurrences(docs, id_col, text_col)
    h1, h2 = F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(17)).alias("h2")
    occurrences = each.select("id", "th", "no", "pos", h1, h2)
    # ids are fixed when the table is written
    distinct = each.groupBy("line").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))
    lines = written(distinct.withColumn("lid", F.monotonically_increasing_id()), "lines")
    signed = written(_signed(lines, ROWS, BANDS, PACKED), "signed")

    spread = signed.select("lid", F.posexplode("keys").alias("band", "key"))
    buckets = written(spread.groupBy("key").agg(F.min("lid").alias("lead"), F.max("lid").alias("last"), F.count("*").alias("cnt")).where("cnt > 1"), "buckets")
    large = written(buckets.where("cnt > 2").select(F.col("key").alias("large"), "lead"), "large")
    members = written(spread.join(_few(large), F.col("key") == F.col("large")).select("key", "band", "lid", "lead"), "members")
    twos = buckets.where("cnt = 2").select(F.col("lead").alias("a"), F.col("last").alias("b"))
    stars = written(twos.union(members.where("lid <> lead").select(F.col("lead").alias("a"), F.col("lid").alias("b"))).distinct(), "stars")
    drop_written(buckets, large)
    pairs = written(_similar(stars, signed, PACKED, COARSE, threshold), "pairs")
    links = written(_confirmed(pairs, lines, threshold), "links")
    drop_written(stars, pairs)
    found = components(links)

    rest = _unsettled(members, found)
    rest = written(rest.join(_picked(signed.select("lid", *PACKED), written(rest.select(F.col("lid").alias("wanted")).distinct(), "wanted")), "lid"), "rest")
    near = _partnered(rest, PACKED, COARSE, threshold)
    if not near.isEmpty():
        some = written(_picked(lines.select("lid", "line"), near), "some")
        n = some.select("lid", F.size(F.array_distinct(F.transform(shingles(F.col("line")), lambda s: F.xxhash64(s)))).alias("n"))
        fine = written(_signed(some, FINE_ROWS, FINE_BANDS, FINE_PACKED, COARSE).join(n, "lid").join(_picked(signed.select("lid", *[F.col("keys")[b].bitwiseAND(F.lit(LOW)).cast("int").alias(k) for b, k in enumerate(KEYS)], *PACKED), near), "lid"), "fine")
        drop_written(signed, rest)
        tried = written(_similar(written(_fine_pairs(fine, found), "tried"), fine, FINE_PACKED, FINE, threshold), "pairs")
        links = links.union(written(_confirmed(tried, lines, threshold), "links"))
        found = components(links)
        last = written(_last_links(_picked(members.select("key", "band", "lid"), near), found, fine, lines, threshold), "links")
        if not last.isEmpty():
            found = components(links.union(last))
    firsts = lines.select("lid", "pos").join(found, F.col("lid") == F.col("node")).groupBy("component").agg(F.min("pos").alias("keep"))
    in_comp = found.join(firsts, "component").select("node", "keep")
    kept = lines.select(h1, h2, "pos", "times", "lid").join(in_comp, F.col("lid") == F.col("node"), "left")
    return occurrences, kept.where("times > 1 OR keep <> pos").select("h1", "h2", F.coalesce("keep", "pos").alias("keep"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """(id, th, removed): for each row with lines to remove, their sorted numbers from 0; th tells texts of one id apart."""
    occurrences, kept = line_components(docs, id_col, text_col, threshold)
    kept = kept.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "keep")
    gone = occurrences.join(kept, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where("pos <> keep")
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def _th(text: Column) -> Column:
    """28 bits of a hash of a text, which tell rows of one id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 28) - 1))


def _with_removed(rows: DataFrame, gone: DataFrame, row_id: Column, th: Column) -> tuple[DataFrame, str]:
    """``rows`` with the numbers of the lines to remove (null: none) in a column of a free name, and that name."""
    name, gid, gth = (free_name(rows, base=x) for x in ("removed", "removed_id", "removed_th"))
    gone = gone.select(F.col("id").alias(gid), F.col("th").alias(gth), F.col("removed").alias(name))
    return rows.join(gone, row_id.eqNullSafe(F.col(gid)) & (th == F.col(gth)), "left").drop(gid, gth), name


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """``docs`` whose texts keep one line of each component; rows stay, though a text may become empty.

    Blank lines stay. Null texts stay null, null ids are ids that come last, and ids may be any longs. Rows
    that repeat id and text are one: each copy keeps the same lines. Rows that share an id only are told
    apart by their texts. Other columns pass through, whatever their names; an empty table gives none.
    """
    text = F.col(f"`{text_col}`")
    gone = removed_lines(docs, id_col, text_col, threshold)
    joined, name = _with_removed(docs, gone, F.col(f"`{id_col}`").cast("long"), _th(text.cast("string")))
    clean = F.when(F.col(name).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(name), i)), "\n"))
    return joined.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (not blank), n_removed, removed (line numbers from 0).

    A null text has no lines. An empty table gives none. Null and repeated ids: see deduplicated_lines.
    """
    text = F.col(f"`{text_col}`").cast("string")
    n = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _th(text).alias("th"), F.when(text.isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    joined, name = _with_removed(rows, removed_lines(docs, id_col, text_col, threshold), F.col("doc_id"), F.col("th"))
    removed = F.coalesce(F.col(name), F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line report of all documents; ``removed`` goes out as text: line numbers joined by commas."""
    out = line_report(table(spark, sf_dir, "documents"))
    return out.withColumn("removed", F.array_join("removed", ","))


OP6_SQL = f"""
WITH RECURSIVE o AS MATERIALIZED (
  SELECT doc_id, i - 1 AS no, trim(ls[i], ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE trim(ls[i], ' ') <> ''),
d AS MATERIALIZED (SELECT line, min(doc_id * 4294967296 + no) AS pos FROM o GROUP BY line),
s AS MATERIALIZED (SELECT DISTINCT pos, substr(line, i, {SHINGLE}) AS s FROM (SELECT pos, line, unnest(range(1, greatest(length(line) - {SHINGLE - 1}, 1) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT pos, count(*) AS n FROM s GROUP BY pos),
c AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.pos < b.pos GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.pos = a JOIN n y ON y.pos = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
m AS (SELECT n, min(m) AS keep FROM r GROUP BY n),
g AS (SELECT o.doc_id, o.no FROM o JOIN d USING (line) LEFT JOIN m ON m.n = d.pos WHERE o.doc_id * 4294967296 + o.no <> coalesce(m.keep, d.pos)),
cnt AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id)
SELECT t.doc_id, coalesce(any_value(cnt.n), 0)::BIGINT AS n_lines, count(g.no)::BIGINT AS n_removed, coalesce(string_agg(g.no::VARCHAR, ',' ORDER BY g.no), '') AS removed
FROM documents t LEFT JOIN cnt USING (doc_id) LEFT JOIN g USING (doc_id) GROUP BY t.doc_id
"""
