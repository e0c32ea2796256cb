"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a row's hash. All rows begin in one bucket; only a
bucket that exceeds the byte limit splits on its next bit, until every shard fits. Rows are counted once
into a small table of hashes and sizes; each round sums the prefixes of the buckets that are still too
large over STEP more bits, so sums are pre-aggregated and no bucket is gathered in a task.

Rows that can't be told apart (the same id and text) have the same hash; if they alone, or one row
alone, exceed the limit, they stay a shard of their own and ``fits`` is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import drop_written, free_name, table, written

STEP = 10
BITS = 120
LIMIT = 32 << 20
#: The registered query's limit is small, so that shards split, and single texts exceed it, in tables of any size.
QUERY_LIMIT = 64 << 10


def _bits(md5) -> F.Column:
    """The first BITS bits of an md5 in hex as a string of 0 and 1."""
    halves = [F.lpad(F.conv(F.substring(md5, i, 10), 16, 2), 40, "0") for i in (1, 11, 21)]
    return F.concat(*halves)


def row_hash(id_col, text_col) -> F.Column:
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("~")), F.lit("|"), F.coalesce(F.md5(text_col), F.lit("~"))).cast("binary"))


def shard_directory(sized: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_rows, fits) of each shard. sized: (bits, bytes)."""
    open_ = sized.groupBy("bits").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    # rows with the same hash can never be parted: one entry, however many copies
    open_ = written(open_, "hashes")
    leaves: DataFrame | None = None
    depth = 0
    while depth <= BITS:
        last = min(depth + STEP - 1, BITS)
        fine = open_.groupBy(F.substring("bits", 1, last).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.count("*").alias("hashes"))
        levels = fine.select("bytes", "n", "hashes", F.explode(F.transform(F.sequence(F.lit(depth), F.lit(last)), lambda d: F.substring("fine", F.lit(1), d))).alias("prefix"))
        sums = levels.groupBy("prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.sum("hashes").alias("hashes"))
        sums = written(sums.withColumn("closed", (F.col("shard_bytes") <= limit) | (F.col("hashes") == 1) | (F.length("prefix") == BITS)), "prefixes")
        # a shard is closed and its parent isn't; depth's first level has open parents only
        parent = F.expr("substring(prefix, 1, length(prefix) - 1)")
        split = sums.where("NOT closed").select(F.col("prefix").alias("split"))
        closed = sums.where("closed").withColumn("parent", parent)
        now = closed.where(F.length("prefix") == depth).drop("parent").union(closed.where(F.length("prefix") > depth).join(split, F.col("parent") == F.col("split"), "left_semi").drop("parent"))
        leaves = now if leaves is None else leaves.union(now)
        deep = written(split.where(F.length("split") == last), "split")
        if deep.isEmpty():
            break
        rest = written(open_.join(deep, F.substring("bits", 1, last) == F.col("split"), "left_semi"), "hashes")
        drop_written(open_)
        open_, depth = rest, last + 1
    return leaves.select("prefix", F.length("prefix").alias("depth"), "shard_bytes", "shard_rows", (F.col("shard_bytes") <= limit).alias("fits"))


def sharded(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits, shard, depth, shard_bytes, shard_rows, fits) of each row of ``docs``; bits is the row's hash.

    shard is the shard's hash prefix ('' when all rows fit in one). Sizes are UTF-8 bytes of the texts; a
    null text has none. Rows with a null id, or the same id, are told apart by their texts. An empty
    table gives none. Other columns are ignored.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    sized = written(docs.select(i.alias("id"), _bits(row_hash(i, t)).alias("bits"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes")), "sized")
    leaves = written(shard_directory(sized, limit), "directory")
    # each row meets the prefixes of the depths that occur, which are few
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    if not depths:
        return sized.select("id", "bits", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), F.lit(True).alias("fits"))
    prefixes = F.explode(F.array(*[F.substring("bits", 1, d) for d in depths]))
    return (
        sized.groupBy("bits").agg(F.first("bytes").alias("bytes")).select("bits", prefixes.alias("prefix"))
        .join(leaves, "prefix")
        .join(sized.select("id", F.col("bits").alias("b")), F.col("bits") == F.col("b"))
        .select("id", "bits", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_rows", "fits")
    )


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, partitioned by shard; the shard of all rows ('') is named by Spark's default partition."""
    with_shards(docs, limit, id_col, text_col).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


def with_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns shard, shard_depth, shard_bytes; the shard is found from each row's hash and a directory.

    The directory grows with the corpus, so it is joined, not broadcast. Columns of these three names are
    replaced; others pass through, whatever their names. Null and empty texts have no bytes; null and
    repeated ids are told apart by their texts, and rows that repeat altogether share a shard. An empty
    table gives an empty one.
    """
    kept = docs.drop("shard", "shard_depth", "shard_bytes")
    found = sharded(docs, limit, id_col, text_col).select("bits", "shard", F.col("depth").alias("shard_depth"), "shard_bytes").dropDuplicates(["bits"])
    own = free_name(kept, found, base="own_bits")
    theirs = free_name(kept, found, base="found_bits")
    bits = _bits(row_hash(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    joined = kept.withColumn(own, bits).join(found.withColumnRenamed("bits", theirs), F.col(own) == F.col(theirs))
    return joined.select(*[F.col(f"`{c}`") for c in kept.columns], "shard", "shard_depth", "shard_bytes")


def op3_extendible_shards(spark, sf_dir: str) -> DataFrame:
    """The shard of each document. Null texts have no bytes; an empty table gives none; see ``sharded``."""
    return sharded(table(spark, sf_dir, "documents"), QUERY_LIMIT).select(F.col("id").alias("doc_id"), "shard", "depth", "shard_bytes", "shard_rows", "fits")


def shards_sql(limit: int = QUERY_LIMIT, depth: int = 24) -> str:
    """The same by prefix sums at all depths at once (for tables that need no deeper shards)."""
    return f"""
WITH h AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(md5(text), '~')), 1, 10))::BIGINT), 40, '0') AS bits
  FROM documents),
p AS (SELECT d, substr(bits, 1, d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, count(DISTINCT bits) = 1 AS one
  FROM h, range({depth} + 1) r(d) GROUP BY ALL),
l AS (SELECT doc_id, min(d) AS depth FROM h JOIN p ON prefix = substr(bits, 1, d) AND (shard_bytes <= {limit} OR one) GROUP BY doc_id)
SELECT h.doc_id, p.prefix AS shard, l.depth::INTEGER AS depth, shard_bytes, shard_rows, shard_bytes <= {limit} AS fits
FROM h JOIN l USING (doc_id) JOIN p ON p.d = l.depth AND p.prefix = substr(bits, 1, l.depth)
"""


OP3_SQL = shards_sql()
