"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree is domain - language - source. Each node's budget is shared among its children by weight; a
child that has fewer tokens than its share (times ``max_epochs``) is filled and what is missing goes to
its siblings, by their weights. As a node never gets more than all its leaves can give, a shortage is
made up by siblings first and reaches the ancestors' level only when the whole subtree is short.

A leaf with budget b and n tokens takes every row b // n times and then the longest prefix of one more
epoch, whose order is a hash of seed, epoch and id, that fits the rest. Budgets are exact integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.llm.common import free_name, table, written

#: Production weights: level -> name -> integer weight; names that aren't listed weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"crawl": 60, "curated": 40},
    "lang": {"en": 50, "de": 20, "fr": 15, "es": 15},
    "source": {"src0": 3},
}
DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'crawl' ELSE 'curated' END"
TOKENS = r"regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SHARE, EPOCHS, SEED = 80, 2, 11


def _weight(level: str, weights: dict[str, dict[str, int]]) -> F.Column:
    w = F.lit(1)
    for name, value in weights.get(level, {}).items():
        w = F.when(F.col(level) == name, F.lit(value)).otherwise(w)
    return w.cast("decimal(10,0)")


def _shared(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Children (parent.., name, cap, w) of nodes with ``budget`` get theirs in column ``given``.

    In order of cap / w, a child is full if its share of what is left for it and those after it is at
    least its cap; the first that isn't sets the rate for the rest.
    """
    big = "decimal(38,0)"
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    # cap / w as a key: exact compare by cross products isn't an order Spark has, so ties go by name
    order = [F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double")).otherwise(F.lit(float("inf"))), F.col(name)]
    run = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = by.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    d = children.withColumn("before", F.coalesce(F.sum("cap").over(run), F.lit(0)).cast("decimal(20,0)"))
    d = d.withColumn("left", (F.col("budget") - F.col("before")).cast("decimal(20,0)")).withColumn("tail", F.sum("w").over(rest).cast("decimal(15,0)"))
    full = (F.col("w") > 0) & ((F.col("cap") * F.col("tail")).cast(big) <= (F.col("w") * F.col("left")).cast(big))
    d = d.withColumn("full", full)
    first = F.min(F.when(~F.col("full") & (F.col("w") > 0), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "left", "tail"))).over(by)
    d = d.withColumn("rate", first)
    part = F.expr("CAST(w * rate.left AS DECIMAL(38,0)) div rate.tail")
    given = F.when(F.col("w") == 0, F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(part)
    return d.withColumn("given", F.greatest(F.lit(0), given).cast("decimal(20,0)")).drop("before", "left", "tail", "full", "rate")


def budgets(leaves: DataFrame, total: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    n = "decimal(20,0)"
    cap = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast(n))
    w = {k: _weight(k, weights) for k in ("domain", "lang", "source")}
    # a subtree all of whose leaves have weight 0 can give nothing
    cap = cap.withColumn("cap", F.when((w["source"] > 0) & (w["lang"] > 0) & (w["domain"] > 0), F.col("cap")).otherwise(F.lit(0).cast(n)))
    langs = cap.groupBy("domain", "lang").agg(F.sum("cap").cast(n).alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").cast(n).alias("cap"))
    all_ = domains.agg(F.least(F.sum("cap"), F.lit(total).cast(n)).cast(n).alias("budget"))
    top = _shared(domains.crossJoin(F.broadcast(all_)).withColumn("w", w["domain"]), [], "domain")  # one row
    mid = langs.withColumn("w", w["lang"]).join(top.select(F.col("domain").alias("d"), F.col("given").alias("budget")), F.col("domain").eqNullSafe(F.col("d"))).drop("d")
    mid = _shared(mid, ["domain"], "lang")
    low = cap.withColumn("w", w["source"]).join(
        mid.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("given").alias("budget")), F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))
    ).drop("d", "l")
    return _shared(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("given").cast("long").alias("budget"))


def _order(epoch) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("~"))).cast("binary"))


def mixed(
    docs: DataFrame,
    share: int = SHARE,
    max_epochs: int = EPOCHS,
    weights: dict[str, dict[str, int]] | None = None,
    domain: str = DOMAIN,
    tokens: str = TOKENS,
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, domain, lang, source, tokens, epochs) of each row: how often the mix takes it.

    The total budget is ``share`` per cent of all tokens. ``docs`` has lang and source; ``domain`` and
    ``tokens`` are SQL expressions over it. Null lang, source and domain are names of their own. Rows of
    one id and leaf are taken together, as one entry; rows without tokens are taken as often as the
    epochs that are full. An empty table gives none.
    """
    weights = WEIGHTS if weights is None else weights
    leaf = ["domain", "lang", "source"]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.expr(domain).cast("string"), F.lit("")).alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.expr(tokens).cast("long").alias("tokens"),
    )
    rows = written(rows, "mix")
    leaves = written(rows.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "leaves")
    total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * share // 100)
    plan = budgets(leaves, total, max_epochs, weights)
    plan = written(
        plan.withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).select(*leaf, "full", "rest"),
        "plan",
    )
    placed = rows.join(plan, leaf).withColumn("h", _order(F.col("full"))).withColumn("bucket", F.substring("h", 1, 4))
    placed = written(placed, "placed")
    # prefix sums in two steps: over the buckets of a leaf, then inside the one bucket where the rest ends
    inside = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy(*leaf, "bucket", "rest").agg(F.sum("tokens").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(inside))
    state = sums.select(*leaf, "bucket", (F.col("upto") - F.col("n")).alias("before"), (F.col("upto") <= F.col("rest")).alias("whole"))
    at = placed.join(state, [*leaf, "bucket"])
    cut = (~F.col("whole")) & (F.col("before") < F.col("rest"))
    same = ["id", *leaf]
    some = at.where(cut)
    entries = some.groupBy(*same, "bucket", "h", "before", "rest").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf, "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    taken = entries.withColumn("taken", F.col("before") + upto <= F.col("rest")).where("taken").select(*[F.col(c).alias(f"t_{c}") for c in same])
    out = at.where(~cut).select(*same, "tokens", (F.col("full") + F.col("whole").cast("int")).alias("epochs"))
    both = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in same]
    edge = some.join(taken, both, "left").select(*same, "tokens", (F.col("full") + F.col("t_domain").isNotNull().cast("int")).alias("epochs"))
    return out.unionByName(edge)


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as its epochs; the columns of ``docs``, whatever their names.

    Rows that share an id in one leaf are taken or left together. Null ids are one id, null lang and
    source are names of their own, and a null or empty text has no tokens: see ``mixed``. An empty table
    gives an empty one.
    """
    domain = options.get("domain", DOMAIN)
    took = mixed(docs, id_col=id_col, **options).where("epochs > 0").select("id", "domain", "lang", "source", "epochs").dropDuplicates(["id", "domain", "lang", "source"])
    own = {c: free_name(docs, base=f"took_{c}") for c in took.columns}
    took = took.select(*[F.col(c).alias(name) for c, name in own.items()])
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own["id"]))
    for c, value in (("domain", F.expr(domain)), ("lang", F.col("lang")), ("source", F.col("source"))):
        same = same & (F.coalesce(value.cast("string"), F.lit("")) == F.col(own[c]))
    copies = docs.join(took, same).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.expr(f"sequence(1L, `{own['epochs']}`)")).alias(free_name(docs, base="took_copy")))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How often the mix takes each document. Nulls, ties and repeated rows: see ``mixed``."""
    return mixed(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "domain", "lang", "source", "tokens", "epochs")


def _case(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


def _level(frm: str, parent: str, name: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    key = f"cap::DOUBLE / w, {name}"
    return f"""(SELECT *, CASE WHEN isfull THEN cap ELSE w * first(leftover ORDER BY isfull, k, {name}) OVER ({by} ORDER BY isfull, k, {name}) // first(tail ORDER BY isfull, k, {name}) OVER ({by} ORDER BY isfull, k, {name}) END AS given
  FROM (SELECT *, cap * tail <= w * leftover AS isfull, cap::DOUBLE / w AS k FROM (
    SELECT *, budget - coalesce(sum(cap) OVER ({by} ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS leftover,
      sum(w) OVER ({by} ORDER BY {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail
    FROM ({frm}))))"""


OP5_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, coalesce({DOMAIN}, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::HUGEINT AS tokens FROM documents),
leaves AS MATERIALIZED (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens, sum(tokens)::HUGEINT * {EPOCHS} AS cap FROM r GROUP BY ALL),
tot AS (SELECT sum(tokens)::HUGEINT * {SHARE} // 100 AS budget FROM leaves),
dom AS MATERIALIZED (SELECT * FROM {_level(f"SELECT domain, sum(cap)::HUGEINT AS cap, any_value(budget) AS budget, ({_case('domain')})::HUGEINT AS w FROM leaves, tot GROUP BY domain", "", "domain")}),
lng AS MATERIALIZED (SELECT * FROM {_level(f"SELECT l.domain, lang, sum(l.cap)::HUGEINT AS cap, any_value(d.given) AS budget, ({_case('lang')})::HUGEINT AS w FROM leaves l JOIN dom d USING (domain) GROUP BY l.domain, lang", "domain", "lang")}),
src AS MATERIALIZED (SELECT * FROM {_level(f"SELECT l.domain, l.lang, source, tokens, l.cap, g.given AS budget, ({_case('source')})::HUGEINT AS w FROM leaves l JOIN lng g USING (domain, lang)", "domain, lang", "source")}),
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM src),
o AS (SELECT r.*, full_, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}|' || full_ || '|' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, (full_ + (upto <= rest)::INT)::BIGINT AS epochs FROM o
"""
