"""Registered queries over the test tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.frame import FairFrame
from evenhand.functions.draws import uniform_sql as u
from evenhand.operators import encode, masking, metrics, neighbors, optmap, oversample, prototypes, relabel, repair, rules, weights
from evenhand.plans import pipeline
from evenhand.sources.readers import decode_sex
from evenhand.streaming.monitor import fairness_monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# frames ---------------------------------------------------------------------------------------------

LI = "(SELECT (l_linestatus = 'O')::INT AS a, (l_returnflag = 'R')::INT AS y, (l_discount >= 0.05)::INT AS p FROM lineitem)"
ORD = "(SELECT o_orderkey, o_totalprice, o_orderpriority, (c_mktsegment = 'AUTOMOBILE')::INT AS a, (o_orderstatus = 'F')::INT AS y, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
REG = "(SELECT o_orderkey, o_totalprice, r_name, (r_name = 'AMERICA')::INT AS a, (c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))::INT AS s, (o_orderstatus = 'F')::INT AS y, (o_totalprice >= 150000)::INT AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
CUST = """(SELECT c_custkey, c_acctbal, coalesce(n, 0)::BIGINT AS n_orders, coalesce(cents / n / 100.0::DOUBLE, 0)::DOUBLE AS avg_price, c_mktsegment,
  (c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))::INT AS a, (c_acctbal >= 6000)::INT AS y
  FROM customer LEFT JOIN (SELECT o_custkey, count(*)::DOUBLE AS n, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS cents FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def li(spark: SparkSession, d: str) -> FairFrame:
    t = _t(spark, d, "lineitem").select(
        (F.col("l_linestatus") == "O").cast("int").alias("a"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") >= 0.05).cast("int").alias("p")
    )
    return FairFrame(t, "a", "y", "p")


def orders(spark: SparkSession, d: str) -> FairFrame:
    t = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("c_mktsegment") == "AUTOMOBILE").cast("int").alias("a"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "c_mktsegment")
    return FairFrame(t, "a", "y", key="o_orderkey")


def regions(spark: SparkSession, d: str) -> FairFrame:
    t = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    t = t.join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.select(
        "o_orderkey", "o_totalprice", "r_name", (F.col("r_name") == "AMERICA").cast("int").alias("a"), F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("s"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") >= 150000).cast("int").alias("p"),
    )
    return FairFrame(t, "a", "y", "p", key="o_orderkey")


def customers(spark: SparkSession, d: str) -> FairFrame:
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("cents"))
    c = _t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    c = c.select(
        "c_custkey", "c_acctbal", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n_orders"), F.coalesce(F.col("cents") / F.col("n") / 100.0, F.lit(0.0)).alias("avg_price"),
        "c_mktsegment", F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING").cast("int").alias("a"), (F.col("c_acctbal") >= 6000).cast("int").alias("y"),
    )
    return FairFrame(c, "a", "y", key="c_custkey")


# metrics --------------------------------------------------------------------------------------------

_CONF = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


_RATE = {
    "accuracy": _div("tp + tn", "tp + tn + fp + fn"),
    "true_positive_rate": _div("tp", "tp + fn"),
    "false_positive_rate": _div("fp", "fp + tn"),
    "true_negative_rate": _div("tn", "tn + fp"),
    "false_negative_rate": _div("fn", "tp + fn"),
}
_RATE["balanced_accuracy"] = f"(({_RATE['true_positive_rate']}) + ({_RATE['true_negative_rate']})) / 2"
_SHORT = {"accuracy": "accuracy", "true_positive_rate": "tpr", "false_positive_rate": "fpr", "true_negative_rate": "tnr", "false_negative_rate": "fnr", "balanced_accuracy": "balanced_accuracy"}

query(f"SELECT {_CONF} FROM {LI}", "confusion_counts")(lambda s, d: metrics.confusion_counts(li(s, d).df, "y", "p").select("tp", "tn", "fp", "fn"))
for _name, _sql in _RATE.items():
    query(f"SELECT {_sql} AS {_name} FROM (SELECT {_CONF} FROM {LI})", _SHORT[_name])(lambda s, d, n=_name: metrics.performance_report(li(s, d).df, "y", "p").select(n))

_BOTH = ", ".join(f"count(*) FILTER (a = {v} AND y = {y} AND p = {p}) AS {n}_{g}" for v, g in ((1, "p"), (0, "u")) for y, p, n in ((1, 1, "tp"), (0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn")))
_BOTH += ", " + ", ".join(f"count(*) FILTER (a = {v}) AS n_{g}, count(*) FILTER (a = {v} AND p = 1) AS pos_{g}" for v, g in ((1, "p"), (0, "u")))


def _rate(name: str, g: str) -> str:
    sql = _RATE[name]
    for c in ("tp", "tn", "fp", "fn"):
        sql = sql.replace(c, f"{c}_{g}")
    return f"({sql})"


_RP, _RU = _div("pos_p", "n_p"), _div("pos_u", "n_u")
_FAIR = {
    "disparate_impact": f"CASE WHEN ({_RP}) = 0 THEN CASE WHEN ({_RU}) > 0 THEN 'inf'::DOUBLE ELSE 1.0 END ELSE ({_RU}) / ({_RP}) END",
    "statistical_parity_difference": f"({_RU}) - ({_RP})",
    "equal_opportunity_difference": f"{_rate('true_positive_rate', 'u')} - {_rate('true_positive_rate', 'p')}",
    "average_odds_difference": f"(({_rate('false_positive_rate', 'u')} - {_rate('false_positive_rate', 'p')}) + ({_rate('true_positive_rate', 'u')} - {_rate('true_positive_rate', 'p')})) / 2",
    "true_negative_rate_difference": f"{_rate('true_negative_rate', 'u')} - {_rate('true_negative_rate', 'p')}",
}
_FSHORT = {"disparate_impact": "disparate_impact", "statistical_parity_difference": "stat_parity_diff", "equal_opportunity_difference": "equal_opp_diff", "average_odds_difference": "avg_odds_diff", "true_negative_rate_difference": "tnr_diff"}
_ALL = ", ".join(f"{v} AS {k}" for k, v in _FAIR.items())
for _name, _sql in _FAIR.items():
    query(f"SELECT {_sql} AS {_name} FROM (SELECT {_BOTH} FROM {LI})", _FSHORT[_name])(lambda s, d, n=_name: metrics.fairness_report(li(s, d)).select(n))
_COUNTED = "n_p AS n_priv, n_u AS n_unpriv, " + ", ".join(f"{c}_{g}" for g in "pu" for c in ("tp", "tn", "fp", "fn"))
query(f"SELECT 0::BIGINT AS invalid, {_COUNTED}, {_ALL} FROM (SELECT {_BOTH} FROM {LI})", "fairness_report")(lambda s, d: metrics.fairness_report(li(s, d)))
query(f"SELECT r_name, 0::BIGINT AS invalid, {_COUNTED}, {_ALL} FROM (SELECT r_name, {_BOTH} FROM (SELECT * REPLACE (s AS a) FROM {REG}) GROUP BY r_name)", "fairness_report_by_region")(
    lambda s, d: metrics.fairness_report(FairFrame(regions(s, d).df, "s", "y", "p"), by=["r_name"])
)

# rules ----------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN (o_totalprice >= 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR (o_orderstatus = 'F' AND o_orderpriority IS DISTINCT FROM '5-LOW') THEN 1 ELSE 0 END AS flag FROM orders")
def intersectional_flag(spark, d):
    each = [{"o_totalprice": {">=": 200000}, "o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_orderstatus": "F", "o_orderpriority": {"!=": "5-LOW"}}]
    return rules.privilege_flag(_t(spark, d, "orders"), each, "flag").select("o_orderkey", "flag")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(spark, d):
    return rules.drop_columns(_t(spark, d, "customer"), ["c_name", "c_acctbal"])


# weights --------------------------------------------------------------------------------------------

_GRID = f"""g AS (SELECT s, c, coalesce(n, 0) AS n FROM (SELECT DISTINCT a AS s FROM {ORD}) CROSS JOIN (SELECT DISTINCT y AS c FROM {ORD}) LEFT JOIN (SELECT a AS s, y AS c, count(*) AS n FROM {ORD} GROUP BY ALL) USING (s, c))"""
_RW = f"""WITH {_GRID}, q AS (SELECT s, c, n::BIGINT AS n, sum(n) OVER (PARTITION BY s) / sum(n) OVER () AS p_s, sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS p_c, n / sum(n) OVER () AS p_joint FROM g)
SELECT *, p_s * p_c AS p_expected, CASE WHEN n = 0 THEN 0.0 ELSE p_s * p_c / p_joint END AS weight FROM q"""
query(_RW, "reweighing_table")(lambda s, d: weights.reweighing_table(orders(s, d)))
query(f"SELECT o_orderkey, weight FROM {ORD} JOIN ({_RW}) ON a = s AND y = c", "reweighing_rows")(lambda s, d: weights.reweigh(orders(s, d)).select("o_orderkey", "weight"))
query(f"SELECT o_orderkey, (count(*) OVER (PARTITION BY a))::DOUBLE / count(*) OVER (PARTITION BY a, y) AS weight FROM {ORD}", "fairbalance_rows")(lambda s, d: weights.fair_balance(orders(s, d)).select("o_orderkey", "weight"))
query(f"SELECT o_orderkey, (count(*) OVER ())::DOUBLE / ((SELECT count(*) FROM (SELECT DISTINCT a, y FROM {ORD})) * count(*) OVER (PARTITION BY a, y)) AS weight FROM {ORD}", "fairbalance_variant_rows")(
    lambda s, d: weights.fair_balance(orders(s, d), variant=True).select("o_orderkey", "weight")
)

# labels and rows ------------------------------------------------------------------------------------


@query(f"""
WITH f AS MATERIALIZED (SELECT * FROM {REG}),
c AS (SELECT count(*) AS n, sum(a) AS p, count(*) - sum(a) AS q, sum(a * y) AS pp, sum((1 - a) * y) AS up FROM f),
m AS (SELECT CASE WHEN disc > 0 THEN greatest(0, least(round_even(disc * p * q / n, 0)::BIGINT, q - up, pp)) ELSE 0 END AS m FROM (SELECT *, pp::DOUBLE / p - up::DOUBLE / q AS disc FROM c)),
k AS (SELECT o_orderkey, y, CASE WHEN a = 0 AND y = 0 THEN row_number() OVER (PARTITION BY a, y ORDER BY o_totalprice DESC, o_orderkey) WHEN a = 1 AND y = 1 THEN row_number() OVER (PARTITION BY a, y ORDER BY o_totalprice, o_orderkey) END AS r FROM f)
SELECT o_orderkey, CASE WHEN r <= m THEN 1 - y ELSE y END AS y, coalesce(r <= m, false) AS flipped FROM k, m""")
def massaging_score_ranked(spark, d):
    return relabel.massage(regions(spark, d), F.col("o_totalprice")).select("o_orderkey", "y", "flipped")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_quantity * 2 - l_discount * 100 > 40) = (l_quantity * 1.5 - l_discount * 50 > 35)")
def disagreement_filter_linear(spark, d):
    t = _t(spark, d, "lineitem").withColumn("a", (F.col("l_linestatus") == "O").cast("int")).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    one = F.col("l_quantity") * 2 - F.col("l_discount") * 100 > 40
    two = F.col("l_quantity") * 1.5 - F.col("l_discount") * 50 > 35
    return relabel.drop_disagreements(FairFrame(t, "a", "y"), (one, two)).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# features -------------------------------------------------------------------------------------------

_REPAIR = """
WITH r AS MATERIALIZED (SELECT c_custkey, c_mktsegment AS s, c_acctbal AS v, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal RANGE UNBOUNDED PRECEDING) - 1 AS r,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
z AS (SELECT min(n) AS b FROM r),
k AS MATERIALIZED (SELECT r.*, least(b - 1, (r * b) // (n - 1)) AS bucket FROM r, z),
e AS (SELECT g.s AS s, g.j AS j, x.v + frac * (y.v - x.v) AS q FROM (SELECT s, n, unnest(range(0, b + 1)) AS j, b FROM (SELECT DISTINCT s, n FROM r), z) g,
  LATERAL (SELECT ((n - 1) * j) // b AS lo, (((n - 1) * j) % b) / b::DOUBLE AS frac) h JOIN r x ON x.s = g.s JOIN r y ON y.s = g.s WHERE x.i = lo AND y.i = least(lo + 1, g.n - 1)),
m AS (SELECT s, bucket, median(v) AS m FROM k GROUP BY ALL),
t AS MATERIALIZED (SELECT e0.j AS bucket, median(coalesce(m.m, (e0.q + e1.q) / 2)) AS target FROM e e0 JOIN e e1 ON e0.s = e1.s AND e1.j = e0.j + 1 LEFT JOIN m ON m.s = e0.s AND m.bucket = e0.j GROUP BY e0.j)
"""
query(_REPAIR + "SELECT bucket::BIGINT AS bucket, round(target, 6) AS target FROM t", "repair_targets")(
    lambda s, d: repair.repair_targets(_t(s, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey").select("bucket", F.round("target", 6).alias("target"))
)
for _key, _lam in (("repair_apply", 1.0), ("repair_partial", 0.5)):
    query(_REPAIR + f"SELECT c_custkey, round({1 - _lam} * v + {_lam} * target, 6) AS c_acctbal FROM k JOIN t USING (bucket)", _key)(
        lambda s, d, lam=_lam: repair.QuantileRepair("c_mktsegment", ["c_acctbal"], "c_custkey", lam).fit_transform(_t(s, d, "customer")).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))
    )

# fitted on the customers of some nations, applied to all: new rows are clipped to their group's range and looked up
query(
    _REPAIR.replace("AS n FROM customer)", "AS n FROM customer WHERE c_nationkey < 10)")
    + """, x AS (SELECT c_custkey, c_mktsegment AS s, least(greatest(c_acctbal, lo), hi) AS v
  FROM customer JOIN (SELECT s, min(q) AS lo, max(q) AS hi FROM e GROUP BY s) ON s = c_mktsegment),
i AS (SELECT s, j, q FROM e, z WHERE j > 0 AND j < b),
w AS (SELECT x.c_custkey, coalesce(max(j), 0) AS bucket FROM x LEFT JOIN i ON i.s = x.s AND q <= v GROUP BY x.c_custkey)
SELECT c_custkey, round(target, 6) AS c_acctbal FROM w JOIN t USING (bucket)""",
    "repair_transform",
)(
    lambda s, d: repair.QuantileRepair("c_mktsegment", ["c_acctbal"], "c_custkey").fit(_t(s, d, "customer").where("c_nationkey < 10")).transform(_t(s, d, "customer"))
    .select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))
)

PROTOS = [[0.1, 0.5], [0.6, 1.2], [0.9, 0.2]]
_E = [f"exp(-(sqrt((z1 - {a}) * (z1 - {a}) + (z2 - {b}) * (z2 - {b}))))" for a, b in PROTOS]
_LFR = ", ".join("round((" + " + ".join(f"{e} * {p[j]}" for e, p in zip(_E, PROTOS, strict=True)) + ") / (" + " + ".join(_E) + f"), 6) AS z{j + 1}" for j in range(2))


@query(f"SELECT c_custkey, {_LFR} FROM (SELECT c_custkey, c_acctbal / 10000.0::DOUBLE AS z1, n_orders / 10.0::DOUBLE AS z2 FROM {CUST})")
def lfr_transform(spark, d):
    t = customers(spark, d).df.select("c_custkey", (F.col("c_acctbal") / 10000.0).alias("z1"), (F.col("n_orders") / 10.0).alias("z2"))
    return prototypes.represent(t, ["z1", "z2"], PROTOS).select("c_custkey", F.round("z1", 6).alias("z1"), F.round("z2", 6).alias("z2"))


# neighbours -----------------------------------------------------------------------------------------

_D2 = "(x.c_acctbal - q.c_acctbal) * (x.c_acctbal - q.c_acctbal) + (x.n_orders - q.n_orders)::DOUBLE * (x.n_orders - q.n_orders) + (x.avg_price - q.avg_price) * (x.avg_price - q.avg_price)"
FEATS = ["c_acctbal", "n_orders", "avg_price"]


def _nn(frm: str, k: int, within: str = "") -> str:
    on = "AND " + " AND ".join(f"x.{c} IS NOT DISTINCT FROM q.{c}" for c in within.split()) if within else ""
    return f"""(SELECT x.c_custkey AS key, q.c_custkey AS nn_key, {_D2} AS d2, row_number() OVER (PARTITION BY x.c_custkey ORDER BY {_D2}, q.c_custkey) AS rank
    FROM {frm} x JOIN {frm} q ON x.c_custkey <> q.c_custkey {on} QUALIFY rank <= {k})"""


query(f"WITH f AS MATERIALIZED (SELECT * FROM {CUST}) SELECT key, nn_key, rank::INTEGER AS rank, d2 FROM {_nn('f', 3, 'c_mktsegment')}", "knn_join")(
    lambda s, d: neighbors.knn(customers(s, d).df, "c_custkey", FEATS, 3, within=["c_mktsegment"])
)
_DENS = "(SELECT key, CASE WHEN count(*) FILTER (p.y <> o.y) = 0 THEN 0.1 ELSE count(*) FILTER (p.y <> o.y)::DOUBLE / count(*) END AS delta, max(d2) AS max_d2 FROM nn JOIN f p ON p.c_custkey = key JOIN f o ON o.c_custkey = nn_key GROUP BY key)"
query(f"WITH f AS MATERIALIZED (SELECT * FROM {CUST}), nn AS MATERIALIZED (SELECT * FROM {_nn('f', 5)}) SELECT * FROM {_DENS}", "local_density")(
    lambda s, d: neighbors.local_density(customers(s, d).df, "c_custkey", FEATS, 5, "y")
)
_TYPE = f"""f AS MATERIALIZED (SELECT * FROM {CUST}), nn AS MATERIALIZED (SELECT * FROM {_nn('f', 5)}),
sm AS MATERIALIZED (SELECT key, count(*) FILTER (p.y = o.y AND p.a = o.a) AS same, min(nn_key) FILTER (p.y = o.y AND p.a = o.a) AS only_ FROM nn JOIN f p ON p.c_custkey = key JOIN f o ON o.c_custkey = nn_key GROUP BY key),
ty AS MATERIALIZED (SELECT x.key, x.same, CASE WHEN x.same >= 4 THEN 'safe' WHEN x.same >= 2 THEN 'borderline' WHEN x.same = 0 THEN 'outlier' WHEN z.same = 0 OR (z.same = 1 AND z.only_ = x.key) THEN 'rare' ELSE 'borderline' END AS kind
  FROM sm x LEFT JOIN sm z ON z.key = x.only_ JOIN f ON c_custkey = x.key WHERE f.a = 0 AND f.y = 1)"""
query(f"WITH {_TYPE} SELECT key, same, kind FROM ty", "typology")(
    lambda s, d: (lambda ff: neighbors.typology(ff.df, "c_custkey", FEATS, "y", "a", ff.df.where("a = 0 AND y = 1")))(customers(s, d))
)

# oversampling ---------------------------------------------------------------------------------------


def _cust(spark, d) -> FairFrame:
    ff = customers(spark, d)
    return ff.with_df(ff.df.drop("c_mktsegment"))


_IDX = "row_number() OVER (PARTITION BY {0} ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1"


def _pick(seed_tags: str, n: str) -> str:
    return f"floor({seed_tags} * {n})::BIGINT"


_OUT = ["c_acctbal", "n_orders", "avg_price", "a", "y"]


def _num(expr: str, c: str) -> str:
    return f"round_even({expr}, 0)::BIGINT" if c == "n_orders" else expr


def _de_col(c: str) -> str:
    v = f"least(greatest(b.{c}::DOUBLE + 0.8::DOUBLE * (n1.{c}::DOUBLE - n2.{c}::DOUBLE), (SELECT min({c})::DOUBLE FROM f)), (SELECT max({c})::DOUBLE FROM f))"
    return f"CASE WHEN {u(42, quote('de'), 'b.cell', 'j', quote('cross'), quote(c))} >= 0.8 OR n < 3 THEN b.{c} ELSE {_num(v, c)} END AS {c}"


def quote(s: str) -> str:
    return f"'{s}'"


_DE = f"""
WITH f AS MATERIALIZED (SELECT *, concat_ws('|', y, a) AS cell FROM {CUST}),
ix AS MATERIALIZED (SELECT *, {_IDX.format('cell')} AS idx FROM f),
pl AS (SELECT cell, n, max(n) OVER () - n AS need FROM (SELECT cell, count(*) AS n FROM f GROUP BY cell)),
js AS (SELECT cell, n, unnest(range(1, need + 1)) AS j FROM pl WHERE need > 0),
b AS MATERIALIZED (SELECT ix.*, n, j, {_pick(u(42, "'de'", 'js.cell', 'j', "'first'"), 'least(5, n - 1)')} AS i1, {_pick(u(42, "'de'", 'js.cell', 'j', "'second'"), '(least(5, n - 1) - 1)')} AS i2
  FROM js JOIN ix ON ix.cell = js.cell AND ix.idx = {_pick(u(42, "'de'", 'js.cell', 'j', "'parent'"), 'n')}),
nn AS MATERIALIZED (SELECT * FROM {_nn('f', 5, 'cell')})
SELECT b.cell, j, {', '.join(_de_col(c) for c in _OUT[:3])}, b.a, b.y FROM b
LEFT JOIN nn k1 ON k1.key = b.c_custkey AND k1.rank = i1 + 1 LEFT JOIN nn k2 ON k2.key = b.c_custkey AND k2.rank = i2 + (i2 >= i1)::INT + 1
LEFT JOIN f n1 ON n1.c_custkey = k1.nn_key LEFT JOIN f n2 ON n2.c_custkey = k2.nn_key"""
query(f"SELECT {', '.join(_OUT)}, FALSE AS is_synthetic FROM {CUST} UNION ALL SELECT {', '.join(_OUT)}, TRUE FROM ({_DE})", "fair_smote_union")(
    lambda s, d: oversample.oversample(_cust(s, d), "de").df.select(*_OUT, "is_synthetic")
)
query(_DE, "fair_smote")(lambda s, d: oversample.oversample(_cust(s, d), "de").synthetic.select("cell", "j", *_OUT))


def _between(name: str, has: str = "n1.c_custkey") -> str:
    r = u(42, f"'{name}'", "b.cell", "j", "'r'")
    return ", ".join(f"CASE WHEN {has} IS NULL THEN b.{c} ELSE {_num(f'b.{c}::DOUBLE + {r} * (n1.{c}::DOUBLE - b.{c}::DOUBLE)', c)} END AS {c}" for c in _OUT[:3])


_FOS = f"""
WITH f0 AS MATERIALIZED (SELECT *, CASE WHEN a = 1 THEN 'priv' ELSE 'unpriv' END AS cell FROM {CUST}),
lo AS (SELECT y AS low, tie FROM (SELECT y, count(*) AS n, count(*) OVER (PARTITION BY count(*)) > 1 AS tie FROM f0 GROUP BY y) ORDER BY n, y LIMIT 1),
pl AS (SELECT cell, count(*) FILTER (y = low) AS n, CASE WHEN any_value(tie) THEN 0 ELSE greatest(count(*) FILTER (y <> low) - count(*) FILTER (y = low), 0) END AS need FROM f0, lo GROUP BY cell),
f AS MATERIALIZED (SELECT f0.* FROM f0, lo WHERE y = low),
ix AS MATERIALIZED (SELECT *, {_IDX.format('cell')} AS idx FROM f),
js AS (SELECT cell, n, unnest(range(1, need + 1)) AS j FROM pl WHERE need > 0 AND n > 0),
b AS MATERIALIZED (SELECT ix.*, n, j, {_pick(u(42, "'fos'", 'js.cell', 'j', "'neighbour'"), 'least(5, n - 1)')} + 1 AS i FROM js JOIN ix ON ix.cell = js.cell AND ix.idx = {_pick(u(42, "'fos'", 'js.cell', 'j', "'parent'"), 'n')}),
nn AS MATERIALIZED (SELECT * FROM {_nn('f', 5, 'cell')})
SELECT b.cell, j, {_between('fos')}, b.a, b.y FROM b LEFT JOIN nn ON nn.key = b.c_custkey AND nn.rank = i LEFT JOIN f n1 ON n1.c_custkey = nn.nn_key"""
query(_FOS, "fos")(lambda s, d: oversample.oversample(_cust(s, d), "side_smote").synthetic.select("cell", "j", *_OUT))

_FAWOS = f"""
WITH {_TYPE},
cn AS (SELECT count(*) FILTER (a = 1 AND y = 1) AS pp, count(*) FILTER (a = 1 AND y = 0) AS np, count(*) FILTER (a = 0 AND y = 1) AS pu, count(*) FILTER (a = 0 AND y = 0) AS nu FROM f),
need AS (SELECT greatest(0, trunc(pp * nu / np::DOUBLE - pu)::BIGINT) AS need FROM cn),
ms AS (SELECT kind, o, n, CASE WHEN kind = 'outlier' THEN 0 ELSE n END AS m FROM (SELECT k.kind, o, count(ty.key) AS n FROM (VALUES ('safe', 1), ('borderline', 2), ('rare', 3), ('outlier', 4)) k(kind, o) LEFT JOIN ty ON ty.kind = k.kind GROUP BY ALL)),
m2 AS (SELECT kind, o, n, CASE WHEN sum(m) OVER () = 0 THEN n ELSE m END::DOUBLE AS m FROM ms),
cm AS (SELECT *, sum(m) OVER (ORDER BY o) AS hi, sum(m) OVER () AS total FROM m2),
js AS (SELECT j, kind, n, floor({u(42, "'fawos'", 'j', "'parent'")} * n)::BIGINT AS idx FROM (SELECT unnest(range(1, need + 1)) AS j FROM need) JOIN cm ON {u(42, "'fawos'", 'j', "'kind'")} * total >= hi - m AND {u(42, "'fawos'", 'j', "'kind'")} * total < hi),
ix AS MATERIALIZED (SELECT f.*, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(c_custkey::VARCHAR), c_custkey) - 1 AS idx FROM ty JOIN f ON c_custkey = key),
sn AS MATERIALIZED (SELECT key, nn_key, row_number() OVER (PARTITION BY key ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY key) AS m FROM nn JOIN f p ON p.c_custkey = key JOIN f o ON o.c_custkey = nn_key WHERE p.y = o.y AND p.a = o.a),
b AS (SELECT 'unpriv' AS cell, j, ix.* EXCLUDE (idx) FROM js JOIN ix ON ix.kind = js.kind AND ix.idx = js.idx)
SELECT b.cell, j, {_between('fawos')}, b.a, b.y FROM b LEFT JOIN sn ON sn.key = b.c_custkey AND sn.i = floor({u(42, "'fawos'", 'j', "'neighbour'")} * sn.m)::BIGINT LEFT JOIN f n1 ON n1.c_custkey = sn.nn_key"""
query(_FAWOS, "fawos")(lambda s, d: oversample.oversample(_cust(s, d), "typology").synthetic.select("cell", "j", *_OUT))

_HD = "((b.c_acctbal - n1.c_acctbal) * (b.c_acctbal - n1.c_acctbal) + (b.n_orders - n1.n_orders)::DOUBLE * (b.n_orders - n1.n_orders) + (b.avg_price - n1.avg_price) * (b.avg_price - n1.avg_price))"


def _hcol(c: str) -> str:
    w = f"{u(42, quote('hfos'), 'b.cell', 'j', quote('w'))} * delta"
    v = f"b.{c}::DOUBLE + {w} * (n1.{c}::DOUBLE - b.{c}::DOUBLE) * CASE WHEN {_HD} = 0 THEN 1.0::DOUBLE ELSE sqrt(max_d2) / sqrt({_HD}) END"
    return f"CASE WHEN n1.c_custkey IS NULL THEN b.{c} ELSE {_num(v, c)} END AS {c}"


_HFOS = f"""
WITH f AS MATERIALIZED (SELECT *, concat_ws('|', y, a) AS cell FROM {CUST}), nn AS MATERIALIZED (SELECT * FROM {_nn('f', 5)}),
dn AS MATERIALIZED (SELECT * FROM {_DENS}),
ix AS MATERIALIZED (SELECT *, {_IDX.format('cell')} AS idx FROM f),
sz AS MATERIALIZED (SELECT cell, y, a, count(*) AS n FROM f GROUP BY ALL),
pr AS (SELECT x.cell AS frm, z.cell AS dest, z.n AS n2, sum(z.n) OVER (PARTITION BY x.cell ORDER BY x.y = z.y, z.cell) AS hi, sum(z.n) OVER (PARTITION BY x.cell) AS pool FROM sz x JOIN sz z ON (x.y <> z.y AND x.a = z.a) OR (x.y = z.y AND x.a <> z.a)),
js AS (SELECT cell, n, unnest(range(1, need + 1)) AS j FROM (SELECT cell, n, max(n) OVER () - n AS need FROM sz) WHERE need > 0),
b AS MATERIALIZED (SELECT ix.*, j FROM js JOIN ix ON ix.cell = js.cell AND ix.idx = {_pick(u(42, "'hfos'", 'js.cell', 'j', "'parent'"), 'n')})
SELECT b.cell, j, {', '.join(_hcol(c) for c in _OUT[:3])}, b.a, b.y FROM b JOIN dn ON dn.key = b.c_custkey
LEFT JOIN pr ON frm = b.cell AND {_pick(u(42, "'hfos'", 'b.cell', 'j', "'partner'"), 'pool')} >= hi - n2 AND {_pick(u(42, "'hfos'", 'b.cell', 'j', "'partner'"), 'pool')} < hi
LEFT JOIN ix n1 ON n1.cell = dest AND n1.idx = {_pick(u(42, "'hfos'", 'b.cell', 'j', "'partner'"), 'pool')} - (hi - n2)"""
query(_HFOS, "hfos")(lambda s, d: oversample.oversample(_cust(s, d), "hetero").synthetic.select("cell", "j", *_OUT))

# mapping and masking --------------------------------------------------------------------------------

query(f"SELECT a, o_orderpriority, y, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / (SELECT count(*) FROM {ORD}) AS p FROM (SELECT DISTINCT a FROM {ORD}) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM {ORD}) CROSS JOIN (SELECT DISTINCT y FROM {ORD}) LEFT JOIN (SELECT a, o_orderpriority, y, count(*) AS n FROM {ORD} GROUP BY ALL) USING (a, o_orderpriority, y)", "joint_distribution")(
    lambda s, d: optmap.joint_distribution(orders(s, d), ["o_orderpriority"])
)


def optmap_apply(spark, d):
    """A fixed mapping of urgent orders: keep, move to low priority, or flip the label; other cells aren't mapped."""
    options = {0: [("1-URGENT", 0, 0.5), ("1-URGENT", 1, 0.25), ("5-LOW", 0, 0.25)], 1: [("1-URGENT", 0, 0.25), ("1-URGENT", 1, 0.5), ("5-LOW", 1, 0.25)]}
    rows = [(a, "1-URGENT", y, *new) for a in (0, 1) for y, each in options.items() for new in each]
    mapping = spark.createDataFrame(rows, "a int, o_orderpriority string, y int, new_o_orderpriority string, new_y int, p double")
    return optmap.apply_mapping(orders(spark, d).df, mapping, "a", ["o_orderpriority"], "y", "o_orderkey").select("o_orderkey", "o_orderpriority", "y")


QUERIES["optmap_apply"] = optmap_apply
ORACLE_SQL["optmap_apply"] = f"""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND r >= 0.75 THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority,
CASE WHEN o_orderpriority = '1-URGENT' AND y = 0 AND r >= 0.5 AND r < 0.75 THEN 1 WHEN o_orderpriority = '1-URGENT' AND y = 1 AND r < 0.25 THEN 0 ELSE y END AS y
FROM (SELECT *, {u(42, "'optmap'", 'o_orderkey')} AS r FROM {ORD})"""


@query(f"SELECT o_orderkey, CASE WHEN 0.5 * (o_totalprice > 150000)::INT + 0.3 * (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INT + 0.2 * (y = 1)::INT > 0.5 * (o_totalprice <= 150000)::INT + 0.3 * (o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))::INT + 0.2 * (y = 0)::INT THEN 1 ELSE 0 END AS vote FROM {ORD}")
def mask_vote(spark, d):
    votes = [(F.col("o_totalprice") > 150000).cast("int"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"), F.col("y")]
    return orders(spark, d).df.select("o_orderkey", masking.weighted_vote(votes, [0.5, 0.3, 0.2], [0, 1]).alias("vote"))


# exploration and experiments ------------------------------------------------------------------------

query(f"SELECT a AS grp, y AS label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY a) AS share FROM {ORD} GROUP BY a, y", "outcome_crosstab")(lambda s, d: pipeline.outcome_crosstab(orders(s, d).df, "a", "y"))
query("SELECT o_orderpriority AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY o_orderpriority", "value_shares")(lambda s, d: pipeline.value_shares(_t(s, d, "orders"), "o_orderpriority"))
query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c}::VARCHAR = '?') AS placeholders FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), "null_profile")(
    lambda s, d: pipeline.null_profile(_t(s, d, "customer"))
)
_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]
query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min,
  {', '.join(f'round(quantile_cont({c}::DOUBLE, {q / 100}), 6) AS q{q}' for q in (25, 50, 75))}, max({c})::DOUBLE AS max FROM customer"""
        for c in _NUMERIC
    ),
    "numeric_summary",
)(lambda s, d: pipeline.numeric_summary(_t(s, d, "customer")).select("column", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]))
query(
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", sum(n)::BIGINT AS count, count(*) AS "unique", arg_min(v, (-n, v)) AS top, max(n) AS freq FROM (SELECT {c} AS v, count(*) AS n FROM customer WHERE {c} IS NOT NULL GROUP BY {c}))"""
        for c in ("c_name", "c_mktsegment")
    ),
    "object_summary",
)(lambda s, d: pipeline.object_summary(_t(s, d, "customer")))


def _region_results(spark, d) -> DataFrame:
    wide = metrics.fairness_report(FairFrame(regions(spark, d).df, "s", "y", "p"), by=["r_name"])
    return wide.select(F.col("r_name").alias("method"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in _FAIR])).alias("x")).select("method", "x.metric", "x.mean")


query(
    f"SELECT r_name AS method, {', '.join(_FAIR)}, abs(statistical_parity_difference) AS abs_spd FROM (SELECT r_name, {_ALL} FROM (SELECT r_name, {_BOTH} FROM (SELECT * REPLACE (s AS a) FROM {REG}) GROUP BY r_name))",
    "results_pivot",
)(lambda s, d: pipeline.results_pivot(_region_results(s, d)))
_DRAW = "row_number() OVER (PARTITION BY y ORDER BY {0}, o_orderkey) - 1"
query(f"SELECT o_orderkey, ({_DRAW.format(u(42, quote('split'), 'o_orderkey'))}) < (count(*) OVER (PARTITION BY y) * 20 + 99) // 100 AS is_test FROM {ORD}", "train_val_split")(
    lambda s, d: pipeline.stratified_split(orders(s, d).df, "y", "o_orderkey").select("o_orderkey", "is_test")
)
query(f"SELECT o_orderkey, (({_DRAW.format(u(42, quote('fold'), 'o_orderkey'))}) % 5)::INTEGER AS fold FROM {ORD}", "stratified_folds")(
    lambda s, d: pipeline.stratified_folds(orders(s, d).df, "y", "o_orderkey", 5).select("o_orderkey", "fold")
)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '4-NOT SPECIFIED') THEN 1 ELSE 0 END AS sex, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS target FROM orders")
def german_like_decode(spark, d):
    code = F.create_map(*[F.lit(x) for p in (("1-URGENT", "A91"), ("2-HIGH", "A92"), ("3-MEDIUM", "A93"), ("4-NOT SPECIFIED", "A94"), ("5-LOW", "A95")) for x in p])
    t = _t(spark, d, "orders").withColumn("personal_status", F.get(F.array(F.element_at(code, F.col("o_orderpriority"))), F.lit(0)))
    return t.select("o_orderkey", decode_sex().alias("sex"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("target"))


@query(f"""SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / CASE WHEN stddev_samp(c_acctbal) OVER () = 0 THEN 1 ELSE stddev_samp(c_acctbal) OVER () END, 6) AS c_acctbal,
{', '.join(f"c_mktsegment = '{v}' AS c_mktsegment_{v}" for v in ('BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM customer""")
def standardize_onehot(spark, d):
    t = _t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return encode.standardize_onehot(t, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (a = 1) AS n_priv, count(*) FILTER (a = 0) AS n_unpriv, count(*) FILTER (a = 1 AND p = 1) AS pos_priv, count(*) FILTER (a = 0 AND p = 1) AS pos_unpriv,
CASE WHEN count(*) FILTER (a = 0) = 0 THEN 0.0 ELSE count(*) FILTER (a = 0 AND p = 1)::DOUBLE / count(*) FILTER (a = 0) END - CASE WHEN count(*) FILTER (a = 1) = 0 THEN 0.0 ELSE count(*) FILTER (a = 1 AND p = 1)::DOUBLE / count(*) FILTER (a = 1) END AS parity_difference
FROM (SELECT ts, (user_id % 2)::INT AS a, (value >= 10)::INT AS p FROM events) GROUP BY 1""")
def fairness_windows(spark, d):
    t = _t(spark, d, "events").select("ts", (F.col("user_id") % 2).cast("int").alias("a"), (F.col("value") >= 10).cast("int").alias("p"))
    return fairness_monitor(t, "ts", "a", "p").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# model fits -----------------------------------------------------------------------------------------


def _scaled(spark, d) -> FairFrame:
    ff = customers(spark, d)
    t = ff.df.select("c_custkey", (F.col("n_orders") / 10.0).alias("x1"), (F.col("avg_price") / 100000.0).alias("x2"), "a", "y")
    return ff.with_df(t)


@query()
def reweighing_classifier(spark, d):
    ff = _scaled(spark, d)
    m = weights.WeightedFairClassifier(scheme="reweighing", sens="a", label="y", features=["x1", "x2", "a"]).fit(ff.df)
    return m.transform(ff.df).select("c_custkey", "score", "prediction")


@query()
def fairbalance_classifier(spark, d):
    ff = _scaled(spark, d)
    m = weights.WeightedFairClassifier(scheme="balance", sens="a", label="y", features=["x1", "x2", "a"]).fit(ff.df)
    return m.transform(ff.df).select("c_custkey", "score", "prediction")


@query()
def massaging_lr(spark, d):
    return relabel.massage(_scaled(spark, d)).select("c_custkey", "y", "flipped")


@query()
def fairway_lr(spark, d):
    return relabel.drop_disagreements(_scaled(spark, d)).select("c_custkey", "a", "y")


@query()
def fairmask(spark, d):
    ff = _scaled(spark, d)
    m = masking.MaskedClassifier("c_custkey").fit(ff)
    return m.transform(ff.df).select("c_custkey", F.col("a").alias("masked"), "prediction")


@query()
def lfr_fit(spark, d):
    ff = _scaled(spark, d)
    m = prototypes.PrototypeRepresentation(k=3).fit(ff)
    return m.transform(ff.df).select("c_custkey", "x1", "x2")


@query()
def optmap_fit(spark, d):
    ff = orders(spark, d)
    t = ff.df.select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"), "a", "y")
    ff = FairFrame(t.withColumn("prio", F.when(F.col("prio") <= 2, 1).otherwise(2)), "a", "y", key="o_orderkey")
    m = optmap.RandomizedMap(["prio"], lambda o, n: float(abs(o["prio"] - n["prio"]) + abs(o["y"] - n["y"]))).fit(ff)
    return m.apply(ff.df, "o_orderkey").select("o_orderkey", "prio", "y")
