"""Fairness-aware oversampling: keyed draws, index joins and neighbour tables instead of loops.

Every draw is a hash of seed, method, cell, number of the new row and purpose, so results don't depend on
partitioning. Parents are found by an equi-join on (cell, index), neighbours by one on (parent, rank).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.frame import FairFrame
from evenhand.functions.draws import pick, uniform
from evenhand.functions.ranks import indexed, numbered
from evenhand.operators.neighbors import knn, local_density, typology

#: Put before the frame's own column names while rows are made, so that none clashes with a working column.
OWN = "f__"
METHODS = ("de", "side_smote", "typology", "hetero")


@dataclass
class Oversampled:
    """``df``: original and new rows with ``is_synthetic``; ``synthetic``: the new rows with cell and number; ``plan``: needs."""

    df: DataFrame
    synthetic: DataFrame
    plan: DataFrame


def plain(name: str) -> str:
    return name.removeprefix(OWN)


def owned(ff: FairFrame) -> FairFrame:
    return FairFrame(ff.df.toDF(*[OWN + c for c in ff.df.columns]), OWN + ff.sens, OWN + ff.label, key=tuple(OWN + k for k in ff.key), priv=ff.priv, pos=ff.pos)


def _given_back(df: DataFrame) -> DataFrame:
    return df.toDF(*[plain(c) for c in df.columns])


def _cast(value: Column, kind: T.DataType) -> Column:
    return F.rint(value).cast(kind) if isinstance(kind, T.IntegralType) else value.cast(kind)


def _new_rows(plan: DataFrame, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """(cell, n, j): j from 1 to need for cells that need rows."""
    return numbered(plan.where("need > 0 AND n > 0").select(*by, "n", "need"), F.col("need"), "j", first=1).drop("need")


def _side(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(f"{prefix}key"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def _finish(ff: FairFrame, rows: DataFrame, plan: DataFrame) -> Oversampled:
    data = [c for c in ff.df.columns if c not in ff.key]
    old = ff.df.withColumn("is_synthetic", F.lit(False))
    new = rows.select(*[F.col(c).cast(ff.df.schema[c].dataType).alias(c) for c in data], F.lit(True).alias("is_synthetic"))
    return Oversampled(old.unionByName(new, allowMissingColumns=True), rows, plan)


def _need_numeric(ff: FairFrame) -> None:
    if not ff.numeric:
        raise ValueError("there is no numeric column to interpolate")


def differential(ff: FairFrame, seed: int = 42, k: int = 5, cr: float = 0.8, f: float = 0.8, clip: bool = True) -> Oversampled:
    """All cells of label and group grow to the largest: parent + f (neighbour 1 - neighbour 2), column by column.

    A column keeps the parent's value with probability 1 - cr. Numbers are clipped to the table's range
    and integers rounded half to even; other columns take one of the three values. A cell of fewer than
    three rows is duplicated. Without numeric columns, neighbours are those of the cell by key.
    """
    key, name = ff.key[0], "de"
    df = ff.df.withColumn("cell", F.concat_ws("|", F.col(ff.label).cast("string"), F.col(ff.sens).cast("string")))
    sizes = df.groupBy("cell").agg(F.count("*").alias("n"))
    plan = sizes.withColumn("need", F.max("n").over(Window.partitionBy(F.lit(1))) - F.col("n"))  # one row a cell
    columns = [*ff.numeric, *[c for c in ff.others if c not in ff.numeric], ff.sens, ff.label]
    parents = indexed(df, ["cell"], key)
    j = _new_rows(plan).withColumn("idx", pick(seed, F.col("n"), name, F.col("cell"), F.col("j"), "parent"))
    base = j.join(parents, ["cell", "idx"]).withColumn("_k", F.col(key).cast("long"))
    nn = knn(df, key, ff.numeric, k, within=["cell"], queries=base.select(key)).select(F.col("key").alias("_k"), "nn_key", "rank")
    kk = F.least(F.lit(k), F.col("n") - 1)
    i1, i2 = pick(seed, kk, name, F.col("cell"), F.col("j"), "first"), pick(seed, kk - 1, name, F.col("cell"), F.col("j"), "second")
    base = base.withColumn("i1", i1 + 1).withColumn("i2", i2 + F.when(i2 >= i1, 1).otherwise(0) + 1)
    one = nn.select("_k", F.col("rank").alias("i1"), F.col("nn_key").alias("ka"))
    two = nn.select("_k", F.col("rank").alias("i2"), F.col("nn_key").alias("kb"))
    x = base.join(one, ["_k", "i1"], "left").join(two, ["_k", "i2"], "left")
    feats = [*ff.numeric, *[c for c in ff.others if c not in ff.numeric]]
    x = x.join(_side(ff.df, key, feats, "a_"), F.col("ka") == F.col("a_key"), "left").join(_side(ff.df, key, feats, "b_"), F.col("kb") == F.col("b_key"), "left")
    if clip and ff.numeric:
        bounds = ff.df.agg(*[g(c).alias(f"{p}_{c}") for c in ff.numeric for p, g in (("lo", F.min), ("hi", F.max))])
        x = x.crossJoin(F.broadcast(bounds))  # one row
    out = []
    for c in columns:
        kind = ff.df.schema[c].dataType
        keep = (uniform(seed, name, F.col("cell"), F.col("j"), "cross", plain(c)) >= cr) | (F.col("n") < 3)
        if c in ff.numeric:
            v = F.col(c).cast("double") + F.lit(f) * (F.col(f"a_{c}").cast("double") - F.col(f"b_{c}").cast("double"))
            if clip:
                v = F.least(F.greatest(v, F.col(f"lo_{c}").cast("double")), F.col(f"hi_{c}").cast("double"))
            out.append(F.when(keep, F.col(c)).otherwise(_cast(v, kind)).alias(c))
        elif c in feats:
            u = pick(seed, F.lit(3), name, F.col("cell"), F.col("j"), "which", plain(c))
            out.append(F.when(keep | (u == 0), F.col(c)).when(u == 1, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return _finish(ff, x.select("cell", "j", *out), plan)


def side_smote(ff: FairFrame, seed: int = 42, k: int = 5) -> Oversampled:
    """Each side (privileged or not) gets minority rows until its classes are even; one factor a row for all columns.

    Majority and minority are those of the whole table; a tie changes nothing. A side of one minority row
    is duplicated.
    """
    _need_numeric(ff)
    key, name = ff.key[0], "fos"
    counts = {r[0]: r[1] for r in ff.df.groupBy(ff.label).count().collect()}  # two labels
    if len(counts) != 2:
        raise ValueError("the label must have two values")
    (low, n_low), (high, n_high) = sorted(counts.items(), key=lambda x: (x[1], str(x[0])))
    df = ff.df.withColumn("cell", F.when(ff.is_priv, "priv").otherwise("unpriv"))
    minority = F.col(ff.label) == F.lit(low)
    plan = df.groupBy("cell").agg(F.count_if(minority).alias("n"), F.count_if(~minority).alias("maj"))
    need = F.lit(0).cast("long") if n_low == n_high else F.greatest(F.col("maj") - F.col("n"), F.lit(0))
    plan = plan.withColumn("need", need.cast("long"))
    return _finish(ff, _smote_rows(ff, df.where(minority), plan, seed, k, name), plan)


def _smote_rows(ff: FairFrame, pool: DataFrame, plan: DataFrame, seed: Column | int, k: int, name: str, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """``by``: what tells cells apart. Parents are indexed by the last key of the frame, neighbours are told by the first."""
    key = ff.key[0]
    parents = indexed(pool, list(by), ff.key[-1])
    j = _new_rows(plan, by).withColumn("idx", pick(seed, F.col("n"), name, F.col("cell"), F.col("j"), "parent"))
    base = j.join(parents, [*by, "idx"]).withColumn("_k", F.col(key).cast("long"))
    nn = knn(pool, key, ff.numeric, k, within=list(by), queries=base.select(key)).select(F.col("key").alias("_k"), F.col("rank").alias("i"), F.col("nn_key").alias("ka"))
    kk = F.least(F.lit(k), F.col("n") - 1)
    x = base.withColumn("i", pick(seed, kk, name, F.col("cell"), F.col("j"), "neighbour") + 1).join(nn, ["_k", "i"], "left")
    return _interpolated(ff, x, seed, name, by)


def _interpolated(ff: FairFrame, x: DataFrame, seed: Column | int, name: str, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """New rows between a parent and the neighbour in ``ka``; without one the parent is duplicated."""
    key = ff.key[0]
    x = x.join(_side(ff.df, key, ff.others, "a_"), F.col("ka") == F.col("a_key"), "left")
    r = uniform(seed, name, F.col("cell"), F.col("j"), "r")
    out = []
    for c in [*ff.others, ff.sens, ff.label]:
        kind = ff.df.schema[c].dataType
        if c in ff.numeric:
            v = F.col(c).cast("double") + r * (F.col(f"a_{c}").cast("double") - F.col(c).cast("double"))
            out.append(F.when(F.col("ka").isNull(), F.col(c)).otherwise(_cast(v, kind)).alias(c))
        elif c in ff.others:
            u = uniform(seed, name, F.col("cell"), F.col("j"), "which", plain(c))
            out.append(F.when(F.col("ka").isNull() | (u < 0.5), F.col(c)).otherwise(F.col(f"a_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return x.select(*by, "j", *out)


def typology_need(ff: FairFrame, alpha: float = 1.0) -> int:
    """Rows to add: trunc(alpha (PP NU / NP - PU)); not below 0."""
    r = ff.df.agg(
        F.count_if(ff.is_priv & ff.is_pos).alias("pp"), F.count_if(ff.is_priv & ~ff.is_pos).alias("np"),
        F.count_if(~ff.is_priv & ff.is_pos).alias("pu"), F.count_if(~ff.is_priv & ~ff.is_pos).alias("nu"),
    ).first()
    if not r["np"] or not r["pu"]:
        return 0
    return max(0, int(alpha * (r["pp"] * r["nu"] / r["np"] - r["pu"])))


def by_typology(ff: FairFrame, seed: int = 42, alpha: float = 1.0, safe: float = 1.0, borderline: float = 1.0, rare: float = 1.0, k: int = 5) -> Oversampled:
    """New unprivileged positives from parents drawn by the weight of their kind, towards a neighbour of the same type.

    The kind is drawn first (by count times weight), then a row of it evenly, which is the same
    distribution and needs no running sum over rows. If all weights are 0, any row is as likely, and
    outliers are duplicated.
    """
    _need_numeric(ff)
    key, name = ff.key[0], "fawos"
    n = typology_need(ff, alpha)
    df = ff.df
    target = df.where(~ff.is_priv & ff.is_pos)
    weights = {"safe": safe, "borderline": borderline, "rare": rare, "outlier": 0.0}
    if n == 0:
        empty = df.limit(0).withColumn("cell", F.lit("")).withColumn("j", F.lit(0).cast("long"))
        return _finish(ff, empty, df.limit(0).select(F.lit("").alias("cell"), F.lit(0).alias("n"), F.lit(0).alias("need")))
    kinds = typology(df, key, ff.numeric, ff.label, ff.sens, target, k).persist()
    marked = target.withColumn("_k", F.col(key).cast("long")).join(kinds.select(F.col("key").alias("_k"), "kind"), "_k")
    counts = {r[0]: r[1] for r in marked.groupBy("kind").count().collect()}  # four kinds
    mass = [(t, counts.get(t, 0) * w) for t, w in weights.items()]
    if not sum(m for _, m in mass):
        mass = [(t, float(counts.get(t, 0))) for t in weights]
    total = sum(m for _, m in mass)
    j = df.sparkSession.range(1, n + 1).select(F.col("id").alias("j")).withColumn("u", uniform(seed, name, F.col("j"), "kind") * F.lit(total))
    chosen, upto = F.lit(None).cast("string"), 0.0
    for t, m in mass:
        chosen = F.when(chosen.isNull() & (F.col("u") >= upto) & (F.col("u") < upto + m), F.lit(t)).otherwise(chosen)
        upto += m
    size = F.lit(0).cast("long")
    for t, c in counts.items():
        size = F.when(F.col("kind") == t, F.lit(c).cast("long")).otherwise(size)
    j = j.withColumn("kind", chosen).withColumn("n", size).withColumn("idx", pick(seed, F.col("n"), name, F.col("j"), "parent"))
    base = j.join(indexed(marked, ["kind"], key), ["kind", "idx"]).withColumn("cell", F.lit("unpriv"))
    type_ = df.select(F.col(key).cast("long").alias("nn_key"), F.struct(F.col(ff.label).alias("y"), F.col(ff.sens).alias("s")).alias("u_"))
    nn = knn(df, key, ff.numeric, k, queries=base.select(key)).join(type_, "nn_key").join(target.select(F.col(key).cast("long").alias("key"), F.struct(F.col(ff.label).alias("y"), F.col(ff.sens).alias("s")).alias("t_")), "key")
    order = Window.partitionBy("key").orderBy("rank")
    same = nn.where("t_ = u_").select(F.col("key").alias("_k"), F.col("nn_key").alias("ka"), (F.row_number().over(order) - 1).alias("i"))
    many = same.groupBy("_k").agg(F.count("*").alias("m"))
    x = base.join(many, "_k", "left").withColumn("i", pick(seed, F.coalesce("m", F.lit(1)), name, F.col("j"), "neighbour").cast("int")).join(same, ["_k", "i"], "left")
    plan = df.sparkSession.createDataFrame([(t, counts.get(t, 0), float(m)) for t, m in mass], "cell string, n long, mass double").withColumn("need", F.lit(n))
    return _finish(ff, _interpolated(ff, x, seed, name), plan)


def heterogeneous(ff: FairFrame, seed: int = 42, k: int = 5) -> Oversampled:
    """All cells grow to the largest: from x_i towards x_j of the other class (same group) or another group (same class).

    x_new = x_i + w (x_j - x_i) maxdist(i) / d(i, j) with w uniform below the local density of i; the
    factor is 1 where d is 0. Values may leave the range of the data. Without any x_j, x_i is duplicated.
    """
    _need_numeric(ff)
    key, name = ff.key[0], "hfos"
    y, s = F.col(ff.label), F.col(ff.sens)
    df = ff.df.withColumn("cell", F.concat_ws("|", y.cast("string"), s.cast("string")))
    sizes = df.groupBy("cell", y.alias("y"), s.alias("s")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row a cell
    plan = sizes.withColumn("need", F.max("n").over(every) - F.col("n"))
    # partner cells of each cell, as ranges of one index: other class first, then other groups
    other = sizes.select(F.col("cell").alias("to"), F.col("y").alias("y2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    pairs = sizes.join(other, ((F.col("y") != F.col("y2")) & (F.col("s") == F.col("s2"))) | ((F.col("y") == F.col("y2")) & (F.col("s") != F.col("s2"))))
    pairs = pairs.withColumn("other_class", (F.col("y") != F.col("y2")).cast("int"))
    run = Window.partitionBy("cell").orderBy(F.desc("other_class"), "to").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("hi", F.sum("n2").over(run)).withColumn("lo", F.col("hi") - F.col("n2")).select(F.col("cell").alias("from"), "to", "lo", "hi")
    total = pairs.groupBy("from").agg(F.max("hi").alias("pool"))
    index = indexed(df, ["cell"], key)
    j = _new_rows(plan).withColumn("idx", pick(seed, F.col("n"), name, F.col("cell"), F.col("j"), "parent"))
    base = j.join(index, ["cell", "idx"]).withColumn("_k", F.col(key).cast("long")).join(total, F.col("cell") == F.col("from"), "left").drop("from")
    # an even draw over both pools together takes the other class with |Hy| / (|Hy| + |Hg|)
    base = base.withColumn("at", pick(seed, F.coalesce("pool", F.lit(1)), name, F.col("cell"), F.col("j"), "partner"))
    base = base.join(pairs, (F.col("cell") == F.col("from")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left").withColumn("at", F.col("at") - F.col("lo"))
    partner = index.select(F.col("cell").alias("pc"), F.col("idx").alias("pi"), *[F.col(c).alias(f"a_{c}") for c in ff.others], F.lit(True).alias("has"))
    x = base.join(partner, (F.col("to") == F.col("pc")) & (F.col("at") == F.col("pi")), "left")
    dens = local_density(df, key, ff.numeric, k, ff.label, queries=base.select(key)).withColumnRenamed("key", "_k")
    x = x.join(dens, "_k")
    d2 = F.lit(0.0)
    for c in ff.numeric:
        diff = F.col(c).cast("double") - F.col(f"a_{c}").cast("double")
        d2 = d2 + diff * diff
    x = x.withColumn("d2", d2).withColumn("w", uniform(seed, name, F.col("cell"), F.col("j"), "w") * F.col("delta"))
    factor = F.when(F.col("d2") == 0, F.lit(1.0)).otherwise(F.sqrt("max_d2") / F.sqrt("d2"))
    out = []
    for c in [*ff.others, ff.sens, ff.label]:
        kind = ff.df.schema[c].dataType
        if c in ff.numeric:
            v = F.col(c).cast("double") + F.col("w") * (F.col(f"a_{c}").cast("double") - F.col(c).cast("double")) * factor
            out.append(F.when(F.col("has").isNull(), F.col(c)).otherwise(_cast(v, kind)).alias(c))
        elif c in ff.others:
            u = uniform(seed, name, F.col("cell"), F.col("j"), "which", plain(c))
            out.append(F.when(F.col("has").isNull() | (u < 0.5), F.col(c)).otherwise(F.col(f"a_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return _finish(ff, x.select("cell", "j", *out), plan)


def oversample(ff: FairFrame, method: str, **options) -> Oversampled:
    """``method``: de, side_smote, typology or hetero. The frame needs one key column."""
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    if len(ff.key) != 1:
        raise ValueError("oversampling needs one key column")
    ff.check(binary=method != "de")
    make = {"de": differential, "side_smote": side_smote, "typology": by_typology, "hetero": heterogeneous}[method]
    out = make(owned(ff), **options)
    return Oversampled(_given_back(out.df), _given_back(out.synthetic), out.plan)
