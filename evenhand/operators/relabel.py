"""Massaging of labels near the decision boundary, and removal of rows on which group models disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.frame import FairFrame
from evenhand.functions.names import free_name
from evenhand.functions.ranks import first_by
from evenhand.operators.linear import Logistic, scored_by


def massage_count(ff: FairFrame) -> tuple[int, float]:
    """(labels to flip on each side, discrimination)."""
    r = ff.df.agg(
        F.count("*").alias("n"), F.count_if(ff.is_priv).alias("p"), F.count_if(ff.is_priv & ff.is_pos).alias("pp"), F.count_if(~ff.is_priv & ff.is_pos).alias("up")
    ).first()
    n, p = r["n"], r["p"]
    u = n - p
    if not p or not u:
        raise ValueError("a group has no rows")
    disc = r["pp"] / p - r["up"] / u
    m = round(disc * p * u / n) if disc > 0 else 0
    return max(0, min(m, u - r["up"], r["pp"])), disc


def massage(ff: FairFrame, score: Column | object | None = None) -> DataFrame:
    """``ff.df`` with m labels flipped on each side and column ``flipped``.

    Up go the unprivileged negatives of highest score, down the privileged positives of lowest; ties go
    by key. Without discrimination nothing changes. ``score`` is a column, a model or an estimator;
    default: a logistic regression on all numeric columns and the sensitive one.
    """
    ff.check()
    if len(ff.key) != 1:
        raise ValueError("massaging needs one key column")
    m, _ = massage_count(ff)
    key = ff.key[0]
    if m == 0:
        return ff.df.withColumn("flipped", F.lit(False))
    base = score if score is not None else Logistic([*ff.numeric, ff.sens], ff.label, pos=ff.pos, penalize_intercept=True)
    scored = scored_by(base, ff.df, ff.pos).select(key, "score", ff.is_priv.alias("_p"), ff.is_pos.alias("_y"))
    up = first_by(scored.where(~F.col("_p") & ~F.col("_y")), m, F.col("score"), key, ascending=False)
    down = first_by(scored.where(F.col("_p") & F.col("_y")), m, F.col("score"), key)
    k, f = free_name(ff.df, base="_k"), free_name(ff.df, base="_f")
    flips = up.select(F.col(key).alias(k)).union(down.select(F.col(key).alias(k))).withColumn(f, F.lit(True))
    neg = ff.df.where(~ff.is_pos).select(F.min(ff.label)).first()[0]
    joined = ff.df.join(flips, F.col(key) == F.col(k), "left").withColumn("flipped", F.coalesce(f, F.lit(False))).drop(k, f)
    other = F.when(ff.is_pos, F.lit(neg)).otherwise(F.lit(ff.pos)).cast(ff.df.schema[ff.label].dataType)
    return joined.withColumn(ff.label, F.when(F.col("flipped"), other).otherwise(F.col(ff.label)))


def drop_disagreements(ff: FairFrame, predictors: tuple[Column, Column] | None = None, estimator=None) -> DataFrame:
    """Rows on which the privileged group's model and the other group's model predict the same.

    ``predictors`` gives both predictions as columns; else ``estimator`` (default: logistic regression
    without the sensitive column) is fitted on each group.
    """
    if predictors is not None:
        return ff.df.where(predictors[0].eqNullSafe(predictors[1]))
    est = estimator or Logistic(ff.numeric, ff.label, pos=ff.pos, penalize_intercept=True)
    a, b = est.fit(ff.df.where(ff.is_priv)), est.fit(ff.df.where(~ff.is_priv))
    if hasattr(a, "score"):
        return ff.df.where((a.score() > 0.5) == (b.score() > 0.5))
    p, q = free_name(ff.df, base="_a"), free_name(ff.df, base="_b")
    one = a.transform(ff.df).select(*ff.df.columns, F.col("prediction").alias(p))
    two = b.transform(one).select(*ff.df.columns, p, F.col("prediction").alias(q))
    return two.where(F.col(p) == F.col(q)).drop(p, q)
