"""Pipelines that know train-only stages, and cross-validation as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.frame import FairFrame
from evenhand.functions.draws import uniform
from evenhand.functions.names import free_name
from evenhand.functions.ranks import ranked
from evenhand.operators.metrics import FAIRNESS, fairness_report, performance_report


@dataclass
class TrainOnly:
    """A sampler, weighter or relabeller: a function of the training frame, skipped when the model is applied."""

    run: Callable[[DataFrame], DataFrame]


class FairPipeline:
    """Stages in order: TrainOnly, estimators (fit, then transform) and transformers (transform)."""

    def __init__(self, stages: list):
        self.stages = list(stages)

    def fit(self, df: DataFrame) -> FairPipelineModel:
        fitted = []
        for i, stage in enumerate(self.stages):
            if isinstance(stage, TrainOnly):
                df = stage.run(df)
                continue
            model = stage.fit(df) if hasattr(stage, "fit") else stage
            fitted.append(model)
            if i + 1 < len(self.stages):
                df = stage.fit_transform(df) if hasattr(stage, "fit_transform") else model.transform(df)
        return FairPipelineModel(fitted)


class FairPipelineModel:
    def __init__(self, stages: list):
        self.stages = stages

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.stages:
            df = s.transform(df)
        return df


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 to k - 1, dealt evenly inside each label in the order of a keyed draw."""
    draw, rank = free_name(df, base="_draw"), free_name(df, base="_rank")
    r = ranked(df.withColumn(draw, uniform(seed, "fold", F.col(key))), [label], draw, key, out=rank, even=True)
    return r.withColumn(out, (F.col(rank) % k).cast("int")).drop(draw, rank)


def stratified_split(df: DataFrame, label: str, key: str, share: int = 20, seed: int = 42, out: str = "is_test") -> DataFrame:
    """``df`` with ``out``: the first ceil(share % of n) rows of each label by a keyed draw."""
    draw, rank, cut = (free_name(df, base=x) for x in ("_draw", "_rank", "_cut"))
    r = ranked(df.withColumn(draw, uniform(seed, "split", F.col(key))), [label], draw, key, out=rank, even=True)
    sizes = df.groupBy(label).agg(F.expr(f"(count(*) * {share} + 99) div 100").alias(cut))
    return r.join(sizes, label).withColumn(out, F.col(rank) < F.col(cut)).drop(draw, rank, cut)


def cross_validate(ff: FairFrame, make: Callable[[], FairPipeline], k: int = 5, seed: int = 42, name: str = "method") -> DataFrame:
    """(method, metric, mean, std): k folds, metrics on the held-out rows; std is the population's."""
    folds = stratified_folds(ff.df, ff.label, ff.key[0], k, seed).persist()
    rows = []
    for i in range(k):
        model = make().fit(folds.where(F.col("fold") != i).drop("fold"))
        out = model.transform(folds.where(F.col("fold") == i).drop("fold"))
        got = FairFrame(out, ff.sens, ff.label, "prediction", ff.key, ff.priv, ff.pos)
        perf, fair = performance_report(out, ff.label, "prediction").first(), fairness_report(got).first()
        rows += [(name, m, float(perf[m])) for m in ("accuracy", "balanced_accuracy")] + [(name, m, float(fair[m])) for m in FAIRNESS]
    folds.unpersist()
    out = ff.df.sparkSession.createDataFrame(rows, "method string, metric string, value double")
    return out.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def null_profile(df: DataFrame, placeholder: str = "?") -> DataFrame:
    """(column, nulls, placeholders) in one scan."""
    pairs = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c).cast("string") == placeholder).alias("placeholders")) for c in df.columns]
    return df.agg(F.array(*pairs).alias("a")).select(F.inline("a"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))  # one row, however many values there are
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of each numeric column, nulls left out; quartiles are interpolated."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    rows = []
    for c in names:
        v = F.col(f"`{c}`").cast("double")
        quarters = [F.percentile(v, q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
        rows.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *quarters, F.max(v).alias("max")))
    if not names:
        raise ValueError("there is no numeric column")
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def object_summary(df: DataFrame) -> DataFrame:
    """(column, count, unique, top, freq) of each string or boolean column, nulls left out; ties of the top go to the least value."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType | T.BooleanType)]
    if not names:
        raise ValueError("there is no string or boolean column")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]))
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("p.value").alias("n"))
    top = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("m"), F.col("value"))))
    out = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count_if(F.col("value").isNotNull()).alias("unique"), top.alias("t"))
    return out.select("column", "count", "unique", F.col("t.value").alias("top"), (-F.col("t.m")).alias("freq"))


def outcome_crosstab(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, share of the group)."""
    counts = df.groupBy(F.col(group).alias("grp"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp")))


def results_pivot(results: DataFrame) -> DataFrame:
    """Mean of each metric by method, one column a metric, with the absolute parity difference."""
    wide = results.groupBy("method").pivot("metric").agg(F.avg("mean"))
    spd = "statistical_parity_difference"
    return wide.na.drop().withColumn("abs_spd", F.abs(F.col(spd))) if spd in wide.columns else wide
