"""Instance weights from a small table of cell counts."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.frame import FairFrame
from evenhand.functions.names import free_name


def reweighing_table(ff: FairFrame) -> DataFrame:
    """(s, c, n, p_s, p_c, p_joint, p_expected, weight) of the full grid; an empty cell has weight 0.

    weight = P(s) P(c) / P(s, c).
    """
    cells = ff.cells()
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # the grid is groups x labels: few rows
    s, c = F.sum("n").over(Window.partitionBy("s")), F.sum("n").over(Window.partitionBy("c"))
    t = cells.withColumn("p_s", s / total).withColumn("p_c", c / total).withColumn("p_joint", F.col("n") / total)
    t = t.withColumn("p_expected", F.col("p_s") * F.col("p_c"))
    return t.withColumn("weight", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("p_expected") / F.when(F.col("p_joint") > 0, F.col("p_joint"))))


def balance_table(ff: FairFrame, variant: bool = False) -> DataFrame:
    """(s, c, n, weight): n_s / n_sc, or with ``variant`` 1 / n_sc; an empty cell has weight 0."""
    cells = ff.cells()
    top = F.lit(1.0) if variant else F.sum("n").over(Window.partitionBy("s")).cast("double")
    return cells.withColumn("weight", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(top / F.when(F.col("n") > 0, F.col("n"))))


def _applied(ff: FairFrame, table: DataFrame, out: str) -> DataFrame:
    s, c = free_name(ff.df, base="_s"), free_name(ff.df, base="_c")
    small = table.select(F.col("s").alias(s), F.col("c").alias(c), F.col("weight").alias(out))
    # groups x labels rows; Spark decides on broadcasting from the measured size
    return ff.df.join(small, (F.col(ff.sens) == F.col(s)) & (F.col(ff.label) == F.col(c))).drop(s, c)


def reweigh(ff: FairFrame, out: str = "weight") -> DataFrame:
    return _applied(ff.check(), reweighing_table(ff), out)


def fair_balance(ff: FairFrame, variant: bool = False, out: str = "weight") -> DataFrame:
    """Weights n_s / n_sc; the variant's 1 / n_sc are scaled to a sum of n, that is n / (cells * n_sc)."""
    ff.check()
    table = balance_table(ff, variant)
    if variant:
        every = Window.partitionBy(F.lit(1))
        table = table.withColumn("weight", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.sum("n").over(every).cast("double") / (F.count_if(F.col("n") > 0).over(every) * F.when(F.col("n") > 0, F.col("n")))))
    return _applied(ff, table, out)


class WeightedFairClassifier(Estimator):
    """Weights the rows by ``scheme`` (reweighing, balance, balance_variant), then fits ``base`` with them.

    ``base`` is any estimator with a weight column, told as ``weightCol``; the sensitive column may be
    among its features.
    """

    SCHEMES = {
        "reweighing": lambda ff: reweigh(ff),
        "balance": lambda ff: fair_balance(ff),
        "balance_variant": lambda ff: fair_balance(ff, variant=True),
    }

    def __init__(self, base=None, scheme: str = "reweighing", sens: str = "", label: str = "label", priv=1, pos=1, features: list[str] | None = None):
        super().__init__()
        if scheme not in self.SCHEMES:
            raise ValueError(f"no scheme {scheme}")
        self.base, self.scheme, self.sens, self.label, self.priv, self.pos, self.features = base, scheme, sens, label, priv, pos, features

    def _fit(self, df: DataFrame) -> Model:
        from evenhand.operators.linear import Logistic

        ff = FairFrame(df, self.sens, self.label, priv=self.priv, pos=self.pos)
        weighted = self.SCHEMES[self.scheme](ff)
        base = self.base
        if base is None:
            base = Logistic(self.features or [*ff.numeric, self.sens], self.label, pos=self.pos, weight="weight")
        elif hasattr(base, "hasParam") and base.hasParam("weightCol"):
            base = base.copy({base.weightCol: "weight"})
        return base.fit(weighted)
