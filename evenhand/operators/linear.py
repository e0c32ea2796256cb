"""Ridge logistic regression by Newton steps: one distributed aggregate a step, a small solve on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.ship import ship


def _linear(features: list[str], coef: np.ndarray) -> Column:
    z = F.lit(float(coef[-1]))
    for f, b in zip(features, coef[:-1], strict=True):
        z = z + F.lit(float(b)) * F.col(f).cast("double")
    return z


class LogisticModel:
    """Adds ``score`` (probability of ``pos``) and ``prediction`` (``pos`` or ``neg``)."""

    def __init__(self, features: list[str], coef: np.ndarray, pos=1, neg=0):
        self.features, self.coef, self.pos, self.neg = features, coef, pos, neg

    def score(self) -> Column:
        return 1 / (1 + F.exp(-_linear(self.features, self.coef)))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score()).withColumn("prediction", F.when(F.col("score") > 0.5, F.lit(self.pos)).otherwise(F.lit(self.neg)))


class Logistic:
    """L2-penalised logistic regression with penalty 1 / (2 C) |b|^2; ``penalize_intercept`` includes the intercept.

    Features are scaled by their largest absolute value while solving; the penalty stays that of the raw
    coefficients.
    """

    def __init__(self, features: list[str], label: str, pos=1, neg=0, C: float = 1.0, weight: str | None = None, penalize_intercept: bool = False, steps: int = 40):
        self.features, self.label, self.pos, self.neg = list(features), label, pos, neg
        self.C, self.weight, self.penalize_intercept, self.steps = C, weight, penalize_intercept, steps

    def _design(self, df: DataFrame, scale: np.ndarray) -> tuple[list[Column], Column, Column]:
        x = [F.col(f).cast("double") / F.lit(float(s)) for f, s in zip(self.features, scale, strict=True)] + [F.lit(1.0)]
        return x, (F.col(self.label) == F.lit(self.pos)).cast("double"), F.col(self.weight).cast("double") if self.weight else F.lit(1.0)

    def fit(self, df: DataFrame) -> LogisticModel:
        d = len(self.features) + 1
        neg = self.neg
        row = df.agg(*[F.max(F.abs(F.col(f).cast("double"))) for f in self.features], F.max(F.when(F.col(self.label) != F.lit(self.pos), F.col(self.label)))).first()
        neg = neg if row[-1] is None else row[-1]
        scale = np.array([abs(v) if v else 1.0 for v in row[:-1]], float)
        x, y, w = self._design(df, scale)
        beta = np.zeros(d)
        ridge = np.append(1 / scale**2, 1.0 if self.penalize_intercept else 0.0) / self.C
        for _ in range(self.steps):
            eta = sum((F.lit(float(b)) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
            p = 1 / (1 + F.exp(-eta))
            rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], (w * (y - p)).alias("g"), (w * p * (1 - p)).alias("h"))
            grads = [F.sum(F.col("g") * F.col(f"x{i}")) for i in range(d)]
            hess = [F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(d) for j in range(i, d)]
            got = [float(v or 0) for v in rows.agg(*grads, *hess).first()]
            g = np.array(got[:d]) - ridge * beta
            h = np.zeros((d, d))
            h[np.triu_indices(d)] = got[d:]
            h = h + np.triu(h, 1).T + np.diag(ridge + 1e-12)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 20 / max(1e-12, np.abs(step).max()))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        return LogisticModel(self.features, np.append(beta[:-1] / scale, beta[-1]), self.pos, neg)


def fit_each(df: DataFrame, group: str, features: list[str], label: str, values: list, steps: int = 40) -> dict[tuple[int, int], LogisticModel]:
    """``Logistic(features, label, pos=values[v])`` for each group (a small integer) and v; a step of all of them is one job."""
    ship(df.sparkSession)
    d = len(features) + 1
    top = df.groupBy(group).agg(*[F.max(F.abs(F.col(f).cast("double"))) for f in features]).collect()  # one row a group
    scale = {r[0]: np.array([abs(v) if v else 1.0 for v in r[1:]], float) for r in top}
    code = F.lit(-1)
    for v, value in enumerate(values):
        code = F.when(F.col(label) == F.lit(value), F.lit(v)).otherwise(code)
    data = df.select(F.col(group).cast("int").alias("g"), code.alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).dropna(subset=[f"x{i}" for i in range(len(features))] or None)
    beta = {(g, v): np.zeros(d) for g in scale for v in range(len(values))}
    upper, size = np.triu_indices(d), d + d * (d + 1) // 2
    active = list(beta)

    def sums(now: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
        place = {at: i for i, at in enumerate(now)}

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(place), size))
            for b in batches:
                g, y = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = np.stack([*[b.column(i + 2).to_numpy() for i in range(d - 1)], np.ones(len(g))], axis=1)
                for one in np.unique(g):
                    rows = g == one
                    z, own = x[rows] / np.append(scale[one], 1.0), y[rows]
                    for (at, v), i in place.items():
                        if at == one:
                            with np.errstate(over="ignore"):
                                p = 1 / (1 + np.exp(-(z @ now[at, v])))
                            total[i, :d] += z.T @ ((own == v) - p)
                            total[i, d:] += ((z * (p * (1 - p))[:, None]).T @ z)[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "t"])

        out = np.zeros(len(place) * size)
        for r in data.mapInArrow(part, "i long, t double").groupBy("i").agg(F.sum("t")).collect():  # one row a parameter
            out[r[0]] = r[1]
        return dict(zip(now, out.reshape(len(place), size), strict=True))

    for _ in range(steps):
        got = sums({at: beta[at] for at in active})
        for at in list(active):
            ridge = np.append(1 / scale[at[0]] ** 2, 0.0)
            g = got[at][:d] - ridge * beta[at]
            h = np.zeros((d, d))
            h[upper] = got[at][d:]
            h = h + np.triu(h, 1).T + np.diag(ridge + 1e-12)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 20 / max(1e-12, np.abs(step).max()))
            beta[at] = beta[at] + step
            if np.abs(step).max() < 1e-9:
                active.remove(at)
        if not active:
            break
    return {(g, v): LogisticModel(features, np.append(b[:-1] / scale[g], b[-1]), values[v]) for (g, v), b in beta.items()}


def scored_by(estimator, df: DataFrame, pos) -> DataFrame:
    """``df`` with column ``score``: from a Column, a model, or an estimator that is fitted first.

    Models may be ours (column score) or pyspark.ml classifiers (last entry of probability).
    """
    if isinstance(estimator, Column):
        return df.withColumn("score", estimator)
    model = estimator.fit(df) if hasattr(estimator, "fit") else estimator
    out = model.transform(df)
    if "score" in out.columns:
        return out
    if "probability" not in out.columns:
        raise ValueError("the estimator must give probabilities")
    from pyspark.ml.functions import vector_to_array

    return out.withColumn("score", F.element_at(vector_to_array("probability"), -1))
