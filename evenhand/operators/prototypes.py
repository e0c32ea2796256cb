"""Fair representations by prototypes: soft assignment to k learned points.

M = softmax(-|x - v|), x^ = M V, y^ = clip(M w). The loss adds reconstruction error of both groups, cross
entropy and the mean gap between the groups' mean assignments. Each evaluation is two distributed sums
(mean assignments, then loss and analytic gradient), a few of them a core; the driver runs L-BFGS with w kept in [0, 1].
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.frame import FairFrame
from evenhand.functions.ship import ship

EPS = 1e-9


def assignments(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(M, distances)."""
    d = np.sqrt(np.maximum(((x[:, None, :] - v) ** 2).sum(axis=2), 0))
    e = np.exp(-(d - d.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True), d


def mean_sums(x: np.ndarray, a: np.ndarray, v: np.ndarray) -> np.ndarray:
    m, _ = assignments(x, v)
    return np.concatenate([m[~a].sum(axis=0), m[a].sum(axis=0), [(~a).sum(), a.sum()]])


def loss_sums(x: np.ndarray, a: np.ndarray, y: np.ndarray, v: np.ndarray, w: np.ndarray, coef: tuple[float, float, float], n: tuple[float, float], sign: np.ndarray) -> np.ndarray:
    """Loss (without the gap) and gradient of the whole loss, summed over rows."""
    ax, ay, az = coef
    m, d = assignments(x, v)
    k, dim = v.shape
    nu, np_ = n
    per = np.where(a, 1 / max(np_, 1), 1 / max(nu, 1))[:, None]
    err = m @ v - x
    raw = m @ w
    yh = np.clip(raw, EPS, 1 - EPS)
    total = nu + np_
    loss = ax * (per * err**2).sum() / dim - ay * (y * np.log(yh) + (1 - y) * np.log(1 - yh)).sum() / total
    gx = 2 * ax * per * err / dim
    gy = np.where((raw > EPS) & (raw < 1 - EPS), -ay * (y / yh - (1 - y) / (1 - yh)) / total, 0.0)[:, None]
    gm = gx @ v.T + gy * w + az / k * sign * np.where(a, -1, 1)[:, None] * per
    gd = -m * (gm - (m * gm).sum(axis=1, keepdims=True))
    coef_ = gd / np.where(d > 1e-12, d, np.inf)
    gv = m.T @ gx + coef_.sum(axis=0)[:, None] * v - coef_.T @ x
    return np.concatenate([[loss], gv.ravel(), (m * gy).sum(axis=0)])


class PrototypeModel:
    def __init__(self, columns: list[str], prototypes: np.ndarray, weights: np.ndarray, losses: list[float]):
        self.columns, self.prototypes, self.weights, self.losses = columns, prototypes, weights, losses

    def transform(self, df: DataFrame) -> DataFrame:
        return represent(df, self.columns, self.prototypes)


def represent(df: DataFrame, columns: list[str], prototypes) -> DataFrame:
    """``df`` with numeric columns replaced by x^; k * d literals, no Python worker."""
    dist: list[Column] = []
    for v in prototypes:
        d2 = F.lit(0.0)
        for c, a in zip(columns, v, strict=True):
            diff = F.col(c).cast("double") - F.lit(float(a))
            d2 = d2 + diff * diff
        dist.append(F.sqrt(d2))
    low = F.least(*dist) if len(dist) > 1 else dist[0]
    named = df.select("*", *[F.exp(-(d - low)).alias(f"_e{i}") for i, d in enumerate(dist)])
    total = sum((F.col(f"_e{i}") for i in range(1, len(dist))), F.col("_e0"))
    out = {}
    for j, c in enumerate(columns):
        num = F.lit(0.0)
        for i, v in enumerate(prototypes):
            num = num + F.col(f"_e{i}") * F.lit(float(v[j]))
        out[c] = num / total
    return named.withColumns(out).select(*df.columns)


class PrototypeRepresentation:
    def __init__(self, k: int = 5, ax: float = 0.01, ay: float = 1.0, az: float = 50.0, steps: int = 50, seed: int = 42):
        self.k, self.coef, self.steps, self.seed = k, (ax, ay, az), steps, seed

    def fit(self, ff: FairFrame) -> PrototypeModel:
        ff.check()
        ship(ff.df.sparkSession)
        columns, k = ff.numeric, self.k
        if not columns:
            raise ValueError("there is no numeric column")
        # an evaluation sends a result a task to the driver, so their number follows the cores and not the table
        tasks = 2 * ff.df.sparkSession.sparkContext.defaultParallelism
        data = ff.df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), ff.is_priv.alias("a"), ff.is_pos.cast("double").alias("y")).coalesce(tasks).persist()
        dim = len(columns)

        def summed(fn, size: int) -> np.ndarray:
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(size)
                for b in batches:
                    if b.num_rows:
                        x = b.column(0).flatten().to_numpy().reshape(-1, dim)
                        total = total + fn(x, b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

            rows = data.mapInArrow(part, "t array<double>").collect()  # one row a task
            return np.sum([r[0] for r in rows], axis=0) if rows else np.zeros(size)

        def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
            v, w = theta[: k * dim].reshape(k, dim), theta[k * dim :]
            s = summed(lambda x, a, y: mean_sums(x, a, v), 2 * k + 2)
            nu, np_ = s[-2:]
            gap = s[:k] / max(nu, 1) - s[k : 2 * k] / max(np_, 1)
            g = summed(lambda x, a, y: loss_sums(x, a, y, v, w, self.coef, (nu, np_), np.sign(gap)), 1 + k * dim + k)
            return g[0] + self.coef[2] * np.abs(gap).mean(), g[1:]

        rng = np.random.default_rng(self.seed)
        low, high = np.full(k * dim + k, -np.inf), np.full(k * dim + k, np.inf)
        low[k * dim :], high[k * dim :] = 0, 1
        theta, losses = minimise(evaluate, rng.random(k * dim + k), low, high, self.steps)
        data.unpersist()
        if len(losses) > self.steps and (len(losses) < 2 or losses[-2] - losses[-1] >= 1e-10 * max(1, abs(losses[-2]))):
            warnings.warn(f"the fit hasn't converged after {self.steps} steps", stacklevel=2)
        return PrototypeModel(columns, theta[: k * dim].reshape(k, dim), theta[k * dim :], losses)


def minimise(f, x: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, list[float]]:
    """Projected L-BFGS with backtracking."""
    value, grad = f(x)
    losses, hist = [value], []
    for _ in range(steps):
        free = ~(((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0)))
        q = np.where(free, grad, 0.0)
        if np.abs(q).max(initial=0) < 1e-7:
            break
        alphas = []
        for s, y in reversed(hist):
            alphas.append((s @ q) / (y @ s))
            q = q - alphas[-1] * y
        if hist:
            q = q * (hist[-1][0] @ hist[-1][1]) / (hist[-1][1] @ hist[-1][1])
        for (s, y), a in zip(hist, reversed(alphas), strict=True):
            q = q + s * (a - (y @ q) / (y @ s))
        d = -np.where(free, q, 0.0)
        if d @ grad >= 0:
            d, hist = -np.where(free, grad, 0.0), []
        t = 1.0 if hist else min(1.0, 1 / np.abs(d).sum())
        for _ in range(25):
            new = np.clip(x + t * d, low, high)
            v, g = f(new)
            if v <= value + 1e-4 * (grad @ (new - x)):
                break
            t /= 2
        else:
            break
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            hist = [*hist[-(memory - 1) :], (s, y)]
        done = value - v < 1e-10 * max(1, abs(value))
        x, value, grad = new, v, g
        losses.append(v)
        if done:
            break
    return x, losses
