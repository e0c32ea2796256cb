"""Optimised randomised mapping: P(x', y' | d, x, y) from a small linear program, applied by keyed draws.

Joint probabilities are one distributed count; the program over the grid of domains is solved on the
driver (its size is bounded by ``max_variables``); application is a join and a draw.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.frame import FairFrame
from evenhand.functions.draws import uniform
from evenhand.operators import lp


def domain_sizes(ff: FairFrame, features: list[str]) -> list[int]:
    """How many values the sensitive column, the features and the label have."""
    row = ff.df.agg(*[F.count_distinct(F.struct(F.col(c))).alias(f"d{i}") for i, c in enumerate((ff.sens, *features, ff.label))]).first()
    return [int(x) for x in row]


def joint_distribution(ff: FairFrame, features: list[str], most: int = 1_000_000) -> DataFrame:
    """(sens, features.., label, n, p) over the full product of domains, of ``most`` cells at most."""
    cells = math.prod(domain_sizes(ff, features))
    if cells > most:
        raise ValueError(f"the product of domains has {cells} cells; the limit is {most}")
    cols = [ff.sens, *features, ff.label]
    counts = ff.df.groupBy(*cols).agg(F.count("*").alias("n"))
    grid = counts.select(cols[0]).distinct()
    for c in cols[1:]:
        grid = grid.crossJoin(counts.select(c).distinct())  # products of small domains
    full = grid.join(counts, cols, "left").select(*cols, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select(*cols, "n", (F.col("n") / F.col("total")).alias("p"))  # one row


@dataclass
class MapModel:
    ff: FairFrame
    features: list[str]
    mapping: DataFrame

    def apply(self, df: DataFrame, key: str, seed: int = 42) -> DataFrame:
        """``df`` with features and label drawn from the mapping of each row's cell; other columns stay.

        A row whose cell isn't in the mapping stays as it is.
        """
        return apply_mapping(df, self.mapping, self.ff.sens, self.features, self.ff.label, key, seed)


def apply_mapping(df: DataFrame, mapping: DataFrame, sens: str, features: list[str], label: str, key: str, seed: int = 42) -> DataFrame:
    """mapping: (sens, features.., label, new_*.., p); each row's draw picks by running sums in the order of the new values."""
    cell = [sens, *features, label]
    new = [f"new_{c}" for c in (*features, label)]
    packed = mapping.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct(*new, "p"))).alias("_options"))  # as many as the grid has
    ups = F.transform(F.sequence(F.lit(1), F.size("_options")), lambda i: F.aggregate(F.slice("_options", F.lit(1), i), F.lit(0.0), lambda a, o: a + o["p"]))
    packed = packed.withColumn("_ups", ups).select(*[F.col(c).alias(f"_m_{c}") for c in cell], "_options", "_ups")
    same = [F.col(c) == F.col(f"_m_{c}") for c in cell]
    j = df.join(packed, same, "left").withColumn("_u", uniform(seed, "optmap", F.col(key)) * F.element_at("_ups", -1))
    at = F.least(F.size(F.filter("_ups", lambda v: v <= F.col("_u"))), F.size("_options") - 1)
    j = j.withColumn("_o", F.get("_options", at))
    out = [F.coalesce(F.col(f"_o.new_{c}"), F.col(c)).alias(c) if c in (*features, label) else F.col(c) for c in df.columns]
    return j.select(*out)


class RandomizedMap:
    """Estimator of the mapping; ``distortion(old, new)`` gets dictionaries of features and label and returns a number.

    For each level c of ``levels`` a row's chance of a distortion above it is at most the entry of
    ``chances``; the label's distribution differs between groups by ``epsilon`` at most; the distance to
    the data's distribution is least.
    """

    def __init__(self, features: list[str], distortion: Callable[[dict, dict], float], epsilon: float = 0.05, levels=(0.99, 1.99, 2.99), chances=(0.1, 0.05, 0.01), max_variables: int = 20_000):
        if not callable(distortion):
            raise TypeError("distortion must be callable")
        if len(levels) != len(chances):
            raise ValueError("levels and chances must have one length")
        self.features, self.distortion, self.epsilon = list(features), distortion, epsilon
        self.levels, self.chances, self.max_variables = list(levels), list(chances), max_variables

    def fit(self, ff: FairFrame) -> MapModel:
        ff.check()
        absent = [c for c in self.features if c not in ff.df.columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}")
        cols = [ff.sens, *self.features, ff.label]
        sizes = domain_sizes(ff, self.features)
        if (variables := math.prod(sizes) * math.prod(sizes[1:])) > self.max_variables:
            raise ValueError(f"the grid has {variables} variables; the limit is {self.max_variables}")
        rows = joint_distribution(ff, self.features).orderBy(*cols).collect()  # less than max_variables
        cells = [tuple(r[c] for c in cols) for r in rows]
        p = np.array([r["p"] for r in rows])
        goals = sorted({c[1:] for c in cells})
        nc, ng = len(cells), len(goals)
        groups = sorted({c[0] for c in cells})
        labels = sorted({g[-1] for g in goals})
        nv = nc * ng
        size = nv + 2 * ng
        names = [*self.features, ff.label]
        cost = np.array([[self.distortion(dict(zip(names, c[1:], strict=True)), dict(zip(names, g, strict=True))) for g in goals] for c in cells])
        eq, beq = np.zeros((nc + ng, size)), np.zeros(nc + ng)
        for i in range(nc):
            eq[i, i * ng : (i + 1) * ng] = 1
        beq[:nc] = 1
        old = np.array([sum(p[i] for i, c in enumerate(cells) if c[1:] == g) for g in goals])
        for j in range(ng):
            eq[nc + j, [i * ng + j for i in range(nc)]] = p
            eq[nc + j, nv + j], eq[nc + j, nv + ng + j] = -1, 1
        beq[nc:] = old
        ub, bub = [], []
        weight = {d: sum(p[i] for i, c in enumerate(cells) if c[0] == d) for d in groups}
        for a, b in itertools.permutations([d for d in groups if weight[d] > 0], 2):
            for y in labels:
                row = np.zeros(size)
                for i, c in enumerate(cells):
                    sign = 1 / weight[a] if c[0] == a else -1 / weight[b] if c[0] == b else 0
                    for j, g in enumerate(goals):
                        row[i * ng + j] += sign * p[i] * (g[-1] == y)
                ub.append(row), bub.append(self.epsilon)
        for level, chance in zip(self.levels, self.chances, strict=True):
            for i in range(nc):
                if p[i] > 0 and (cost[i] > level).any():
                    row = np.zeros(size)
                    row[i * ng : (i + 1) * ng] = cost[i] > level
                    ub.append(row), bub.append(chance)
        c = np.concatenate([np.zeros(nv), np.ones(2 * ng)])
        x = lp.solve(c, eq, beq, np.array(ub).reshape(-1, size), np.array(bub))
        q = np.clip(x[:nv].reshape(nc, ng), 0, None)
        q[p == 0] = [[float(cells[i][1:] == g) for g in goals] for i in np.flatnonzero(p == 0)] or 0
        q /= q.sum(axis=1, keepdims=True)
        data = [(*cells[i], *goals[j], float(q[i, j])) for i in range(nc) for j in range(ng) if q[i, j] > 1e-9]
        kinds = {f.name: f.dataType for f in ff.df.schema}
        schema = T.StructType([*[T.StructField(n, kinds[n]) for n in cols], *[T.StructField(f"new_{n}", kinds[n]) for n in names], T.StructField("p", T.DoubleType())])
        return MapModel(ff, self.features, ff.df.sparkSession.createDataFrame(data, schema))
