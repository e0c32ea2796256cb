"""FairFrame: a DataFrame whose columns have roles in a fairness question."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class FairFrame:
    """Role binding: sensitive column, label, prediction, key; ``priv`` and ``pos`` are the favoured values."""

    df: DataFrame
    sens: str
    label: str
    pred: str | None = None
    key: tuple[str, ...] = field(default_factory=tuple)
    priv: Any = 1
    pos: Any = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", (self.key,) if isinstance(self.key, str) else tuple(self.key))
        absent = [c for c in (self.sens, self.label, *self.key, *([self.pred] if self.pred else [])) if c not in self.df.columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}")

    @property
    def is_priv(self) -> Column:
        return F.col(self.sens) == F.lit(self.priv)

    @property
    def is_pos(self) -> Column:
        return F.col(self.label) == F.lit(self.pos)

    @property
    def others(self) -> list[str]:
        """Columns without a role."""
        return [c for c in self.df.columns if c not in (self.sens, self.label, self.pred, *self.key)]

    @property
    def numeric(self) -> list[str]:
        """Numeric feature columns (booleans are categories)."""
        return [f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType) and f.name in self.others]

    @property
    def integral(self) -> list[str]:
        return [f.name for f in self.df.schema if isinstance(f.dataType, T.IntegralType) and f.name in self.others]

    def with_df(self, df: DataFrame) -> FairFrame:
        return replace(self, df=df)

    def cells(self) -> DataFrame:
        """(s, c, n) of the full grid of groups and labels; empty cells have 0."""
        counts = self.df.groupBy(F.col(self.sens).alias("s"), F.col(self.label).alias("c")).agg(F.count("*").alias("n"))
        # both domains are small: distinct values of the counted cells
        grid = counts.select("s").distinct().crossJoin(counts.select("c").distinct())
        return grid.join(counts, ["s", "c"], "left").select("s", "c", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def check(self, binary: bool = True) -> FairFrame:
        """Raise unless roles have no nulls and, with ``binary``, the label has two values, one of them ``pos``."""
        s, c = F.col(self.sens), F.col(self.label)
        row = self.df.agg(F.count_if(s.isNull()).alias("s"), F.count_if(c.isNull()).alias("c"), F.collect_set(c).alias("values") if binary else F.lit(None).alias("values")).first()
        if row["s"] or row["c"]:
            raise ValueError("the sensitive column and the label must have no nulls")
        if binary and len(row["values"]) != 2:
            raise ValueError(f"the label must have two values, it has {len(row['values'])}")
        if binary and self.pos not in row["values"]:
            raise ValueError(f"the label has no value {self.pos!r}")
        return self
