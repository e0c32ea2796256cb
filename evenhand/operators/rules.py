"""Predicates from rule dictionaries, and dropping columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS: dict[str, Callable[[Column, Any], Column]] = {
    ">": lambda c, t: c > t,
    "<": lambda c, t: c < t,
    ">=": lambda c, t: c >= t,
    "<=": lambda c, t: c <= t,
}


def _term(df: DataFrame, name: str, value: Any) -> Column:
    if name not in df.columns:
        raise KeyError(f"no column {name}")
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    if isinstance(value, dict):
        if len(value) != 1:
            raise ValueError(f"{name}: give one comparison, not {len(value)}")
        op, limit = next(iter(value.items()))
        if op == "!=":
            return ~col.eqNullSafe(F.lit(limit))
        if op not in _OPS:
            raise ValueError(f"{name}: no comparison {op}")
        test = _OPS[op](col, F.lit(limit))
        # a NaN compares with nothing; Spark would put it above all numbers
        return F.coalesce(test & ~F.isnan(col) if floating else test, F.lit(False))
    test = col.isin(list(value)) if isinstance(value, (list, tuple, set)) else col == F.lit(value)
    return F.coalesce(test, F.lit(False))


def predicate(df: DataFrame, rules: dict | list[dict]) -> Column:
    """Any rule holds; a rule holds if all its terms do. A rule without terms always holds, no rules never."""
    if rules is None or not isinstance(rules, (dict, list, tuple)) or any(not isinstance(r, dict) for r in (rules if not isinstance(rules, dict) else [])):
        raise ValueError("rules must be a dictionary or a list of dictionaries")
    each = [rules] if isinstance(rules, dict) else list(rules)
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (_term(df, k, v) for k, v in r.items()), F.lit(True)) for r in each), F.lit(False))


def privilege_flag(df: DataFrame, rules: dict | list[dict], out: str = "is_privileged", value: Any = 1) -> DataFrame:
    """``df`` with column ``out``: ``value`` where the rules hold, else 0."""
    return df.withColumn(out, F.when(predicate(df, rules), F.lit(value)).otherwise(F.lit(0)))


def drop_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    names = [columns] if isinstance(columns, str) else list(columns)
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")
    return df.drop(*names)
