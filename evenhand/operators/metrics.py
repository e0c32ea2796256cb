"""Performance and group-fairness metrics: one conditional aggregate, then projections.

A rate without a denominator is 0. Groups: priv (sens = priv) and unpriv; rows of other groups than
``priv`` and ``unpriv`` are left out. Differences are unprivileged minus privileged.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.frame import FairFrame

COUNTS = ("tp", "tn", "fp", "fn")
PERFORMANCE = ("accuracy", "true_positive_rate", "false_positive_rate", "true_negative_rate", "false_negative_rate", "balanced_accuracy")
FAIRNESS = ("disparate_impact", "statistical_parity_difference", "equal_opportunity_difference", "average_odds_difference", "true_negative_rate_difference")


def _counts(y: Column, p: Column, where: Column | None = None, suffix: str = "") -> list[Column]:
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond if where is None else cond & where).alias(name + suffix)

    return [n((y == 1) & (p == 1), "tp"), n((y == 0) & (p == 0), "tn"), n((y == 0) & (p == 1), "fp"), n((y == 1) & (p == 0), "fn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _rates(s: str = "") -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c + s) for c in COUNTS)
    tpr, tnr = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "true_positive_rate": tpr,
        "false_positive_rate": _ratio(fp, fp + tn),
        "true_negative_rate": tnr,
        "false_negative_rate": _ratio(fn, tp + fn),
        "balanced_accuracy": (tpr + tnr) / 2,
    }


def confusion_counts(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn and ``invalid`` (rows whose label or prediction isn't 0 or 1), overall or for each slice."""
    c, p = F.col(y), F.col(pred)
    bad = ~F.coalesce(c.isin(0, 1) & p.isin(0, 1), F.lit(False))
    return df.groupBy(*(by or [])).agg(*_counts(c, p), F.count_if(bad).alias("invalid"))


def performance_report(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return confusion_counts(df, y, pred, by).select(*(by or []), *COUNTS, "invalid", *[v.alias(k) for k, v in _rates().items()])


def fairness_report(ff: FairFrame, by: list[str] | None = None, unpriv=0) -> DataFrame:
    """All metrics of both groups in one scan: one row, or one for each slice.

    ``n_priv`` and ``n_unpriv`` tell whether both groups are there; ``invalid`` counts bad 0/1 values.
    """
    y, p = F.col(ff.label), F.col(ff.pred)
    s = F.col(ff.sens)
    priv, un = F.coalesce(s == ff.priv, F.lit(False)), F.coalesce(s == F.lit(unpriv), F.lit(False))
    bad = ~F.coalesce(y.isin(0, 1) & p.isin(0, 1), F.lit(False))
    agg = ff.df.groupBy(*(by or [])).agg(
        *_counts(y, p, priv, "_p"), *_counts(y, p, un, "_u"),
        F.count_if(priv).alias("n_priv"), F.count_if(un).alias("n_unpriv"),
        F.count_if(priv & (p == 1)).alias("pos_p"), F.count_if(un & (p == 1)).alias("pos_u"),
        F.count_if(bad & (priv | un)).alias("invalid"),
    )
    rp, ru = _ratio(F.col("pos_p"), F.col("n_priv")), _ratio(F.col("pos_u"), F.col("n_unpriv"))
    a, b = _rates("_u"), _rates("_p")
    di = F.when(rp == 0, F.when(ru > 0, F.lit(float("inf"))).otherwise(1.0)).otherwise(F.try_divide(ru, rp))
    out = {
        "disparate_impact": di,
        "statistical_parity_difference": ru - rp,
        "equal_opportunity_difference": a["true_positive_rate"] - b["true_positive_rate"],
        "average_odds_difference": ((a["false_positive_rate"] - b["false_positive_rate"]) + (a["true_positive_rate"] - b["true_positive_rate"])) / 2,
        "true_negative_rate_difference": a["true_negative_rate"] - b["true_negative_rate"],
    }
    base = [*(by or []), "n_priv", "n_unpriv", "invalid", *[c + g for g in ("_p", "_u") for c in COUNTS]]
    return agg.select(*base, *[v.alias(k) for k, v in out.items()])


def metric(name: str, df: DataFrame, y: str, pred: str, sens: str | None = None, priv=1, unpriv=0) -> float:
    """One metric as a number; raises on values other than 0 and 1 and on an absent group."""
    if name in PERFORMANCE:
        row = performance_report(df, y, pred).first()
        if row["invalid"]:
            raise ValueError("labels and predictions must be 0 or 1")
        none = {"true_positive_rate": ("tp", "fn"), "false_negative_rate": ("tp", "fn"), "false_positive_rate": ("fp", "tn"), "true_negative_rate": ("fp", "tn")}
        if name in none and not sum(row[c] for c in none[name]):
            warnings.warn(f"{name}: no row has that label, so the rate is 0", RuntimeWarning, stacklevel=2)
        return float(row[name])
    if name not in FAIRNESS:
        raise ValueError(f"no metric named {name}")
    row = fairness_report(FairFrame(df, sens, y, pred, priv=priv), unpriv=unpriv).first()
    if not row["n_priv"]:
        raise ValueError("there is no row of the privileged group")
    if not row["n_unpriv"]:
        raise ValueError("there is no row of the unprivileged group")
    if row["invalid"] and name not in ("disparate_impact", "statistical_parity_difference"):
        raise ValueError("labels and predictions must be 0 or 1")
    return float(row[name])
