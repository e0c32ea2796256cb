"""Fairness over event-time windows of a stream: the counts are sums, so Spark's own state is enough."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fairness_monitor(events: DataFrame, ts: str, sens: str, pred: str, priv=1, unpriv=0, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, n_priv, n_unpriv, pos_priv, pos_unpriv, parity_difference) of each window; works on batches too."""
    s, p = F.col(sens), F.col(pred)
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    agg = rows.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count_if(s == priv).alias("n_priv"), F.count_if(s == unpriv).alias("n_unpriv"),
        F.count_if((s == priv) & (p == 1)).alias("pos_priv"), F.count_if((s == unpriv) & (p == 1)).alias("pos_unpriv"),
    )

    def rate(a: str, b: str) -> F.Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return agg.select(F.col("w.start").alias("start"), "n_priv", "n_unpriv", "pos_priv", "pos_unpriv", (rate("pos_unpriv", "n_unpriv") - rate("pos_priv", "n_priv")).alias("parity_difference"))
