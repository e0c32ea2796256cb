"""Names for working columns that no column of a table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(*frames: DataFrame, base: str) -> str:
    """``base`` with as many underscores behind it as it takes, whatever the case of the frames' names."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
