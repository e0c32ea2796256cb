"""Shared pieces of the training-data operators: scratch tables, Arrow helpers, group runs."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.functions.names import free_name  # noqa: F401  the operators take both from here
from evenhand.functions.ship import ship  # noqa: F401

#: Seconds of a job from which its shuffle files are worth a collection of the driver's garbage.
LONG_JOB = 0.5
_SWEPT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing and all runs in one JVM (local tests) a temporary folder of this
    machine is taken; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_evenhand_root", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="evenhand-")
        spark.sparkContext.setCheckpointDir(root)
        spark.sparkContext._evenhand_root = root
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM has gone: the folder stays for the cluster's own clean-up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; everything below it goes when the application ends."""
    top = f"{shared_root(spark)}/evenhand-{spark.sparkContext.applicationId}"
    if top not in _SWEPT:
        _SWEPT.add(top)
        atexit.register(_sweep, spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut, executors may go."""
    spark = df.sparkSession
    path, began = scratch_path(spark, name), time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evenhand_path = path
    if time.monotonic() - began > LONG_JOB:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "_evenhand_path", None)
        if path:
            delete(df.sparkSession, path)


def bin_texts(column: pa.Array) -> list[bytes | None]:
    """Python bytes of a binary or string Arrow column."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of a column of strings or binaries, of about ``size`` bytes and one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j
        i = j


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``keys``, from batches sorted by them.

    Each yielded table ends where a run ends; ``run_starts`` finds the runs in it.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = run_starts(batch, keys)
        first = held[-1].slice(held[-1].num_rows - 1) if held else None
        joined = first is not None and all(first.column(k)[0].equals(batch.column(k)[0]) for k in keys)
        if len(starts) == 1 and (joined or not held):
            held.append(batch)
            continue
        cut = int(starts[-1])
        if held and not joined:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held:
            held.append(batch)
            continue
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def run_starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    n = batch.num_rows
    change = np.zeros(n, bool)
    if n:
        change[0] = True
    for k in keys:
        col = batch.column(k)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        v = col.to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def binary_rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of binaries of one width as a 2-d array of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least member index) of an undirected graph over 0..n-1, by hooking and halving."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        before = label.copy()
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            nxt = label[label]
            if np.array_equal(nxt, label):
                break
            label = nxt
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns``, so that other columns can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
