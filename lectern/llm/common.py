"""Shared plumbing of the training-data operators: scratch space and Arrow maps."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as a full URI.

    A cluster names it in spark.checkpoint.dir; where that is unset and driver
    and executors are one machine, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = _scratch.get("base") or "file://" + tempfile.mkdtemp(prefix="lectern-")
        _scratch["base"] = base
        spark.sparkContext.setCheckpointDir(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is already gone; its scratch folder is the cluster's to clear
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    _remove(spark, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df once as Parquet in the shared folder and reread it.

    Unlike a cache it survives lost executors, and later stages prune columns.
    Shuffle files of the write go when it is done; nothing refers to them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize wrote for df; nothing may read it any more."""
    _remove(df.sparkSession, df._scratch)


def parts(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batch in slices of about `most` bytes, so that what is made of them stays small; none if it is empty."""
    step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """mapInArrow for functions of one batch, which gets a few megabytes of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, parts(batch))

    return df.mapInArrow(run, schema)


def texts(docs: DataFrame, text: str = "text"):
    """Column of the whole text as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("__utf8")


def runs(batches: Iterator[pa.RecordBatch], columns: int, widths: dict[int, int] | None = None) -> Iterator[list[np.ndarray]]:
    """Batches of sorted rows, cut so that a first-column value is never split.

    widths: columns of byte strings of one length, given as matrices of bytes.
    """
    widths = widths or {}

    def read(col: pa.Array, k: int) -> np.ndarray:
        if k in widths:
            return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), widths[k])
        return col.to_numpy(zero_copy_only=False)

    left: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [read(batch.column(k), k) for k in range(columns)]
        if cols[0][0] == cols[0][-1]:
            if left and left[-1][0][-1] != cols[0][0]:
                yield [np.concatenate(x) for x in zip(*left)]
                left = []
            left.append(cols)
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        left.append([c[:cut] for c in cols])
        yield [np.concatenate(x) for x in zip(*left)]
        left = [[c[cut:] for c in cols]]
    if left:
        yield [np.concatenate(x) for x in zip(*left)]
