"""Intermediate tables in the folder that all executors share, and fixed-size membership bitmaps."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that one call of Spark's bitmap_construct_agg covers (fixed by Spark).
BITS_PER_BUCKET = 32768


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition function whose worker gives freed memory back when the task ends: Spark keeps
    workers for later tasks, and several idle ones share an executor's memory with the running ones."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def named(name: str) -> Column:
    """The column of exactly this name, whatever dots or backticks it has."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it names none, a folder of our own, in local mode only."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = held.get() if held.isDefined() else None
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="cellflux-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session may already be gone when the interpreter ends
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a short lineage that any
    executor can reread after a loss.  The folder goes when the interpreter ends, or earlier by
    ``discard``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellflux/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def discard() -> None:
    """Delete all intermediate tables written so far.  For long sessions, when results that were
    computed lazily from them have been written or collected."""
    while _tables:
        _remove_quietly(*_tables.pop())


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def key_bitmap(df: DataFrame, key: str, buckets: int = 256) -> np.ndarray:
    """A bitmap of ``buckets * 32768`` bits with the slots of the long column ``key`` set.

    What reaches the driver is at most ``buckets`` rows of 4 KiB whatever the input's size; several
    keys may share a slot, so a set bit means "may be a member" and a clear one "is none".
    """
    slots = buckets * BITS_PER_BUCKET
    slot = F.pmod(F.col(key), F.lit(slots))
    rows = (
        df.select(slot.alias("slot"))
        .select(
            F.expr(f"cast(slot div {BITS_PER_BUCKET} as int)").alias("bucket"),
            F.expr(f"slot % {BITS_PER_BUCKET}").alias("bit"),
        )
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros((buckets, BITS_PER_BUCKET // 8), dtype=np.uint8)
    for row in rows:
        out[row["bucket"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 ``keys`` have their slot set (pmod, least significant bit first)."""
    slot = np.mod(keys.astype(np.int64), np.int64(len(bitmap) * 8))
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
