"""Sparse time checkpoints joined to measurement slots, and the slots' reserved tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpoint_conflicts(checkpoints: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose checkpoints differ; identical repeats are one."""
    both = checkpoints.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("greatest"))
    return both.where("least != greatest")


def join_checkpoints(slots: DataFrame, checkpoints: DataFrame, slot_key: str, key: str, value: str) -> DataFrame:
    """Each slot with its checkpoint's value or null; nothing is interpolated.  The optimiser chooses the
    join from the sizes."""
    once = checkpoints.groupBy(key).agg(F.min(value).alias(value)).withColumnRenamed(key, "__key")
    return slots.join(once, slots[slot_key] == once["__key"], "left").drop("__key")


def trim_padding(slots: DataFrame, index: str, values: list[str], last_checkpoint: int | None = None, source: str | None = None) -> DataFrame:
    """Without the all-zero tail of each source: zeros up to the last non-zero slot, or the last
    checkpoint if that is later, stay."""
    used = F.lit(False)
    for v in values:
        used = used | (F.col(v) != 0)
    last = F.max(F.when(used, F.col(index)))
    if last_checkpoint is not None:
        last = F.greatest(last, F.lit(last_checkpoint))
    if source is None:
        ends = slots.agg(last.alias("__end"))
        return slots.join(F.broadcast(ends), F.col(index) <= F.col("__end")).drop("__end")  # one row
    ends = slots.groupBy(source).agg(last.alias("__end"))
    return slots.join(ends, source).where(F.col(index) <= F.col("__end")).drop("__end")
