"""Ordered union of acquisitions with their times shifted on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataStandardizationError, IncompatibleDataError
from ..schema import CANONICAL_COLUMNS, ROW, SOURCE, TIME
from .ordered import with_neighbours
from .validate import coerced, validate, with_row_numbers


def segment_summary(df: DataFrame, time: str = TIME, source: str = SOURCE, row: str = ROW) -> DataFrame:
    """Per source: first and last finite time, and the first and last positive step between
    physically adjacent rows that both have a time."""
    near = with_neighbours(df.select(source, row, time), [time], [], source, row)
    step = F.col(time) - F.col(f"prev_{time}")
    up = F.when(step > 0, F.col(row))
    there = F.when(F.col(time).isNotNull(), F.col(row))
    return near.groupBy(source).agg(
        F.count("*").alias("rows"), F.min_by(time, there).alias("first_time"), F.max_by(time, there).alias("last_time"),
        F.min_by(step, up).alias("first_step"), F.max_by(step, up).alias("last_step"),
    )


def offsets(summaries: list[dict]) -> list[float]:
    """What is added to each segment's time: the shifted end of the one before, a bridge (its own last
    step, else the first of this one), less this one's start.  Folded in order."""
    out, end = [0.0], summaries[0]["last_time"]
    for k in range(1, len(summaries)):
        bridge = summaries[k - 1]["last_step"]
        if bridge is None:
            bridge = summaries[k]["first_step"]
        if bridge is None:
            raise IncompatibleDataError(f"no positive time step between datasets {k - 1} and {k}")
        shift = end + bridge - summaries[k]["first_time"]
        out.append(shift)
        end = summaries[k]["last_time"] + shift
    return out


def merge(datasets: Iterable[DataFrame]) -> DataFrame:
    """One canonical frame of all datasets in the given order; each is validated first."""
    if isinstance(datasets, DataFrame):
        raise IncompatibleDataError("give an iterable of DataFrames, not one DataFrame")
    try:
        frames = list(datasets)
    except TypeError as error:
        raise IncompatibleDataError("give an iterable of DataFrames") from error
    if not frames:
        raise IncompatibleDataError("nothing to merge")
    for k, frame in enumerate(frames):
        if not isinstance(frame, DataFrame):
            raise IncompatibleDataError(f"dataset {k} is no DataFrame")
        try:
            validate(frame, emit_warnings=False)
        except DataStandardizationError as error:
            raise type(error)(f"dataset {k}: {error}") from error
    if len(frames) == 1:
        return frames[0]
    numbered = [with_row_numbers(coerced(f)) for f in frames]
    summaries = [segment_summary(f).first().asDict() for f in numbered]
    shifts, base, parts = offsets(summaries), 0, []
    for frame, shift, summary in zip(numbered, shifts, summaries, strict=True):
        parts.append(frame.select((F.col(TIME) + shift).alias(TIME), *CANONICAL_COLUMNS[1:], F.lit("").alias(SOURCE), (F.col(ROW) + base).alias(ROW)))
        base += summary["rows"]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    validate(out, emit_warnings=False)
    return out


def merge_segments(df: DataFrame, order: str, time: str = TIME, source: str = SOURCE, row: str = ROW) -> DataFrame:
    """All sources of ``df`` as one acquisition, ordered by the column ``order`` (constant in a
    source): ``time`` shifted, offsets folded on the driver from one small row per source."""
    facts = segment_summary(df, time, source, row).join(df.groupBy(source).agg(F.min(order).alias("__order")), source).orderBy("__order").collect()
    if not facts:
        return df
    shifts = df.sparkSession.createDataFrame([(f[source], s) for f, s in zip(facts, offsets([f.asDict() for f in facts]), strict=True)], f"{source} {df.schema[source].dataType.simpleString()}, __shift double")
    return df.join(shifts, source).withColumn(time, F.col(time) + F.col("__shift")).drop("__shift")
