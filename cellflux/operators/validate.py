"""The canonical contract: a schema check and one aggregate."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataStandardizationError, IncompatibleDataError, MissingValueWarning
from ..functions.numeric import nulled, number
from ..schema import CANONICAL_COLUMNS, ROW, SOURCE
from .standardise import quality_report, raise_violation


def with_row_numbers(df: DataFrame, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with its rows numbered 0, 1, 2, ... in their present order, and one source.

    Only the number of rows of each partition is brought to the driver.  A sort's or a shuffle's borders
    differ from job to job, so ``settle`` must make partitions stay as they are: by default for the
    frame's life, in blocks whose loss is an error."""
    if SOURCE in df.columns and ROW in df.columns:
        return df
    marked = df.withColumn("__id", F.monotonically_increasing_id())
    marked = settle(marked) if settle else marked.localCheckpoint(eager=False)
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    first, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in sizes):
        first += [F.lit(p), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*first), part) if first else F.lit(0)
    return marked.withColumns({SOURCE: F.lit(""), ROW: (start + place).cast("long")}).drop("__id")


def coerced(df: DataFrame) -> DataFrame:
    """Canonical columns as doubles with null for missing: numbers widen, text is parsed."""
    out = []
    for field in df.schema.fields:
        if field.name not in CANONICAL_COLUMNS:
            continue
        if isinstance(field.dataType, T.StringType):
            out.append(number(F.col(field.name)).alias(field.name))
        elif isinstance(field.dataType, T.NumericType):
            out.append(nulled(F.col(field.name).cast("double")).alias(field.name))
        else:
            raise IncompatibleDataError(f"{field.name} is {field.dataType.simpleString()}, not numeric")
    extra = [c for c in (SOURCE, ROW) if c in df.columns]
    return df.select(*out, *extra)


def check_columns(df: DataFrame) -> None:
    names = tuple(c for c in df.columns if c not in (SOURCE, ROW))
    if names != CANONICAL_COLUMNS:
        raise IncompatibleDataError(f"columns are {names}, not {CANONICAL_COLUMNS}")


def missing_counts(report: dict) -> dict[str, int]:
    return {c: report[f"missing_{c}"] for c in CANONICAL_COLUMNS if report.get(f"missing_{c}")}


def validate(df: DataFrame, emit_warnings: bool = True, what: str = "") -> dict:
    """Check a canonical frame; raises the first fault, returns its report."""
    if not isinstance(df, DataFrame):
        raise IncompatibleDataError(f"{what}not a DataFrame: {type(df).__name__}")
    check_columns(df)
    for c in CANONICAL_COLUMNS:
        if not isinstance(df.schema[c].dataType, T.DoubleType):
            raise IncompatibleDataError(f"{what}{c} is {df.schema[c].dataType.simpleString()}, not double")
    held = []
    try:
        row = quality_report(with_row_numbers(coerced(df), lambda d: held.append(d.persist(StorageLevel.MEMORY_AND_DISK)) or d)).first()
    finally:
        for kept in held:
            kept.unpersist()
    report = row.asDict(recursive=True) if row else {"rows": 0, "violation": None, "origin": None}
    raise_violation(report, what, zero_origin=True)
    missing = missing_counts(report)
    if missing and emit_warnings:
        warnings.warn(MissingValueWarning(f"missing values: {missing}", missing), stacklevel=2)
    return report


def is_standardized(value: object) -> bool:
    """Whether a value is a canonical frame, without warnings."""
    try:
        validate(value, emit_warnings=False)
    except DataStandardizationError:
        return False
    return True
