"""Time normalisation, current from capacity, and the report that says what is wrong where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CurrentReconstructionError, IncompatibleDataError, NonMonotonicTimeError
from ..schema import CURRENT, ROW, SOURCE, TIME, VOLTAGE
from .ordered import BUCKET_ROWS, with_neighbours

CUMULATIVE, DELTA, PAIR = "cumulative_signed", "delta_signed", "pair"
PREVIOUS, NEXT = "previous", "next"
#: Kinds of violation in the order in which they count within a row.
VIOLATIONS = ("time_infinite", "capacity_infinite", "time_backward", "counter_reset", "current_infinite", "voltage_infinite")


@dataclass(frozen=True)
class Reconstruction:
    """How current follows from capacity (in mAh) columns ``q`` or ``charge`` and ``discharge``."""

    kind: str
    alignment: str = PREVIOUS
    counters: bool = False  # known counters must not decrease


def finite(value: Column) -> Column:
    return F.when(F.abs(value) != float("inf"), value)


def origin(df: DataFrame, time: str = TIME, source: str = SOURCE, row: str = ROW) -> DataFrame:
    """The first time of each source that is not missing."""
    return df.groupBy(source).agg(F.min_by(time, F.when(F.col(time).isNotNull(), F.col(row))).alias("origin"))


def normalise_time(df: DataFrame, time: str = TIME, source: str = SOURCE, row: str = ROW) -> DataFrame:
    """Time since each source's first; an aggregate and a join by source, no window."""
    return df.join(origin(df, time, source, row), source).withColumn(time, F.col(time) - F.col("origin")).drop("origin")


def current_expression(kind: str, alignment: str = PREVIOUS, time: str = "time", q: str = "q", discharge: str = "discharge") -> Column:
    """Current in mA from the neighbour columns of ``with_neighbours``; missing where an input is,
    or where time does not advance."""
    t, before, after = F.col(time), F.col(f"prev_{time}"), F.col(f"next_{time}")
    if kind == DELTA and alignment == NEXT:
        return F.when(after - t > 0, F.lit(3600.0) * F.col(q) / (after - t))
    dt = t - before
    if kind == DELTA:
        return F.when(dt > 0, F.lit(3600.0) * F.col(q) / dt)
    change = F.col(q) - F.col(f"prev_{q}")
    if kind == PAIR:
        change = change - (F.col(discharge) - F.col(f"prev_{discharge}"))
    return F.when(dt > 0, F.lit(3600.0) * change / dt)


def reconstruct(df: DataFrame, how: Reconstruction, source: str = SOURCE, row: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` has time, voltage and capacity columns time, q (and discharge).  Adds current_mA and
    ``reset``: a known counter fell below its greatest earlier value, gaps passed over."""
    capacities = ["q", "discharge"] if how.kind == PAIR else ["q"]
    running = capacities if how.kind == PAIR or how.counters else []
    near = with_neighbours(df, ["time", *capacities], running, source, row, bucket_rows)
    fell = F.lit(False)
    for c in running:
        fell = fell | F.coalesce(F.col(c) < F.col(f"before_{c}"), F.lit(False))
    made = near.withColumns({CURRENT: current_expression(how.kind, how.alignment), "reset": fell})
    return made.select(*df.columns, CURRENT, "reset")


def quality_report(df: DataFrame, source: str = SOURCE, row: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per source: rows, values missing (and, where ``malformed_*`` columns are there,
    malformed), first finite time, and the first violation by row, then kind."""
    names = [c for c in (TIME, CURRENT, VOLTAGE) if c in df.columns]
    marks = {
        "time_infinite": F.abs(F.col(TIME)) == float("inf"),
        "capacity_infinite": F.col("capacity_infinite") if "capacity_infinite" in df.columns else F.lit(False),
        "counter_reset": F.col("reset") if "reset" in df.columns else F.lit(False),
        "current_infinite": F.abs(F.col(CURRENT)) == float("inf") if CURRENT in df.columns else F.lit(False),
        "voltage_infinite": F.abs(F.col(VOLTAGE)) == float("inf") if VOLTAGE in df.columns else F.lit(False),
    }
    kind = F.lit(None).cast("int")
    for rank, name in reversed(list(enumerate(VIOLATIONS))):
        if name in marks:
            kind = F.when(marks[name], F.lit(rank)).otherwise(kind)
    malformed = [c for c in df.columns if c.startswith("malformed_")]
    # what a row shows by itself needs no order; only the times go through the window
    alone = df.withColumn("__kind", kind).groupBy(source).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in names],
        *[F.count_if(c).alias(c) for c in malformed],
        *([F.count(CURRENT).alias("currents")] if CURRENT in names else []),
        F.min_by(TIME, F.when(F.col(TIME).isNotNull(), F.col(row))).alias("origin"),
        F.min(F.when(F.col("__kind").isNotNull(), F.struct(F.col(row).alias("row"), F.col("__kind").alias("kind")))).alias("__own"),
    )
    times = df.select(source, row, finite(F.col(TIME)).alias("finite"))
    fell = with_neighbours(times, [], ["finite"], source, row, bucket_rows).where("finite < before_finite")
    backward = fell.groupBy(source).agg(F.struct(F.min(row).alias("row"), F.lit(VIOLATIONS.index("time_backward")).alias("kind")).alias("__back"))
    both = alone.alias("a").join(backward.alias("b"), F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")), "left")
    first = F.when(F.col("__back").isNull() | (F.col("__own") < F.col("__back")), F.col("__own")).otherwise(F.col("__back"))
    return both.select("a.*", first.alias("violation")).drop("__own")


_MESSAGES = {
    "time_infinite": (IncompatibleDataError, "infinite time"),
    "capacity_infinite": (CurrentReconstructionError, "infinite capacity"),
    "time_backward": (NonMonotonicTimeError, "time goes backward"),
    "counter_reset": (CurrentReconstructionError, "a capacity counter was reset"),
    "current_infinite": (IncompatibleDataError, "infinite current"),
    "voltage_infinite": (IncompatibleDataError, "infinite voltage"),
}


def raise_violation(report: dict, what: str = "", reconstructed: bool = False, zero_origin: bool = False) -> None:
    """Raise what a source's report shows, the earliest row first."""
    where = f"{what}: " if what else ""
    if report["violation"] is not None:
        error, text = _MESSAGES[VIOLATIONS[report["violation"]["kind"]]]
        raise error(f"{where}{text} at row {report['violation']['row']}")
    if not report["rows"]:
        raise IncompatibleDataError(f"{where}no rows")
    if report["origin"] is None:
        raise IncompatibleDataError(f"{where}no finite time")
    if reconstructed and not report["currents"]:
        raise CurrentReconstructionError(f"{where}no current could be reconstructed")
    if zero_origin and report["origin"] != 0:
        raise IncompatibleDataError(f"{where}the first finite time is {report['origin']}, not 0")
