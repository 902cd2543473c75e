"""The public functions: the same eight names and options whatever the file."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .errors import DataStandardizationError, IncompatibleDataError, MalformedValueWarning, MissingValueWarning
from .functions.numeric import decimal_number, is_malformed, time_number
from .functions.units import to_canonical
from .operators.merge import merge
from .operators.standardise import quality_report, raise_violation, reconstruct
from .operators.validate import coerced, is_standardized, missing_counts, validate, with_row_numbers
from .plans.models import FormatInfo, InspectionResult, ReadOptions, make_options
from .schema import CANONICAL_COLUMNS, CURRENT, ROW, SOURCE, TIME, VOLTAGE
from .sources.readers import REGISTRY, ParquetReader, Scan
from .sources.records import PER_FILE, load, translated
from .sources.sinks import ordered_batches, output_format, published, write_file

__all__ = ["detect_format", "inspect", "read", "read_many", "iter_read", "write", "convert", "merge", "is_standardized", "release"]
CHUNK_ROWS = 250_000
#: So many files are planned on the driver, more of them in a job; and origins of so many are broadcast.
DRIVER_FILES, BROADCAST_FILES = 200, 10_000


def _path(source: object) -> str:
    if not isinstance(source, (str, os.PathLike)):
        raise IncompatibleDataError("a source is a path")
    path = os.fspath(source)
    if not os.path.isfile(path):
        raise IncompatibleDataError(f"{path} is no file")
    return path


def detect_format(path: object) -> FormatInfo:
    return REGISTRY.select(_path(path))[1]


def inspect(path: object, *, reader: str | None = None, **options: object) -> InspectionResult:
    """How a file's columns are understood, from its head alone; no Spark job runs."""
    where = _path(path)
    chosen, _ = REGISTRY.select(where, reader)
    return chosen.inspect(where, make_options(**options))


_kept: list[DataFrame] = []


def _keep(df: DataFrame) -> DataFrame:
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


@contextmanager
def _released() -> Iterator[None]:
    """Parsed rows that are kept within the block are let go at its end."""
    before = len(_kept)
    try:
        yield
    finally:
        while len(_kept) > before:
            _kept.pop().unpersist()


def release() -> None:
    """Let go of the parsed rows that ``read`` and ``read_many`` keep for their callers."""
    while _kept:
        _kept.pop().unpersist()


def _typed(cell: Column, scan: Scan, quantity: str) -> Column:
    if scan.spec["kind"] != "text":
        return cell
    return time_number(cell, scan.decimal) if quantity == "time" else decimal_number(cell, scan.decimal)


def _frame(spark: SparkSession, scans: list[Scan]) -> DataFrame:
    """Files of one shape as one frame: source, row, time, voltage, current (or capacities made to
    current), malformed flags, ``clock`` where a time cell is a clock.  Parsed values are kept in memory
    and on disk: the check, the windows and the reader's user all go over them."""
    scan = scans[0]
    raw = load(spark, [s.final_spec() for s in scans])
    b, text = scan.binding, scan.spec["kind"] == "text"
    if scan.micros:
        return _keep(raw.select(SOURCE, ROW, F.col("c0").alias(TIME), F.col("c1").alias(CURRENT), F.col("c2").alias(VOLTAGE)))
    roles = [("time", "time", b.time), ("voltage", "voltage", b.voltage)]
    if b.current:
        roles.append(("current", "current", b.current))
    else:
        roles += [(name, "capacity", s) for name, s in zip(("q", "discharge"), b.capacities, strict=False)]
    out = raw
    for k, (role, quantity, selected) in enumerate(roles):
        value = _typed(F.col(f"c{k}"), scan, quantity)
        out = out.withColumn(f"v{k}", value)
        if text:
            out = out.withColumn(f"bad{k}", is_malformed(F.col(f"c{k}"), F.col(f"v{k}")))
        out = out.withColumn(role, to_canonical(F.col(f"v{k}"), quantity, selected.unit))
    names = {"time": TIME, "voltage": VOLTAGE, "current": CURRENT}
    flags = [F.col(f"bad{k}").alias(f"malformed_{names[r]}") for k, (r, _, _) in enumerate(roles) if text and r in names]
    clocks = [F.col("c0").contains(":").alias("clock")] if text and b.time.unit != "s" else []
    if b.current:
        frame = out.select(SOURCE, ROW, F.col("time").alias(TIME), F.col("current").alias(CURRENT), F.col("voltage").alias(VOLTAGE), *flags, *clocks)
        return _keep(frame)
    capacities = [r for r, q, _ in roles if q == "capacity"]
    infinite = F.lit(False)
    for c in capacities:
        infinite = infinite | F.coalesce(F.abs(F.col(c)) == float("inf"), F.lit(False))
    # dt comes from times before the origin is taken off
    parsed = _keep(out.select(SOURCE, ROW, "time", "voltage", *capacities, infinite.alias("capacity_infinite"), *flags, *clocks))
    made = reconstruct(parsed, b.how)
    return made.withColumnsRenamed({"time": TIME, "voltage": VOLTAGE}).drop(*capacities)


def _signature(scan: Scan) -> tuple:
    spec = {k: v for k, v in scan.spec.items() if k in ("kind", "fields")}
    return repr(spec), scan.binding, scan.decimal, scan.names, scan.canonical, scan.micros


def _warn(report: dict, what: str) -> None:
    malformed = {c: report[f"malformed_{c}"] for c in CANONICAL_COLUMNS if report.get(f"malformed_{c}")}
    missing = missing_counts(report)
    if malformed:
        warnings.warn(MalformedValueWarning(f"{what}: cells that are no numbers: {malformed}", malformed), stacklevel=3)
    if missing:
        warnings.warn(MissingValueWarning(f"{what}: missing values: {missing}", missing), stacklevel=3)


def _group(spark: SparkSession, scans: list[Scan], emit: bool = True) -> tuple[DataFrame, dict[str, dict]]:
    """Validated canonical rows of files of one shape, with source and row; one aggregate job."""
    frame = _frame(spark, scans)
    clock = "clock" in frame.columns
    with translated():
        if clock and frame.where("clock").limit(1).count():
            raise IncompatibleDataError("clock times need the unit s")
        reports = {r[SOURCE]: r.asDict(recursive=True) for r in quality_report(frame).collect()}
    scan = scans[0]
    for s in scans:
        path = s.spec["path"]
        report = reports.setdefault(path, {"rows": 0, "violation": None, "origin": None})
        raise_violation(report, path, reconstructed=scan.binding.how is not None, zero_origin=scan.canonical)
        if emit:
            _warn(report, path)
    time = F.col(TIME)
    if not scan.canonical:
        if len(scans) == 1:
            time = time - F.lit(float(reports[scan.spec["path"]]["origin"]))
        else:  # one row for each path given to the driver
            origins = spark.createDataFrame([(p, float(r["origin"])) for p, r in reports.items()], f"{SOURCE} string, origin double")
            frame = frame.join(F.broadcast(origins) if len(reports) <= BROADCAST_FILES else origins, SOURCE)
            time = time - F.col("origin")
    if scan.micros:
        time = time / 1e6
    return frame.select(SOURCE, ROW, time.alias(TIME), CURRENT, VOLTAGE), reports


def _parquet(spark: SparkSession, path: str, options: ReadOptions, emit: bool) -> DataFrame:
    ParquetReader().check(path, options)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.row_index").alias(ROW))
    frame = coerced(rows.withColumn(SOURCE, F.lit(path)))
    row = quality_report(frame).first()
    report = row.asDict(recursive=True) if row else {"rows": 0, "violation": None, "origin": None}
    raise_violation(report, path, zero_origin=True)
    if emit:
        _warn(report, path)
    return frame.select(SOURCE, ROW, *CANONICAL_COLUMNS)


def _planned(path: str, reader: str | None, options: ReadOptions) -> Scan | None:
    """None for canonical Parquet, which Spark reads."""
    chosen, _ = REGISTRY.select(_path(path), reader)
    return None if isinstance(chosen, ParquetReader) else chosen.scan(path, options)


def _plans(spark: SparkSession, paths: list[str], reader: str | None, options: ReadOptions) -> list[tuple[tuple, Scan | None]]:
    """Every path's signature and scan; of many files the tasks of a job look at the heads, and each
    shape's common part comes to the driver once a task."""
    if len(paths) <= DRIVER_FILES:
        return [(_signature(scan) if scan else (), scan) for scan in (_planned(p, reader, options) for p in paths)]

    def part(numbered: Iterator[tuple[int, str]]) -> Iterator[tuple[list[Scan | None], list[tuple[int, int, dict]], tuple[int, str, str] | None]]:
        shapes: dict[str, int] = {}
        scans, files, fault = [], [], None
        for k, path in numbered:
            try:
                scan = _planned(path, reader, options)
            except DataStandardizationError as error:
                fault = k, type(error).__name__, str(error)
                break
            own = {x: scan.spec[x] for x in PER_FILE if x in scan.spec} if scan else {}
            common = scan and replace(scan, spec={x: v for x, v in scan.spec.items() if x not in PER_FILE})
            at = shapes.setdefault(repr(common), len(shapes))
            if at == len(scans):
                scans.append(common)
            files.append((k, at, own))
        yield scans, files, fault

    found = spark.sparkContext.parallelize(list(enumerate(paths)), min(256, len(paths) // 50)).mapPartitions(part).collect()
    faults = [fault for _, _, fault in found if fault]
    if faults:
        _, name, message = min(faults)
        raise getattr(errors, name)(message)
    out, known = [], {}
    for scans, files, _ in found:
        shapes = [known.setdefault(repr(s), (_signature(s) if s else (), s)) for s in scans]
        out += [(signature, scan and replace(scan, spec={**scan.spec, **own})) for _, at, own in files for signature, scan in (shapes[at],)]
    return out


def read_many(spark: SparkSession, paths: Sequence[object], *, reader: str | None = None, emit_warnings: bool = True, **options: object) -> DataFrame:
    """Many acquisitions in one job per shape of file: columns source and row, then the canonical ones."""
    checked = make_options(**options)
    groups: dict[tuple, list[Scan]] = {}
    parts = []
    where = [_path(p) for p in paths]
    for path, (signature, scan) in zip(where, _plans(spark, where, reader, checked), strict=True):
        if scan is None:
            parts.append(_parquet(spark, path, checked, emit_warnings))
        else:
            groups.setdefault(signature, []).append(scan)
    parts += [_group(spark, scans, emit_warnings)[0] for scans in groups.values()]
    if not parts:
        raise IncompatibleDataError("nothing to read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read(spark: SparkSession, path: object, reader: str | None, options: dict, emit: bool = True) -> DataFrame:
    return read_many(spark, [path], reader=reader, emit_warnings=emit, **options)


def read(spark: SparkSession, path: object, *, reader: str | None = None, **options: object) -> DataFrame:
    """A file's canonical rows in their order; validated before it returns.  Scans keep the order of
    their partitions, so only reconstructed rows, which windows moved, are sorted."""
    frame = _read(spark, path, reader, options)
    return (frame if _in_order(path, reader, options) else frame.orderBy(ROW)).select(*CANONICAL_COLUMNS)


def _in_order(path: object, reader: str | None, options: dict) -> bool:
    chosen, _ = REGISTRY.select(_path(path), reader)
    return isinstance(chosen, ParquetReader) or chosen.scan(_path(path), make_options(**options)).binding.how is None


def iter_read(spark: SparkSession, path: object, *, reader: str | None = None, chunk_size: int = CHUNK_ROWS, **options: object) -> Iterator[pa.Table]:
    """The same rows as tables of at most ``chunk_size`` rows, in order, a partition at the driver at a
    time.  The whole source is validated before the first table."""
    if not isinstance(chunk_size, int) or isinstance(chunk_size, bool) or chunk_size < 1:
        raise IncompatibleDataError("chunk_size is a positive whole number")
    ordered = _in_order(path, reader, options)

    before = len(_kept)
    try:
        frame = _read(spark, path, reader, options)
    finally:
        mine, _kept[before:] = _kept[before:], []

    def tables() -> Iterator[pa.Table]:
        try:
            yield from ordered_batches(frame.drop(ROW) if ordered else frame, chunk_size)
        finally:  # also when the caller closes the iterator
            for kept in mine:
                kept.unpersist()

    return tables()


def write(dataframe: DataFrame, destination: object, *, format: str | None = None, overwrite: bool = False) -> str:  # noqa: A002
    """One canonical file, written after the whole frame was validated; returns its path."""
    path = os.fspath(destination)
    kind = output_format(path, format)
    numbered = isinstance(dataframe, DataFrame) and SOURCE in dataframe.columns and ROW in dataframe.columns
    with published(path, overwrite) as temporary, _released():
        frame = with_row_numbers(coerced(dataframe), _keep) if isinstance(dataframe, DataFrame) else dataframe
        validate(frame)
        write_file(frame if numbered else frame.drop(ROW), temporary, kind)
    return path


def convert(spark: SparkSession, source: object, destination: object, *, format: str | None = None, overwrite: bool = False, chunk_size: int = CHUNK_ROWS, reader: str | None = None, **options: object) -> str:  # noqa: A002
    """A file of any known format as one canonical file."""
    path = os.fspath(destination)
    kind = output_format(path, format)
    if not isinstance(chunk_size, int) or isinstance(chunk_size, bool) or chunk_size < 1:
        raise IncompatibleDataError("chunk_size is a positive whole number")
    where = _path(source)
    make_options(**options)
    REGISTRY.select(where, reader)[0].inspect(where, make_options(**options))
    with published(path, overwrite) as temporary, _released():
        frame = _read(spark, where, reader, options)
        write_file(frame.drop(ROW) if _in_order(where, reader, options) else frame, temporary, kind, chunk_size)
    return path
