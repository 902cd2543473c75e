"""Python data sources for files that Spark's own readers can't take strictly.

One data source reads any number of files; each file, and each range of records where records have a
fixed width, is a partition of its own.  Specifications are JSON, so a scan carries no state but paths
and numbers.  Faults are raised as text that starts with a marker, which ``translated`` turns back
into the library's errors on the driver.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import errors
from ..schema import ROW, SOURCE
from . import neware

ROWS_PER_BATCH = 20_000
#: Records of fixed width per partition.
ROWS_PER_RANGE = 1 << 20
#: A delimited file of this size or more is read in ranges of lines, of so many bytes.
SPLIT_BYTES, LEAST_RANGE, MOST_RANGE = 4 << 20, 2 << 20, 64 << 20
#: Encodings in which a line feed byte is always a line feed.
_SPLITTABLE = frozenset({"utf-8", "ascii", "cp1252", "latin-1", "iso-8859-1"})
#: Small files are read together, so many bytes by one task; opening a file counts as so many.
LEAST_TOGETHER, MOST_TOGETHER, OPEN_BYTES = 1 << 20, 64 << 20, 64 << 10
#: What specifications of files of one shape differ in.
PER_FILE = ("path", "offset", "rows", "stamp", "ranges")
_MARK = "cellflux-error:"


class _Range:
    def __init__(self, spec: dict, begin: int = 0, end: int | None = None, row: int = 0):
        self.spec, self.begin, self.end, self.row = spec, begin, end, row


class _Ranges(InputPartition):
    """What one task reads: a range of a large file, or many small files."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def stamp(path: str) -> list[int]:
    """What changes when a file is replaced or written to."""
    s = os.stat(path)
    return [s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns]


def text_records(path: str, encoding: str, separator: str, skiprows: int) -> Iterator[list[str]]:
    """Records of the whole file, strictly decoded and quoted, blank ones left out."""
    csv.field_size_limit(sys.maxsize)
    with open(path, encoding=encoding, errors="strict", newline="") as f:
        for _ in range(skiprows):
            if not f.readline():
                return
        rows = (line.split() for line in f) if separator == "whitespace" else csv.reader(f, delimiter=separator, strict=True)
        for row in rows:
            if row and (len(row) > 1 or row[0].strip()):
                yield row


def data_start(spec: dict) -> int | None:
    """Where the records after the header begin; None if a quote before that may hide a line feed."""
    with open(spec["path"], "rb") as f:
        for _ in range(spec["skiprows"]):
            f.readline()
        wanted = -1 if spec["header_record"] is None else spec["header_record"]
        while wanted >= 0 and (head := f.readline()):
            if b'"' in head:
                return None
            wanted -= bool(head.strip())
        return f.tell()


def byte_ranges(spec: dict) -> list[tuple[int, int]]:
    """Ranges of bytes of a large file whose lines can be its records; nothing but the header is read."""
    total = os.path.getsize(spec["path"])
    if total < SPLIT_BYTES or spec["separator"] == "whitespace" or spec["encoding"].lower() not in _SPLITTABLE:
        return []
    begin = data_start(spec)
    size = min(MOST_RANGE, max(LEAST_RANGE, total // 64))
    return [] if begin is None else [(at, min(at + size, total)) for at in range(begin, total, size)]


def survey(spec: dict, begin: int, end: int) -> tuple[int, int, int, bool]:
    """Of the lines that start in a range of bytes: where they begin and end, how many are records, and
    whether each line is one for certain (no quotes, no lone carriage returns)."""
    with open(spec["path"], "rb") as f:
        if begin > spec["start"]:
            f.seek(begin - 1)
            f.readline()  # the line that began before, or nothing but its end
        else:
            f.seek(begin)
        first = f.tell()
        data = f.read(max(0, end - first))
        if data and not data.endswith(b"\n"):
            data += f.readline()
    plain = b'"' not in data and data.count(b"\r") == data.count(b"\r\n")
    body = data.removesuffix(b"\n")
    lines = body.count(b"\n") + 1 if data else 0
    blanks = len((_BLANK_TAB if spec["separator"] == "\t" else _BLANK).findall(body)) if data else 0
    return first, first + len(data), lines - blanks, plain


#: Lines that are no records; where tabs separate cells, a line of tabs is one.
_BLANK, _BLANK_TAB = re.compile(rb"(?m)^[ \t\r\f\v]*$"), re.compile(rb"(?m)^[ \r\f\v]*$")


def with_ranges(spark: SparkSession, specs: list[dict]) -> list[dict]:
    """Large text files with the ranges of whole lines that tasks read, and the number of each range's
    first record: one job counts records range by range, one row each comes to the driver."""
    asked = []
    for spec in specs:
        ranges = byte_ranges(spec) if spec["kind"] == "text" else []
        if ranges:
            asked.append({**spec, "kind": "survey", "start": ranges[0][0], "asked": ranges, "n_columns": 4})
    if not asked:
        return specs
    with translated():
        rows = spark.read.format("cellflux").option("specs", packed(asked)).load().collect()
    out = []
    for spec in specs:
        mine = sorted({(int(r["c0"]), int(r["c1"]), int(r["c2"]), r["c3"]) for r in rows if r[SOURCE] == spec["path"]})
        if mine and all(plain for *_, plain in mine):
            row, ranges = 0, []
            for begin, end, records, _ in mine:
                if end > begin:
                    ranges.append((begin, end, row))
                row += records
            spec = {**spec, "ranges": ranges}
        out.append(spec)
    return out


def _range_rows(spec: dict, data: bytes) -> list[pa.Array]:
    """The selected columns of a range's records, strictly of one width."""
    names = [f"f{k}" for k in range(spec["width"])]
    chosen = [f"f{p}" for p in spec["positions"]]
    if spec["encoding"].lower() in ("utf-8", "ascii") and not spec["strip_last"]:
        try:
            table = pacsv.read_csv(
                pa.BufferReader(data), pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(data) + 1)),
                pacsv.ParseOptions(delimiter=spec["separator"], quote_char=False), pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=chosen, strings_can_be_null=False),
            )
            return [table.column(c).combine_chunks() for c in chosen]
        except pa.ArrowInvalid:
            pass  # a fault, or a line of blanks: the slower way tells
    records = []
    for record in csv.reader(io.StringIO(data.decode(spec["encoding"], "strict")), delimiter=spec["separator"], strict=True):
        if not record or len(record) == 1 and not record[0].strip():
            continue
        if spec["strip_last"] and len(record) == spec["width"] + 1 and not record[-1].strip():
            record.pop()
        if len(record) != spec["width"]:
            raise errors.CorruptedFileError(f"{spec['path']}: a record has {len(record)} cells, not {spec['width']}")
        records.append(record)
    return [pa.array([r[p] for r in records], pa.string()) for p in spec["positions"]]


def _text_range(spec: dict, begin: int, end: int, row: int) -> Iterator[pa.RecordBatch]:
    with open(spec["path"], "rb") as f:
        f.seek(begin)
        data = f.read(end - begin)
    if len(data) != end - begin:
        raise errors.CorruptedFileError(f"{spec['path']} changed while it was read")
    try:
        columns = _range_rows(spec, data)
    except (UnicodeError, csv.Error) as error:
        raise errors.CorruptedFileError(f"{spec['path']}: {error}") from error
    for at in range(0, len(columns[0]), ROWS_PER_BATCH):
        part = [c.slice(at, ROWS_PER_BATCH) for c in columns]
        yield _batch(spec["path"], row + at, len(part[0]), part)


def _text(spec: dict) -> Iterator[pa.RecordBatch]:
    width, positions, header = spec["width"], spec["positions"], spec["header_record"]
    drop = -1 if header is None else header
    row, held = 0, []

    def batch() -> pa.RecordBatch:
        cells = [pa.array([r[p] for r in held], pa.string()) for p in positions]
        return _batch(spec["path"], row, len(held), cells)

    try:
        for k, record in enumerate(text_records(spec["path"], spec["encoding"], spec["separator"], spec["skiprows"])):
            if k <= drop:
                continue
            if spec["strip_last"] and len(record) == width + 1 and not record[-1].strip():
                record.pop()
            if len(record) != width:
                raise errors.CorruptedFileError(f"record {k} has {len(record)} cells, not {width}")
            held.append(record)
            if len(held) == ROWS_PER_BATCH:
                yield batch()
                row, held = row + len(held), []
    except (UnicodeError, csv.Error) as error:
        raise errors.CorruptedFileError(f"{spec['path']}: {error}") from error
    if held:
        yield batch()


def _batch(path: str, row: int, n: int, columns: list[pa.Array]) -> pa.RecordBatch:
    names = [SOURCE, ROW, *(f"c{k}" for k in range(len(columns)))]
    return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(row, row + n)), *columns], names=names)


def _mpr(spec: dict, begin: int, end: int) -> Iterator[pa.RecordBatch]:
    """Fixed-width records by range; the file must be the one that was planned."""
    kind = np.dtype([tuple(x) for x in spec["fields"]])
    with open(spec["path"], "rb") as f:
        f.seek(spec["offset"] + begin * kind.itemsize)
        for row in range(begin, end, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, end - row)
            raw = f.read(n * kind.itemsize)
            if len(raw) != n * kind.itemsize or stamp(spec["path"]) != spec["stamp"]:
                raise errors.CorruptedFileError(f"{spec['path']} changed while it was read")
            table = np.frombuffer(raw, kind)
            yield _batch(spec["path"], row, n, [_doubles(table[name].astype(np.float64)) for name in spec["names"]])


def _doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _neware(spec: dict) -> Iterator[pa.RecordBatch]:
    row = 0
    for columns in neware.records(spec["path"]):
        yield _batch(spec["path"], row, len(columns[0]), [_doubles(c) for c in columns])
        row += len(columns[0])


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:
        return 0  # the task that opens it tells


def _together(whole: list[_Range]) -> list[InputPartition]:
    """Whole files in their order, neighbours read by one task up to a share of all bytes."""
    costs = [_size(r.spec["path"]) + OPEN_BYTES for r in whole]
    most = min(MOST_TOGETHER, max(LEAST_TOGETHER, sum(costs) // 64))
    out: list[InputPartition] = []
    held, total = [], 0
    for one, cost in zip(whole, costs, strict=True):
        if held and total + cost > most:
            out.append(_Ranges(held))
            held, total = [], 0
        held.append(one)
        total += cost
    return [*out, _Ranges(held)] if held else out


class _Reader(DataSourceReader):
    def __init__(self, specs: list[dict]):
        self.specs = specs

    def __getstate__(self) -> dict:
        return {"specs": []}  # a task gets its own files with its partition, not all of them

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        whole: list[_Range] = []
        for spec in self.specs:
            if spec["kind"] == "mpr" and spec["rows"] > ROWS_PER_RANGE:
                out += [_Ranges([_Range(spec, k, min(k + ROWS_PER_RANGE, spec["rows"]))]) for k in range(0, spec["rows"], ROWS_PER_RANGE)]
            elif spec["kind"] == "mpr":
                whole.append(_Range(spec, 0, spec["rows"]))
            elif spec["kind"] == "survey":
                out += [_Ranges([_Range(spec, *r)]) for r in spec["asked"]]
            elif spec.get("ranges"):
                slim = {k: v for k, v in spec.items() if k != "ranges"}
                out += [_Ranges([_Range(slim, *r)]) for r in spec["ranges"]]
            else:
                whole.append(_Range(spec))
        return out + _together(whole)

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        spec = partition.spec
        try:
            if spec["kind"] == "text" and partition.end is not None:
                yield from _text_range(spec, partition.begin, partition.end, partition.row)
            elif spec["kind"] == "text":
                yield from _text(spec)
            elif spec["kind"] == "survey":
                found = survey(spec, partition.begin, partition.end)
                yield _batch(spec["path"], 0, 1, [pa.array([float(x)]) for x in found])
            elif spec["kind"] == "mpr":
                yield from _mpr(spec, partition.begin, partition.end)
            else:
                yield from _neware(spec)
        except errors.DataStandardizationError as error:
            raise RuntimeError(f"{_MARK}{type(error).__name__}:{error}{_MARK}") from error
        except OSError as error:
            raise RuntimeError(f"{_MARK}CorruptedFileError:{spec['path']}: {error}{_MARK}") from error


def packed(specs: list[dict]) -> str:
    shapes: dict[str, tuple[dict, list[dict]]] = {}
    for spec in specs:
        common = {k: v for k, v in spec.items() if k not in PER_FILE}
        shapes.setdefault(repr(common), (common, []))[1].append({k: spec[k] for k in PER_FILE if k in spec})
    return json.dumps(list(shapes.values()))


class RecordSource(DataSource):
    """Format ``cellflux``: option ``specs`` is a JSON list of file specifications of one shape, each
    shape's common part followed by what its files differ in."""

    @classmethod
    def name(cls) -> str:
        return "cellflux"

    def _specs(self) -> list[dict]:
        return [{**common, **own} for common, files in json.loads(self.options["specs"]) for own in files]

    def schema(self) -> str:
        first = json.loads(self.options["specs"])[0][0]
        kind = "string" if first["kind"] == "text" else "double"
        return ", ".join([f"{SOURCE} string", f"{ROW} long", *(f"c{k} {kind}" for k in range(first["n_columns"]))])

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self._specs())


def load(spark: SparkSession, specs: list[dict]) -> DataFrame:
    spark.dataSource.register(RecordSource)
    specs = with_ranges(spark, specs)
    return spark.read.format("cellflux").option("specs", packed(specs)).load()


@contextmanager
def translated() -> Iterator[None]:
    """Errors that a scan raised on an executor, as the library's own."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        text = str(error)
        if _MARK not in text:
            raise
        name, _, message = text.split(_MARK)[1].partition(":")
        raise getattr(errors, name)(message) from error
