"""Outputs that appear only when they are complete and valid."""

from __future__ import annotations

import csv
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IncompatibleDataError, OutputExistsError
from ..schema import CANONICAL_COLUMNS, ROW

FORMATS = ("parquet", "csv", "txt")
ROWS_PER_GROUP = 250_000


def output_format(destination: str, requested: str | None) -> str:
    kind = requested.lower() if isinstance(requested, str) else os.path.splitext(destination)[1][1:].lower()
    if kind not in FORMATS:
        raise IncompatibleDataError(f"cannot write {kind or 'a file without suffix'}; formats are {FORMATS}")
    return kind


@contextmanager
def published(destination: str, overwrite: bool) -> Iterator[str]:
    """A sibling path to write to.  It takes the destination's name only when the block ends well:
    by an atomic rename, or without overwriting by a link that fails if the name was taken meanwhile."""
    folder = os.path.dirname(os.path.abspath(destination))
    if not os.path.isdir(folder):
        raise IncompatibleDataError(f"{folder} does not exist")
    if os.path.lexists(destination) and not overwrite:
        raise OutputExistsError(f"{destination} exists")
    handle, path = tempfile.mkstemp(dir=folder, prefix=".cellflux-", suffix=os.path.splitext(destination)[1])
    os.close(handle)
    try:
        yield path
        if overwrite:
            os.replace(path, destination)
        else:
            try:
                os.link(path, destination)
            except FileExistsError as error:
                raise OutputExistsError(f"{destination} exists") from error
    finally:
        if os.path.lexists(path):
            os.unlink(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch as one binary value, which reaches the driver without becoming rows."""
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def ordered_batches(df: DataFrame, rows: int = ROWS_PER_GROUP) -> Iterator[pa.Table]:
    """The canonical rows in order, a partition of them at the driver at a time, in tables of ``rows``."""
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    schema = pa.schema([(c, pa.float64()) for c in CANONICAL_COLUMNS])
    held: list[pa.Table] = []
    for packed in ordered.select(*CANONICAL_COLUMNS).mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
        held.append(pa.ipc.open_stream(packed["batch"]).read_all().cast(schema))
        while sum(map(len, held)) >= rows:
            table = pa.concat_tables(held)
            yield table.slice(0, rows)
            held = [table.slice(rows)]
    left = pa.concat_tables(held) if held else None
    if left is not None and len(left):
        yield left


def write_file(df: DataFrame, path: str, kind: str, rows: int = ROWS_PER_GROUP) -> None:
    """One file; one row group per table.  Missing values are nulls, or empty cells in text."""
    schema = pa.schema([(c, pa.float64()) for c in CANONICAL_COLUMNS])
    if kind == "parquet":
        with pq.ParquetWriter(path, schema) as out:
            for table in ordered_batches(df, rows):
                out.write_table(table)
        return
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, delimiter="," if kind == "csv" else "\t", lineterminator="\n")
        out.writerow(CANONICAL_COLUMNS)
        for table in ordered_batches(df, rows):
            out.writerows(zip(*(c.to_pylist() for c in table.columns), strict=True))  # floats by repr, None as nothing


def write_folder(df: DataFrame, folder: str, kind: str = "parquet", overwrite: bool = False) -> None:
    """A distributed write for large outputs: part files in row order, in any store Spark knows.  Its
    committer publishes the folder's files only when all tasks are done."""
    ordered = df.repartitionByRange(ROW).sortWithinPartitions(ROW) if ROW in df.columns else df
    out = ordered.select(*[F.col(c) for c in CANONICAL_COLUMNS]).write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "parquet":
        out.parquet(folder)
    else:
        out.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(folder)
