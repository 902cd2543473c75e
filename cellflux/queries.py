"""The registered queries of the standardisation operators over the test tables, with their SQL.

An acquisition is the events of one user: row is event_id, time is ts in seconds, charge is value in
whole cents, so that running sums are exact.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions.numeric import clock_seconds, decimal_number, is_malformed, number
from .functions.units import to_canonical
from .operators.joins import checkpoint_conflicts, join_checkpoints, trim_padding
from .operators.merge import merge_segments, segment_summary
from .operators.ordered import running_sums, with_neighbours
from .operators.standardise import CUMULATIVE, DELTA, NEXT, PAIR, PREVIOUS, Reconstruction, current_expression, normalise_time, quality_report, reconstruct
from .operators.validate import coerced
from .plans.recognition import recognize_columns
from .schema import CANONICAL_COLUMNS, CURRENT, ROW, SOURCE, TIME, VOLTAGE
from .sources import encode
from .sources.sinks import write_folder
from .streaming.stateful import report_stream, standardise_stream


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, row, t and cents of every event."""
    e = _table(spark, sf_dir, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    cents = F.round(F.coalesce(F.col("value"), F.lit(0.0)) * 100).cast("long").alias("cents")
    return e.select(F.col("user_id").alias(SOURCE), F.col("event_id").alias(ROW), t, cents, "event_type")


_EVENTS = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, round(coalesce(value, 0) * 100)::BIGINT AS cents, event_type FROM events)"
_W = "OVER (PARTITION BY user_id ORDER BY event_id)"


def _named(df: DataFrame, *columns: object) -> DataFrame:
    return df.select(F.col(SOURCE).alias("user_id"), F.col(ROW).alias("event_id"), *columns)


def _charged(rows: DataFrame, **parts: Column) -> DataFrame:
    """Each of ``parts`` (in cents) summed up over the acquisition, as a capacity."""
    summed = running_sums(rows.withColumns(parts), list(parts))
    return summed.withColumns({c: F.col(c) / F.lit(100.0) for c in parts})


def time_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(normalise_time(_events(spark, sf_dir), "t"), F.col("t").alias("time_s"))


def _reconstruction(rows: DataFrame, how: Reconstruction) -> DataFrame:
    return _named(reconstruct(rows.withColumnRenamed("t", "time"), how), CURRENT)


def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("q", F.col("cents") / F.lit(100.0))


def recon_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruction(_charged(_events(spark, sf_dir), q=F.col("cents")), Reconstruction(CUMULATIVE))


def recon_delta_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruction(_increments(spark, sf_dir), Reconstruction(DELTA, PREVIOUS))


def recon_delta_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconstruction(_increments(spark, sf_dir), Reconstruction(DELTA, NEXT))


def recon_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    charging = F.col("event_type").isin("click", "purchase")
    part = lambda chosen: F.when(chosen, F.col("cents")).otherwise(0)
    return _reconstruction(_charged(_events(spark, sf_dir), q=part(charging), discharge=part(~charging)), Reconstruction(PAIR))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed time and reconstructed current of every acquisition."""
    rows = _charged(_events(spark, sf_dir), q=F.col("cents"))
    near = with_neighbours(rows.withColumnRenamed("t", "time"), ["time", "q"])
    made = near.withColumn(CURRENT, current_expression(CUMULATIVE))
    return _named(normalise_time(made, "time"), F.col("time").alias(TIME), CURRENT)


#: Another order of the rows, as dense as theirs: every 10,007 of them change places.
_SHUFFLED = "cast({row} - {row} % 10007 + {row} * 7919 % 10007 AS bigint)"


def monotonic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward times of rows taken in another order: how many, and the first."""
    rows = _events(spark, sf_dir).withColumn("event_id", F.col(ROW)).withColumn(ROW, F.expr(_SHUFFLED.format(row=ROW)))
    near = with_neighbours(rows, [], ["t"]).where("t < before_t")
    return near.groupBy(F.col(SOURCE).alias("user_id")).agg(F.count("*").alias("violations"), F.min_by("event_id", ROW).alias("first_event"))


def reset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Falls of a counter below its greatest earlier value."""
    near = with_neighbours(_events(spark, sf_dir), [], ["cents"]).where("cents < before_cents")
    return near.groupBy(F.col(SOURCE).alias("user_id")).agg(F.count("*").alias("resets"), F.min(ROW).alias("first_event"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    frame = rows.select(
        SOURCE, ROW, F.when(F.col(ROW) % 7 != 0, F.col("t")).alias(TIME), F.when(F.col(ROW) % 5 != 0, F.col("cents") / F.lit(100.0)).alias(CURRENT),
        (F.col("cents") / F.lit(1000.0)).alias(VOLTAGE), (F.col(ROW) % 11 == 0).alias("malformed_current_mA"),
    )
    report = quality_report(frame)
    return report.select(
        F.col(SOURCE).alias("user_id"), "rows", F.col("missing_time_s").alias("missing_time"), F.col("missing_current_mA").alias("missing_current"),
        F.col("malformed_current_mA").alias("malformed_current"), "origin", F.col("violation.row").alias("violation_row"),
    )


_CELLS = """CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN 'bad' WHEN 2 THEN concat(cast(o_orderkey AS {s}), 'd') WHEN 3 THEN concat(cast(o_orderkey AS {s}), 'e3')
 WHEN 4 THEN concat(' ', cast(o_orderkey AS {s}), ' ') WHEN 5 THEN concat('-', cast(o_orderkey AS {s}), '.5') WHEN 6 THEN '1_000' WHEN 7 THEN '1e400'
 WHEN 8 THEN '.25' WHEN 9 THEN concat('+', cast(o_orderkey AS {s}), '.') WHEN 10 THEN '0x10' ELSE cast(o_orderkey AS {s}) END"""


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CELLS.format(s="string")).alias("cell"))
    rows = rows.withColumn("value", number(F.col("cell")))
    return rows.select("o_orderkey", "value", is_malformed(F.col("cell"), F.col("value")).alias("malformed"))


def decimal_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.when(F.col("o_orderkey") % 3 == 0, ".").otherwise(",")
    cell = F.concat(F.col("o_orderkey").cast("string"), point, (F.col("o_custkey") % 1000).cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", decimal_number(cell, ",").alias("value"))


def clock_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    key = F.col("o_orderkey")
    cell = F.concat((key % 100).cast("string"), F.lit(":"), two(key % 70), F.lit(":"), two(F.floor(key / 7) % 60), F.lit(".125"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", clock_seconds(cell).alias("seconds"))


def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    scaled = [
        to_canonical(F.col("l_extendedprice"), "current", "A").alias("current_mA"), to_canonical(F.col("l_quantity"), "time", "min").alias("time_s"),
        to_canonical(F.col("l_discount"), "voltage", "mV").alias("voltage_V"), to_canonical(F.col("l_tax"), "capacity", "C").alias("capacity_mAh"),
    ]
    return rows.select("l_orderkey", "l_linenumber", *scaled)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh time is missing; a quarter of the acquisitions stand still, so have no step."""
    still = F.when(F.col(SOURCE) % 4 == 0, F.lit(1e9)).otherwise(F.col("t"))
    return _events(spark, sf_dir).withColumn("t", F.when(F.col(ROW) % 7 != 0, still))


def bridge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment_summary(_segments(spark, sf_dir), "t")
    return found.select(F.col(SOURCE).alias("user_id"), "rows", "first_time", "last_time", "first_step", "last_step")


def merge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acquisition that stands still is bridged by the next one's first step."""
    merged = merge_segments(_segments(spark, sf_dir).withColumn("user", F.col(SOURCE)), "user", "t")
    return _named(merged, F.round("t", 3).alias("time_s"))


def _ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")


def checkpoints_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = _table(spark, sf_dir, "orders").select("o_orderkey")
    return join_checkpoints(slots, _ships(spark, sf_dir), "o_orderkey", "l_orderkey", "l_shipdate")


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_conflicts(_ships(spark, sf_dir), "l_orderkey", "l_shipdate")


def padding_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(SOURCE, ROW, F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0).alias("slot"))
    return _named(trim_padding(rows, ROW, ["slot"], source=SOURCE), "slot")


#: Labels of the recognition query with the quantity and state they must get.
LABELS = (
    ("Time/s", "time", "resolved"), ("Step Time(s)", "time", "unresolved"), ("Current (mA)", "current", "resolved"), ("Max Current (A)", "current", "unresolved"),
    ("Voltage(V)", "voltage", "resolved"), ("Charge Capacity(mAh)", "capacity", "resolved"), ("Discharge Capacity(mAh)", "capacity", "resolved"),
    ("Specific Capacity (mAh/g)", "capacity", "unresolved"), ("Step Type", "unknown", "unresolved"),
)


def recognise_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize_columns([label for label, _, _ in LABELS])
    return spark.createDataFrame([(m.source_position, m.source_column, m.quantity, m.state) for m in found], "position long, label string, quantity string, state string")


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the order of their ids as one acquisition."""
    rows = _events(spark, sf_dir)
    start = rows.agg(F.min("t").alias("start"))
    frame = rows.join(F.broadcast(start), F.lit(True))  # one row
    return frame.select(
        (F.col("t") - F.col("start")).alias(TIME), F.when(F.col(ROW) % 7 != 0, F.col("cents") / F.lit(100.0)).alias(CURRENT), (F.col("cents") / F.lit(1000.0)).alias(VOLTAGE),
        F.lit(0).alias(SOURCE), ROW,
    )


def _folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/roundtrip-{name}-{uuid.uuid4().hex}"


def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "parquet")
    _canonical(spark, sf_dir).select(*CANONICAL_COLUMNS, ROW).write.parquet(path)
    back = spark.read.parquet(path)
    return coerced(back).select(F.col(ROW).alias("event_id"), *CANONICAL_COLUMNS)


def roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    _canonical(spark, sf_dir).select(ROW, *CANONICAL_COLUMNS).write.option("header", True).csv(path)
    back = spark.read.schema(f"{ROW} long, " + ", ".join(f"{c} string" for c in CANONICAL_COLUMNS)).option("header", True).csv(path)
    return back.select(F.col(ROW).alias("event_id"), *[number(F.col(c)).alias(c) for c in CANONICAL_COLUMNS])


def _local(spark: SparkSession, name: str) -> str:
    """A folder for files that are opened by path: the shared one must be mounted by all executors."""
    path = _folder(spark, name).removeprefix("file:")
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


#: Columns of the events that the fixtures are made of: whole numbers, so that every format holds them.
_FIXTURE = ("user_id", "event_id", "unix_micros(cast(ts as timestamp)) AS micros", "cast(round(coalesce(value, 0D) * 100) AS bigint) AS cents", "30000 + pmod(event_id * 37, 12000) AS volts")


def _read_back(spark: SparkSession, sf_dir: str, name: str, suffix: str, encoded: Callable[[pd.DataFrame], bytes], **options: object) -> DataFrame:
    """Every user's events as one file of a format, made by the executors and read by the library: user,
    row and the canonical columns."""
    folder = _local(spark, name)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the users that have not ended yet

        def files(events: pd.DataFrame) -> pd.DataFrame:
            users = events.user_id.to_numpy()
            cuts = [0, *(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
            paths = []
            for first, end in zip(cuts, cuts[1:], strict=False):
                paths.append(f"{folder}/{users[first]}.{suffix}")
                with open(paths[-1], "wb") as f:
                    f.write(encoded(events.iloc[first:end]))
            return pd.DataFrame({"path": paths})

        for part in parts:
            if not len(part):
                continue
            if held and part.user_id.iloc[-1] != held[0].user_id.iloc[-1]:
                whole = pd.concat([*held, part], ignore_index=True)
                open_ = whole.user_id == whole.user_id.iloc[-1]
                yield files(whole[~open_])
                held = [whole[open_]]
            else:
                held.append(part)
        if held:
            yield files(pd.concat(held, ignore_index=True))

    events = _table(spark, sf_dir, "events").selectExpr(*_FIXTURE)
    paths = [r["path"] for r in events.repartition("user_id").sortWithinPartitions("user_id", "event_id").mapInPandas(put, "path string").collect()]
    found = api.read_many(spark, sorted(paths), emit_warnings=False, **options)
    user = F.regexp_extract(SOURCE, r"([0-9]+)[.][a-z]+$", 1).cast("long")
    return found.select(user.alias("user_id"), F.col(ROW).alias("row"), *CANONICAL_COLUMNS)


def _comma(cents: int) -> str:
    return f"{cents / 100:.2f}".replace(".", ",")


def source_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons, decimal commas, and other units than the canonical ones."""
    labels = ("Elapsed Time (ms)", "Current (A)", "Potential (mV)", "Step Type")
    return _read_back(
        spark, sf_dir, "delimited", "csv",
        lambda e: encode.delimited(labels, [[str(m // 1000) for m in e.micros], [_comma(c) for c in e.cents], [f"{v},0" for v in e.volts], ["x"] * len(e)], ";"),
    )


def source_mpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ("mode", "time/s", "<I>/mA", "Ewe/V")
    return _read_back(spark, sf_dir, "mpt", "mpt", lambda e: encode.mpt(labels, [["1"] * len(e), [f"{m // 1000 / 1000:.3f}" for m in e.micros], [f"{c / 100:.2f}" for c in e.cents], [f"{v / 10000:.4f}" for v in e.volts]]))


def source_mpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of flags, known ones that are not canonical, and accessory ones between the three."""
    return _read_back(
        spark, sf_dir, "mpr", "mpr",
        lambda e: encode.mpr_file({1: np.zeros(len(e)), 4: e.micros / 1e6, 24: np.ones(len(e)), 115: np.zeros(len(e), "V8"), 8: e.cents / 100, 39: np.ones(len(e)), 6: e.volts / 10000}),
    )


def source_mpr_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current from signed increments of charge, in a file without one."""
    return _read_back(spark, sf_dir, "mpr-dq", "mpr", lambda e: encode.mpr_file({4: e.micros / 1e6, 7: e.cents / 100, 6: e.volts / 10000}, 2))


def source_nda29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir, "nda29", "nda", lambda e: encode.nda_29(e.micros.to_numpy(), e.cents.to_numpy(), e.volts.to_numpy(), 10))


def source_nda130(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir, "nda130", "nda", lambda e: encode.nda_130(e.micros.to_numpy(), e.cents.to_numpy() / 100, e.volts.to_numpy() / 10000))


def source_nda130_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir, "nda130n", "nda", lambda e: encode.nda_130(e.micros.to_numpy(), e.cents.to_numpy() / 100, e.volts.to_numpy() / 10000, True))


def source_ndax_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(spark, sf_dir, "ndax", "ndax", lambda e: encode.ndax_full(e.micros.to_numpy(), e.cents.to_numpy(), e.volts.to_numpy(), -50, 2 + 3 * (int(e.user_id.iloc[0]) % 2)))


def source_ndax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third measurement has a recorded time; the others' times stay missing."""
    return _read_back(spark, sf_dir, "split", "ndax", lambda e: encode.ndax_split(e.micros.to_numpy(), e.cents.to_numpy() / 100, e.volts.to_numpy() / 10000, np.arange(len(e)) % 3 == 0))


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that the stream's operator needs."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _streamed(spark: SparkSession, rows: DataFrame, made: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """All rows in their order through a stream that is stopped and taken up again for each part of them,
    then every acquisition's end; what the stream wrote."""
    folder = _folder(spark, "stream")
    last = rows.agg(F.max("row").alias("last")).first()["last"] or 0
    ends = rows.groupBy("source").agg(F.lit(last + 1).cast("long").alias("row"), F.lit(True).alias("final"))
    rows = rows.withColumn("final", F.lit(False))
    rows.where("false").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    with _rocksdb(spark):
        for k in range(batches):
            part = rows.where((F.col("row") * batches >= k * (last + 1)) & (F.col("row") * batches < (k + 1) * (last + 1)))
            if k == batches - 1:
                part = part.unionByName(ends, allowMissingColumns=True)
            part.write.mode("append").parquet(f"{folder}/in")
            query = made(arriving).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(made(arriving).schema).parquet(f"{folder}/out")


def stream_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increments of the next interval: the last row of each part waits for the part after it."""
    rows = _events(spark, sf_dir).select(
        F.col(SOURCE).alias("source"), F.col(ROW).alias("row"), F.when(F.col(ROW) % 7 != 0, F.col(ROW).cast("double")).alias("time"),
        (F.col("cents") / F.lit(1000.0)).alias("voltage"), (F.col("cents") / F.lit(100.0)).alias("q"),
    )
    found = _streamed(spark, rows, lambda s: standardise_stream(s, Reconstruction(DELTA, NEXT)))
    return found.select(F.col("source").alias("user_id"), F.col("row").alias("event_id"), *CANONICAL_COLUMNS)


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with times that fall, and how much is missing or malformed, at each acquisition's end."""
    rows = _events(spark, sf_dir).select(
        F.col(SOURCE).alias("source"), F.col(ROW).alias("row"), F.when(F.col(ROW) % 7 != 0, (F.col(ROW) * 31 % 1009).cast("double")).alias("time"),
        (F.col("cents") / F.lit(1000.0)).alias("voltage"), F.when(F.col(ROW) % 5 != 0, F.col("cents") / F.lit(100.0)).alias("current"), (F.col(ROW) % 11 == 0).alias("malformed_current_mA"),
    )
    found = _streamed(spark, rows, report_stream)
    return found.select(
        F.col("source").alias("user_id"), "rows", F.col("missing_time_s").alias("missing_time"), F.col("missing_current_mA").alias("missing_current"),
        F.col("malformed_current_mA").alias("malformed_current"), "origin", "violation_row",
    )


def _in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the order of time as one canonical acquisition, those without a time last as in the SQL."""
    return _canonical(spark, sf_dir).orderBy(F.asc_nulls_last(TIME), F.asc_nulls_last(ROW)).select(*CANONICAL_COLUMNS)


def _rows_of(spark: SparkSession, path: str) -> DataFrame:
    return api.read_many(spark, [path], emit_warnings=False).select(F.col(ROW).alias("row"), *CANONICAL_COLUMNS)


def sink_write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_of(spark, api.write(_in_time(spark, sf_dir), f"{_local(spark, 'sink')}/out.parquet"))


def sink_write_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_of(spark, api.write(_in_time(spark, sf_dir), f"{_local(spark, 'sink')}/out.txt"))


def sink_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text to Parquet by ``convert``, the text written by ``write``."""
    folder = _local(spark, "sink")
    text = api.write(_in_time(spark, sf_dir), f"{folder}/out.csv")
    return _rows_of(spark, api.convert(spark, text, f"{folder}/out.parquet"))


def sink_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distributed sink, with the rows' own numbers."""
    path = _folder(spark, "folder")
    rows = _canonical(spark, sf_dir)
    write_folder(rows.withColumn(CURRENT, F.coalesce(CURRENT, F.col(ROW).cast("double"))), path)
    return spark.read.parquet(path).select(*CANONICAL_COLUMNS)


#: So many of the tables are written as one row group.
TABLES_TOGETHER = 250


def sink_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``iter_read`` in tables of 997 rows, each numbered from where the one before ended.  They are
    written to a file as they come, so the driver holds ``TABLES_TOGETHER`` of them and a partition's rows at a time."""
    folder = _local(spark, "sink")
    path = api.write(_in_time(spark, sf_dir), f"{folder}/out.csv")
    schema = pa.schema([("row", pa.int64()), ("part", pa.int64()), *((c, pa.float64()) for c in CANONICAL_COLUMNS)])
    row, held = 0, []
    with pq.ParquetWriter(f"{folder}/tables.parquet", schema) as out:
        for k, table in enumerate(api.iter_read(spark, path, chunk_size=997)):
            numbers = [pa.array(np.arange(row, row + len(table))), pa.array(np.full(len(table), k))]
            held.append(pa.table([*numbers, *table.columns], schema))
            row += len(table)
            if len(held) == TABLES_TOGETHER:
                out.write_table(pa.concat_tables(held))
                held = []
        if held:
            out.write_table(pa.concat_tables(held))
    return spark.read.parquet(f"file://{folder}/tables.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship, "time_origin": time_origin, "recon_cumulative": recon_cumulative, "recon_delta_prev": recon_delta_prev,
    "recon_delta_next": recon_delta_next, "recon_pair": recon_pair, "monotonic_report": monotonic_report, "reset_report": reset_report,
    "quality_report": quality, "numeric_coerce": numeric_coerce, "decimal_comma": decimal_comma, "clock_parse": clock_parse, "unit_scale": unit_scale,
    "bridge_intervals": bridge_intervals, "merge_segments": merge_users, "checkpoint_join": checkpoints_joined, "checkpoint_conflicts": conflicts,
    "trim_padding": padding_trimmed, "recognise_labels": recognise_labels, "roundtrip_csv": roundtrip_csv, "roundtrip_parquet": roundtrip_parquet,
    **{
        f.__name__: f
        for f in (
            source_delimited, source_mpt, source_mpr, source_mpr_increments, source_nda29, source_nda130, source_nda130_newer, source_ndax_full, source_ndax_split,
            sink_write_parquet, sink_write_text, sink_convert, sink_folder, sink_tables, stream_reconstruct, stream_report,
        )
    },
}

_Q = f"q AS (SELECT *, sum(cents) {_W} / 100.0 AS q FROM e)"
_LAGS = f"(t - lag(t) {_W})"
_CANONICAL_SQL = f"WITH {_EVENTS} SELECT event_id, t - (SELECT min(t) FROM e) AS time_s, CASE WHEN event_id % 7 <> 0 THEN cents / 100.0 END AS \"current_mA\", cents / 1000.0 AS \"voltage_V\" FROM e"
_SEGMENTS_SQL = f"""{_EVENTS}, g AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN user_id % 4 = 0 THEN 1e9 ELSE t END END AS t FROM e),
d AS (SELECT *, t - lag(t) {_W} AS dt FROM g),
s AS (SELECT user_id, count(*) AS rows, arg_min(t, event_id) FILTER (t IS NOT NULL) AS first_time, arg_max(t, event_id) FILTER (t IS NOT NULL) AS last_time,
  arg_min(dt, event_id) FILTER (dt > 0) AS first_step, arg_max(dt, event_id) FILTER (dt > 0) AS last_step FROM d GROUP BY user_id)"""

def _source_sql(time: str, current: str, voltage: str, extra: str = "") -> str:
    """What reading a file of each user's events must give, from the table itself."""
    return f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, round(coalesce(value, 0) * 100)::BIGINT AS cents, 30000 + (event_id * 37) % 12000 AS volts FROM events),
n AS (SELECT *, row_number() {_W} - 1 AS row, {time} AS t FROM e)
SELECT user_id, row, {extra or f"t - first_value(t) {_W}"} AS time_s, {current} AS "current_mA", {voltage} AS "voltage_V" FROM n"""


_FLOAT = "CAST(cents / 100.0 AS FLOAT)::DOUBLE", "CAST(volts / 10000.0 AS FLOAT)::DOUBLE"
_IN_TIME_SQL = f"""WITH {_EVENTS}, c AS (SELECT event_id, t - (SELECT min(t) FROM e) AS time_s, CASE WHEN event_id % 7 <> 0 THEN cents / 100.0 END AS "current_mA", cents / 1000.0 AS "voltage_V" FROM e)
SELECT row_number() OVER (ORDER BY time_s, event_id) - 1 AS row, time_s, "current_mA", "voltage_V" FROM c"""
_REPORT_SQL = f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN ({{time}})::DOUBLE END AS g FROM e),
m AS (SELECT *, max(g) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT user_id, count(*) AS rows, count(*) FILTER (event_id % 7 = 0) AS missing_time, count(*) FILTER (event_id % 5 = 0) AS missing_current,
  count(*) FILTER (event_id % 11 = 0) AS malformed_current, arg_min(g, event_id) FILTER (g IS NOT NULL) AS origin, min(event_id) FILTER (g < before) AS violation_row
FROM m GROUP BY user_id"""

ORACLES: dict[str, str] = {
    "source_delimited": _source_sql("(us // 1000)::DOUBLE * 0.001::DOUBLE", "(cents / 100.0) * 1000", "volts::DOUBLE * 0.001::DOUBLE"),
    "source_mpt": _source_sql("(us // 1000) / 1000.0", "cents / 100.0", "volts / 10000.0"),
    "source_mpr": _source_sql("us / 1e6", *_FLOAT),
    "source_mpr_increments": _source_sql("us / 1e6", f"CASE WHEN t - lag(t) {_W} > 0 THEN 3600.0::DOUBLE * (cents / 100.0) / (t - lag(t) {_W}) END", _FLOAT[1]),
    "source_nda29": _source_sql("(us // 1000000)::DOUBLE", "cents * 0.001::DOUBLE", "volts / 10000.0"),
    "source_nda130": _source_sql("us", *_FLOAT, extra=f"(us - first_value(us) {_W}) / 1e6"),
    "source_nda130_newer": _source_sql("us", *_FLOAT, extra=f"(us - first_value(us) {_W}) / 1e6"),
    "source_ndax_full": _source_sql("(us // 1000000)::DOUBLE", "cents * 0.0001::DOUBLE", "volts / 10000.0"),
    "source_ndax_split": _source_sql("us // 1000 * 1000", _FLOAT[0], "CAST(volts AS FLOAT)::DOUBLE * 0.0001::DOUBLE", extra=f"CASE WHEN row % 3 = 0 THEN (t - first_value(t) {_W}) / 1e6 END"),
    "sink_write_parquet": _IN_TIME_SQL, "sink_write_text": _IN_TIME_SQL, "sink_convert": _IN_TIME_SQL,
    "sink_folder": f"SELECT time_s, coalesce(\"current_mA\", event_id) AS \"current_mA\", \"voltage_V\" FROM ({_CANONICAL_SQL})",
    "sink_tables": f"SELECT *, row // 997 AS part FROM ({_IN_TIME_SQL})",
    "flagship": f"WITH {_EVENTS}, {_Q} SELECT user_id, event_id, t - first_value(t) {_W} AS time_s, CASE WHEN {_LAGS} > 0 THEN 3600.0::DOUBLE * (q - lag(q) {_W}) / {_LAGS} END AS \"current_mA\" FROM q",
    "time_origin": f"WITH {_EVENTS} SELECT user_id, event_id, t - first_value(t) {_W} AS time_s FROM e",
    "recon_cumulative": f"WITH {_EVENTS}, {_Q} SELECT user_id, event_id, CASE WHEN {_LAGS} > 0 THEN 3600.0::DOUBLE * (q - lag(q) {_W}) / {_LAGS} END AS \"current_mA\" FROM q",
    "recon_delta_prev": f"WITH {_EVENTS} SELECT user_id, event_id, CASE WHEN {_LAGS} > 0 THEN 3600.0::DOUBLE * (cents / 100.0) / {_LAGS} END AS \"current_mA\" FROM e",
    "recon_delta_next": f"WITH {_EVENTS} SELECT user_id, event_id, CASE WHEN lead(t) {_W} - t > 0 THEN 3600.0::DOUBLE * (cents / 100.0) / (lead(t) {_W} - t) END AS \"current_mA\" FROM e",
    "recon_pair": f"""WITH {_EVENTS}, p AS (SELECT *, sum(CASE WHEN event_type IN ('click', 'purchase') THEN cents ELSE 0 END) {_W} / 100.0 AS c,
  sum(CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE cents END) {_W} / 100.0 AS d FROM e)
SELECT user_id, event_id, CASE WHEN {_LAGS} > 0 THEN 3600.0::DOUBLE * ((c - lag(c) {_W}) - (d - lag(d) {_W})) / {_LAGS} END AS "current_mA" FROM p""",
    "monotonic_report": f"""WITH {_EVENTS}, k AS (SELECT *, {_SHUFFLED.format(row="event_id")} AS k FROM e),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT user_id, count(*) AS violations, arg_min(event_id, k) AS first_event FROM m WHERE t < before GROUP BY user_id""",
    "reset_report": f"""WITH {_EVENTS}, m AS (SELECT *, max(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT user_id, count(*) AS resets, min(event_id) AS first_event FROM m WHERE cents < before GROUP BY user_id""",
    "stream_reconstruct": f"""WITH {_EVENTS}, g AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN event_id::DOUBLE END AS g FROM e)
SELECT user_id, event_id, g - min(g) OVER (PARTITION BY user_id) AS time_s, CASE WHEN lead(g) {_W} - g > 0 THEN 3600.0::DOUBLE * (cents / 100.0) / (lead(g) {_W} - g) END AS "current_mA",
  cents / 1000.0 AS "voltage_V" FROM g""",
    "stream_report": _REPORT_SQL.format(time="event_id * 31 % 1009"),
    "quality_report": _REPORT_SQL.format(time="t"),
    "numeric_coerce": f"""WITH c AS (SELECT o_orderkey, {_CELLS.format(s="VARCHAR")} AS cell FROM orders),
n AS (SELECT *, CASE WHEN regexp_full_match(trim(cell), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(trim(cell) AS DOUBLE) END AS v FROM c)
SELECT o_orderkey, CASE WHEN isfinite(v) THEN v END AS value, trim(cell) <> '' AND (v IS NULL OR NOT isfinite(v)) AS malformed FROM n""",
    "decimal_comma": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN cast(concat(o_orderkey::VARCHAR, '.', (o_custkey % 1000)::VARCHAR) AS DOUBLE) END AS value FROM orders",
    "clock_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 70 < 60 THEN (o_orderkey % 100)::DOUBLE * 3600 + (o_orderkey % 70)::DOUBLE * 60 + ((o_orderkey // 7) % 60 + 0.125)::DOUBLE END AS seconds FROM orders",
    "unit_scale": 'SELECT l_orderkey, l_linenumber, l_extendedprice * 1000 AS "current_mA", l_quantity * 60 AS time_s, l_discount * 0.001::DOUBLE AS "voltage_V", l_tax * (1::DOUBLE / 3.6::DOUBLE) AS "capacity_mAh" FROM lineitem',
    "bridge_intervals": f"WITH {_SEGMENTS_SQL} SELECT * FROM s",
    "merge_segments": f"""WITH {_SEGMENTS_SQL}, u AS (SELECT *, lag(last_time - first_time) OVER (ORDER BY user_id) + coalesce(lag(last_step) OVER (ORDER BY user_id), first_step) AS step FROM s),
o AS (SELECT user_id, first_time, (SELECT arg_min(first_time, user_id) FROM u) + coalesce(sum(step) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS start FROM u)
SELECT user_id, event_id, round(t - first_time + start, 3) AS time_s FROM g JOIN o USING (user_id)""",
    "checkpoint_join": "SELECT o_orderkey, l_shipdate FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "checkpoint_conflicts": "SELECT l_orderkey, min(l_shipdate) AS least, max(l_shipdate) AS greatest FROM lineitem GROUP BY l_orderkey HAVING min(l_shipdate) <> max(l_shipdate)",
    "trim_padding": f"""WITH {_EVENTS}, s AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END AS slot FROM e),
l AS (SELECT user_id, max(event_id) AS last FROM s WHERE slot <> 0 GROUP BY user_id) SELECT user_id, event_id, slot FROM s JOIN l USING (user_id) WHERE event_id <= last""",
    "recognise_labels": "SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{a}', '{b}', '{c}')" for k, (a, b, c) in enumerate(LABELS)) + ") AS t(position, label, quantity, state)",
    "roundtrip_csv": _CANONICAL_SQL,
    "roundtrip_parquet": _CANONICAL_SQL,
}
