import random
import warnings

import pytest
from pyspark.sql import functions as F

from cellflux.errors import IncompatibleDataError, MissingValueWarning, NonMonotonicTimeError
from cellflux.operators.joins import checkpoint_conflicts, join_checkpoints, trim_padding
from cellflux.operators.merge import merge
from cellflux.operators.ordered import with_neighbours
from cellflux.operators.standardise import Reconstruction, quality_report, reconstruct
from cellflux.operators.validate import is_standardized, validate
from cellflux.schema import CANONICAL_SCHEMA, ROW, SOURCE

N = None


def canonical(spark, times, current=1.0, voltage=3.7):
    return spark.createDataFrame([(None if t is None else float(t), current, voltage) for t in times], CANONICAL_SCHEMA)


def rebuilt(spark, rows, how, bucket=1 << 20):
    names = ["time", "q", "discharge"][: len(rows[0])]
    data = [("a", k, *(None if v is None else float(v) for v in r)) for k, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"{SOURCE} string, {ROW} long, " + ", ".join(f"{n} double" for n in names))
    out = reconstruct(df, how, bucket_rows=bucket).orderBy(ROW).collect()
    return [r["current_mA"] for r in out], [r["reset"] for r in out]


@pytest.mark.parametrize("bucket", [1, 2, 1000])
@pytest.mark.parametrize(
    ("rows", "kind", "alignment", "expected"),
    [
        ([(10, 0), (11, 1), (12, -1), (13, -1)], "cumulative_signed", "previous", [N, 3600, -7200, 0]),
        ([(10, 0), (11, 1), (12, -1), (13, -1)], "delta_signed", "previous", [N, 3600, -3600, -3600]),
        ([(10, 0), (11, 1), (12, -1), (13, -1)], "delta_signed", "next", [0, 3600, -3600, N]),
        ([(0, 0), (1, 1), (1, 2), (2, 3)], "cumulative_signed", "previous", [N, 3600, N, 3600]),
        ([(0, 0), (N, 1), (2, 2), (3, 3)], "cumulative_signed", "previous", [N, N, N, 3600]),
        ([(0, 0), (1, N), (2, 2), (3, 3)], "cumulative_signed", "previous", [N, N, N, 3600]),
        ([(0, 1), (N, 1), (2, 1), (3, 1)], "delta_signed", "previous", [N, N, N, 3600]),
        ([(0, 1), (N, 1), (2, 1), (3, 1)], "delta_signed", "next", [N, N, 3600, N]),
        ([(0, 0, 0), (1, 1, 0), (2, 1, 2)], "pair", "previous", [N, 3600, -7200]),
    ],
)
def test_reconstruction(spark, rows, kind, alignment, expected, bucket):
    assert rebuilt(spark, rows, Reconstruction(kind, alignment), bucket)[0] == expected


@pytest.mark.parametrize("bucket", [1, 3, 100])
def test_counter_resets_across_gaps(spark, bucket):
    assert rebuilt(spark, [(0, 1, 0), (1, N, 0), (2, 0, 0)], Reconstruction("pair"), bucket)[1] == [False, False, True]
    assert rebuilt(spark, [(0, 0), (1, 1), (2, 0)], Reconstruction("cumulative_signed", counters=True), bucket)[1] == [False, False, True]


def test_neighbours_do_not_depend_on_buckets(spark):
    random.seed(42)
    rows = [("s", k, random.choice([None, float(random.randint(0, 9))])) for k in range(500)]
    df = spark.createDataFrame(rows, f"{SOURCE} string, {ROW} long, v double").repartition(7)
    out = [[tuple(r) for r in with_neighbours(df, ["v"], ["v"], bucket_rows=b).orderBy(ROW).collect()] for b in (1, 7, 64, 10_000)]
    assert all(o == out[0] for o in out)
    best = None
    for k, r in enumerate(out[0]):
        assert r[3] == (rows[k - 1][2] if k else None) and r[4] == (rows[k + 1][2] if k < 499 else None)
        assert r[-1] == best
        if rows[k][2] is not None:
            best = rows[k][2] if best is None else max(best, rows[k][2])


@pytest.mark.parametrize(
    ("inputs", "expected"),
    [
        ([[0, 10, 20, 30], [0, 5, 10, 15]], [0, 10, 20, 30, 40, 45, 50, 55]), ([[0], [0, 5, 10]], [0, 5, 10, 15]), ([[0], [0, 0, 5]], [0, 5, 5, 10]),
        ([[0, 5, 10], [0]], [0, 5, 10, 15]), ([[0, N, 10, 10], [0, 5]], [0, N, 10, 10, 15, 20]), ([[0, 10, 10], [0, 2]], [0, 10, 10, 20, 22]),
        ([[0, 10], [0, 5], [0, 2]], [0, 10, 20, 25, 30, 32]), ([[N, 0, 10, N], [N, 0, 5, N]], [N, 0, 10, N, N, 20, 25, N]),
    ],
)
def test_merge(spark, inputs, expected):
    merged = merge([canonical(spark, t) for t in inputs])
    assert [r["time_s"] for r in merged.orderBy(ROW).collect()] == expected


def test_merge_faults(spark):
    for bad in (canonical(spark, [0]), [], [1], 3, [canonical(spark, [0]), canonical(spark, [0])], [canonical(spark, [0, N, 0])] * 2):
        with pytest.raises(IncompatibleDataError):
            merge(bad)
    with pytest.raises(NonMonotonicTimeError, match="dataset 1"):
        merge([canonical(spark, [0, 1]), canonical(spark, [0, 2, 1])])
    one = canonical(spark, [0, 1])
    assert merge([one]) is one


def test_validation(spark):
    assert is_standardized(canonical(spark, [0, N, 0, 5]))
    for bad in ([], [N], [1, 2], [0, 2, N, 1], [0, float("inf")]):
        assert not is_standardized(canonical(spark, bad))
    assert not is_standardized(canonical(spark, [0], current=float("-inf")))
    assert not is_standardized(canonical(spark, [0]).select("voltage_V", "time_s", "current_mA"))
    assert not is_standardized(canonical(spark, [0]).withColumn("time_s", F.col("time_s").cast("float")))
    assert not is_standardized(7)
    with pytest.warns(MissingValueWarning) as seen:
        validate(canonical(spark, [0, N], current=None))
    assert [w.message.affected_counts for w in seen if isinstance(w.message, MissingValueWarning)] == [{"time_s": 1, "current_mA": 2}]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert is_standardized(canonical(spark, [0, N]))


def test_first_violation_wins(spark):
    rows = [("a", 0, 0.0, 1.0, 1.0), ("a", 1, 5.0, 1.0, float("inf")), ("a", 2, 4.0, 1.0, 1.0), ("b", 0, 1.0, float("inf"), float("inf"))]
    df = spark.createDataFrame(rows, f"{SOURCE} string, {ROW} long, time_s double, current_mA double, voltage_V double")
    found = {r[SOURCE]: r["violation"] for r in quality_report(df, bucket_rows=2).collect()}
    assert (found["a"]["row"], found["a"]["kind"]) == (1, 5) and found["b"]["kind"] == 4


def test_checkpoints_and_padding(spark):
    slots = spark.createDataFrame([(k,) for k in range(1, 5)], "idx long")
    times = spark.createDataFrame([(2, 20.0), (2, 20.0), (4, 40.0), (4, 41.0)], "i long, t double")
    assert [tuple(r) for r in checkpoint_conflicts(times, "i", "t").collect()] == [(4, 40.0, 41.0)]
    joined = join_checkpoints(slots, times.where("i = 2"), "idx", "i", "t").orderBy("idx").collect()
    assert [r["t"] for r in joined] == [None, 20.0, None, None]
    data = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 2.0), (4, 0.0), (5, 0.0)], "idx long, v double")
    assert trim_padding(data, "idx", ["v"]).count() == 3
    assert trim_padding(data, "idx", ["v"], last_checkpoint=4).count() == 4
