import pytest
from pyspark.sql import functions as F

from cellflux.errors import InvalidUnitError, UnknownUnitError
from cellflux.functions.labels import normalize_label, parse_label
from cellflux.functions.numeric import clock_seconds, decimal_number, is_malformed, number, time_number
from cellflux.functions.units import SPELLINGS, canonical_unit, conversion_factor, identify_unit


@pytest.mark.parametrize(
    ("quantity", "unit", "value", "expected"),
    [("time", "ms", 1000, 1), ("time", "min", 2, 120), ("time", "h", 1, 3600), ("time", "d", 1, 86400), ("current", "A", 1.5, 1500), ("current", "µA", 1000, 1), ("current", "μA", 1000, 1),
     ("current", "nA", 1e6, 1), ("voltage", "mV", 3700, 3.7), ("voltage", "uV", 1e6, 1), ("capacity", "Ah", 1, 1000), ("capacity", "C", 3.6, 1), ("capacity", "uAh", 1000, 1)],
)
def test_factors(quantity, unit, value, expected):
    assert value * conversion_factor(quantity, unit) == pytest.approx(expected)


def test_every_spelling_is_of_one_quantity():
    seen = [n for scales in SPELLINGS.values() for _, names in scales for n in names]
    assert len(seen) == len(set(seen)) == 78
    assert [sum(len(n) for _, n in SPELLINGS[q]) for q in ("time", "current", "voltage", "capacity")] == [27, 24, 11, 16]
    for quantity, scales in SPELLINGS.items():
        for _, names in scales:
            assert {identify_unit(n) for n in names} == {(quantity, names[0])}
        assert conversion_factor(quantity, canonical_unit(quantity)) == 1


def test_unit_faults():
    with pytest.raises(UnknownUnitError):
        conversion_factor("time", "S")
    with pytest.raises(InvalidUnitError):
        conversion_factor("time", "mA")


def test_labels():
    assert normalize_label(" Cell_Current ") == "cell current"
    assert parse_label("Current(mA)").spelling == "mA"
    assert (parse_label("time/s").name, parse_label("time/s").quantity) == ("time", "time")
    assert parse_label("Voltage V").quantity == "voltage"
    assert parse_label("Capacity (mAh/g)").derived
    assert parse_label("Q charge/mA.h").spelling == "mAh"
    assert parse_label("Voltage").unit is None
    assert parse_label("Total Time(furlong)").quantity is None


CELLS = {"1": 1.0, " 2.5 ": 2.5, "-.5": -0.5, "+3.": 3.0, "1e3": 1000.0, "inf": float("inf"), "-Infinity": float("-inf"), "1d": None, "1f": None, "0x10": None, "1_000": None,
         "NaN": None, "": None, "True": None, "1e400": None, ".": None, None: None}


def test_numbers(spark):
    rows = spark.createDataFrame([(k,) for k in CELLS], "c string").select("c", number(F.col("c")).alias("v"), is_malformed(F.col("c"), number(F.col("c"))).alias("m")).collect()
    assert {r["c"]: r["v"] for r in rows} == CELLS
    assert {r["c"] for r in rows if r["m"]} == {"1d", "1f", "0x10", "1_000", "NaN", "True", "1e400", "."}


def test_decimal_comma_and_clock(spark):
    rows = spark.createDataFrame([("1,5",), ("1.5",), ("7",)], "c string").select(decimal_number(F.col("c"), ",").alias("v"))
    assert [r["v"] for r in rows.collect()] == [1.5, None, 7.0]
    cells = ["25:00:01.125", "00:60:00", "1:02:03", "12"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(clock_seconds(F.col("c")).alias("k"), time_number(F.col("c")).alias("t"))
    assert [tuple(r) for r in rows.collect()] == [(90001.125, 90001.125), (None, None), (3723.0, 3723.0), (None, 12.0)]
