import itertools

import pandas as pd
import pytest

from cellflux.operators.standardise import CUMULATIVE, DELTA, NEXT, PAIR, VIOLATIONS, Reconstruction, quality_report, reconstruct
from cellflux.streaming.stateful import START, Acquisition, report_stream, standardise_stream

SCHEMA = "source string, row long, time double, voltage double, current double, q double, discharge double, malformed_time_s boolean, final boolean"
INF = float("inf")
END = (None, None, None, None, None, None, True)


def rows(*cells, source="a", start=0):
    """(time, voltage, current, q, discharge) cells as rows of one source."""
    return [(source, start + k, *[None if v is None else float(v) for v in c], None, False) for k, c in enumerate(cells)]


def end(row, source="a"):
    return [(source, row, *END)]


def run(spark, tmp_path, batches, made):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    name = f"out_{tmp_path.name.replace('-', '_')}"
    query = made(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    if query.exception():
        raise query.exception()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_origin_and_capacity_cross_batches(spark, tmp_path):
    cells = [(10, 3, None, 0, None), (11, 3, None, 1, None), (12, 3, None, -1, None)]
    found = run(spark, tmp_path, [rows(*cells[:2]), rows(cells[2], start=2), end(3)], lambda s: standardise_stream(s, Reconstruction(CUMULATIVE)))
    assert found == [("a", 0, 0.0, None, 3.0), ("a", 1, 1.0, 3600.0, 3.0), ("a", 2, 2.0, -7200.0, 3.0)]


def test_the_next_interval_waits_for_its_row(spark, tmp_path):
    """The last row of each micro-batch comes out with the one after it, or at the end."""
    cells = [(None, 3, None, 5, None), (10, 3, None, 1, None), (12, None, None, 2, None), (12, 3, None, 4, None)]
    found = run(spark, tmp_path, [rows(c, start=k) for k, c in enumerate(cells)] + [end(4)], lambda s: standardise_stream(s, Reconstruction(DELTA, NEXT)))
    assert found == [("a", 0, None, None, 3.0), ("a", 1, 0.0, 1800.0, 3.0), ("a", 2, 2.0, None, None), ("a", 3, 2.0, None, 3.0)]


def test_reports_of_ended_acquisitions(spark, tmp_path):
    """Violations are told, not raised, and only of what has ended."""
    first = rows((1, 3, 1, None, None), (0, None, 1, None, None)) + rows((None, 3, 2, None, None), source="b") + rows((5, 3, 2, None, None), source="c")
    found = run(spark, tmp_path, [first, end(2) + end(1, "b")], report_stream)
    assert found == [("a", 1.0, 1, "time_backward", 2, 2, 0, 0, 1, 0, 0, 0), ("b", None, None, None, 1, 1, 1, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("batches, how, message", [
    ([rows((10, 3, 1, None, None)), rows((9, 3, 1, None, None), start=1)], None, "backward at row 1"),
    ([rows((1, INF, 1, None, None))], None, "infinite voltage at row 0"),
    ([rows((1, 3, -INF, None, None))], None, "infinite current at row 0"),
    ([rows((1, 3, None, INF, None))], Reconstruction(CUMULATIVE), "infinite capacity at row 0"),
    ([rows(c, start=k) for k, c in enumerate([(1, 3, None, 2, None), (2, 3, None, None, None), (3, 3, None, 1, None)])], Reconstruction(CUMULATIVE, counters=True), "counter was reset at row 2"),
    ([rows(c, start=k) for k, c in enumerate([(1, 3, None, 2, 4), (2, 3, None, 2, 3)])], Reconstruction(PAIR), "counter was reset at row 1"),
    ([rows((1, 3, None, 2, None)), end(1)], Reconstruction(CUMULATIVE), "no current"),
    ([rows((None, 3, 1, None, None)), end(1)], None, "no finite time"),
    ([rows((1, 3, 1, None, None)), rows((2, 3, 1, None, None))], None, "row 0 came again or late"),
    ([end(0) + rows((2, 3, 1, None, None), start=1)], None, "row 1 came after the end"),
])
def test_violations_of_the_batch_path(spark, tmp_path, batches, how, message):
    """One row to most micro-batches, so that violations need the state."""
    with pytest.raises(Exception, match=message):
        run(spark, tmp_path, batches, lambda s: standardise_stream(s, how))


def test_canonical_rows_start_at_zero(spark, tmp_path):
    with pytest.raises(Exception, match="not 0"):
        run(spark, tmp_path, [rows((1, 3, 1, None, None)), end(1)], lambda s: standardise_stream(s, zero_origin=True))


#: (time, voltage, current, q, discharge): gaps, ties, a fall, falling counters, infinite values.
CASES = {
    "gaps": [(None, 3, 1, 0, 0), (5, None, None, 1, 0), (5, 3, 2, None, 1), (7, 3, 1, 3, 2), (None, 3, 1, 4, 2), (9, 3, 1, 4, 5)],
    "fall": [(1, 3, 1, 1, 1), (None, 3, 1, 5, 1), (4, 3, 1, None, 2), (None, 3, 1, 4, 3), (3, 3, 1, 6, 3), (2, 3, 1, 0, 0)],
    "infinite": [(1, 3, 1, 1, 1), (2, 3, 1, 1, 1), (3, 3, 1, 2, 1), (4, INF, -INF, 3, 1), (3, 3, 1, INF, 1), (INF, 3, 1, 1, 1)],
    "overflow": [(1, 3, 1, 0, 0), (1.5, 3, 1, 1e306, 0), (1.5000001, INF, 1, 1e308, 0), (2, 3, 1, 1e308, 1), (3, 3, 1, 1e308, 1), (4, 3, 1, 1e308, 1)],
}
KINDS = (None, Reconstruction(CUMULATIVE), Reconstruction(CUMULATIVE, counters=True), Reconstruction(DELTA), Reconstruction(DELTA, NEXT), Reconstruction(PAIR))


def _same(a, b):
    return [tuple(None if v is None or v != v else v for v in r) for r in a] == [tuple(None if v is None or v != v else v for v in r) for r in b]


@pytest.mark.parametrize("how", KINDS, ids=lambda h: "measured" if h is None else f"{h.kind}-{h.alignment}-{h.counters}")
def test_every_split_gives_the_batch_result(spark, how):
    """Rows, violations and counts of the batch path, whatever rows come together."""
    table = [r for name, cells in CASES.items() for r in rows(*cells, source=name)]
    frame = spark.createDataFrame(table, SCHEMA)
    infinite = " OR ".join(f"coalesce(abs({c}) = double('inf'), false)" for c in (["q", "discharge"] if how and how.kind == PAIR else ["q"]))
    if how is not None:
        frame = reconstruct(frame.drop("current"), how, "source", "row", 2).selectExpr("*", f"{infinite} AS capacity_infinite").withColumnRenamed("current_mA", "current")
    frame = frame.drop("malformed_time_s").withColumnsRenamed({"time": "time_s", "current": "current_mA", "voltage": "voltage_V"}).cache()
    expected = {r["source"]: r.asDict(recursive=True) for r in quality_report(frame, "source", "row", 2).collect()}
    for name, cells in CASES.items():
        values = frame.where(frame.source == name).orderBy("row").select("row", "time_s", "current_mA", "voltage_V").collect()
        report = expected[name]
        values = [(r["row"], None if r["time_s"] is None else r["time_s"] - report["origin"], r["current_mA"], r["voltage_V"]) for r in values]
        mine = pd.DataFrame(rows(*cells, source=name), columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(mine)), n) for n in range(len(mine))):
            state, out = dict(START), []
            for a, b in itertools.pairwise((0, *cuts, len(mine))):
                out += Acquisition(state, how).advance(mine.iloc[a:b], False).itertuples(index=False, name=None)
            out += Acquisition(state, how).advance(mine.iloc[:0], True).itertuples(index=False, name=None)
            violation = None if state["violation"] is None else {"row": state["violation_row"], "kind": state["violation"]}
            assert violation == report["violation"], (name, cuts, violation and VIOLATIONS[violation["kind"]])
            assert {c: state[c] for c in ("rows", "origin", "missing_time_s", "missing_voltage_V")} == {c: report[c] for c in ("rows", "origin", "missing_time_s", "missing_voltage_V")}
            if violation is None:
                assert (state["currents"], state["missing_current_mA"]) == (report["currents"], report["missing_current_mA"])
            assert _same(out[: 1 + (len(out) if violation is None else violation["row"])], values[: 1 + (len(out) if violation is None else violation["row"])]), (name, cuts)
    frame.unpersist()


def test_malformed_cells_are_counted_over_batches():
    state = dict(START)
    for k, bad in enumerate((True, None, False, True)):
        Acquisition(state, Reconstruction(DELTA, NEXT)).advance(pd.DataFrame({"row": [k], "time": [float(k)], "q": [1.0], "malformed_time_s": [bad]}), k == 3)
    assert (state["rows"], state["malformed_time_s"], state["currents"], state["missing_voltage_V"]) == (4, 2, 3, 4)
