"""Standardise acquisitions that arrive in micro-batches, in order, with bounded state.

Input rows: source, row, time (s), voltage (V), current (mA) or capacities q and discharge (mAh), final,
and, where cells were text, ``malformed_*`` flags named as in the batch report.  All kinds of capacity
are known: cumulative, increments of the previous or the next interval, pairs of counters.

State per acquisition is one row: what the batch report counts, the greatest values so far, the row
before, and, where an increment belongs to the next interval, the one row whose current is not known
until its successor comes.  Violations are those of the batch path and count in its order.  A row with
``final`` set ends its acquisition, which is when whole-source checks (any finite time, any current) are
made.  Late, repeated or backward rows are an error, so there is no watermark.

A key's rows of one micro-batch are sorted together, since a shuffle keeps no order: the source's limit
on a micro-batch (files or bytes per trigger) bounds a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import CorruptedFileError
from ..operators.standardise import DELTA, NEXT, PAIR, VIOLATIONS, Reconstruction, raise_violation
from ..schema import CURRENT, TIME, VOLTAGE

OUTPUT = f"row long, {TIME} double, {CURRENT} double, {VOLTAGE} double"
COUNTS = ("rows", "currents", *(f"{what}_{c}" for what in ("missing", "malformed") for c in (TIME, CURRENT, VOLTAGE)))
REPORT = f"origin double, violation_row long, violation string, {', '.join(f'{c} long' for c in COUNTS)}"
#: Values of the row before, greatest values so far, and the row that waits for its successor.
VALUES = ("time", "voltage", "current", "q", "discharge")
BEFORE = ("time", "q", "discharge")
FLAGS = tuple(f"malformed_{c}" for c in (TIME, CURRENT, VOLTAGE))
FIELDS = {
    "seen": "long", "origin": "double", "violation_row": "long", "violation": "int", **{c: "long" for c in COUNTS},
    **{f"before_{c}": "double" for c in BEFORE}, **{f"peak_{c}": "double" for c in BEFORE},
    "waiting_row": "long", **{f"waiting_{c}": "double" for c in VALUES}, **{f"waiting_{c}": "boolean" for c in FLAGS},
}
STATE = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
START = {**dict.fromkeys(FIELDS), "seen": -1, **dict.fromkeys(COUNTS, 0)}


def _number(value: float | None) -> float:
    return np.nan if value is None else value


def _value(number: float) -> float | None:
    return None if np.isnan(number) else float(number)


def _shifted(values: np.ndarray, first: float | None) -> np.ndarray:
    """Each row's predecessor."""
    return np.concatenate([[_number(first)], values])[: len(values)]


def _earlier_peak(values: np.ndarray, peak: float | None) -> np.ndarray:
    """The greatest finite value before each row, and, one longer, after the last."""
    finite = np.where(np.isfinite(values), values, -np.inf)
    peaks = np.maximum.accumulate(np.concatenate([[-np.inf if peak is None else peak], finite]))
    return np.where(peaks == -np.inf, np.nan, peaks)


class Acquisition:
    """The rows of one source, advanced a micro-batch at a time; ``state`` is all that is kept between."""

    def __init__(self, state: dict, how: Reconstruction | None):
        self.state = state
        self.how = how
        self.capacities = [] if how is None else ["q", "discharge"] if how.kind == PAIR else ["q"]
        self.increments = how is not None and how.kind == DELTA
        self.looks_ahead = self.increments and how.alignment == NEXT

    def advance(self, rows: pd.DataFrame, final: bool) -> pd.DataFrame:
        """``rows`` in order, those without a successor held back; the canonical rows that are ready."""
        s = self.state
        frame = {c: rows[c].to_numpy("float64", na_value=np.nan) if c in rows else np.full(len(rows), np.nan) for c in VALUES}
        flags = {c: rows[c].eq(True).to_numpy(bool) if c in rows else np.zeros(len(rows), bool) for c in FLAGS}
        number = rows["row"].to_numpy("int64")
        if s["waiting_row"] is not None:
            number = np.concatenate([[s["waiting_row"]], number])
            frame = {c: np.concatenate([[_number(s[f"waiting_{c}"])], v]) for c, v in frame.items()}
            flags = {c: np.concatenate([[bool(s[f"waiting_{c}"])], v]) for c, v in flags.items()}
        ready = len(number) - int(self.looks_ahead and not final and len(number) > 0)
        s["waiting_row"] = int(number[-1]) if ready < len(number) else None
        for c, v in frame.items():
            s[f"waiting_{c}"] = _value(v[-1]) if ready < len(number) else None
        for c, v in flags.items():
            s[f"waiting_{c}"] = bool(v[-1]) if ready < len(number) else None

        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            current = frame["current"] if self.how is None else self._current(frame)
            ahead = {c: v[:ready] for c, v in frame.items()}
            ahead["current"] = current[:ready]
            self._check(number[:ready], ahead)
        self._count(ahead, {c: v[:ready] for c, v in flags.items()})
        if ready:
            for c in BEFORE:
                s[f"before_{c}"] = _value(ahead[c][-1])
                s[f"peak_{c}"] = _value(_earlier_peak(ahead[c], s[f"peak_{c}"])[-1])
        return pd.DataFrame({"row": number[:ready], TIME: ahead["time"] - _number(s["origin"]), CURRENT: ahead["current"], VOLTAGE: ahead["voltage"]})

    def _current(self, frame: dict[str, np.ndarray]) -> np.ndarray:
        """As ``standardise.current_expression``: missing where an input is or time does not advance."""
        time, s = frame["time"], self.state
        step = np.append(time[1:], np.nan) - time if self.looks_ahead else time - _shifted(time, s["before_time"])
        change = frame["q"]
        if not self.increments:
            change = change - _shifted(change, s["before_q"])
            if self.how.kind == PAIR:
                change = change - (frame["discharge"] - _shifted(frame["discharge"], s["before_discharge"]))
        return np.where(step > 0, 3600.0 * change / step, np.nan)

    def _check(self, number: np.ndarray, frame: dict[str, np.ndarray]) -> None:
        s, n = self.state, len(number)
        known = np.flatnonzero(~np.isnan(frame["time"]))
        if s["origin"] is None and len(known):
            s["origin"] = float(frame["time"][known[0]])
        running = self.capacities if self.how is not None and (self.how.kind == PAIR or self.how.counters) else []
        marks = {
            "time_infinite": np.isinf(frame["time"]),
            "capacity_infinite": np.logical_or.reduce([np.isinf(frame[c]) for c in self.capacities] or [np.zeros(n, bool)]),
            "time_backward": np.isfinite(frame["time"]) & (frame["time"] < _earlier_peak(frame["time"], s["peak_time"])[:n]),
            "counter_reset": np.logical_or.reduce([frame[c] < _earlier_peak(frame[c], s[f"peak_{c}"])[:n] for c in running] or [np.zeros(n, bool)]),
            "current_infinite": np.isinf(frame["current"]),
            "voltage_infinite": np.isinf(frame["voltage"]),
        }
        wrong = np.stack([marks[name] for name in VIOLATIONS])
        at = np.flatnonzero(wrong.any(axis=0))
        if s["violation"] is None and len(at):
            s["violation_row"], s["violation"] = int(number[at[0]]), int(np.argmax(wrong[:, at[0]]))

    def _count(self, frame: dict[str, np.ndarray], flags: dict[str, np.ndarray]) -> None:
        s = self.state
        s["rows"] += len(frame["time"])
        s["currents"] += int(np.count_nonzero(~np.isnan(frame["current"])))
        for c, name in (("time", TIME), ("current", CURRENT), ("voltage", VOLTAGE)):
            s[f"missing_{name}"] += int(np.count_nonzero(np.isnan(frame[c])))
        for c in FLAGS:
            s[c] += int(np.count_nonzero(flags[c]))


class Standardiser(StatefulProcessor):
    """Canonical rows, the first violation raised; or, with ``report``, one row for each acquisition that
    ended, in which the violation is told and not raised."""

    def __init__(self, how: Reconstruction | None = None, zero_origin: bool = False, report: bool = False):
        self.how = how
        self.zero_origin = zero_origin
        self.report = report

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("acquisition", STATE)

    def _raise(self, source: str, s: dict, ended: bool) -> None:
        violation = None if s["violation"] is None else {"row": s["violation_row"], "kind": s["violation"]}
        if violation or ended:
            raise_violation({**s, "violation": violation}, source, self.how is not None, self.zero_origin)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = dict(zip(FIELDS, self.kept.get(), strict=True)) if self.kept.exists() else dict(START)
        batch = pd.concat(list(rows)).sort_values("row", kind="stable")
        number, ends = batch["row"].to_numpy("int64"), batch["final"].eq(True).to_numpy(bool)
        again = np.flatnonzero(np.diff(number, prepend=state["seen"]) <= 0)
        if len(again):
            raise CorruptedFileError(f"{key[0]}: row {number[again[0]]} came again or late")
        if ends[:-1].any():
            raise CorruptedFileError(f"{key[0]}: row {number[np.argmax(ends) + 1]} came after the end")
        state["seen"], final = int(number[-1]), bool(ends[-1])
        out = Acquisition(state, self.how).advance(batch[~ends], final)
        if not self.report:
            self._raise(key[0], state, final)
        if final:
            self.kept.clear()
        else:
            self.kept.update(tuple(state.values()))
        if not self.report:
            out.insert(0, "source", key[0])
            yield out
        elif final:
            kind = None if state["violation"] is None else VIOLATIONS[state["violation"]]
            told = {"source": key[0], "origin": state["origin"], "violation_row": state["violation_row"], "violation": kind, **{c: state[c] for c in COUNTS}}
            yield pd.DataFrame([told]).astype({"origin": "float64", "violation_row": "Int64"})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, processor: Standardiser, schema: str) -> DataFrame:
    kind = rows.schema["source"].dataType.simpleString()
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"source {kind}, {schema}", outputMode="Append", timeMode="None")


def standardise_stream(rows: DataFrame, how: Reconstruction | None = None, zero_origin: bool = False) -> DataFrame:
    """Canonical rows of a stream, measured or, with ``how``, reconstructed.  ``zero_origin``: the rows
    are canonical already, so that the first finite time must be 0."""
    return _run(rows, Standardiser(how, zero_origin), OUTPUT)


def report_stream(rows: DataFrame, how: Reconstruction | None = None) -> DataFrame:
    """One row for each acquisition that ended: what ``quality_report`` says of the same rows.  Counts
    of currents after an infinite value may differ from it, as its row is the violation anyway."""
    return _run(rows, Standardiser(how, report=True), REPORT)
