"""Variable-capacity best-fit packing of documents into sequences, planned over the whole table.

Pieces are placed in decreasing length into the open bin with the least room that still takes them.
Where none does, a bin is opened at the permitted capacity of least cost per token it is likely to
hold, taking all permitted lengths into account at once: a bin costs its length, a quadratic share
for attention and a fixed overhead, and is likely to hold the piece and as much of its remaining room
as the pieces still to come that fit into it can fill.  At the end every bin is cut down to the
smallest permitted capacity that holds its contents.

Pieces of one length are alike, and there are at most ``max(capacities)`` lengths, so the plan is made
on the driver from the histogram of lengths alone: bins with the same contents are one range of bin
numbers, and a step of the plan puts a range of pieces of one length into a range of bins.  A step
leaves a bin less than half the room it had or ends a length, so the plan has a number of steps that
the capacities bound whatever the number of documents.  Each piece finds its step by its length and
its place among the pieces of that length, so neither the bins' fill nor their number depends on
how the rows are partitioned.  Only lengths are counted, joined or shuffled.

A document longer than the greatest capacity is cut into pieces of that capacity and a rest, which
are packed separately.  A null, negative or zero length takes no room: one row with a null bin.
Repeated rows are packed each on its own, ids may be null, an empty table gives no rows, ties of
length are dealt by the rows' places in the scan, and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, named, written

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Pieces of one document that are made at once.
PIECES_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Cost:
    overhead: float = 16.0
    attention: float = 1 / 32768

    def of(self, capacity: int) -> float:
        return capacity + self.attention * capacity * capacity + self.overhead


@dataclass(frozen=True)
class Plan:
    """Steps by length: pieces from place ``first`` on go ``per_bin`` to a bin from ``bin`` on, behind
    the ``offset`` tokens that are there; and the final capacity of each range of bins."""

    size: np.ndarray
    first: np.ndarray
    bin: np.ndarray
    per_bin: np.ndarray
    offset: np.ndarray
    range_first: np.ndarray
    range_capacity: np.ndarray
    bins: int

    def places(self, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, offset and the bin's capacity of the pieces with these lengths and places."""
        if not len(size):
            return (np.zeros(0, np.int64),) * 3
        step = np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            a, b = np.searchsorted(self.size, [s, s + 1])
            mine = size == s
            step[mine] = a + np.searchsorted(self.first[a:b], place[mine], side="right") - 1
        nth = place - self.first[step]
        bins = self.bin[step] + nth // self.per_bin[step]
        offset = self.offset[step] + nth % self.per_bin[step] * size
        return bins, offset, self.range_capacity[np.searchsorted(self.range_first, bins, side="right") - 1]


def plan_bins(sizes: np.ndarray, counts: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Cost | None = None) -> Plan:
    """The plan for so many pieces of each length; lengths are distinct and 1..max(capacities)."""
    cost = cost or Cost()
    capacities = tuple(sorted(capacities))
    prices = [cost.of(c) for c in capacities]
    most = capacities[-1]
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    upto = np.append(0, np.cumsum(sizes * counts))  # tokens in pieces shorter than each length
    steps: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # distinct rooms of open bins
    by_room: dict[int, deque[tuple[int, int, int]]] = {}  # ranges (first bin, bins, used) of each room
    closed: list[tuple[int, int, int]] = []
    bins = 0

    def put(room: int, first: int, n: int, used: int) -> None:
        if not n:
            return
        if not room:
            closed.append((first, n, used))
            return
        if room not in by_room:
            insort(rooms, room)
            by_room[room] = deque()
        by_room[room].append((first, n, used))

    for k in range(len(sizes) - 1, -1, -1):
        size, left, place = int(sizes[k]), int(counts[k]), 0

        def fill(room: int, first: int, n: int, used: int) -> None:
            """As many pieces as are left into the range; what is not needed stays as it is."""
            nonlocal left, place
            per = min(room // size, left)
            whole = min(n, left // per)
            steps.append((size, place, first, per, used))
            put(room - per * size, first, whole, used + per * size)
            place, left = place + whole * per, left - whole * per
            first, n = first + whole, n - whole
            if n and left:  # the last bin takes fewer
                steps.append((size, place, first, left, used))
                put(room - left * size, first, 1, used + left * size)
                place, left, first, n = place + left, 0, first + 1, n - 1
            put(room, first, n, used)

        while left and (at := bisect_left(rooms, size)) < len(rooms):
            room = rooms[at]
            held = by_room[room].popleft()
            if not by_room[room]:
                del by_room[room], rooms[at]
            fill(room, *held)
        while left:
            best = None
            for capacity, price in zip(capacities, prices, strict=True):
                if capacity >= size:
                    rest = capacity - size
                    # pieces still to come that fit: shorter ones, and those of this length after this one
                    come = int(upto[np.searchsorted(sizes, rest, side="right")]) if rest < size else int(upto[k]) + (left - 1) * size
                    rate = price / (size + min(rest, come))
                    if best is None or rate < best[0]:
                        best = (rate, capacity)
            per = best[1] // size
            # the choice holds as long as more is to come than any bin has room for
            n = max(1, ((left - 1) * size - most) // (per * size))
            first, bins = bins, bins + n
            fill(best[1], first, n, 0)
    for held in by_room.values():
        closed += held
    closed.sort()
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    ends = np.array(closed, np.int64).reshape(-1, 3)
    final = np.array(capacities, np.int64)[np.searchsorted(capacities, ends[:, 2])]
    return Plan(*table.T, ends[:, 0], final, bins)


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, cost: Cost | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's final capacity.  Lengths are 1..max(capacities)."""
    sizes, which, counts = np.unique(lengths, return_inverse=True, return_counts=True)
    plan = plan_bins(sizes, counts, capacities, cost)
    order = np.argsort(which, kind="stable")
    place = np.empty(len(lengths), np.int64)
    place[order] = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
    bins, offsets, capacity = plan.places(np.asarray(lengths, np.int64), place)
    final = np.zeros(plan.bins, np.int64)
    final[bins] = capacity
    return bins, offsets, final


def _pieces(most: int):
    """Pieces (id, start, size, part, place): place is the piece's among those of its size in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            length = batch.column(1).to_numpy()
            n = np.maximum(1, -(-length // most))
            row = 0
            while row < len(length):
                # rows with about PIECES_AT_ONCE pieces in all; a longer document is cut by parts
                stop = row + max(1, int(np.searchsorted(np.cumsum(n[row:]), PIECES_AT_ONCE, side="right")))
                for skip in range(0, int(n[row]) if stop == row + 1 else 1, PIECES_AT_ONCE):
                    many = np.minimum(n[row:stop] - skip, PIECES_AT_ONCE)
                    own = np.repeat(np.arange(row, stop), many)
                    start = (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + skip) * most
                    size = np.minimum(most, length[own] - start)
                    order = np.argsort(size, kind="stable")
                    values, counts = np.unique(size, return_counts=True)
                    place = np.empty(len(size), np.int64)
                    place[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen[values], counts)
                    seen[values] += counts
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(own)), pa.array(start), pa.array(size), pa.array(np.full(len(own), part, np.int64)), pa.array(place)],
                        names=["id", "start", "size", "part", "place"],
                    )
                row = stop

    return run


def _placed(plan: Plan, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, place = (batch.column(k).to_numpy() for k in (1, 2, 3))
            real = np.flatnonzero(size > 0)
            at, offset, room = (np.full(len(size), -1, np.int64) for _ in range(3))
            at[real], offset[real], room[real] = plan.places(size[real], place[real])
            mask = at < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(start // most), pa.array(start), pa.array(size), *(pa.array(x, mask=mask) for x in (at, offset, room))],
                names=["id", "piece", "start", "length", "bin_id", "offset", "capacity"],
            )

    return run


def best_fit(lengths: DataFrame, id_col: str, length_col: str, capacities: tuple[int, ...] = CAPACITIES, cost: Cost | None = None) -> DataFrame:
    """One row per piece: id, piece (from 0), start and length in tokens, bin_id (from 0, without
    gaps), offset in the bin and the bin's capacity.  Where the id column has the name of another
    result column, it is the first of the two."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    kind = lengths.schema[id_col].dataType.simpleString()
    clean = lengths.select(named(id_col).alias("id"), F.greatest(F.coalesce(named(length_col), F.lit(0)), F.lit(0)).cast("long").alias("length"))
    pieces = written(clean.mapInArrow(frugal(_pieces(most)), f"id {kind}, start long, size long, part long, place long"), "pieces")
    # a row for each task and length; places in the table follow from the tasks' numbers
    counts = pieces.where("size > 0").groupBy("size", "part").agg((F.max("place") + 1).alias("n"))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select("size", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "firsts")
    histogram = firsts.groupBy("size").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each length
    plan = plan_bins(histogram.column("size").to_numpy(), histogram.column("n").to_numpy(), capacities, cost)
    # by a shuffle of lengths, since the list of places grows with the tasks
    joined = pieces.join(firsts.drop("n").hint("merge"), ["size", "part"], "left")
    dealt = joined.select("id", "start", "size", (F.col("place") + F.coalesce("first", F.lit(0))).alias("place"))
    packed = dealt.mapInArrow(frugal(_placed(plan, most)), f"id {kind}, piece long, start long, length long, bin_id long, offset long, capacity long")
    return packed.toDF(id_col, *packed.columns[1:])


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts' lengths in words (runs without white space); null counts as empty."""
    return docs.select(named(id_col).alias("id"), F.regexp_count(F.coalesce(named(text_col), F.lit("")), F.lit(r"\S+")).cast("long").alias("n_words")).toDF(id_col, "n_words")
