"""Benchmark decontamination by a prefix-filtered set join.

Every window of ``window`` consecutive words of a benchmark item (an item with fewer words is one
window) is a set of word shingles that a document must contain whole, so one of them, any, is a
necessary prefix.  Shingles are ordered by rarity, counted over all documents, and a window is
indexed by its rarest alone.  A document's shingles probe the index; a hit fixes where the window
would lie, which must be inside the document (positional and length bound), and then every word
of the window is compared.

The benchmark is taken in blocks of at most ``BLOCK_WINDOWS`` windows, read in order; each block's
index is of bounded size and is sent to the tasks, and all documents pass each block.  Documents are
never shuffled.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.  Null and
empty texts have no words; an item without words or with a null id has no windows; an empty
benchmark leaves every document clean.  Repeated documents give repeated rows.  An item that occurs
twice counts once.  The result's own columns are named apart from the documents' columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frugal, named
from .words import ALNUM, Words, hash_words, mix, window_hashes, words_of

BLOCK_WINDOWS = 100_000
SHINGLE = 3
#: Candidate places whose words are compared at once.
PLACES_AT_ONCE = 1 << 18


@dataclass
class Block:
    """Distinct windows of some items, and the index of their necessary shingles."""

    words: np.ndarray  # word hashes of all windows, concatenated
    at: np.ndarray  # offsets into words
    items_at: np.ndarray  # offsets into items, per window
    items: np.ndarray  # positions in names
    names: list[str]
    shingles: dict[int, tuple[np.ndarray, np.ndarray]]  # by shingle size: per window and offset, the distinct shingle's position; the distinct hashes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by size: hashes, offsets, windows, shingle offset in the window

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.at)


def item_blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str, most: int | None = None) -> Iterator[Block]:
    """The benchmark in blocks; an item's windows may lie in two blocks."""
    most = most or BLOCK_WINDOWS
    rows = benchmark.select(named(item_col).cast("string").alias("i"), named(text_col).alias("t")).where("i is not null and t is not null")
    table: dict[tuple[int, ...], set[str]] = {}
    for row in rows.toLocalIterator():
        data = np.frombuffer(row["t"].encode(), np.uint8)
        h = hash_words(data, np.zeros(1, np.int64), ALNUM)[0].tolist()
        for k in range(max(1, len(h) - window + 1) if h else 0):
            table.setdefault(tuple(h[k : k + window]), set()).add(row["i"])
            if len(table) >= most:
                yield _block(table)
                table = {}
    if table:
        yield _block(table)


def _block(table: dict[tuple[int, ...], set[str]]) -> Block:
    names = sorted(set().union(*table.values()))
    place = {n: k for k, n in enumerate(names)}
    lengths = np.array([len(w) for w in table])
    words = np.array([h for w in table for h in w], dtype=np.uint64)
    at = np.append(0, np.cumsum(lengths))
    items = [sorted(place[n] for n in found) for found in table.values()]
    shingles = {}
    for size in np.unique(np.minimum(lengths, SHINGLE)).tolist():
        mine = np.flatnonzero(np.minimum(lengths, SHINGLE) == size)
        n = lengths[mine]
        first = np.append(0, np.cumsum(n))
        flat = Words(0, len(mine), np.concatenate([words[at[w] : at[w + 1]] for w in mine]), first, first[:0], first[:0], np.zeros(0, np.uint8))
        hashes, whole = window_hashes(flat, size)
        where = np.flatnonzero(whole)
        distinct, position = np.unique(hashes[where], return_inverse=True)
        owner = flat.text_of_word[where]
        shingles[size] = (np.stack([mine[owner], where - first[owner], position]), distinct)
    return Block(words, at, np.append(0, np.cumsum([len(x) for x in items])), np.array([x for y in items for x in y], np.int64), names, shingles, {})


class Probe:
    """Which of many 64-bit hashes are in a small sorted table; a bit table answers most."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(table & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are in the table, and their positions there."""
        maybe = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.table, hashes[maybe]), len(self.table) - 1)
        there = self.table[at] == hashes[maybe]
        return maybe[there], at[there]


def _count(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {size: Probe(distinct) for size, (_, distinct) in block.shingles.items()}
        counts = {size: np.zeros(len(distinct), np.int64) for size, (_, distinct) in block.shingles.items()}
        for batch in batches:
            for words in words_of(batch.column(0), ALNUM):
                for size, probe in probes.items():
                    hashes, whole = window_hashes(words, size)
                    at, found = probe(hashes)
                    counts[size] += np.bincount(found[whole[at]], minlength=len(counts[size]))
        for size, n in counts.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), size, np.int32)), pa.array(there.astype(np.int64)), pa.array(n[there])], names=["size", "position", "n"])

    return run


def order_by_rarity(docs: DataFrame, text_col: str, block: Block) -> None:
    """Count the block's shingles in all documents and index each window by its rarest."""
    found = docs.select(text_col).mapInArrow(frugal(_count(block)), "size int, position long, n long").groupBy("size", "position").agg(F.sum("n").alias("n"))
    totals = {size: np.zeros(len(distinct), np.int64) for size, (_, distinct) in block.shingles.items()}
    table = found.toArrow()  # at most one row for each shingle of the block
    for size, total in totals.items():
        mine = table.column("size").to_numpy() == size
        total[table.column("position").to_numpy()[mine]] = table.column("n").to_numpy()[mine]
    for size, (places, distinct) in block.shingles.items():
        window, offset, position = places
        order = np.lexsort((offset, position, totals[size][position], window))
        first = order[np.append(True, np.diff(window[order]) != 0)]
        by = first[np.argsort(position[first], kind="stable")]
        used, at = np.unique(position[by], return_index=True)
        block.prefix[size] = (distinct[used], np.append(at, len(by)), window[by], offset[by])


def _places(words: Words, block: Block, probes: dict[int, Probe]) -> tuple[np.ndarray, np.ndarray]:
    """Verified (first word, window) pairs of all occurrences of the block's windows."""
    starts: list[np.ndarray] = []
    windows: list[np.ndarray] = []
    text = words.text_of_word
    for size, (_, at, window, offset) in block.prefix.items():
        hashes, whole = window_hashes(words, size)
        where, found = probes[size](hashes)
        where, found = where[whole[where]], found[whole[where]]
        for cut in range(0, len(where), PLACES_AT_ONCE // 8):
            w, f = where[cut : cut + PLACES_AT_ONCE // 8], found[cut : cut + PLACES_AT_ONCE // 8]
            n = at[f + 1] - at[f]
            entry = np.repeat(at[f], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(w, n)
            for part in range(0, len(w), PLACES_AT_ONCE):
                e, p = entry[part : part + PLACES_AT_ONCE], w[part : part + PLACES_AT_ONCE]
                begin, which = p - offset[e], window[e]
                length = block.lengths[which]
                fits = (begin >= words.first[text[p]]) & (begin + length <= words.first[text[p] + 1])
                begin, which, length = begin[fits], which[fits], length[fits]
                same = np.ones(len(begin), bool)
                for j in range(int(length.max()) if len(length) else 0):
                    live = np.flatnonzero(same & (length > j))
                    same[live] = words.hashes[begin[live] + j] == block.words[block.at[which[live]] + j]
                starts.append(begin[same])
                windows.append(which[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _runs(cover: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
    inside = np.concatenate([[False], cover[first:last], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _mark(block: Block, column: int, schema: pa.Schema, drop_hit: bool):
    """Adds this block's hits to the state column (n_words, hits, items), the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {size: Probe(prefix[0]) for size, prefix in block.prefix.items()}
        for batch in batches:
            for words in words_of(batch.column(column), ALNUM):
                mine = batch.slice(words.row, words.rows)
                begin, window = _places(words, block, probes)
                edges = np.zeros(len(words.hashes) + 1, np.int64)
                np.add.at(edges, begin, 1)
                np.add.at(edges, begin + block.lengths[window], -1)
                cover = np.cumsum(edges)[:-1] > 0
                text = words.text_of_word[begin]
                kind = schema.field(len(schema) - 1).type
                _, hits, items = mine.column(mine.num_columns - 1).flatten()
                hit = np.unique(text)
                if len(hit):  # clean rows keep what they have
                    before = [x.take(pa.array(hit)).to_pylist() for x in (hits, items)]
                    new_hits, new_items = [], []
                    for r, old, names in zip(hit.tolist(), *before, strict=True):
                        first, last = words.first[r], words.first[r + 1]
                        for x in old:  # hits of earlier blocks
                            cover[first + x["start"] : first + x["end"]] = True
                        new_hits.append([{"start": a, "end": b} for a, b in _runs(cover, first, last)])
                        own = {block.names[i] for w in np.unique(window[text == r]).tolist() for i in block.items[block.items_at[w] : block.items_at[w + 1]].tolist()}
                        new_items.append(sorted(own.union(names)))
                    place = np.arange(words.rows)
                    place[hit] = words.rows + np.arange(len(hit))
                    hits = pa.concat_arrays([hits, pa.array(new_hits, hits.type)]).take(pa.array(place))
                    items = pa.concat_arrays([items, pa.array(new_items, items.type)]).take(pa.array(place))
                counts = pa.array(words.counts.astype(np.int64))
                out = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip((counts, hits, items), kind, strict=True)], fields=list(kind))
                done = pa.RecordBatch.from_arrays([*mine.columns[:-1], out], schema=schema)
                yield done.filter(pc.equal(pc.list_value_length(hits), 0)) if drop_hit else done

    return run


STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    result: str = "contamination", drop_hit: bool = False, block_windows: int | None = None,
) -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, hits (ranges of hit words, end exclusive)
    and items (ids, as sorted strings, of items with a window in the text).  ``drop_hit`` leaves
    out documents that a block hits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if result.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have a column {result}")
    empty = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit([]).cast(STATE["hits"].dataType).alias("hits"), F.lit([]).cast("array<string>").alias("items"))
    # plain names on the way, since the caller's may hold dots and backticks
    safe = [f"c{k}" for k in range(len(docs.columns))]
    column = docs.columns.index(text_col)
    marked = docs.toDF(*safe).withColumn("state", empty)
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(safe, docs.schema.fields, strict=True)), T.StructField("state", STATE)])
    arrow = to_arrow_schema(schema)
    blocks = 0
    for block in item_blocks(benchmark, window, item_col, item_text_col, block_windows):
        order_by_rarity(docs.select(named(text_col).alias("text")), "text", block)
        marked = marked.mapInArrow(frugal(_mark(block, column, arrow, drop_hit)), schema)
        blocks += 1
    if not blocks:  # an empty benchmark: only words are counted
        nothing = Block(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), [], {}, {})
        marked = marked.mapInArrow(frugal(_mark(nothing, column, arrow, False)), schema)
    return marked.toDF(*docs.columns, result)
