"""Exact n-gram Jaccard self-join of documents, one row per document with its component.

Texts become sets of word shingles; documents with equal sets are one class.  A class is a point:
its shingles hashed into groups and counted (see ``count_rtree``).  Classes are searched in blocks
that share a necessary token, because one tree over all classes would compare everything with
everything at its upper levels.  Necessary tokens are the first ``n - ceil(t n) + 1`` of a set in one
global order (any order is exact): by hash, but the ``HEAVY`` most frequent shingles last, by
frequency, so that passages shared by many documents don't make blocks.  A block of more than one
leaf gets count-vector R-trees, a smaller one is a single leaf whose pairs meet the same bound.
Surviving pairs are verified on the whole shingle sets.

Large groups of near copies would give a quadratic number of links.  They are first contracted:
classes that agree in ``CELLS`` minima of a one-permutation sketch with at least ``DENSE`` others are
dealt into lots of about ``LOT``, linked exactly within the lot, and joined to components.  The
exact search then pairs classes of *different* components only, so it loses no component and writes
no clique.  The sketch speeds up, it decides nothing.

What reaches the driver or every task is bounded: the heavy shingles and a bitmap of fixed size.
Shingles are 50-bit hashes; sets are keyed by a 64-bit hash of the whole set (for n classes a chance
of n^2 / 2^65 that two different sets are taken as one).

Null or empty text and text without words has the empty set, links with nothing and is its own
component.  Repeated rows are in one component.  A null id never becomes a component's name unless
the whole component has no other.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .count_rtree import FINER, Points, Sizes, block_pairs, close_blocks, group_counts
from .exact_dedup import without
from .shared import frugal, in_bitmap, key_bitmap, named, written
from .words import HASH_BITS, distinct_shingles, mix, shingle_sets, words_of

HEAVY = 65_536
#: Occurrences among so many shingles that make one a candidate for the heavy list.
HEAVY_BLOCK, HEAVY_LEAST = 1 << 20, 4
#: The sketch: 2 ** SKETCH_BITS cells, in bands of CELLS.
SKETCH_BITS, CELLS = 5, 4
BANDS = (1 << SKETCH_BITS) // CELLS
DENSE, LOT, LOT_SHINGLES = 16, 640, 1 << 21
#: Blocks of so few classes become pairs before their points travel.
CLOSE = 4
#: Classes of a block whose points are searched by one task; of a larger one every two chunks of so many.
BLOCK = 8192
#: Rows a task holds at once, whole blocks of them: of tokens, and of tokens with points.
BLOCK_ROWS, TREE_ROWS = 1 << 18, 1 << 15
TOKEN_BITS = 32


def _members(size: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, own, key, n, null) of the documents, and (null, null, shingle, null, count) of
        shingles that are frequent among those of some thousand documents."""
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= HEAVY_LEAST
            m = int(often.sum())
            return rows(pa.nulls(m, kind), pa.nulls(m, pa.int64()), value[often].view(np.int64), pa.nulls(m, pa.int64()), pa.array(count[often].astype(np.int64)))

        def rows(ids: pa.Array, own: pa.Array, key: np.ndarray, n: pa.Array, count: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, own, pa.array(key), n, count], names=["id", "own", "key", "n", "count"])

        for batch in batches:
            for words in words_of(batch.column(1)):
                value, offsets = shingle_sets(words, size)
                ids = batch.column(0).slice(words.row, words.rows).cast(kind)
                yield rows(ids, batch.column(2).slice(words.row, words.rows), set_keys(value, offsets), pa.array(distinct_shingles(words, size, offsets)), pa.nulls(words.rows, pa.int64()))
                held.append(value)
                total += len(value)
                if total >= HEAVY_BLOCK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


def heavy_shingles(rows: DataFrame) -> np.ndarray:
    """The most frequent shingles of all documents, rarest first; at most HEAVY."""
    counted = rows.where("count is not null").groupBy("key").agg(F.sum("count").alias("n"))
    top = counted.where("n >= 8").orderBy(F.desc("n"), "key").limit(HEAVY).toArrow()
    return top.column("key").to_numpy()[::-1].view(np.uint64).copy()


def _order_keys(value: np.ndarray, heavy: np.ndarray, heavy_sorted: np.ndarray, heavy_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = value.copy()
    if not len(heavy):
        return keys, np.zeros(len(value), bool)
    at = np.minimum(np.searchsorted(heavy_sorted, value), len(heavy) - 1)
    is_heavy = heavy_sorted[at] == value
    keys[is_heavy] = (np.uint64(1) << np.uint64(63)) + heavy_rank[at[is_heavy]].astype(np.uint64)
    return keys, is_heavy


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n + 1 - (-((-num * n) // den)), 0)


def _ragged(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def set_keys(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _signatures(size: int, num: int, den: int, heavy: np.ndarray):
    by_value = np.argsort(heavy)
    heavy_sorted = heavy[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for every class that this task meets."""
        seen: set[int] = set()
        for batch in batches:
            for words in words_of(batch.column(0)):
                value, offsets = shingle_sets(words, size)
                keys = set_keys(value, offsets)
                fresh = [r for r, (k, m) in enumerate(zip(keys.tolist(), np.diff(offsets).tolist(), strict=True)) if m and k not in seen and not seen.add(k)]
                if not fresh:
                    continue
                keys, n, rows = keys[fresh], np.diff(offsets)[fresh], len(fresh)
                if rows < words.rows:
                    mine = np.zeros(words.rows, bool)
                    mine[fresh] = True
                    value = value[np.repeat(mine, np.diff(offsets))]
                    offsets = np.append(0, np.cumsum(n))
                text = np.repeat(np.arange(rows), n)
                body, begin, excess = group_counts(value, offsets)
                vectors = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(begin.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                # one-permutation sketch: the least value in each cell of the hash range
                cell = (text << SKETCH_BITS) | (value >> np.uint64(HASH_BITS - SKETCH_BITS)).astype(np.int64)
                cells = np.arange(rows << SKETCH_BITS)
                first = np.searchsorted(cell, cells)
                there = first < np.searchsorted(cell, cells, side="right")
                least = np.where(there, value[np.minimum(first, max(len(value) - 1, 0))] if len(value) else 0, np.uint64(0)).astype(np.uint64)
                least, there = least.reshape(rows * BANDS, CELLS), there.reshape(rows * BANDS, CELLS)
                pair = (np.arange(rows * BANDS) % BANDS).astype(np.uint64)
                for c in range(CELLS):
                    pair = mix(pair + least[:, c])
                usable = there.all(axis=1) | np.repeat(n < 128, BANDS) & there.any(axis=1)
                band_at = np.append(0, np.cumsum(usable.reshape(rows, BANDS).sum(axis=1))) if rows else np.zeros(1)
                places, is_heavy = _order_keys(value, heavy, heavy_sorted, by_value)
                if is_heavy.any():
                    order = np.lexsort((places, text))
                    value_in_order = value[order]
                else:
                    value_in_order = value
                length = prefix_length(n, num, den)
                chosen = np.arange(len(value)) - np.repeat(offsets[:-1], n) < np.repeat(length, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        pa.array(n.astype(np.int64)),
                        vectors,
                        pa.array(excess),
                        _ragged(pair[usable].view(np.int64), band_at),
                        _ragged((value_in_order[chosen] >> np.uint64(HASH_BITS - TOKEN_BITS)).astype(np.uint32).view(np.int32), np.append(0, np.cumsum(length))),
                    ],
                    names=["key", "n", "counts", "excess", "bands", "prefix"],
                )

    return run


def _sets(size: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for words in words_of(batch.column(0)):
                value, offsets = shingle_sets(words, size)
                keys = set_keys(value, offsets)
                wanted = np.flatnonzero(in_bitmap(bitmap, keys) & (np.diff(offsets) > 0))
                new = [r for r in wanted.tolist() if keys[r] not in seen and not seen.add(keys[r])]
                if new:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[new]), pa.array([value[offsets[r] : offsets[r + 1]].tobytes() for r in new], pa.binary())], names=["key", "shingles"]
                    )

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if den * both >= num * (len(x) + len(y) - both):
                    good.append(i)
            if good:
                rows = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    return run


def sets_of(keys: DataFrame, docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(key, shingles) of classes, at least of those in the long column ``key``: only texts whose key
    passes a bitmap of fixed size give their sets."""
    found = docs.select(text_col).mapInArrow(frugal(_sets(size, key_bitmap(keys, "key"))), "key long, shingles binary")
    return written(found.groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")


def verified(pairs: DataFrame, docs: DataFrame, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set keys whose sets reach the threshold."""
    pairs = written(pairs, "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))), docs, text_col, size)
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(frugal(_verify(num, den)), "a long, b long"), "links")


def _lot_links(keys: list[int], sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within a lot as (class, least class of its component there), from exact overlaps."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    new = np.append(True, value[1:] != value[:-1])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    _, column = np.unique(column[often], return_inverse=True)
    owner = owner[often]
    overlap = np.zeros((len(sets), len(sets)))
    width = 1 << 14
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        grid = np.zeros((len(sets), width), np.float32)
        grid[owner[part], column[part] - at] = 1
        overlap += grid @ grid.T
    both = overlap.astype(np.int64)
    i, j = np.nonzero(np.triu(den * both >= num * (n[:, None] + n - both), 1))
    names = np.array(keys, np.int64)
    nodes, roots = local_roots(names[i], names[j]) if len(i) else (names[:0], names[:0])
    other = nodes != roots
    return nodes[other], roots[other]


def _lots(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (band, lot, key, shingles), those of a lot one after the other."""
        now, keys, sets = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1:
                a, b = _lot_links(keys, sets, num, den)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for band, lot, key, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (band, lot) != now:
                    yield from links()
                    now, keys, sets = (band, lot), [], []
                keys.append(key)
                sets.append(np.frombuffer(shingles, np.uint64))
        yield from links()

    return run


def dense_links(classes: DataFrame, docs: DataFrame, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) that connect most of each large group of near copies, and finer points
    of the classes in such groups."""
    banded = classes.select(F.explode("bands").alias("band"), "key", "n")
    large = written(banded.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).where(F.col("m") >= DENSE), "bands")
    lots = F.greatest(F.ceil(F.col("m") / F.lit(LOT)), F.ceil(F.col("shingles") / F.lit(LOT_SHINGLES)))
    rows = banded.join(large, "band").select("band", F.pmod(F.xxhash64("key"), lots).alias("lot"), "key")
    rows = written(rows, "lots")
    sets = sets_of(rows.select("key"), docs, text_col, size)
    dealt = rows.join(sets, "key").select("band", "lot", "key", "shingles").repartition("band", "lot").sortWithinPartitions("band", "lot")
    links = written(dealt.mapInArrow(frugal(_lots(num, den)), "a long, b long"), "links")
    return links, sets.mapInArrow(frugal(_finer), "key long, fine binary, fine_excess long")


def _whole_blocks(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` integer columns, in tables of about ``least`` rows that
    hold each of their blocks (rows with equal keys) whole."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held)
            last = np.zeros(rows, bool)
            for k in range(keys):
                value = table.column(k).to_numpy()
                last |= value != value[-1]
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0  # the last block may go on
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                rows -= cut
    if held:
        yield pa.Table.from_batches(held)


def _blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, key, n, root or null) sorted by token.  Very small blocks give pairs (null, null,
        a, b), larger ones their rows (token, part, a, null); one of more than BLOCK classes is cut into
        chunks, and every two chunks are a part."""
        for table in _whole_blocks(batches, 1, BLOCK_ROWS):
            table = table.combine_chunks()
            token, key, n = (table.column(k).to_numpy() for k in range(3))
            alone = table.column(3).is_null().to_numpy()
            root = np.where(alone, key, table.column(3).fill_null(0).to_numpy())
            heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(heads, len(token)))
            # a token of one class, or of one component, pairs nothing
            several = (size > 1) & (np.minimum.reduceat(root, heads) != np.maximum.reduceat(root, heads))
            mine = np.repeat(several, size)
            token, key, n, root, size = token[mine], key[mine], n[mine], root[mine], size[several]
            heads = np.cumsum(size) - size
            names, first, which = np.unique(key, return_index=True, return_inverse=True)
            code = close_blocks(which, heads, size, CLOSE, Sizes(n[first], root[first], num, den))
            yield from _rows(None, None, names[code // max(1, len(names))], names[code % max(1, len(names))])
            wide = np.repeat((size > CLOSE) & (size <= BLOCK), size)
            yield from _rows(token[wide], np.zeros(wide.sum(), np.int32), key[wide], None)
            for k in np.flatnonzero(size > BLOCK).tolist():
                block = slice(heads[k], heads[k] + size[k])
                chunks = -(-int(size[k]) // BLOCK)
                own = np.arange(size[k]) // BLOCK
                for other in range(chunks):
                    part = np.minimum(own, other) * chunks + np.maximum(own, other)
                    yield from _rows(token[block], part.astype(np.int32), key[block], None)

    return run


def _rows(token: np.ndarray | None, part: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 50_000):
        cut = slice(at, at + 50_000)
        m = len(a[cut])
        columns = [pa.nulls(m, kind) if x is None else pa.array(x[cut], kind) for x, kind in ((token, pa.int32()), (part, pa.int32()), (a, pa.int64()), (b, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "part", "a", "b"])


def _bounded(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, then n, excess and counts of each) whose bound reaches the need."""
        for batch in batches:
            m = batch.num_rows
            n, excess = (np.concatenate([batch.column(k).to_numpy(), batch.column(k + 3).to_numpy()]) for k in (2, 3))
            counts = batch.column(4).to_pylist() + batch.column(7).to_pylist()
            points = Points(counts, excess, n, np.arange(2 * m), num, den)
            good = points.reach(np.arange(m), np.arange(m, 2 * m))
            if good.any():
                yield batch.select([0, 1]).filter(pa.array(good))

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets (key, shingles) to finer points (key, counts, excess)."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        if sets:
            body, begin, excess = group_counts(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), FINER)
            counts = pa.array([body[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(excess)], names=["key", "fine", "fine_excess"])


def _trees(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, part, key, root, n, excess, counts) of large blocks, sorted by token and part."""
        for table in _whole_blocks(batches, 2, TREE_ROWS):
            table = table.combine_chunks()
            names, first, which = np.unique(table.column(2).to_numpy(), return_index=True, return_inverse=True)
            once = table.take(pa.array(first))  # a class comes with each of its tokens; its point is held once
            root, n, excess = (once.column(k).to_numpy() for k in (3, 4, 5))
            points = Points(once.column(6).to_pylist(), excess, n, root, num, den)
            token, part = table.column(0).to_numpy(), table.column(1).to_numpy()
            heads = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
            pairs = names[block_pairs(points, which, heads)]
            for at in range(0, len(pairs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 50_000, 0]), pa.array(pairs[at : at + 50_000, 1])], names=["a", "b"])

    return run


def candidates(classes: DataFrame, parts: DataFrame, finer: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that may link: every linked pair of them is there."""
    roots = parts.withColumnRenamed("node", "key")
    tokens = classes.select("key", "n", "prefix").join(roots, "key", "left").select(F.explode("prefix").alias("token"), "key", "n", "root")
    dealt = tokens.repartition("token").sortWithinPartitions("token")
    found = written(dealt.mapInArrow(frugal(_blocks(num, den)), "token int, part int, a long, b long"), "blocks")
    pairs = found.where("b is not null").select("a", "b").distinct()
    for end in ("a", "b"):
        point = classes.select(F.col("key").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("n", "excess", "counts")))
        pairs = pairs.join(point, end)
    pairs = pairs.select("a", "b", "a_n", "a_excess", "a_counts", "b_n", "b_excess", "b_counts").mapInArrow(frugal(_bounded(num, den)), "a long, b long")
    points = classes.select("key", "n", "excess", "counts").join(roots, "key", "left").join(finer, "key", "left")
    points = points.withColumns({"root": F.coalesce("root", "key"), "counts": F.coalesce("fine", "counts"), "excess": F.coalesce("fine_excess", "excess")})
    wide = found.where("b is null").select("token", "part", F.col("a").alias("key")).join(points, "key").select("token", "part", "key", "root", "n", "excess", "counts")
    searched = wide.repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(frugal(_trees(num, den)), "a long, b long")
    return pairs.unionByName(searched).distinct()


def _linked(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """From rows (id, text, own): id, own, n_shingles, root (the component's key; null for the empty
    set) and component_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    of_id = docs.schema["id"].dataType
    scanned = docs.select("id", "text", "own").mapInArrow(frugal(_members(size, to_arrow_type(of_id))), f"id {of_id.simpleString()}, own long, key long, n long, count long")
    scanned = written(scanned, "members")
    members = scanned.where("count is null").select("id", "own", "key", "n")
    made = docs.select("text").mapInArrow(frugal(_signatures(size, num, den, heavy_shingles(scanned))), "key long, n long, counts binary, excess long, bands array<long>, prefix array<int>")
    classes = written(made.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "counts", "excess", "bands", "prefix"))), "classes")

    known, finer = dense_links(classes, docs, "text", size, num, den)
    parts = written(components(known), "parts")
    more = verified(candidates(classes, parts, finer, num, den), docs, "text", size, num, den)

    roots = written(components(known.unionByName(more)).withColumnRenamed("node", "key"), "roots")
    least = members.where("n > 0").groupBy("key").agg(F.min("id").alias("least_id"))
    named_classes = least.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = written(named_classes.groupBy("root").agg(F.min("least_id").alias("component_id")), "names")
    by_key = written(named_classes.join(names, "root").select("key", "root", "component_id"), "named")
    linked = members.where("n > 0").join(by_key, "key").select("id", "own", F.col("n").alias("n_shingles"), "root", "component_id")
    empty = members.where("n = 0").select("id", "own", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return linked.unionByName(empty)


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles (of its set of ``size``-word shingles) and
    component_id, the least id reachable over links, where two documents link when
    den * overlap >= num * union.  Words are runs of anything but ASCII white space, A-Z lower-cased."""
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.lit(0).cast("long").alias("own"))
    return _linked(rows, size, num, den).select("id", "n_shingles", "component_id").toDF(id_col, "n_shingles", "component_id")


def keep_least(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the least id (ties: the least hash of its
    text; null ids come last); all columns as they are.  Rows are told apart by id and text, so an id
    that two texts have loses only the one that goes."""
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("own"))
    rows = _linked(rows, size, num, den)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "own")
    groups = rows.where("root is not null").groupBy("root", "id", "own").agg(F.count("*").alias("copies"))
    tops = groups.groupBy("root").agg(F.min(place).alias("top"), F.sum("copies").alias("rows")).where("rows > 1")
    judged = written(groups.join(tops, "root").select("id", "own", "copies", (place == F.col("top")).alias("kept")), "judged")
    return without(docs, judged, lambda of: {"id": of(id_col), "own": F.xxhash64(of(text_col))}, ["id", "own"])
