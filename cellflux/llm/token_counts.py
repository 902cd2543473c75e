"""Byte-level BPE token counts by rank-synchronous array merging.

Each distinct pre-token that a task meets is one run of byte symbols in a ragged numpy array.  A
round looks up the rank of every adjacent pair, takes each run's lowest rank, merges all places of
that pair in all runs at once, and ends when no run has a pair with a rank; the symbols that
survive are the tokens.  Merging every place of a run's lowest pair in one round gives what merging
one place at a time gives, because a merge's product occurs only in pairs of higher rank.

Counts of pre-tokens are kept in a task-local table of at most ``CACHE`` entries.  Null text counts
as empty (0 tokens); texts are taken whole.  Added tokens of the file found in a text count one each,
as the library does by default.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .shared import frugal, named

CACHE = 120_000
#: Most byte symbols merged at once; one longer pre-token is a block of its own.
BLOCK = 1 << 20
_NONE = np.iinfo(np.int32).max
#: The public pre-token pattern of byte-level BPE with use_regex (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text that is all ASCII, which the standard library matches faster.
PLAIN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class RankMerger:
    """Counts tokens of pre-tokens with the merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE files with the standard pattern are supported")
        ids = model["vocab"]
        self.size = max(ids.values()) + 1
        self.byte_ids = np.array([ids[c] for c in byte_letters()], dtype=np.int64)
        keys, ranks, made = [], [], []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(ids[a] * self.size + ids[b])
            ranks.append(rank)
            made.append(ids[a + b])
        self._table(np.array(keys, np.int64), np.array(ranks, np.int32))
        self.made = np.array(made, np.int64)
        added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with special matching are not supported")
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added_mark = added
        self.find_any, self.find_plain = regex.compile(PATTERN).findall, re.compile(PLAIN).findall
        self.known: dict[str, int] = {}

    def _table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressing table of the merges, filled by vectorised linear probing."""
        self.bits = max(16, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int32)
        at, todo, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = keys[free]
            won = free[self.slots[at[free]] == keys[free]]
            self.ranks[at[won]] = ranks[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty byte string."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        result = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        run = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            together = run[:-1] == run[1:]
            rank = np.full(len(symbols), _NONE, np.int32)
            at = np.flatnonzero(together)
            rank[at] = self._rank(symbols[at] * self.size + symbols[at + 1])
            heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            lowest = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(symbols)))
            alive = lowest != _NONE
            result[run[heads[~alive]]] = size[~alive]
            if not alive.any():
                return result
            live = np.repeat(alive, size)
            best = np.repeat(lowest, size)
            merged = live & (rank == best)
            places = np.flatnonzero(merged)
            # in a row of overlapping places every second one merges, from the left
            fresh = np.append(True, np.diff(places) != 1) | np.append(True, run[places[1:]] != run[places[:-1]])
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[since % 2 == 0]
            symbols[places] = self.made[rank[places]]
            live[places + 1] = False
            symbols, run = symbols[live], run[live]
        if len(symbols):
            result[run] = 1
        return result

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        begin = 0
        while begin < len(order):
            stop, total = begin, 0
            while stop < len(order) and (stop == begin or total + len(raw[order[stop]]) <= BLOCK):
                total += len(raw[order[stop]])
                stop += 1
            block = order[begin:stop]
            for i, n in zip(block, self.merge([raw[i] for i in block]).tolist(), strict=True):
                self.known[pieces[i]] = n
            begin = stop

    def find(self, text: str) -> list[str]:
        return self.find_plain(text) if text.isascii() else self.find_any(text)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of added tokens in it."""
        if self.added is None or not any(mark in text for mark in self.added_mark):
            return self.find(text), 0
        parts = self.added.split(text)
        return [p for part in parts for p in self.find(part)], len(parts) - 1

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.pieces(t) for t in texts]
        unknown: set[str] = set()
        for found, _ in split:
            unknown.update(found)
        unknown.difference_update(self.known)
        if unknown:
            self.learn(list(unknown))
        get = self.known.__getitem__
        return [sum(map(get, found)) + extra for found, extra in split]


@functools.lru_cache(1)
def merger_of(path: str) -> RankMerger:
    """A worker's merger, kept from task to task so that the file is read once; a few megabytes, since
    the pre-tokens that a task came to know go with it."""
    return RankMerger(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chars_at_once: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8) and n_tokens of the whole text under the
    byte-level BPE file at ``path`` (a file that every executor has).  Repeated ids give repeated
    rows; an empty table gives none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(path)
        try:
            for batch in batches:
                yield counted(merger, batch)
        finally:
            merger.known.clear()

    def counted(merger: RankMerger, batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(1)
        if text.null_count:
            text = text.fill_null("")
        sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False)
        found: list[int] = []
        row = 0
        while row < len(text):
            total = np.cumsum(sizes[row:])
            stop = row + max(1, int(np.searchsorted(total, chars_at_once, side="right")))
            found += merger.counts(text.slice(row, stop - row).to_pylist())
            row = stop
        n_bytes = pc.binary_length(text).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(found, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, n_bytes long, n_tokens long").toDF(id_col, "n_bytes", "n_tokens")
