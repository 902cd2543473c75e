"""Personal data: base patterns, and terms that disclose an entity by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers.  Each is a mention
of a protected entity e (kind and value).  The context of e is every document that mentions it,
whole, and all its words, of any length, are candidate terms w.  Over the whole corpus, with T
words, count(w) of them w and near(e, w) of these in the context of e, the information content of e
is IC(e) = -ln(mentions(e) / T) and

    PMI(e; w) / IC(e) = 1 + ln(near(e, w) / count(w)) / IC(e)

is the share of that information that w reveals: 1 where w occurs only with e.  A pair of enough
support whose share reaches ``generalise_at`` is disclosive; from ``remove_at`` on the term is
removed, below it is replaced by a general class.  A disclosive term is marked wherever it occurs, in
any document, outside base spans; where it discloses several entities its greatest share counts.

Texts are scanned four times: for the entities, for the words with entities that two documents
share (no other can have support), for the counts of those words, and for the terms found.  Words are
told apart by bitmaps of fixed size, the one thing that is sent to all tasks, and then joined
exactly.  Terms are compared by 64-bit hashes; a run of letters and digits is one word, also in
scripts that write no spaces.

Null text counts as empty.  Rows are told apart by their place in the scan, so ids may be null or
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal, in_bitmap, key_bitmap, named, written
from .words import ALNUM, words_of

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts inside a digit run would also start at the run's head, so heads are enough.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG_CARD = re.compile(r"(?:[0-9][ -]?){13}[0-9]")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Distinct counts that a task holds before it hands them on.
HELD = 1 << 20


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: only the characters up to it can be the local part."""
    found, last = [], 0
    for m in _AFTER_AT.finditer(text):
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            found.append((begin, m.end()))
            last = m.end()
    return found


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    if not _LONG_CARD.search(text):
        return []
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(a, 1, b) for a, b in ips(text)]
    out += [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        out += [(a, 3, b) for a, b in phones(text)]
    out.sort()
    return out


def entity_key(kind: int, value: str) -> int:
    """The same entity whatever its case and separators."""
    value = value.lower() if kind == 0 else re.sub(r"[^0-9.+]", "", value) if kind == 1 else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each batch (entity null), and each text's entities with their mentions."""
    for batch in batches:
        keys: list[int | None] = [None]
        n = [sum(len(words.hashes) for words in words_of(batch.column(0), ALNUM))]
        for text in batch.column(0):
            text = text.as_py()
            found = Counter(entity_key(k, text[a:b]) for a, k, b in base_spans(text)) if text else {}
            keys += found.keys()
            n += found.values()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["entity", "n"])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``keys`` once each, with their summed counts."""
    order = np.lexsort(keys.T)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[heads], np.add.reduceat(counts, heads, axis=0)


def _summing(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A task's parts summed by key, handed on whenever more than HELD distinct keys are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, least = 0, HELD
    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size > least:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [(keys, counts)], len(keys)
            if size > HELD:
                yield keys, counts
                held, size = [], 0
            least = size + HELD
    if held:
        yield _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _beside(bitmap: np.ndarray):
    """(entity, term, occurrences, texts) of the words in texts with an entity of the bitmap."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for words in words_of(batch.column(0), ALNUM):
                hashes = words.hashes.view(np.int64)
                for r, text in enumerate(batch.column(0).slice(words.row, words.rows).to_pylist()):
                    mine = {entity_key(k, text[a:b]) for a, k, b in base_spans(text)} if text else ()
                    if not mine:
                        continue
                    known = np.array(sorted(mine), np.int64)
                    known = known[in_bitmap(bitmap, known)]
                    if not len(known):
                        continue
                    terms, n = np.unique(hashes[words.first[r] : words.first[r + 1]], return_counts=True)
                    for entity in known:
                        yield np.stack([np.full(len(terms), entity), terms], axis=1), np.stack([n, np.ones_like(n)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _summing(parts(batches)):
            columns = [keys[:, 0], keys[:, 1], counts[:, 0], counts[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["entity", "term", "near", "rows"])

    return run


def _count_words(bitmap: np.ndarray):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for words in words_of(batch.column(0), ALNUM):
                keys = words.hashes.view(np.int64)
                keys, n = np.unique(keys[in_bitmap(bitmap, keys)], return_counts=True)
                yield keys[:, None], n[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _summing(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(n[:, 0]))], names=["term", "n"])

    return run


def _scan(bitmap: np.ndarray):
    """Base spans of each text, and the places outside them of words in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for words in words_of(batch.column(1), ALNUM):
                keys = words.hashes.view(np.int64)
                may = in_bitmap(bitmap, keys)
                spans, hits = [], []
                for r, text in enumerate(batch.column(1).slice(words.row, words.rows).to_pylist()):
                    mine = base_spans(text) if text else []
                    spans.append([{"start": a, "kind": k, "end": b} for a, k, b in mine])
                    first, last = words.first[r], words.first[r + 1]
                    told, k, reach = [], 0, 0  # reach: the furthest end of the k spans that start before the word's end
                    if may[first:last].any():
                        for m, key, there in zip(_WORD.finditer(text), keys[first:last].tolist(), may[first:last].tolist(), strict=True):
                            if there:
                                while k < len(mine) and mine[k][0] < m.end():
                                    reach = max(reach, mine[k][2])
                                    k += 1
                                if m.start() >= reach:
                                    told.append({"term": key, "start": m.start(), "end": m.end()})
                    hits.append(told)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + words.rows)),
                        batch.column(0).slice(words.row, words.rows),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                        pa.array(hits, pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))),
                    ],
                    names=["row", "id", "base", "hits"],
                )
                row += words.rows

    return run


def disclosive_terms(docs: DataFrame, text_col: str, min_support: int, generalise_at: float) -> DataFrame:
    """(entity, term, share) of the pairs whose share reaches ``generalise_at``.  Support is the
    number of the term's occurrences in texts with the entity, in at least two rows."""
    texts = docs.select(named(text_col).alias("text"))
    seen = written(texts.mapInArrow(frugal(_entities), "entity long, n long").groupBy("entity").agg(F.sum("n").alias("mentions"), F.count("*").alias("rows")), "entities")
    total = max(1, seen.where("entity is null").agg(F.sum("mentions")).first()[0] or 0)
    shared = seen.where("entity is not null and rows >= 2").select("entity", "mentions")
    beside = texts.mapInArrow(frugal(_beside(key_bitmap(shared, "entity"))), "entity long, term long, near long, rows long")
    supported = (F.col("near") >= min_support) & (F.col("rows") >= 2)
    pairs = written(beside.groupBy("entity", "term").agg(F.sum("near").alias("near"), F.sum("rows").alias("rows")).where(supported), "pairs")
    words = texts.mapInArrow(frugal(_count_words(key_bitmap(pairs, "term"))), "term long, n long")
    counts = words.groupBy("term").agg(F.sum("n").alias("n"))
    content = -F.log(F.least(F.lit(0.5), F.col("mentions") / F.lit(float(total))))
    share = 1 + F.log(F.least(F.lit(1.0), F.col("near") / F.col("n"))) / content
    return pairs.join(counts, "term").join(shared, "entity").select("entity", "term", share.alias("share")).where(F.col("share") >= generalise_at)


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = 3, generalise_at: float = 0.93, remove_at: float = 0.97,
) -> DataFrame:
    """One row per row of ``docs``: id, base and spans, both arrays of (start, kind, end, action) by
    start, then kind; positions are code points, end exclusive.  ``spans`` has the base spans and
    the disclosive terms (kind ``TERM``, action remove or generalise)."""
    kind = docs.schema[id_col].dataType.simpleString()
    terms = written(disclosive_terms(docs, text_col, min_support, generalise_at).groupBy("term").agg(F.max("share").alias("share")), "terms")
    schema = f"row long, id {kind}, base array<struct<start:int,kind:int,end:int>>, hits array<struct<term:long,start:int,end:int>>"
    scanned = written(docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(frugal(_scan(key_bitmap(terms, "term"))), schema), "privacy")
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.*")
    told = hits.join(terms, "term").select("row", "start", "end", "share")
    marks = told.select(
        "row",
        F.struct("start", F.lit(TERM).alias("kind"), "end", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action")).alias("mark"),
    )
    by_row = marks.groupBy("row").agg(F.collect_list("mark").alias("marks"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit("remove").alias("action")))
    joined = scanned.select("row", "id", base.alias("base")).join(by_row, "row", "left")
    return joined.select(F.col("id").alias(id_col), "base", F.sort_array(F.when(F.col("marks").isNull(), F.col("base")).otherwise(F.concat("base", "marks"))).alias("spans"))


def spans_text(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, last = [], 0
            for s in spans or []:
                if s["start"] >= last:
                    name = f"[{KINDS[s['kind']].upper()}]" if s["kind"] < TERM else "" if s["action"] == "remove" else "[WORD]"
                    parts += [text[last : s["start"]], name]
                    last = s["end"]
            out.append(None if text is None else "".join(parts) + text[last:])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with the spans of ``personal_data`` replaced by their kind, a general class or nothing.
    Ids must be unique; where spans overlap the first one counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    both = rows.join(found.select(named(id_col).alias("id"), "spans"), "id", "left").select("id", "text", "spans")
    return both.mapInArrow(frugal(_replace), f"id {kind}, text string").toDF(id_col, text_col)
