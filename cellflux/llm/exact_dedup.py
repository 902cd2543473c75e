"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are first grouped by byte length, then rows of a shared length by a hash of their prefix, and
only rows whose (length, prefix hash) is shared have their whole text hashed.  Between the steps the
surviving groups travel as a bitmap of fixed size (``BUCKETS`` rows of 4 KiB, so its broadcast is
bounded whatever the input); a slot shared by chance only means that one more text is read in full.
No text is ever shuffled, and copies are counted map-side before any exchange on the full hash.

Two texts are equal when they are identical after lower-casing A-Z only.  Null text counts as empty.
Empty texts are equal to each other.  Any id may be null (nulls sort below all ids) or repeated: rows
that repeat id and text count as copies, and exactly one of them is kept.  Other columns are ignored.
An empty table gives an empty result.  Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BITS_PER_BUCKET, named, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_CHARS = 64
BUCKETS = 256
#: Rows with one id and text that are made again by one row.
COPIES_AT_ONCE = 1 << 14


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _light(text: Column) -> list[Column]:
    """What the first two steps group by: byte length and the prefix's hash."""
    head = normalised(F.substring(text, 1, PREFIX_CHARS))
    return [F.coalesce(F.octet_length(text), F.lit(0)).alias("length"), F.xxhash64(head).alias("head")]


def _slot(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * BITS_PER_BUCKET))


def _bucket(slot: Column) -> Column:
    return F.floor(slot / F.lit(BITS_PER_BUCKET)).cast("int")


def _bitmap(keys: DataFrame, *names: str) -> DataFrame:
    """Rows (bucket, bits) with the slots of ``keys`` set; at most BUCKETS rows."""
    slot = keys.select(_slot(*[F.col(n) for n in names]).alias("slot"))
    return (
        slot.select(_bucket(F.col("slot")).alias("bucket"), F.pmod("slot", F.lit(BITS_PER_BUCKET)).alias("bit"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
    )


def _flagged(rows: DataFrame, bitmap: DataFrame, *names: str) -> DataFrame:
    """``rows`` with a column ``hit``: false where no surviving group can have the row."""
    slot = _slot(*[F.col(n) for n in names])
    bit = F.pmod(slot, F.lit(BITS_PER_BUCKET)).cast("int")
    held = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(held, bit % 8) % 2 = 1"), F.lit(False))
    return (
        rows.withColumn("bucket", _bucket(slot))
        .join(F.broadcast(bitmap), "bucket", "left")
        .withColumns({"bit": bit, "held": held})
        .withColumn("hit", hit)
        .drop("bucket", "bits", "bit", "held")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, copies (rows with this id and text), kept,
    digest (SHA-256 of the normalised text; null for texts that needed no full read, unless
    ``all_digests``), length in bytes and head (hash of the normalised prefix).  Of equal texts the
    row with the largest id stays."""
    docs = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    light = docs.select(*_light(F.col("text")))

    lengths = light.groupBy("length").agg(F.count("*").alias("n")).where("n > 1")
    second = _flagged(light, _bitmap(lengths, "length"), "length").where("hit")
    heads = second.groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1")
    full = docs.select("id", *_light(F.col("text")), F.col("text").alias("raw"))
    digest = F.sha2(normalised(F.col("raw")), 256)
    rows = written(
        _flagged(full, _bitmap(heads, "length", "head"), "length", "head").select(
            "id", "length", "head", "hit", (digest if all_digests else F.when(F.col("hit"), digest)).alias("digest")
        ),
        "dedup",
    )

    alone = rows.where("not hit").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("kept"), "digest", "length", "head"
    )
    same = rows.where("hit").groupBy("length", "head", "digest", "id").agg(F.count("*").alias("copies"))
    # written, so that the join has an exchange on either side and can split a group of very many ids
    tops = written(rows.where("hit").groupBy("length", "digest").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id")), "groups")
    shared = (
        same.join(tops, ["length", "digest"])
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long"))).alias("before"))
        .select("*", F.explode(F.sequence(F.col("before") + 1, F.least("copies", F.col("before") + COPIES_AT_ONCE))).alias("copy"))
        .select("id", "keep_id", "group_size", "copies", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest", "length", "head")
    )
    found = alone.unionByName(shared)
    return found.toDF(id_col, *found.columns[1:])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they are.

    Rows whose length and prefix hash no group of copies has pass without a shuffle or a full hash;
    only the others meet the list of rows to drop.
    """
    found = exact_dedup(docs, id_col, text_col)
    found = found.toDF("id", *found.columns[1:]).where("group_size > 1")
    judged = written(found.select("id", "digest", "copies", "kept", "length", "head"), "keepers")
    # of rows that repeat id and text the first one is marked kept
    judged = judged.groupBy("id", "digest", "length", "head").agg(F.max("copies").alias("copies"), F.max("kept").alias("kept"))

    def keys(of: Callable[[str], Column]) -> dict[str, Column]:
        length, head = _light(of(text_col))
        return {"length": length, "head": head, "id": of(id_col), "digest": F.sha2(normalised(of(text_col)), 256)}

    return without(docs, written(judged, "judged"), keys, ["length", "head"])


def without(docs: DataFrame, judged: DataFrame, keys_of: Callable[[Callable[[str], Column]], dict[str, Column]], light: list[str]) -> DataFrame:
    """``docs`` without the rows that ``judged`` lists as not kept, and with one of those it lists as
    kept with several copies.

    ``judged`` has a row (kept, copies and the keys) for each distinct value of the keys; ``keys_of``
    gives their expressions from a function that finds a column of ``docs``.  Rows whose ``light`` keys
    no listed row has pass by a bitmap; only for the others all keys are computed and joined.
    """
    # the whole row as one column, so that no name of the caller's clashes
    first, keys = keys_of(named), keys_of(lambda name: F.col("row")[name])
    packed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *[first[k].alias(k) for k in light])
    listed = judged.where("not kept or copies > 1")
    marked = _flagged(packed, _bitmap(listed, *light), *light)
    kept = marked.where("hit").select("row", *[x.alias(k) for k, x in keys.items()])

    dropped = judged.where("not kept").select(*keys)
    kept = kept.join(dropped, _same(kept, dropped, keys), "left_anti")
    often = judged.where("kept and copies > 1").select(*keys)
    if not often.isEmpty():
        again = _same(kept, often, keys)
        kept = kept.join(often, again, "left_anti").unionByName(kept.join(often, again, "left_semi").dropDuplicates(list(keys)))
    return marked.where("not hit").select("row.*").unionByName(kept.select("row.*"))


def _same(rows: DataFrame, listed: DataFrame, keys: dict[str, Column]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & rows[k].eqNullSafe(listed[k])
    return out
