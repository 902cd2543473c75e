"""Windows over the physical order of rows that scale beyond one task per acquisition.

``Window.partitionBy(source)`` puts a whole acquisition into one task.  Here an acquisition is cut
into buckets of consecutive rows; windows run inside buckets, and what crosses a bucket's border comes
from one summary row per bucket (the first and last row, the greatest value), folded over the
buckets and joined back.  Results don't depend on the bucket size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ROW, SOURCE

BUCKET_ROWS = 1 << 16


def with_neighbours(
    df: DataFrame, columns: Sequence[str], running: Sequence[str] = (), source: str = SOURCE, row: str = ROW, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``df`` with, for each of ``columns`` c, ``prev_c`` and ``next_c`` (the adjacent rows' values),
    ``has_prev`` and ``has_next``, and for each of ``running`` ``before_c``, the greatest value of all
    earlier rows, nulls passed over."""
    names = list(df.columns)
    bucketed = df.withColumn("__bucket", F.floor(F.col(row) / F.lit(bucket_rows)))
    edge = [c for c in columns]
    summary = bucketed.groupBy(source, "__bucket").agg(
        F.min_by(F.struct(*edge) if edge else F.lit(0), row).alias("__first"),
        F.max_by(F.struct(*edge) if edge else F.lit(0), row).alias("__last"),
        *[F.max(c).alias(f"__max_{c}") for c in running],
    )
    over = Window.partitionBy(source).orderBy("__bucket")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    borders = summary.select(
        source, "__bucket", F.lag("__last").over(over).alias("__left"), F.lead("__first").over(over).alias("__right"),
        F.lag(F.lit(True)).over(over).alias("__has_left"), F.lead(F.lit(True)).over(over).alias("__has_right"),
        *[F.max(f"__max_{c}").over(earlier).alias(f"__before_{c}") for c in running],
    )
    joined = bucketed.join(borders, [source, "__bucket"])
    inside = Window.partitionBy(source, "__bucket").orderBy(row)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    at_head, at_tail = F.row_number().over(inside) == 1, F.lead(F.lit(True)).over(inside).isNull()
    out: list[Column | str] = [*names]
    for c in columns:
        out.append(F.when(at_head, F.col("__left")[c]).otherwise(F.lag(c).over(inside)).alias(f"prev_{c}"))
        out.append(F.when(at_tail, F.col("__right")[c]).otherwise(F.lead(c).over(inside)).alias(f"next_{c}"))
    out.append((~at_head | F.coalesce("__has_left", F.lit(False))).alias("has_prev"))
    out.append((~at_tail | F.coalesce("__has_right", F.lit(False))).alias("has_next"))
    for c in running:
        out.append(F.greatest(F.max(c).over(before), F.col(f"__before_{c}")).alias(f"before_{c}"))
    return joined.select(*out)


def running_sums(df: DataFrame, columns: Sequence[str], source: str = SOURCE, row: str = ROW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum up to and with the row, nulls passed over."""
    bucketed = df.withColumn("__bucket", F.floor(F.col(row) / F.lit(bucket_rows)))
    earlier = Window.partitionBy(source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(source, "__bucket").agg(*[F.sum(c).alias(f"__sum_{c}") for c in columns])
    carried = totals.select(source, "__bucket", *[F.coalesce(F.sum(f"__sum_{c}").over(earlier), F.lit(0)).alias(f"__carried_{c}") for c in columns])
    inside = Window.partitionBy(source, "__bucket").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.col(f"__carried_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns}
    return bucketed.join(carried, [source, "__bucket"]).select(*[sums[c].alias(c) if c in sums else c for c in df.columns])
