"""Per-key sequence operations that do not need a whole key in one task.

A plain ``Window.partitionBy(key)`` sorts everything a key owns in a single task, which fails when one key holds a
large share of the table. Here a key is cut into *slices* of its ordering column. Each slice is handled on its own,
and what one slice must know about the earlier ones travels through a small per-slice summary table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SLICE = "__slice"


def add_slice(df: DataFrame, order: str, width: int) -> DataFrame:
    """Tag rows with the slice of their (long) ordering column."""
    return df.withColumn(SLICE, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def previous_row(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], width: int) -> DataFrame:
    """Add ``prev_<column>``: the values of the preceding row of the key, in ``order`` (first element a long)."""
    sliced = add_slice(df, order[0], width)
    inside = W.partitionBy(key, SLICE).orderBy(*order)
    last = (
        sliced.groupBy(key, SLICE)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
        .withColumn("__carry", F.lag("__last").over(W.partitionBy(key).orderBy(SLICE)))
        .select(key, SLICE, "__carry")
    )
    lagged = sliced.withColumn("__prev", F.lag(F.struct(*columns)).over(inside)).join(last, [key, SLICE], "left")
    for column in columns:
        lagged = lagged.withColumn(f"prev_{column}", F.coalesce(F.col("__prev"), F.col("__carry"))[column])
    return lagged.drop(SLICE, "__prev", "__carry")


def streak_since(df: DataFrame, key: str, order: Sequence[str], reset: Column, out: str, width: int) -> DataFrame:
    """Number of rows of the key since the last row where ``reset`` holds (0 on such a row)."""
    sliced = add_slice(df, order[0], width).withColumn("__reset", F.coalesce(reset, F.lit(False)))
    inside = W.partitionBy(key, SLICE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = sliced.withColumn("__pos", F.count(F.lit(1)).over(inside)).withColumn(
        "__last", F.max(F.when(F.col("__reset"), F.col("__pos"))).over(inside)
    )
    before = W.partitionBy(key).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    totals = local.groupBy(key, SLICE).agg(F.count(F.lit(1)).alias("__n"), F.max("__last").alias("__reset_pos"))
    carry = (
        totals.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__reset_at", F.col("__before") + F.col("__reset_pos"))
        .withColumn("__carry", F.coalesce(F.max("__reset_at").over(before), F.lit(0)))
        .select(key, SLICE, "__before", "__carry")
    )
    joined = local.join(carry, [key, SLICE], "left")
    start = F.coalesce(F.col("__before") + F.col("__last"), F.col("__carry"))
    return joined.withColumn(out, (F.col("__before") + F.col("__pos") - start).cast("bigint")).drop(
        SLICE, "__reset", "__pos", "__last", "__before", "__carry"
    )


def rank_up_to(df: DataFrame, group: Sequence[str], row_id: str, limit: int, out: str) -> DataFrame:
    """Rank rows of a group by ``row_id`` for the first ``limit`` of them; the others get NULL.

    The filter on the rank lets Spark keep only ``limit`` rows per group on the map side, so a group of any size
    sends a bounded number of rows to its task. The ranks return to the rows by their unique id.
    """
    ranked = (
        df.select(*group, row_id)
        .withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(row_id)))
        .filter(F.col(out) <= limit)
        .select(row_id, F.col(out).cast("bigint").alias(out))
    )
    return df.join(ranked, row_id, "left")
