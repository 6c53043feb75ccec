"""Ordering snapshots of a key in time, without one task per hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time blocks that split a hot key's history.
BLOCK_US = 24 * 3600 * 1_000_000


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch of an ISO 8601 text; a text without zone is UTC; else null."""
    t = F.upper(F.trim(text))
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp; one without zone is in the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def standing(rows: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """Of rows with the same key and instant only the one with the highest id.

    Rows with a null key or instant are no snapshots and are left out.
    """
    rest = [c for c in rows.columns if c not in (key, ts, row_id)]
    best = F.max(F.struct(row_id, *rest)).alias("_best")
    kept = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, ts).agg(best)
    return kept.select(key, ts, F.col("_best")[row_id].alias(row_id), *(F.col("_best")[c].alias(c) for c in rest))


def consecutive(rows: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """(new_id, prev_id) for each row that has an earlier one of the same key.

    Two levels: a lag inside each (key, time block), then one row per block to link
    the first of a block with the last of the block before. No task holds more than
    one block of a hot key, and the second level holds one row per block.
    """
    block = (F.col(ts) / F.lit(BLOCK_US)).cast("bigint")
    slim = rows.select(key, ts, row_id, block.alias("_block"))
    inner = Window.partitionBy(key, "_block").orderBy(ts)
    near = slim.select(key, "_block", F.col(row_id).alias("new_id"), F.lag(row_id).over(inner).alias("prev_id"))
    ends = slim.groupBy(key, "_block").agg(
        F.min_by(row_id, ts).alias("new_id"), F.max_by(row_id, ts).alias("_last")
    )
    outer = Window.partitionBy(key).orderBy("_block")
    links = ends.select("new_id", F.lag("_last").over(outer).alias("prev_id"))
    return (
        near.filter(F.col("prev_id").isNotNull())
        .select("new_id", "prev_id")
        .unionByName(links.filter(F.col("prev_id").isNotNull()))
    )


def with_next(rows: DataFrame, key: str, order: str, values: list[str], block: Column) -> DataFrame:
    """``rows`` with ``next``: a struct of ``values`` of the key's next row by ``order``, null for the last.

    Two levels as in :func:`consecutive`: inside each (key, ``block``), then the first row of each
    block for the last of the one before. ``block`` must not fall as ``order`` rises.
    """
    split = rows.withColumn("_block", block)
    value = F.struct(*values)
    inner = Window.partitionBy(key, "_block").orderBy(order)
    firsts = split.groupBy(key, "_block").agg(F.min_by(value, order).alias("_first"))
    after = firsts.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), F.lead("_first").over(Window.partitionBy(key).orderBy("_block")).alias("_after"))
    near = split.withColumn("_near", F.lead(value).over(inner))
    both = near.join(after, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")))
    return both.withColumn("next", F.coalesce("_near", "_after")).drop("_block", "_near", "_key", "_b", "_after")


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], block: Column) -> DataFrame:
    """``rows`` with running totals of ``sums`` over each key's rows in ``order``, own row included.

    Two levels: inside each (key, ``block``), then one row per block; a hot key's rows are spread
    over its blocks.
    """
    split = rows.withColumns({"_block": block, **{f"_{n}": c for n, c in sums.items()}})
    inner = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = split.groupBy(key, "_block").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    offsets = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = split.withColumns({f"_r_{n}": F.sum(f"_{n}").over(inner) for n in sums})
    both = own.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")))
    return both.select(*rows.columns, *((F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))
