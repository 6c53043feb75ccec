"""Timings and counters of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def op_stats(samples: DataFrame, by: str = "op", value: str = "duration_s") -> DataFrame:
    """(op, n, total, median, p95): p95 is the nearest rank."""
    v = F.col(value)
    return samples.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.median(v).alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95")
    )


def slowest(samples: DataFrame, n: int = 8) -> DataFrame:
    """The n slowest, ties by operation and detail; a top-n, not a sort of everything."""
    return samples.orderBy(F.col("duration_s").desc(), "op", "detail").limit(n)


def skip_breakdown(skips: DataFrame) -> DataFrame:
    """(reason, n) of skipped actions."""
    return skips.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def benchmark_entries(stats: DataFrame) -> DataFrame:
    """(name, unit, value): the statistics as rows."""
    return stats.select("op", F.expr("stack(2, 'total', total, 'median', median) as (what, value)")).select(
        F.concat_ws(" ", "op", "what").alias("name"), F.lit("s").alias("unit"), "value"
    )


def drift(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(name, expected, found) of counters that differ; counters without a baseline are skipped."""
    rows = measured.withColumnRenamed("value", "found").join(baseline.withColumnRenamed("value", "expected"), "name")
    return rows.filter(F.col("found") != F.col("expected")).select("name", "expected", "found")


def resource_trace(transactions: DataFrame) -> DataFrame:
    """Transactions in time order with rounded figures."""
    return transactions.select(
        F.bround("start_offset", 3).alias("start_s"), "op", F.bround("duration_s", 4).alias("duration_s"), "detail",
        F.bround(F.greatest("rss_before", "rss_after") / 1e6, 1).alias("rss_mb"),
    ).orderBy("start_s")


def image_counts(refs: DataFrame) -> DataFrame:
    """References, distinct files and clips of a run's pictures."""
    return refs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("refs"), F.count_distinct("src").alias("files"), F.count_if(F.col("box").isNotNull()).alias("clips")
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run's outcomes (run_id, outcome), one row per run."""
    kinds = ("record", "page", "blocked", "dead", "unchanged", "retry")
    return outcomes.groupBy("run_id").agg(*(F.count_if(F.col("outcome") == k).alias(f"{k}s") for k in kinds))
