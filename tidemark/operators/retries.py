"""Attempts at pages folded into outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import policy

#: Tries of a page, and seconds before the second.
MAX_ATTEMPTS = 3
BACKOFF_S = 0.5


def outcomes(attempts: DataFrame, most: int = MAX_ATTEMPTS, backoff: float = BACKOFF_S, respect_retry_after: bool = True) -> DataFrame:
    """(url, outcome, reason, attempts, waited_s): how the tries of each page ended.

    ``attempts``: url, attempt (from 1), status (null where nothing came back), retry_after
    in seconds. The first success or permanent failure ends the tries, else the last
    that is allowed, as a dead letter; later rows don't count. ``waited_s`` is the time
    between the tries. Of rows with one url and attempt the one with the lowest status stands;
    rows without an attempt number are left out.
    """
    c = policy.classify_status(F.col("status"))
    kind = F.coalesce(c["kind"], F.lit("transient"))
    reason = F.coalesce(c["reason"], F.lit("no response"))
    wait = policy.retry_wait(F.col("attempt"), F.lit(backoff), F.col("retry_after"), F.lit(respect_retry_after))
    each = attempts.filter(F.col("attempt").between(1, most)).select(
        "url", "attempt", F.struct(F.coalesce("status", F.lit(1 << 30)).alias("order"), kind.alias("kind"), reason.alias("reason"), wait.alias("wait")).alias("r")
    )
    once = each.groupBy("url", "attempt").agg(F.min("r").alias("r"))
    listed = once.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("attempt", "r"))).alias("l"))  # at most ``most`` each
    ends = F.filter("l", lambda x: x["r"]["kind"] != "transient")
    last = F.coalesce(F.get(ends, F.lit(0)), F.element_at("l", -1))
    before = F.filter("l", lambda x: x["attempt"] < F.col("last.attempt"))
    waited = F.aggregate(before, F.lit(0.0), lambda a, x: a + x["r"]["wait"])
    rows = listed.withColumn("last", last)
    return rows.select(
        "url",
        F.when(F.col("last.r.kind") == "success", "success").otherwise("dead").alias("outcome"),
        F.col("last.r.reason").alias("reason"),
        F.col("last.attempt").alias("attempts"),
        waited.alias("waited_s"),
    )
