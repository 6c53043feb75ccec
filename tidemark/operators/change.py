"""What is known of pages across runs: validators, and upserts that keep the latest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import conditional_headers, is_unchanged


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by a map-side combinable maximum."""
    rest = [c for c in rows.columns if c not in (*key, *order)]
    best = F.max(F.struct(*order, *rest)).alias("_b")
    return rows.groupBy(*key).agg(best).select(*key, "_b.*").select(*rows.columns)


def upsert(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with those of ``fresh`` in place of the same key; ``fresh`` has one row per key."""
    return stored.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def detect(responses: DataFrame, validators: DataFrame) -> DataFrame:
    """Responses with whether they are unchanged against stored validators.

    ``responses``: url, status, body, ...; ``validators``: url, etag, last_modified, content_hash.
    """
    prior = validators.select("url", F.col("content_hash").alias("_h"))
    return responses.join(prior, "url", "left").withColumn("unchanged", is_unchanged(F.col("status"), F.col("body"), F.col("_h"))).drop("_h")


def record(responses: DataFrame, validators: DataFrame) -> DataFrame:
    """Validators after a run: those of changed pages replaced, the others kept."""
    fresh = detect(responses, validators).filter("not unchanged")
    rows = fresh.select("url", "etag", "last_modified", F.sha2("body", 256).alias("content_hash"))
    return upsert(validators, rows, ["url"])


def request_headers(urls: DataFrame, validators: DataFrame) -> DataFrame:
    """(url, headers) of conditional requests; pages not seen before have none."""
    joined = urls.join(validators, "url", "left")
    return joined.select("url", conditional_headers(F.col("etag"), F.col("last_modified")).alias("headers"))
