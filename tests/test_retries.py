"""Tries of pages folded into outcomes."""

from pyspark.sql import functions as F

from tidemark.operators import retries

DDL = "url string, attempt int, status int, retry_after double"


def fold(spark, rows, **kw):
    df = spark.createDataFrame(rows, DDL).withColumns({c: F.lit("z") for c in ("r", "l", "last", "kind", "outcome", "order")})
    return sorted((tuple(r) for r in retries.outcomes(df, **kw).collect()), key=str)


def test_outcomes(spark):
    rows = [("a", 1, 503, None), ("a", 2, 429, 300.0), ("a", 3, 200, None), ("b", 1, 404, None), ("b", 2, 200, None), ("c", 1, None, None), ("c", 2, 500, None), ("c", 3, 429, None), ("c", 4, 200, None), ("d", 1, 301, None)]
    assert fold(spark, rows) == [
        ("a", "success", "", 3, 0.5 + 120.0), ("b", "dead", "client error (404)", 1, 0.0), ("c", "dead", "rate limited (429)", 3, 0.5 + 1.0), ("d", "success", "", 1, 0.0),
    ]
    assert fold(spark, rows, respect_retry_after=False)[0][4] == 0.5 + 1.0
    assert fold(spark, rows, most=4)[2][1:4] == ("success", "", 4)


def test_repeated_and_missing_rows(spark):
    rows = [("a", 1, 503, None), ("a", 1, 503, None), ("a", None, 200, None), (None, 1, 200, None), ("b", 2, 200, None)]
    assert fold(spark, rows) == [("a", "dead", "server error (503)", 1, 0.0), ("b", "success", "", 2, 0.0), (None, "success", "", 1, 0.0)]
    assert fold(spark, []) == []
