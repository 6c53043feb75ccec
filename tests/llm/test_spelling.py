"""Duplicates in another spelling, against brute force."""

import unicodedata
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import spelling

FIELDS = {"name": True, "brand": True, "price": False}
DDL = "row_id bigint, name string, brand string, price double"


def plain(s):
    if s is None:
        return None
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).casefold())
    return "".join(c for i, c in enumerate(s) if c.isalnum() or (c in ".," and 0 < i < len(s) - 1 and s[i - 1].isdecimal() and s[i + 1].isdecimal()))


def brute(rows):
    groups = defaultdict(list)
    for row_id, name, brand, price in rows:
        groups[plain(name), plain(brand), price].append(row_id)
    return sorted((min(g), r) for g in groups.values() for r in g if r != min(g))


def found(df, **kw):
    return sorted((r["keep_id"], r["row_id"]) for r in spelling.copies(df, "row_id", FIELDS, **kw).collect())


ROWS = [
    (1, "Café Mug 1.5 L", "A", 2.0), (2, "CAFÉ-mug  1.5 l!", "a", 2.0), (3, "Cafe Mug 1.5 L", "A", 2.0), (4, "Café Mug 15 L", "A", 2.0), (5, "Café Mug 1,5 L", "A", 2.0),
    (6, None, "A", 2.0), (7, None, "A", 2.0), (8, "", "A", 2.0), (9, "!?", "A", 2.0), (10, "café​mug1.5l.", "A", None), (11, "Café Mug 1.5 L", "A", None),
    (12, "x", None, 0.0), (13, "X", None, -0.0), (14, "straße", None, 1.0), (15, "STRASSE", None, 1.0), (16, "x" * 100_000, "", 3.0), (17, "X " * 100_000, "", 3.0),
]


def test_cases(spark):
    df = spark.createDataFrame(ROWS, DDL)
    got = found(df)
    assert got == brute(ROWS)
    assert (1, 2) in got and (6, 7) in got and (8, 9) in got and (12, 13) in got and (14, 15) in got and (16, 17) in got
    assert {r for pair in got for r in pair}.isdisjoint({3, 4, 5})


@pytest.mark.parametrize("hot", [1, 2, 3, 10**6])
def test_hot_groups_and_large_dictionaries(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", 3)
    rows = ROWS + [(100 + i, "same name" if i % 3 else f"n{i}", "B", 1.0) for i in range(90)]
    assert found(spark.createDataFrame(rows, DDL), hot=hot) == brute(rows)


def test_repeated_row_ids_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, DDL).withColumns({c: F.lit("z") for c in ("_id", "raw", "canon", "code", "c0", "_f0", "copies", "keep_id")})
    assert found(df) == brute(ROWS)
    assert found(df.unionByName(df.filter("row_id = 1"))) == brute(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert found(df) == [] and spelling.collapse(df, "row_id", FIELDS).count() == 0


def test_counts(spark):
    got = {r["keep_id"]: r["copies"] for r in spelling.collapse(spark.createDataFrame(ROWS, DDL), "row_id", FIELDS).collect()}
    assert sum(got.values()) == len(ROWS) and got[1] == 2 and got[8] == 2


def test_real_tables(spark):
    for table, fields in spelling.LISTINGS.items():
        df = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        names = list(fields)
        data = [(r["row_id"], r[names[0]], r[names[1]], r[names[2]]) for r in df.collect()]
        assert sorted((r["keep_id"], r["row_id"]) for r in spelling.copies(df, "row_id", fields).collect()) == brute(data)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZéé1.,5 -_​­“ñÑß²", max_size=12))
def test_fold_is_stable(text):
    once = spelling.fold(text)
    assert spelling.fold(text.upper()) == spelling.fold(text.upper().lower()) or "ß" in text
    assert spelling.fold(f" «{text}» ") == spelling.fold(f"({text})") and "​" not in once
