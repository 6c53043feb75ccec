"""Mixing: the apportionment and what it makes of the documents."""

import heapq
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixture


def by_quotients(votes, seats, caps):
    """Seat by seat, as the method is stated."""
    out = [0] * len(votes)
    heap = [(-Fraction(v), i) for i, v in enumerate(votes) if v > 0 and caps[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-Fraction(votes[i]) / (2 * out[i] + 1), i))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment(parties, seats):
    votes, caps = [v for v, _ in parties], [c for _, c in parties]
    assert mixture.apportion(votes, seats, caps) == by_quotients(votes, seats, caps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=6), st.integers(0, 60), st.integers(0, 4))
def test_shards_give_all_their_source_may(sizes, blocks, cap):
    got = mixture.shard_quotas(sizes, blocks, cap, 16)
    wanted = min(blocks * 16, cap * sum(sizes))
    assert all(q <= cap * n for q, n in zip(got, sizes)) and wanted <= sum(got) <= max(wanted + 15, wanted)


def test_small_sources_are_used_up(spark):
    """Less than a block, or a rest after the last block, is a short block and isn't lost."""
    docs, targets = frames(spark, [(1, "x" * 10, "a"), (2, "y" * 3000, "b"), (3, "z" * 1500, "c"), (4, "w" * 4000, None)], [("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.4, 1)])
    rows = {r["source_name"]: r for r in mixture.reached(docs, targets).collect()}
    assert rows["a"]["mix_tokens"] == 10 and rows["c"]["mix_tokens"] == 1500 and rows["a"]["short"] and rows["c"]["short"]
    assert rows["a"]["quota_tokens"] == 10 and rows["c"]["quota_tokens"] == 1500 and rows["b"]["mix_tokens"] >= 6000


DDL, TARGETS = "doc_id bigint, text string, source string", "source_name string, target_share double, max_repeats int"


def frames(spark, docs, targets):
    return spark.createDataFrame(docs, DDL), spark.createDataFrame(targets, TARGETS)


def sample(n=400):
    return [(i, "x" * (20 + i % 37), ["a", " A\t", "b", "B", None, "c"][i % 6]) for i in range(n)]


def test_shares_and_caps(spark):
    docs, targets = frames(spark, sample(), [("a", 0.5, 2), ("b", 0.3, 2), ("C ", 0.2, 2), ("none", 0.0, 3)])
    rows = {r["source_name"]: r for r in mixture.reached(docs, targets, block=16).collect()}
    assert rows["a"]["reached_share"] == pytest.approx(0.5, abs=0.02) and rows["none"]["docs"] == 0
    assert all(r["most_uses"] <= r["max_repeats"] for r in rows.values())
    uses = mixture.mix(docs, targets, block=16).collect()
    assert len({r["doc_id"] for r in uses}) == len(uses)
    again = mixture.mix(docs.repartition(7), targets, block=16).collect()
    assert sorted(map(tuple, uses)) == sorted(map(tuple, again))
    assert sorted(map(tuple, mixture.mix(docs, targets, seed=8, block=16).collect())) != sorted(map(tuple, uses))


def test_short_sources(spark):
    docs, targets = frames(spark, [(1, "x" * 10, "a"), (2, "y" * 89, "b"), (3, None, "a"), (4, "z", None)], [("A", 0.3, 2), ("b", 0.7, 1), ("gone", 0.0, 5), ("gone2", 0.01, 5)])
    short = {r["source_name"]: r["short"] for r in mixture.source_report(docs, targets).collect()}
    assert short == {"A": True, "b": False, "gone": False, "gone2": True}


def test_exactly_enough_is_not_short(spark):
    docs, targets = frames(spark, [(1, "x" * 50, "a"), (2, "x" * 50, "b")], [("a", 0.5, 1), ("b", 0.5, 1)])
    assert not any(r["short"] for r in mixture.source_report(docs, targets).collect())


def test_hot_source_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SHARD_DOCS", 10)
    docs, targets = frames(spark, sample(), [("a", 0.6, 3), ("b", 0.4, 3)])
    rows = {r["source_name"]: r for r in mixture.reached(docs, targets, block=16).collect()}
    assert rows["a"]["reached_share"] == pytest.approx(0.6, abs=0.03) and all(r["most_uses"] <= 3 for r in rows.values())


def test_empty_null_and_clashing(spark):
    docs, targets = frames(spark, [], [("a", 0.5, 2), (None, 0.5, 2), ("b", None, None)])
    assert [(r["source_name"], r["short"]) for r in mixture.source_report(docs, targets).collect()] == [("a", False), ("b", False)]
    assert mixture.mix(docs, targets).count() == 0
    docs, _ = frames(spark, sample(30), [])
    extra = docs.withColumns({c: F.lit("z") for c in ("key", "n_tokens", "shard", "uses", "passes", "rest")})
    assert mixture.mix(extra, targets, block=16).count() > 0
    none = spark.createDataFrame([], TARGETS)
    assert mixture.source_report(docs, none).count() == 0 and mixture.mix(docs, none).count() == 0
