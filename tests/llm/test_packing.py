"""Containers: the plan, the programme behind it, and the placed pieces."""

from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing


def best_padding(lengths, counts, k):
    """Brute force over all ways to cut into at most k ranges."""
    n = len(lengths)

    def cost(i, j):
        return sum(c * (lengths[j - 1] - x) for x, c in zip(lengths[i:j], counts[i:j]))

    best = {0: 0}
    for _ in range(min(k, n)):
        best = {j: min([best[i] + cost(i, j) for i in best if i <= j], default=None) for j in range(n + 1)}
    return best[n]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_have_the_least_padding(histogram, k):
    lengths = sorted(histogram)
    counts = [histogram[x] for x in lengths]
    bounds = packing.bucket_bounds(lengths, counts, k)
    assert bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1] and len(bounds) <= k
    got = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
    assert got == best_padding(lengths, counts, k)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15), st.integers(40, 50))
def test_plan_places_everything_once(histogram, capacity):
    p = packing.plan(histogram, capacity, 4)
    load, ranks = defaultdict(int), defaultdict(list)
    placed = [tuple(map(int, r)) for r in p.placed]
    for i, (length, rank, per, first) in enumerate(placed):
        end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else histogram[length]
        for r in range(rank, end):
            load[first + (r - rank) // per] += length
            ranks[length].append(r)
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
    rooms = {first + k: room for first, count, room, _ in p.runs for k in range(count)}
    assert rooms == {c: capacity - n for c, n in load.items()} and len(rooms) == p.containers
    total = sum(x * n for x, n in histogram.items())
    assert p.containers <= 2 * -(-total // capacity) + 1


def by_container(p, histogram):
    held = defaultdict(list)
    placed = [tuple(map(int, r)) for r in p.placed]
    for i, (length, rank, per, first) in enumerate(placed):
        end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else histogram[length]
        for r in range(rank, end):
            held[first + (r - rank) // per].append(length)
    return held


HISTOGRAM = {x: 1 + (x * 7919) % 5 for x in [*range(3, 40, 4), *range(41, 100, 3)]}


def test_bounds_decide_what_shares_a_batch():
    plans = {k: packing.plan(HISTOGRAM, 100, k) for k in (1, 4, 12)}
    made = {k: sorted(sorted(v) for v in by_container(p, HISTOGRAM).values()) for k, p in plans.items()}
    assert made[1] != made[4] != made[12]
    other = packing.bucket_bounds
    try:
        packing.bucket_bounds = lambda lengths, counts, buckets: [max(lengths)]
        assert sorted(sorted(v) for v in by_container(packing.plan(HISTOGRAM, 100, 4), HISTOGRAM).values()) == made[1]
    finally:
        packing.bucket_bounds = other


def test_batches_stay_in_their_bucket_without_topping_up():
    p = packing.plan(HISTOGRAM, 100, 6, top_up=False)
    bucket = lambda x: next(i for i, b in enumerate(p.bounds) if x <= b)
    held = by_container(p, HISTOGRAM)
    assert all(len({bucket(x) for x in v}) == 1 for v in held.values())
    assert packing.plan(HISTOGRAM, 100, 6).containers < p.containers


def test_a_batch_is_topped_up_by_shorter_buckets_only():
    p = packing.plan(HISTOGRAM, 100, 6)
    bucket = lambda x: next(i for i, b in enumerate(p.bounds) if x <= b)
    own = {first + k: b for first, count, _, b in p.runs for k in range(count)}
    assert all(max(map(bucket, v)) == own[c] for c, v in by_container(p, HISTOGRAM).items())


def test_too_long_item():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)
    assert packing.plan({}, 10).containers == 0


def placed(spark, texts, capacity=10, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.lit("z") for c in ("total", "piece", "n_tokens", "rank", "container", "_block")})
    return packing.pack(df, capacity, **kw).collect()


def check(rows, texts, capacity):
    load, room, pieces = defaultdict(int), {}, defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start_token"], r["end_token"]))
        if r["container"] is None:
            assert r["n_tokens"] == 0 and r["room_left"] is None
            continue
        load[r["container"]] += r["n_tokens"]
        room[r["container"]] = r["room_left"]
    assert room == {c: capacity - n for c, n in load.items()} and all(n <= capacity for n in load.values())
    for i, t in enumerate(texts):
        n = len((t or "").encode())
        spans = sorted(pieces[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == max(1, -(-n // capacity)) and all(b - a == capacity for a, b in spans[:-1])
    return load


def test_pieces(spark):
    texts = ["a" * 10, "b" * 11, "c" * 25, "", None, "é" * 4, "d", "d", "e" * 9, "f" * 6, "f" * 6, "g" * 4]
    load = check(placed(spark, texts), texts, 10)
    assert len(load) == -(-sum(load.values()) // 10)


def test_hot_length_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 7)
    texts = ["x" * (3 if i % 3 else i % 11 + 1) for i in range(100)]
    load = check(placed(spark, texts), texts, 10)
    assert len(load) <= -(-sum(load.values()) // 9)  # three threes leave one over


def test_empty_and_long(spark):
    assert placed(spark, []) == []
    check(placed(spark, ["z" * 100_003], 8192), ["z" * 100_003], 8192)


def test_other_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = placed(spark, ["hello world " * 9, "a", None], 8, tokenizer=path)
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(path).encode("hello world " * 9).ids)
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 0) == n


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(df).collect()
    used = {r["container"]: 8192 - r["room_left"] for r in rows if r["container"] is not None}
    assert len(used) <= -(-sum(used.values()) // 8192) + 1
    long = {r["doc_id"] for r in df.collect() if len((r["text"] or "").encode()) > 8192}
    assert {r["doc_id"] for r in rows if r["piece"] == 1} == long
