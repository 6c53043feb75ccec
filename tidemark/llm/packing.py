"""Filling fixed-capacity containers with texts, planned on the global length histogram.

The histogram of lengths, one count per length up to the capacity, is all the driver
sees. A dynamic programme picks the bucket boundaries with the least padding. Going
from the longest bucket to the shortest, a bucket's items first top up the room that
batches of longer buckets left; what remains forms token-budget batches of its own
bucket. All that happens to *counts*, so the plan's size depends on the capacity alone.
Items then look their container up by length and rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .tokens import with_tokens

CAPACITY = 8192
BUCKETS = 32
#: Items of one length that are ranked by one task.
RANK_BLOCK = 500_000


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` ranges of ``lengths`` (ascending) with the least
    padding, where each item is padded to its range's bound.

    Dynamic programme over prefixes; the cost of ending a range at bound ``h`` is a line
    in ``h`` for each start, so each layer takes one pass over a lower hull of lines.
    """
    n = len(lengths)
    items, tokens = [0], [0]
    for length, count in zip(lengths, counts):
        items.append(items[-1] + count)
        tokens.append(tokens[-1] + count * length)
    best = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, start
        at, layer, cut = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-items[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (
                    hull[-1][1] - hull[-2][1]
                ) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            h = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * h + hull[at + 1][1] <= hull[at][0] * h + hull[at][1]:
                at += 1
            slope, base, start = hull[at]
            layer[j] = h * items[j] - tokens[j] + slope * h + base
            cut[j] = start
        cuts.append(cut)
        best = layer
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = cut[j]
    return bounds[::-1]


@dataclass
class Plan:
    """Where items go: rows (length, first rank, items per container, first container) sorted
    by length and rank, and runs of containers (first, count, room, bucket of its batch)."""

    capacity: int
    bounds: list[int]
    placed: np.ndarray
    runs: np.ndarray
    containers: int


class _Rooms:
    """Runs of containers by the room they have left."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int]]] = {}  # room: (first container, count, bucket)
        self.sizes: list[int] = []  # rooms in use, ascending

    def put(self, room: int, run: tuple[int, int, int]) -> None:
        if room not in self.runs:
            self.runs[room] = []
            insort(self.sizes, room)
        self.runs[room].append(run)

    def take(self, length: int) -> tuple[int, tuple[int, int, int]] | None:
        """The tightest run that has room for one item of ``length``."""
        i = bisect_left(self.sizes, length)
        if i == len(self.sizes):
            return None
        room = self.sizes[i]
        run = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.sizes.pop(i)
        return room, run


def plan(histogram: dict[int, int], capacity: int = CAPACITY, buckets: int = BUCKETS, top_up: bool = True) -> Plan:
    """Pack counts of items by length (1 to ``capacity``) into containers.

    From the longest bucket to the shortest: the bucket's items go, longest first, into the
    tightest room that closed batches of longer buckets left (not without ``top_up``); those
    for which there is none form the bucket's own token-budget batches: one after another,
    longest first, a batch is closed when the next item no longer fits. What a batch has
    left is for shorter buckets, so the bounds decide which lengths share a container.
    """
    lengths = sorted(length for length, count in histogram.items() if count > 0 and length > 0)
    if lengths and lengths[-1] > capacity:
        raise ValueError("an item is longer than a container")
    bounds = bucket_bounds(lengths, [histogram[x] for x in lengths], buckets)
    placed: list[tuple[int, int, int, int]] = []
    closed = _Rooms()
    total = 0

    def fill(rooms: _Rooms, length: int, rank: int, left: int, room: int, run: tuple[int, int, int]) -> tuple[int, int]:
        """Place up to ``left`` items into a run of containers; the next rank and what is left."""
        first, count, bucket = run
        per = room // length
        whole = min(count, left // per)
        if whole:
            placed.append((length, rank, per, first))
            rooms.put(room - per * length, (first, whole, bucket))
            rank, left = rank + whole * per, left - whole * per
        if whole < count and left:
            placed.append((length, rank, left, first + whole))
            rooms.put(room - left * length, (first + whole, 1, bucket))
            rank, left, whole = rank + left, 0, whole + 1
        if whole < count:
            rooms.put(room, (first + whole, count - whole, bucket))
        return rank, left

    for bucket in range(len(bounds) - 1, -1, -1):
        low = bounds[bucket - 1] if bucket else 0
        own = [x for x in reversed(lengths) if low < x <= bounds[bucket]]
        rest = {length: (0, histogram[length]) for length in own}
        for length in own if top_up else ():
            rank, left = rest[length]
            while left and (spot := closed.take(length)):
                rank, left = fill(closed, length, rank, left, *spot)
            rest[length] = rank, left
        at, room = 0, 0  # the batch that is being filled
        for length in own:
            rank, left = rest[length]
            while left:
                if room < length:
                    if room:
                        closed.put(room, (at, 1, bucket))
                    many = left // (capacity // length)  # whole batches of this length
                    if many:
                        rank, left = fill(closed, length, rank, left, capacity, (total, many, bucket))
                        total += many
                    at, room = (total, capacity) if left else (0, 0)
                    total += bool(left)
                take = min(left, room // length)
                if take:
                    placed.append((length, rank, take, at))
                    rank, left, room = rank + take, left - take, room - take * length
                    if not room:
                        closed.put(0, (at, 1, bucket))
        if room:
            closed.put(room, (at, 1, bucket))
    runs = sorted((first, count, room, bucket) for room, many in closed.runs.items() for first, count, bucket in many)
    as_array = lambda rows, n: np.array(sorted(rows), dtype=np.int64).reshape(-1, n)
    return Plan(capacity, bounds, as_array(placed, 4), as_array(runs, 4), total)


def pieces(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start_token, end_token, n_tokens): a text longer than the capacity in
    pieces of it and a rest, any other as one piece. A null or empty text is one piece of none."""
    sized = with_tokens(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "text", tokenizer, "total")
    many = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int")
    each = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return each.select(
        "doc_id",
        "piece",
        start.alias("start_token"),
        F.least(start + capacity, "total").alias("end_token"),
        (F.least(start + capacity, "total") - start).alias("n_tokens"),
    )


def ranked(items: DataFrame, blocks: int) -> DataFrame:
    """Items with their rank among those of the same length, in two levels.

    Inside a (length, block) rows are numbered; blocks of a length follow each other by
    their counts. A hot length is spread over ``blocks`` tasks.
    """
    split = items.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    counts = split.groupBy("n_tokens", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("n_tokens").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("n_tokens", "_block").orderBy("doc_id", "piece")
    numbered = split.withColumn("_rn", F.row_number().over(inner))
    return numbered.join(offsets, ["n_tokens", "_block"]).withColumn("rank", F.col("_offset") + F.col("_rn") - 1).drop("_block", "_offset", "_rn")


_PLACED = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int64()), ("container", pa.int64()), ("room_left", pa.int64())]
)
PLACED_DDL = "doc_id bigint, piece int, start_token bigint, end_token bigint, n_tokens bigint, container bigint, room_left bigint"


def histogram_of(items: DataFrame) -> dict[int, int]:
    """Items per length; at most as many entries as a container has tokens."""
    return {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(documents: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every text with its container and the room that container has left.

    Pieces without tokens (null and empty texts) need no container: theirs is null, as is
    the room. A text of exactly the capacity is one piece. Documents of one length are placed
    by a hash of their id, so repeated rows are packed like any others; which of two rows with
    the same id comes first is left open. An empty table gives no rows; other columns are not read.
    """
    items = staged(pieces(documents, capacity, tokenizer), "packing_pieces")  # texts are read once
    histogram = histogram_of(items)
    empty = histogram.pop(0, 0)
    made = plan(histogram, capacity, buckets)
    shared = documents.sparkSession.sparkContext.broadcast((made.placed, made.runs))  # bounded by the capacity
    largest = max([*histogram.values(), empty, 1])

    def place(batches):
        placed, runs = shared.value
        keys = (placed[:, 0] << 44) + placed[:, 1]
        for batch in batches:
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            n, rank = column["n_tokens"].astype(np.int64), column["rank"].astype(np.int64)
            none = n == 0
            container = np.zeros(len(n), np.int64)
            room = np.zeros(len(n), np.int64)
            if len(keys):
                at = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
                container = placed[at, 3] + (rank - placed[at, 1]) // placed[at, 2]
                room = runs[np.searchsorted(runs[:, 0], container, side="right") - 1, 2]
            arrays = [batch.column(batch.schema.names.index(f.name)).cast(f.type) for f in list(_PLACED)[:5]]
            arrays += [pa.array(container, mask=none), pa.array(room, mask=none)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PLACED)

    rows = ranked(items, -(-largest // RANK_BLOCK))
    return rows.select("doc_id", "piece", "start_token", "end_token", "n_tokens", "rank").mapInArrow(place, PLACED_DDL)
