"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is a number of blocks of equal size. Blocks go to sources by highest
quotients, never beyond what a source's documents give at ``max_repeats`` uses; a
source's blocks go to its shards the same way. So every shard has an integer quota.
A shard puts its documents in seeded order, cuts the order into blocks of equal tokens
(a document belongs to the block that holds its middle) and selects as many as its quota
says, starting over at the first where the documents may be used again; it needs no word
from other shards. What is left of a source after its last full block is a short block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .tokens import with_tokens

BLOCK_TOKENS = 1024
#: Documents of a source that one task puts in order.
SHARD_DOCS = 200_000
MAX_SHARDS = 4096


def apportion(votes: list, seats: int, caps: list[int] | None = None) -> list[int]:
    """Sainte-Laguë seats for exact ``votes``, none beyond its cap; ties go to the first.

    A divisor a little too large gives all but a few seats at once (the method is house
    monotone); a heap of quotients gives the rest. Parties at their cap drop out and
    the others share what they left. Seats that nobody can take stay empty.
    """
    exact = [Fraction(v) for v in votes]
    caps = list(caps) if caps is not None else [seats] * len(exact)
    out = [0] * len(exact)
    active = [i for i, v in enumerate(exact) if v > 0 and caps[i] > 0]
    left = seats
    while active and left > 0:
        total = sum(exact[i] for i in active)
        given = {i: 0 for i in active}
        sure = left - Fraction(len(active), 2)
        if sure > 0:
            divisor = total / sure
            given = {i: int(exact[i] / divisor + Fraction(1, 2)) for i in active}
        heap = [(-exact[i] / (2 * given[i] + 1), i) for i in active]
        heapq.heapify(heap)
        for _ in range(left - sum(given.values())):
            _, i = heap[0]
            given[i] += 1
            heapq.heapreplace(heap, (-exact[i] / (2 * given[i] + 1), i))
        full = [i for i in active if given[i] >= caps[i]]
        if not full:
            for i in active:
                out[i] = given[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        active = [i for i in active if i not in full]
    return out


def shard_quotas(sizes: list[int], blocks: int, cap: int, block: int) -> list[int]:
    """Tokens that each shard gives of ``blocks`` blocks of its source, at most ``cap`` times its size.

    Seats go by Sainte-Laguë; where a shard's last block is short, others take what is missing.
    """
    most = [cap * n for n in sizes]
    wanted = min(blocks * block, sum(most))
    caps = [-(-m // block) for m in most]
    seats = blocks
    while True:
        got = [min(q * block, m) for q, m in zip(apportion(sizes, seats, caps), most)]
        missing = wanted - sum(got)
        if missing <= 0:
            return got
        seats += -(-missing // block)


def source_key(name: Column) -> Column:
    """Source names match after trimming blanks, tabs too, and ignoring case."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> list[dict]:
    """One entry per source key; shares of repeated keys add up, the highest cap counts.

    A null share is 0, a null or negative cap 0. There are as many as sources are named.
    """
    rows = (
        targets.filter(F.col("source_name").isNotNull())
        .groupBy(source_key(F.col("source_name")).alias("key"))
        .agg(
            F.min("source_name").alias("source_name"),
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"),
            F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("cap"),
        )
    )
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["key"])


def _sized(documents: DataFrame, tokenizer: str | None) -> DataFrame:
    return with_tokens(documents.select("doc_id", source_key(F.col("source")).alias("key"), "text"), "text", tokenizer).drop("text")


def _shard(shards: dict[str, int]) -> Column:
    spread = F.lit(1)
    for key, n in shards.items():
        if n > 1:
            spread = F.when(F.col("key") == key, F.lit(n)).otherwise(spread)
    return F.pmod(F.xxhash64("doc_id"), spread.cast("bigint")).cast("int")


def plan(documents: DataFrame, targets: DataFrame, mix_tokens: int | None = None, block: int = BLOCK_TOKENS, tokenizer: str | None = None):
    """(quota per source and shard, report per source): what is collected is one row per
    named source, and at most ``MAX_SHARDS`` per source. Texts that are null or empty have
    no tokens; documents without a named source count for the size only. Targets without a
    name are left out. Without documents nothing is short and nothing is drawn.

    The mix is ``mix_tokens`` tokens large, rounded up to blocks, by default as large as all
    documents, those of no source included. ``short``: the apportionment ended at (or within
    rounding of) what the source has, and by the exact count max_repeats times the source's
    tokens is less than its share of the mix.
    """
    wanted = _targets(targets)
    docs = staged(_sized(documents, tokenizer), "mixture_sizes")  # texts are read once
    keys = [t["key"] for t in wanted]
    own = F.when(F.col("key").isin(keys), F.col("key")) if keys else F.lit(None).cast("string")
    totals = {r["key"]: r for r in docs.groupBy(own.alias("key")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    all_tokens = sum(r["tokens"] for r in totals.values())
    size = all_tokens if mix_tokens is None else mix_tokens
    shards = {k: min(MAX_SHARDS, max(1, -(-totals[k]["docs"] // SHARD_DOCS))) for k in keys if k in totals}
    named = docs.filter(F.col("key").isin(keys)) if keys else docs.limit(0)
    parts = named.groupBy("key", _shard(shards).alias("shard")).agg(F.sum("n_tokens").alias("tokens")).collect()
    by_key: dict[str, list] = {k: [] for k in keys}
    for r in sorted(parts, key=lambda r: (r["key"], r["shard"])):
        by_key[r["key"]].append((r["shard"], r["tokens"]))
    tokens = [totals[k]["tokens"] if k in totals else 0 for k in keys]
    caps = [-(-t["cap"] * n // block) for t, n in zip(wanted, tokens)]
    blocks = apportion([t["share"] for t in wanted], -(-size // block), caps)
    quotas, report = [], []
    for t, n, given, cap in zip(wanted, tokens, blocks, caps):
        have = by_key[t["key"]]
        for (shard, held), q in zip(have, shard_quotas([h for _, h in have], given, t["cap"], block)):
            if q:
                quotas.append((t["key"], shard, q // held, q % held))
        # a quota is never further below its exact share than half a block a source
        ended = given >= cap - len(wanted)
        short = ended and t["cap"] * n < Fraction(t["share"]) * size
        docs_of = totals[t["key"]]["docs"] if t["key"] in totals else 0
        report.append((t["key"], t["source_name"], float(t["share"]), int(t["cap"]), docs_of, n, given, min(given * block, t["cap"] * n), short))
    return docs, shards, quotas, report


REPORT_DDL = (
    "key string, source_name string, target_share double, max_repeats int, docs bigint, tokens bigint, "
    "blocks bigint, quota_tokens bigint, short boolean"
)


def source_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """One row per named source: what it has, its quota, and whether it falls short of its share."""
    *_, report = plan(documents, targets, **options)
    return documents.sparkSession.createDataFrame(report, REPORT_DDL)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, **options) -> DataFrame:
    """(doc_id, key, n_tokens, uses): every document that is used, and how often.

    Documents stay whole, so a shard meets its quota to half a document. ``uses``: how many
    of the shard's selected blocks hold the document's middle.
    """
    docs, shards, quotas, _ = plan(documents, targets, **options)
    return _uses(docs, shards, quotas, seed)


def _uses(docs: DataFrame, shards: dict[str, int], quotas: list[tuple], seed: int) -> DataFrame:
    quota = docs.sparkSession.createDataFrame(quotas, "key string, shard int, passes bigint, rest bigint")
    rows = docs.filter(F.col("n_tokens") > 0).withColumn("shard", _shard(shards)).join(F.broadcast(quota), ["key", "shard"])
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("n_tokens").over(order) - F.col("n_tokens") / 2
    uses = F.col("passes") + (middle < F.col("rest")).cast("bigint")
    return rows.withColumn("uses", uses).filter("uses > 0").select("doc_id", "key", "n_tokens", "uses")


def reached(documents: DataFrame, targets: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The report with the tokens and shares that :func:`mix` reaches."""
    docs, shards, quotas, report = plan(documents, targets, **options)
    got = _uses(docs, shards, quotas, seed).groupBy("key").agg(
        F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("mix_tokens")
    )
    sources = documents.sparkSession.createDataFrame(report, REPORT_DDL)
    rows = sources.join(got, "key", "left").fillna(0, ["uses", "most_uses", "mix_tokens"])
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))  # one row per named source
    share = F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(F.lit(0.0))
    return rows.withColumn("reached_share", share).drop("key")
