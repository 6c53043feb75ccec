"""Whole runs: a job over captured pages, tier by tier, into the store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..operators import change, extract, frontier, healing
from ..operators.jobs import Job
from ..session import staged

Hook = Callable[[DataFrame], DataFrame]


@dataclass
class Tier:
    """One way to get pages: a plain capture or a rendered one."""

    name: str
    pages: DataFrame
    renders: bool = False

    def accepts(self, job: Job) -> bool:
        return self.renders or not job.get("pagination", "infinite_scroll", False)


@dataclass
class Result:
    tier: str
    records: DataFrame
    outcomes: dict[str, DataFrame]
    healed: DataFrame | None = None
    validators: DataFrame | None = None
    attempts: list[str] = field(default_factory=list)


def run_tier(tier: Tier, job: Job, on_response: Hook | None = None, validators: DataFrame | None = None, fingerprints: DataFrame | None = None, **crawl) -> Result:
    """Crawl one tier's pages, skip what is unchanged, rewrite by hook, extract, heal.

    Validators are kept from what the server sent; the hook works on what is extracted.
    """
    out = frontier.crawl(tier.pages, job, **crawl)
    got = staged(out["visited"].join(tier.pages.hint("merge"), "url"), "visited_pages")
    unchanged = got.select("url").limit(0)
    fresh, kept = got, validators
    if validators is not None and job.options.get("change_detection"):
        asked = got.withColumnRenamed("html", "body")
        for c in ("etag", "last_modified"):
            if c not in asked.columns:
                asked = asked.withColumn(c, F.lit(None).cast("string"))
        seen = change.detect(asked, validators)
        unchanged = seen.filter("unchanged").select("url")
        fresh = seen.filter("not unchanged").withColumnRenamed("body", "html")
        kept = change.record(asked, validators)
    pages = on_response(fresh) if on_response else fresh
    healed = None
    if fingerprints is not None:
        parts = pages.select(web.authority(F.col("url")).alias("domain"), F.xxhash64("url").alias("seq"), "html")
        healed = staged(healing.heal_extract(parts, job, fingerprints), "healed")
    if healed is not None and job.fields:
        records = healing.records(healed, pages.select("url", F.xxhash64("url").alias("seq")), job)
    else:
        records = extract.extract(pages, job)
    challenge = frontier.challenge_of_run(pages.select(F.lit(0).alias("run_id"), "seq", "html"))
    outcomes = {"visited": got, "unchanged": unchanged, "challenge": challenge, **{k: out[k] for k in ("blocked", "dead", "rest", "seen")}}
    return Result(tier.name, records, outcomes, healed, kept)


def run_job(job: Job, tiers: list[Tier], **options) -> Result:
    """Tiers in order until one comes back with something; nulls in records are something."""
    attempts, result = [], None
    for tier in tiers:
        if not tier.accepts(job):
            continue
        attempts.append(tier.name)
        result = run_tier(tier, job, **options)
        result.attempts = list(attempts)
        parts = [result.records, *(result.outcomes[k] for k in ("blocked", "dead", "unchanged"))]
        if any(p.limit(1).count() for p in parts):
            return result
    if result is None:
        raise ValueError("no tier can run this job")
    return result
