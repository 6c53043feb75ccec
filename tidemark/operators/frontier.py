"""Crawl frontiers: level-synchronous breadth-first walks over page tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.policy import detect_challenge
from ..session import staged
from .extract import discover_links
from .graph import dense_rank
from .history import running
from .jobs import Job

#: Pages per run, sitemaps and their URLs per target.
PAGE_BUDGET = 1000
MAX_SITEMAPS = 50
MAX_SITEMAP_URLS = 50_000
#: Numbers of a queue that one task puts in order for a domain.
DISPATCH_BLOCK = 1 << 16


def first_seen(frontier: DataFrame) -> DataFrame:
    """One row per url, the one queued first."""
    rest = [c for c in frontier.columns if c not in ("url", "seq")]
    best = F.min(F.struct("seq", *rest)).alias("b")
    return frontier.groupBy("url").agg(best).select("url", "b.*").select(*frontier.columns)


def crawl(pages: DataFrame, job: Job, seeds: DataFrame | None = None, seen: DataFrame | None = None, allowed=None, budget: int | None = PAGE_BUDGET) -> dict[str, DataFrame]:
    """Walk a table of pages from a job's target.

    ``pages``: url, status, html. Returns ``visited`` (url, depth, level), ``blocked``,
    ``dead`` and ``rest`` (what the budget left in the queue). A level takes the queue,
    drops what was seen, looks its pages up, and queues their links: pagination at the
    same depth, links one deeper. ``allowed``: a function of a url column for robots
    rules; ``budget`` None for no bound. ``seeds`` (url, and depth where a queue is resumed) and ``seen`` carry earlier
    runs on; the budget is this run's own.
    """
    spark = pages.sparkSession
    # staged urls and texts are a few bytes a row in their files: judged by these they would be broadcast by the million
    pages, by_key = pages.hint("merge"), lambda df: df.select("url").hint("merge")
    start = spark.createDataFrame([(job.target, 0, 0)], "url string, depth int, seq bigint")
    queue = start
    if seeds is not None:
        depth = F.col("depth") if "depth" in seeds.columns else F.lit(0)
        queue = staged(start.unionByName(seeds.select("url", depth.cast("int").alias("depth"), (F.monotonically_increasing_id() + 1).alias("seq"))), "queue")
    done = staged((seen.select("url") if seen is not None else spark.createDataFrame([], "url string")), "seen")
    visited, blocked, dead, level, left = [], [], [], 0, budget
    while left is None or left > 0:
        fresh = first_seen(queue).join(by_key(done), "url", "left_anti")
        taken = staged(fresh if left is None else fresh.orderBy("seq", "url").limit(left), "frontier")
        n = taken.count()
        if n == 0:
            break
        left = None if left is None else left - n
        ok = taken.filter(allowed(F.col("url"))) if allowed else taken
        if allowed:
            blocked.append(taken.filter(~allowed(F.col("url"))).select("url", "depth"))
        found = ok.join(pages, "url", "left").withColumn("status", F.coalesce("status", F.lit(404)))
        dead.append(found.filter(F.col("status") >= 400).select("url", "depth", "status"))
        good = found.filter((F.col("status") < 400) & F.col("html").isNotNull())
        visited.append(good.select("url", "depth", F.lit(level).alias("level"), "seq"))
        links = discover_links(good.select("url", "depth", "html"), job)
        order = links.join(good.select("url", F.col("seq").alias("_s")), "url")
        after = first_seen(queue).join(by_key(taken), "url", "left_anti").join(by_key(done), "url", "left_anti")
        ranked = dense_rank(order.select(F.col("link").alias("url"), "depth", F.struct("_s", "pos").alias("_k")), "_k", "seq")
        ranked = ranked.withColumn("seq", F.col("seq") + F.lit((level + 1) << 40))
        queue = staged(after.select("url", "depth", "seq").unionByName(ranked.select("url", "depth", "seq")), "queue")
        done = done.unionByName(taken.select("url"))  # levels are staged once and only added
        level += 1
    union = lambda parts, empty: _union(parts) if parts else spark.createDataFrame([], empty)
    return {
        "visited": union(visited, "url string, depth int, level int, seq bigint"),
        "blocked": union(blocked, "url string, depth int"),
        "dead": union(dead, "url string, depth int, status int"),
        "rest": first_seen(queue).join(by_key(done), "url", "left_anti").select("url", "depth"),
        "seen": done,
    }


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def challenge_of_run(pages: DataFrame) -> DataFrame:
    """The challenge on the first page of a run that shows one. ``pages``: run_id, seq, html."""
    hit = pages.withColumn("c", detect_challenge(F.col("html"))).filter("c is not null")
    return hit.groupBy("run_id").agg(F.min_by("c", "seq").alias("c")).select("run_id", "c.vendor", "c.marker")


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(url, loc, is_index): locations listed by sitemaps; bad XML lists none. ``bodies``: url, body."""
    schema = "url array<struct<loc string>>, sitemap array<struct<loc string>>"
    x = bodies.select("url", F.from_xml("body", F.lit(schema)).alias("x"))
    pages = x.select("url", F.explode("x.url.loc").alias("loc"), F.lit(False).alias("is_index"))
    index = x.select("url", F.explode("x.sitemap.loc").alias("loc"), F.lit(True).alias("is_index"))
    return pages.unionByName(index).withColumn("loc", F.trim("loc")).filter(F.col("loc") != "")


def sitemap_urls(bodies: DataFrame, start: str, max_urls: int | None = MAX_SITEMAP_URLS) -> DataFrame:
    """Page locations reachable from a sitemap through its indexes, cycles cut, within the limits.

    Beyond ``max_urls`` the first by url are kept; None keeps all.
    """
    spark = bodies.sparkSession
    entries = staged(sitemap_entries(bodies), "sitemaps")
    queue = spark.createDataFrame([(start,)], "url string")
    done, fetched = queue.limit(0), 0
    while fetched < MAX_SITEMAPS:
        take = staged(queue.distinct().join(done, "url", "left_anti").orderBy("url").limit(MAX_SITEMAPS - fetched), "sitemaps")
        n = take.count()
        if n == 0:
            break
        fetched += n
        done = done.unionByName(take)
        queue = entries.filter("is_index").join(take, "url").select(F.col("loc").alias("url"))
    urls = entries.filter("not is_index").join(done, "url").select(F.col("loc").alias("url")).distinct()
    return urls if max_urls is None else urls.orderBy("url").limit(max_urls)


@F.pandas_udf(T.StructType([T.StructField("allowed", T.BooleanType()), T.StructField("delay", T.DoubleType())]))
def robots_verdict(body: pd.Series, status: pd.Series, url: pd.Series, agent: pd.Series) -> pd.DataFrame:
    """What robots.txt says of a url: rules of a 200, nothing allowed on a server error, else all."""
    from urllib.robotparser import RobotFileParser

    cache: dict = {}
    out = []
    for b, s, u, a in zip(body, status, url, agent):
        if s is not None and s == s and s >= 500:
            out.append((False, None))
        elif s != 200 or b is None:
            out.append((True, None))
        else:
            if b not in cache:
                cache[b] = RobotFileParser()
                cache[b].parse(b.splitlines())
            delay = cache[b].crawl_delay(a)
            out.append((cache[b].can_fetch(a, u), None if delay is None else float(delay)))
    return pd.DataFrame(out, columns=["allowed", "delay"]).astype({"allowed": bool, "delay": float})


def dispatch_times(queue: DataFrame, delay: str = "delay", block: int = DISPATCH_BLOCK) -> DataFrame:
    """When each page of a domain may start: the first at once, the rest a delay apart, in order.

    ``seq`` numbers a queue; a domain's rows are placed by ``block`` of it, so that no domain is one task.
    """
    placed = running(queue, "domain", ["seq"], {"_n": F.lit(1)}, F.floor(F.col("seq") / F.lit(block)))
    return placed.withColumn("start_s", (F.col("_n") - 1) * F.col(delay)).drop("_n")
