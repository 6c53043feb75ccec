"""Signals observed in a state: differences, tallies, summaries, settling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..functions.redaction import redact
from ..functions.safety import ACTIONABLE_ROLES, MEDIA_ROLES
from ..functions.similarity import added
from ..session import staged
from .history import BLOCK_US, micros, with_next

#: Headers whose presence is reported; quiet and longest wait in seconds.
SECURITY_HEADERS = ("content-security-policy", "strict-transport-security", "x-frame-options")
QUIET_S = 0.4
TIMEOUT_S = 10.0


def diff(before: Column, after: Column) -> Column:
    """What one action changed, from two signal structs."""
    return F.struct(
        (after["ax_node_count"] - before["ax_node_count"]).alias("ax_node_delta"),
        added(before["console_messages"], after["console_messages"]).alias("console_added"),
        added(before["storage_keys"], after["storage_keys"]).alias("storage_added"),
        added(after["storage_keys"], before["storage_keys"]).alias("storage_removed"),
        added(before["network_requests"], after["network_requests"]).alias("network_added"),
        (~before["screenshot_hash"].eqNullSafe(after["screenshot_hash"])).alias("screenshot_changed"),
    )


def describe(changed: Column) -> Column:
    """A difference as short lines; only what changed is named."""
    listed = lambda name, label: F.when(F.size(changed[name]) > 0, F.concat(F.lit(f"{label}: "), F.array_join(changed[name], ", ")))
    delta = changed["ax_node_delta"]
    lines = F.array(
        F.when(delta != 0, F.concat(F.lit("accessibility nodes: "), F.when(delta > 0, "+").otherwise(""), delta.cast("string"))),
        listed("console_added", "console added"),
        listed("storage_added", "storage added"),
        listed("storage_removed", "storage removed"),
        listed("network_added", "network added"),
        F.when(changed["screenshot_changed"], F.lit("screenshot changed")),
    )
    kept = F.filter(lines, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("nothing observed")))


def counts(signals: Column) -> Column:
    """The sizes of a state's signals; the values stay local."""
    return F.struct(
        signals["ax_node_count"].alias("ax_node_count"),
        F.size(signals["console_messages"]).alias("console_count"),
        F.size(signals["storage_keys"]).alias("storage_count"),
        F.size(signals["network_requests"]).alias("network_count"),
    )


def tally(items: DataFrame, by: list[str], item: str = "item", pos: str = "pos") -> DataFrame:
    """(by..., text, count, first_pos): redacted first, then counted, in order of first sight by ``first_pos``."""
    return items.groupBy(*by, redact(F.col(item)).alias("text")).agg(F.count(F.lit(1)).alias("count"), F.min(pos).alias("first_pos"))


def network_tally(urls: DataFrame, by: list[str]) -> DataFrame:
    """(by..., category, total, rows): requests by kind in display order, rows tallied."""
    each = urls.withColumn("category", web.request_category(F.col("item")))
    rows = tally(each, [*by, "category"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", "text", "count"))), lambda r: F.struct(r["text"].alias("text"), r["count"].alias("count")))
    out = rows.groupBy(*by, "category").agg(F.sum("count").alias("total"), listed.alias("rows"))
    return out.withColumn("rank", web.category_rank(F.col("category")))


def header_signal(headers: DataFrame) -> DataFrame:
    """(run_id, distinct_headers, has_...): header names of a run, whatever their case."""
    name = F.lower("name")
    has = [F.bool_or(name == h).alias("has_" + h.replace("-", "_")) for h in SECURITY_HEADERS]
    return headers.groupBy("run_id").agg(F.count_distinct(name).alias("distinct_headers"), *has)


def console_signal(events: DataFrame) -> DataFrame:
    """(run_id, messages, errors, page_errors) of console events (kind, type)."""
    return events.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "console").alias("messages"),
        F.count_if((F.col("kind") == "console") & (F.col("type") == "error")).alias("errors"),
        F.count_if(F.col("kind") == "pageerror").alias("page_errors"),
    )


def storage_signal(states: DataFrame) -> DataFrame:
    """(run_id, cookies, origins, entries, names): sizes, and redacted name=value pairs.

    ``states``: run_id, cookies array<struct<name,value>>, origins array<struct<origin,
    localStorage array<struct<name,value>>>>.
    """
    stored = F.flatten(F.transform("origins", lambda o: o["localStorage"]))
    pair = lambda x: redact(F.concat(x["name"], F.lit("="), x["value"]))
    return states.select(
        "run_id",
        F.size("cookies").alias("cookies"),
        F.size("origins").alias("origins"),
        F.size(stored).alias("entries"),
        F.concat(F.transform("cookies", pair), F.transform(stored, pair)).alias("names"),
    )


def media_descendants(nodes: DataFrame) -> DataFrame:
    """(state_id, node_id) of nodes below a media element.

    ``nodes``: state_id, node_id, parent_id, role. One join per level of depth below
    media; a cycle adds nothing new and ends the walk.
    """
    found = staged(nodes.filter(F.lower("role").isin(*MEDIA_ROLES)).select("state_id", "node_id").distinct(), "media")
    every, layer = found.limit(0), found
    while True:
        below = nodes.join(layer.select("state_id", F.col("node_id").alias("parent_id")), ["state_id", "parent_id"]).select("state_id", "node_id").distinct()
        layer = staged(below.join(every, ["state_id", "node_id"], "left_anti"), "media")
        if not layer.limit(1).count():
            return every
        every = staged(every.unionByName(layer), "media")


def find_actions(nodes: DataFrame) -> DataFrame:
    """What a user can act on: actionable, not ignored, not inside native media controls; in order by ``pos``."""
    open_nodes = nodes.filter(F.col("role").isin(*ACTIONABLE_ROLES) & ~F.coalesce("ignored", F.lit(False)))
    kept = open_nodes.join(media_descendants(nodes), ["state_id", "node_id"], "left_anti")
    return kept.select("state_id", "pos", "role", F.coalesce("name", F.lit("")).alias("name"), "backend_id")


def enrich(nodes: DataFrame, hrefs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Nodes with where their link leads and their input type, by backend id."""
    where = hrefs.select("state_id", "backend_id", web.destination_path(F.col("href"), F.col("base")).alias("destination"))
    return nodes.join(where, ["state_id", "backend_id"], "left").join(inputs, ["state_id", "backend_id"], "left")


def settled(events: DataFrame, quiet_s: float = QUIET_S, timeout_s: float = TIMEOUT_S) -> DataFrame:
    """(page_id, settled, elapsed_s, mutations): when a page went quiet after its first event.

    ``events``: page_id, ts of any activity. Quiet means no activity for the window; a
    page that never gets there within the timeout is unsettled.
    """
    us = micros(F.col("ts"))
    times = events.select("page_id", us.alias("t"))
    gaps = with_next(times, "page_id", "t", ["t"], F.floor(F.col("t") / F.lit(BLOCK_US)))
    n = F.col("next.t")
    quiet = n.isNull() | (n - F.col("t") >= quiet_s * 1e6)
    at = gaps.groupBy("page_id").agg(F.min(F.when(quiet, F.col("t"))).alias("t"), F.min("t").alias("t0"))
    end = (F.col("t") - F.col("t0")) / 1e6 + F.lit(quiet_s)
    ok = end <= timeout_s
    n = events.join(at, "page_id").filter(us <= F.when(ok, F.col("t")).otherwise(F.col("t0") + timeout_s * 1e6)).groupBy("page_id").agg(F.count(F.lit(1)).alias("mutations"))
    return at.join(n, "page_id").select("page_id", ok.alias("settled"), F.when(ok, end).otherwise(F.lit(timeout_s)).alias("elapsed_s"), "mutations")
