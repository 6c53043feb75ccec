"""The run history: latest map per url, domains, histories, stored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact
from ..functions.web import site_of
from .change import latest, upsert
from .history import instant_us

RUNS_DDL = (
    "id bigint, site_id bigint, url string, captured_at string, tier int, records_json string, "
    "api_surface_json string, exploration_json string, config_json string"
)
SITES_DDL = "id bigint, domain string"
SESSIONS_DDL = "id bigint, site_id bigint, label string, storage_state_json string, created_at string, last_used_at string"


def latest_runs(runs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The last run of each url, by instant and then id; runs without an instant come first."""
    cols = columns or [c for c in runs.columns if c not in ("url", "id")]
    rows = runs.withColumn("_at", F.coalesce(instant_us(F.col("captured_at")), F.lit(-(2**62)))).select("url", "_at", "id", *cols)
    return latest(rows, ["url"], ["_at", "id"]).drop("_at")


def domains(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Domains with a run, sorted."""
    return sites.join(runs.select(F.col("site_id").alias("id")), "id", "left_semi").select("domain").distinct().orderBy("domain")


def urls(sites: DataFrame, runs: DataFrame, domain: str) -> DataFrame:
    """(url, captured_us): each mapped url of a domain with its last capture."""
    own = sites.filter(F.col("domain") == domain).select(F.col("id").alias("site_id"))
    return runs.join(F.broadcast(own), "site_id").groupBy("url").agg(F.max(instant_us(F.col("captured_at"))).alias("captured_us"))


def map_view(runs: DataFrame, now) -> DataFrame:
    """What is served of each url: redacted, with its age in seconds, without its config."""
    last = latest_runs(runs)
    age = (F.unix_micros(now) - instant_us(F.col("captured_at"))) / 1e6
    return last.select("url", "captured_at", "tier", *(redact(F.col(c)).alias(c) for c in ("records_json", "api_surface_json", "exploration_json")), age.alias("age_seconds"))


def add_sites(sites: DataFrame, names: DataFrame) -> DataFrame:
    """Sites with those of ``names`` (url_or_domain) that are new, ids following on."""
    fresh = names.select(site_of(F.col("url_or_domain")).alias("domain")).distinct().join(sites, "domain", "left_anti")
    top = sites.agg(F.max("id")).first()[0] or 0
    numbered = fresh.select((F.lit(top + 1) + F.monotonically_increasing_id()).alias("id"), "domain")
    return sites.unionByName(numbered)


def append_run(runs: DataFrame, path: str) -> None:
    """History is only added to; the latest row is what is served."""
    runs.write.mode("append").parquet(path)


def put_session(sessions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored logins with new ones in place of the same site and label; a new one is unused."""
    return upsert(sessions, fresh.withColumn("last_used_at", F.lit(None).cast("string")).select(*sessions.columns), ["site_id", "label"])


def drop_session(sessions: DataFrame, gone: DataFrame) -> DataFrame:
    return sessions.join(gone.select("site_id", "label"), ["site_id", "label"], "left_anti")


def list_sessions(sessions: DataFrame, sites: DataFrame, domain: str | None = None) -> DataFrame:
    """Labels and times of stored logins, never their content."""
    rows = sessions.join(F.broadcast(sites.withColumnRenamed("id", "site_id")), "site_id")
    rows = rows.filter(F.col("domain") == domain) if domain else rows
    return rows.select("domain", "label", "created_at", "last_used_at").orderBy("domain", "label")


def session_cookies(states: DataFrame) -> DataFrame:
    """(id, name, value, domain, path) of stored cookies; malformed ones are skipped."""
    schema = "struct<cookies:array<struct<name:string,value:string,domain:string,path:string>>>"
    each = states.select("id", F.explode(F.from_json("storage_state_json", schema)["cookies"]).alias("c"))
    ok = each.filter("c.name is not null and c.value is not null")
    return ok.select("id", "c.name", "c.value", F.coalesce("c.domain", F.lit("")).alias("domain"), F.coalesce("c.path", F.lit("/")).alias("path"))
