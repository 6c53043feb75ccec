"""Commands over captured pages and a stored run history: ``python -m tidemark``.

A store is a folder with the parquet tables ``sites``, ``runs`` and ``sessions``.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.web import site_of
from .operators import jobs, store
from .plans import pipeline
from .session import build_session, release_staged, staged
from .sources import sinks

TABLES = {"sites": store.SITES_DDL, "runs": store.RUNS_DDL, "sessions": store.SESSIONS_DDL}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a store; empty where the store has none yet."""
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], TABLES[name])
        raise


def _replace(df: DataFrame, folder: str, name: str) -> None:
    staged(df, name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """A job over tables of captured pages (url, status, html), tier by tier, into a file."""
    job = jobs.load(Path(args.job).read_text(encoding="utf-8"))
    tiers = [pipeline.Tier("plain", spark.read.parquet(args.pages))]
    if args.rendered:
        tiers.append(pipeline.Tier("browser", spark.read.parquet(args.rendered), renders=True))
    result = pipeline.run_job(job, tiers, budget=args.budget)
    kinds = {"number": T.DoubleType()}
    schema = T.StructType([T.StructField(n, kinds.get(f.type, T.StringType())) for n, f in job.fields.items()])
    kind = sinks.write_records(result.records.select(*(f"`{n}`" for n in job.fields)), schema, args.out, args.format, merged=args.merged)
    counts = {k: df.count() for k, df in result.outcomes.items() if k in ("visited", "blocked", "dead")}
    print(f"{result.tier}: {counts} as {kind}")


def domains(spark: SparkSession, args: argparse.Namespace) -> None:
    """Domains with a stored run."""
    _show(store.domains(_table(spark, args.store, "sites"), _table(spark, args.store, "runs")))


def view(spark: SparkSession, args: argparse.Namespace) -> None:
    """The latest map of a url, redacted, with its age in seconds."""
    runs = _table(spark, args.store, "runs").filter(F.col("url") == args.url)
    _show(store.map_view(runs, F.current_timestamp()))


def session(spark: SparkSession, args: argparse.Namespace) -> None:
    """Add, list or remove stored logins; their content is never shown."""
    sites, sessions = _table(spark, args.store, "sites"), _table(spark, args.store, "sessions")
    if args.action == "list":
        return _show(store.list_sessions(sessions, sites, args.domain))
    if not args.domain or not args.label:
        raise SystemExit("a domain and a label are needed")
    named = spark.createDataFrame([(args.domain,)], "url_or_domain string")
    if args.action == "add":
        more = store.add_sites(sites, named)
        _replace(more, args.store, "sites")
        sites = _table(spark, args.store, "sites")
    site = named.select(site_of(F.col("url_or_domain")).alias("domain")).join(sites, "domain").select(F.col("id").alias("site_id"))
    own = site.withColumn("label", F.lit(args.label))
    if args.action == "remove":
        return _replace(store.drop_session(sessions, own), args.store, "sessions")
    if not args.state:
        raise SystemExit("a file with the stored state is needed")
    top = sessions.agg(F.max("id")).first()[0] or 0
    state = Path(args.state).read_text(encoding="utf-8")
    now = datetime.now(timezone.utc).isoformat()
    fresh = own.select(F.lit(top + 1).cast("bigint").alias("id"), "site_id", "label", F.lit(state).alias("storage_state_json"), F.lit(now).alias("created_at"))
    _replace(store.put_session(sessions, fresh), args.store, "sessions")


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    """A registered query over a folder of tables, into parquet; without a name, the names."""
    from .plans import registry

    found = registry.core_queries()
    if not args.name:
        print("\n".join(sorted(found)))
    elif args.name not in found:
        raise SystemExit(f"no query {args.name!r}")
    else:
        found[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    commands = top.add_subparsers(dest="command", required=True)

    def add(fn, name: str, *arguments) -> None:
        p = commands.add_parser(name, help=fn.__doc__)
        p.set_defaults(fn=fn)
        for flags, options in arguments:
            p.add_argument(*flags, **options)

    kept = (("--store",), {"required": True})
    add(
        run, "run", (("job",), {}), (("--pages",), {"required": True}), (("--rendered",), {}), (("--out",), {"required": True}),
        (("--format",), {"choices": sorted(set(sinks.FORMATS.values()))}), (("--merged",), {"action": "store_true"}), (("--budget",), {"type": int, "default": 1000}),
    )
    add(domains, "domains", kept)
    add(view, "map", (("url",), {}), kept)
    add(session, "session", (("action",), {"choices": ["add", "list", "remove"]}), (("domain",), {"nargs": "?"}), (("--label",), {}), (("--state",), {}), kept)
    add(query, "query", (("name",), {"nargs": "?"}), (("--tables",), {}), (("--out",), {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or build_session("tidemark")
    try:
        args.fn(spark, args)
    finally:
        if own:
            release_staged(spark)
            spark.stop()
