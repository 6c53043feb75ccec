"""Tables that capture adapters leave behind, and small driver-side inputs.

Live fetching, browsers and servers stay outside; they append to these tables, and the
engine starts here. Every reader has an explicit schema and tolerates bad rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.healing import PRINT_DDL

#: Contracts of the adapter tables.
CONTRACTS = {
    "pages": "url string, status int, etag string, last_modified string, fetched_at timestamp, html string",
    "responses": "url string, attempt int, status int, retry_after string, fetched_at timestamp, body string",
    "robots": "scheme string, authority string, status int, body string",
    "hars": "capture_id bigint, har string",
    "checkpoints": "capture_id bigint, seq int, label string, at timestamp",
    "ax_nodes": "state_id string, node_id string, parent_id string, backend_id int, role string, name string, ignored boolean, pos int",
    "console_events": "run_id bigint, seq int, kind string, type string, text string",
    "response_headers": "run_id bigint, page_seq int, name string, value string",
    "storage_states": "run_id bigint, cookies array<struct<name:string,value:string>>, origins array<struct<origin:string,localStorage:array<struct<name:string,value:string>>>>",
    "screenshots": "state_id string, seq int, content binary",
    "fingerprints": f"domain string, key string, run_seq int, print {PRINT_DDL}",
    "validators": "url string, etag string, last_modified string, content_hash string",
    "frontier": "target string, url string, depth int, seq bigint, is_seen boolean",
    "element_hashes": "page string, idx int, hash bigint",
}


def bronze(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An adapter table under its contract; a table not written yet is empty."""
    path = f"{folder}/{name}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CONTRACTS[name])
    return spark.read.schema(CONTRACTS[name]).parquet(path)


def har_files(spark: SparkSession, path: str) -> DataFrame:
    """HAR files as (capture_id, har), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("capture_id"), F.col("value").alias("har"))


def frontier_entries(states: DataFrame) -> DataFrame:
    """(target, url, depth, seq, is_seen) of saved crawl states; an entry with any bad part is dropped whole.

    ``states``: target, state (JSON of seen and frontier).
    """
    schema = "struct<seen:array<string>,frontier:array<struct<url:string,depth:int>>>"
    s = states.select("target", F.from_json("state", schema).alias("s"))
    bad = F.col("s.seen").isNull() | F.col("s.frontier").isNull() | F.exists("s.seen", lambda x: x.isNull()) | F.exists("s.frontier", lambda x: x.isNull() | x["url"].isNull() | x["depth"].isNull())
    good = s.filter(~F.coalesce(bad, F.lit(True)))
    queue = good.select("target", F.posexplode("s.frontier").alias("seq", "f")).select("target", "f.url", "f.depth", F.col("seq").cast("bigint").alias("seq"), F.lit(False).alias("is_seen"))
    seen = good.select("target", F.posexplode("s.seen").alias("seq", "url")).select("target", "url", F.lit(None).cast("int").alias("depth"), F.col("seq").cast("bigint").alias("seq"), F.lit(True).alias("is_seen"))
    return queue.unionByName(seen)


def fingerprints_from_json(rows: DataFrame) -> DataFrame:
    """(domain, key, print) of fingerprints kept as JSON; unreadable ones are skipped, later fields may be absent."""
    p = F.from_json("print", PRINT_DDL)
    parsed = rows.select("domain", "key", p.alias("p")).filter(F.col("p.tag").isNotNull())
    empty = {"element_id": F.lit(""), "text": F.lit(""), "sibling_index": F.lit(0), "classes": F.array().cast("array<string>"), "ancestors": F.array().cast("array<string>"),
             "attrs": F.create_map().cast("map<string,string>"), "descendants": F.create_map().cast("map<string,int>")}
    names = ("tag", "element_id", "classes", "attrs", "text", "ancestors", "sibling_index", "descendants", "visual_hash")
    fields = [F.coalesce(F.col("p")[n], empty[n]).alias(n) if n in empty else F.col("p")[n].alias(n) for n in names]
    return parsed.select("domain", "key", F.struct(*fields).alias("print"))


def patterns(items: list[str]) -> list[str]:
    """Glob patterns given as such or as ``@file`` with one per line; blank lines and comments are skipped."""
    out = []
    for item in items:
        if item.startswith("@"):
            lines = Path(item[1:]).read_text(encoding="utf-8").splitlines()
            out += [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
        else:
            out.append(item)
    return out


def scaffold(spark: SparkSession, text: str) -> DataFrame:
    """(state_id, name, kind, value, is_text, generate) of a scaffold file's fields; anything else is none."""
    import yaml

    data = yaml.safe_load(text)
    fields = data.get("fields") if isinstance(data, dict) else None
    rows = []
    for f in fields if isinstance(fields, list) else []:
        if isinstance(f, dict) and isinstance(f.get("state"), str) and isinstance(f.get("name"), str):
            v, kind = f.get("value"), f.get("kind")
            rows.append((f["state"], f["name"], kind if isinstance(kind, str) else None, None if v is None else str(v), isinstance(v, str), f.get("generate") is True))
    return spark.createDataFrame(rows, "state_id string, name string, kind string, value string, is_text boolean, generate boolean")
