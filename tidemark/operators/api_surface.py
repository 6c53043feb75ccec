"""The API surface of a site, mined from captured traffic and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..functions.endpoints import MAX_ENDPOINTS, script_endpoints, template_path
from .history import instant_us, micros

HAR = (
    "struct<log:struct<entries:array<struct<startedDateTime:string,request:struct<method:string,url:string>,"
    "response:struct<status:int,content:struct<mimeType:string>>>>>>"
)
#: Where API descriptions and GraphQL endpoints are looked for, in this order.
SPEC_PATHS = ("/openapi.json", "/swagger.json", "/api-docs", "/.well-known/openapi.json")
GRAPHQL_PATHS = ("/graphql", "/api/graphql")
MAX_SCRIPTS = 10


def har_entries(hars: DataFrame) -> DataFrame:
    """(capture_id, seq, method, url, status, mime, started_at); any other shape gives no rows."""
    m = hars.select("capture_id", F.from_json("har", HAR).alias("h"))
    e = m.select("capture_id", F.posexplode("h.log.entries").alias("seq", "e")).filter(F.col("e").isNotNull())
    return e.select(
        "capture_id", "seq", F.col("e.request.method").alias("method"), F.col("e.request.url").alias("url"),
        F.col("e.response.status").alias("status"), F.col("e.response.content.mimeType").alias("mime"),
        F.col("e.startedDateTime").alias("started_at"),
    )


def api_requests(entries: DataFrame, origin) -> DataFrame:
    """JSON requests of the own origin with upper-case method and templated path."""
    keep = F.lower("mime").contains("json") & (web.authority(F.col("url")) == origin) & F.col("method").isNotNull()
    return entries.filter(keep).withColumn("method", F.upper("method")).withColumn("path", template_path(web.path(F.col("url"))))


def clusters(requests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., method, path, statuses, requests): endpoints with the status codes seen, nulls left out."""
    return requests.groupBy(*by, "method", "path").agg(
        F.array_sort(F.collect_set("status")).alias("statuses"), F.count(F.lit(1)).alias("requests")
    )


def openapi(endpoints: DataFrame, origin: str) -> DataFrame:
    """One OpenAPI document of all endpoints, as JSON: path, then method, then responses."""
    codes = F.when(F.size("statuses") > 0, F.transform("statuses", lambda s: s.cast("string"))).otherwise(F.array(F.lit("default")))
    entry = lambda key, body: F.concat(_quoted(key), F.lit(":"), body)
    listed = lambda parts: F.concat(F.lit("{"), F.array_join(F.array_sort(parts), ","), F.lit("}"))
    responses = listed(F.transform(codes, lambda c: entry(c, F.lit('{"description":""}'))))
    ops = endpoints.select("path", entry(F.lower("method"), F.concat(F.lit('{"responses":'), responses, F.lit("}"))).alias("op"))
    paths = ops.groupBy("path").agg(listed(F.collect_list("op")).alias("ops"))
    head = '{"openapi":"3.0.0","info":{"title":"Synthesized from observed traffic","version":"0.0.0"},"servers":[{"url":'
    return paths.agg(
        F.concat(F.lit(head), _quoted(F.lit(origin)), F.lit('}],"paths":'), listed(F.collect_list(entry(F.col("path"), F.col("ops")))), F.lit("}")).alias("document")
    )


def _quoted(text):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_seq: str, columns: list[str], block_us: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it; rows without one are dropped.

    Both sides meet in one sorted pass per key (a union and a running last value), no
    range join. With ``block_us`` a hot key is split into time blocks: a first pass
    carries each block's last right row to the blocks after it.
    """
    pick = F.struct(*(F.col(c).alias(c) for c in columns))
    keys = [*by, "_block"] if block_us else by
    block = lambda ts: F.floor(micros(F.col(ts)) / F.lit(block_us)).alias("_block")
    extra = (lambda ts: [block(ts)]) if block_us else (lambda ts: [])
    r = right.select(*by, *extra(right_ts), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(right_seq).cast("bigint").alias("_seq"), pick.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("_l"))
    rows_l = left.select(*by, *extra(left_ts), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_seq"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = rows_l.unionByName(r)
    order = Window.partitionBy(*keys).orderBy("_ts", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).filter("_side = 1")
    if block_us:
        ends = r.groupBy(*keys).agg(F.max_by("_r", F.struct("_ts", "_seq")).alias("_e"))
        marks = both.select(*keys).distinct().join(ends, keys, "left")
        before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = marks.select(*keys, F.last("_e", ignorenulls=True).over(before).alias("_c"))
        near = near.join(carried, keys).withColumn("_last", F.coalesce("_last", "_c"))
    return near.filter(F.col("_last").isNotNull()).select("_l.*", *(F.col("_last")[c].alias(c) for c in columns))


def correlate(checkpoints: DataFrame, requests: DataFrame) -> DataFrame:
    """(capture_id, label, at, endpoints, requests): requests attributed to the action before them.

    ``checkpoints``: capture_id, seq, label, at (timestamp); ``requests``: capture_id,
    method, path, started_at (ISO text). Requests before every checkpoint, or without a
    readable time, belong to none; actions without requests are left out.
    """
    timed = requests.withColumn("_us", instant_us(F.col("started_at"))).filter("_us is not null")
    timed = timed.select("capture_id", "method", "path", F.timestamp_micros("_us").alias("_at"))
    marks = checkpoints.select("capture_id", F.col("at"), "label", F.col("seq").alias("cseq"))
    hit = as_of(timed, marks, ["capture_id"], "_at", "at", "cseq", ["label", "at", "cseq"])
    return hit.groupBy("capture_id", "cseq", "label", "at").agg(
        F.array_sort(F.collect_set(F.concat_ws(" ", "method", "path"))).alias("endpoints"), F.count(F.lit(1)).alias("requests")
    )


def correlation_document(actions: DataFrame, note: str) -> DataFrame:
    """(capture_id, document): the correlation of each capture as JSON, actions in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("cseq", "label", "endpoints"))), lambda a: F.struct(a["label"].alias("label"), a["endpoints"].alias("endpoints")))
    doc = F.struct(F.lit(note).alias("note"), listed.alias("actions"))
    return actions.groupBy("capture_id").agg(F.to_json(doc).alias("document"))


def bundle_endpoints(scripts: DataFrame) -> DataFrame:
    """(target, endpoints): endpoint candidates of a target's scripts, sorted, at most 200.

    ``scripts``: target, pos, body. The first ten scripts count.
    """
    order = Window.partitionBy("target").orderBy("pos")
    head = scripts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_SCRIPTS)
    found = head.select("target", F.explode(script_endpoints(F.col("body"))).alias("endpoint"))
    return found.groupBy("target").agg(F.slice(F.array_sort(F.collect_set("endpoint")), 1, MAX_ENDPOINTS).alias("endpoints"))


def specs(responses: DataFrame) -> DataFrame:
    """(target, kind, version, url): the first valid API description by candidate rank.

    ``responses``: target, rank, url, status, body.
    """
    version = lambda key: F.nullif(F.get_json_object("body", f"$.{key}"), F.lit(""))
    kind = F.when(version("openapi").isNotNull(), F.struct(F.lit("openapi").alias("kind"), version("openapi").alias("version"))).when(
        version("swagger").isNotNull(), F.struct(F.lit("swagger").alias("kind"), version("swagger").alias("version"))
    )
    good = responses.filter("status = 200").withColumn("s", kind).filter("s is not null")
    best = good.groupBy("target").agg(F.min_by(F.struct("s.kind", "s.version", "url"), "rank").alias("b"))
    return best.select("target", "b.*")


def graphql(responses: DataFrame) -> DataFrame:
    """(target, url, types): the first endpoint whose introspection names its types."""
    types = F.json_array_length(F.get_json_object("body", "$.data.__schema.types"))
    good = responses.filter("status = 200").withColumn("types", types).filter("types is not null")
    best = good.groupBy("target").agg(F.min_by(F.struct("url", "types"), "rank").alias("b"))
    return best.select("target", "b.*")


def shareable_surface(spec: DataFrame, gql: DataFrame, synthesized: DataFrame, correlation: DataFrame, bundles: DataFrame) -> DataFrame:
    """(target, surface): what may be shared of a target's API as JSON; found files whole, the rest as counts."""
    named = lambda df, name, *cols: df.select("target", F.struct(*cols).alias(name))
    parts = [
        named(spec, "spec", "kind", "version", "url"),
        named(gql, "graphql", "url", "types"),
        named(synthesized, "synthesized", "endpoint_count", "request_count"),
        named(correlation, "correlation", "action_count", "request_count"),
        named(bundles.filter("endpoint_count > 0"), "bundle_endpoints", "endpoint_count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "target", "full_outer")
    return out.select("target", F.to_json(F.struct("spec", "graphql", "synthesized", "correlation", "bundle_endpoints")).alias("surface"))
