"""Queries on what live adapters leave behind: traffic, DOM and accessibility trees, stored state.

The adapter tables are made from the event, document and site tables, as JSON where adapters
write JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.similarity import signed_hash
from ..functions.text import action_label, ax_string, mermaid_text
from ..operators import api_surface, change, extract, graph, healing, jobs, observed, signals, stats, store
from ..session import staging_path
from ..sources import bronze, sinks
from ..sources.tables import table
from . import pipeline
from .map_queries import _EDGES, _MAPS, _order_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def _pick(i, *choices):
    """A column of ``choices`` by the remainder of ``i``."""
    return F.element_at(F.array(*(c if hasattr(c, "cast") else F.lit(c) for c in choices)), (i % len(choices) + 1).cast("int"))


def _listed(e, by, *fields):
    """Per key an array of structs in order of event_id."""
    rows = e.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("event_id", *fields))).alias("l"))
    return rows


# Traffic ------------------------------------------------------------------------


@query(
    "SELECT user_id AS capture_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS seq, CASE WHEN event_type = 'purchase' THEN 'post' ELSE 'GET' END AS method, "
    "'https://shop.example/api/' || event_type AS url, CAST(200 + event_id % 3 AS INTEGER) AS status, CASE WHEN event_id % 4 <> 0 THEN 'application/json' END AS mime FROM events WHERE user_id % 5 <> 0"
)
def har_requests(spark, d):
    """Requests out of HAR documents, one document per capture; broken ones give none."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    request = F.struct(F.when(F.col("event_type") == "purchase", "post").otherwise("GET").alias("method"), F.concat(F.lit("https://shop.example/api/"), "event_type").alias("url"))
    content = F.struct(F.when(F.col("event_id") % 4 != 0, "application/json").alias("mimeType"))
    response = F.struct((F.lit(200) + F.col("event_id") % 3).cast("int").alias("status"), content.alias("content"))
    rows = _listed(e, "user_id", request.alias("request"), response.alias("response"))
    har = F.to_json(F.struct(F.struct(F.transform("l", lambda x: F.struct(x["request"].alias("request"), x["response"].alias("response"))).alias("entries")).alias("log")))
    hars = rows.select(F.col("user_id").alias("capture_id"), F.when(F.col("user_id") % 5 == 0, F.lit('{"log": [')).otherwise(har).alias("har"))
    return api_surface.har_entries(hars).drop("started_at")


_BODIES = ("no json", '{"openapi":""}', '{"swagger":"2.0"}', '{"openapi":"3.0.1"}', '{"info":{}}', '{"data":{"__schema":{"types":[{"name":"A"},{"name":"B"}]}}}', '{"data":{"__schema":{}}}')
_RESPONSES = (
    "(SELECT user_id % 60 AS target, event_id AS rank, '/spec/' || event_id AS url, CASE WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS status, ["
    + ", ".join(f"'{b}'" for b in _BODIES)
    + "][event_id % 7 + 1] AS body FROM events)"
)


def _responses(spark, d):
    e, i = table(spark, d, "events", "event_id", "user_id"), F.col("event_id")
    return e.select(
        (F.col("user_id") % 60).alias("target"), i.alias("rank"), F.concat(F.lit("/spec/"), i).alias("url"), F.when(i % 5 == 0, 404).otherwise(200).alias("status"), _pick(i, *_BODIES).alias("body")
    )


@query(
    f"SELECT target, CASE WHEN contains(body, 'swagger') THEN 'swagger' ELSE 'openapi' END AS kind, CASE WHEN contains(body, 'swagger') THEN '2.0' ELSE '3.0.1' END AS version, url FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY target ORDER BY rank) AS n FROM {_RESPONSES} WHERE status = 200 AND (contains(body, '2.0') OR contains(body, '3.0.1'))) WHERE n = 1"
)
def api_specs(spark, d):
    """The first API description of each target that names its version."""
    return api_surface.specs(_responses(spark, d))


@query(f"SELECT target, min_by(url, rank) AS url, 2 AS types FROM {_RESPONSES} WHERE status = 200 AND contains(body, 'types') GROUP BY target")
def graphql_schemas(spark, d):
    """The first endpoint of each target whose introspection lists types."""
    return api_surface.graphql(_responses(spark, d))


@query(
    "SELECT user_id AS target, list_sort(list(DISTINCT '/api/' || event_type || '/{id}')) AS endpoints FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 10 GROUP BY 1"
)
def bundle_endpoints(spark, d):
    """Endpoint candidates in the first ten scripts of each target."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    body = F.concat(F.lit('fetch("/api/'), "event_type", F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit('");img("/static/a.png");go(\'not a path\')'))
    return api_surface.bundle_endpoints(e.select(F.col("user_id").alias("target"), F.col("event_id").alias("pos"), body.alias("body")))


# Stored state -------------------------------------------------------------------


@query(
    "WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 7 <> 0), f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events WHERE user_id % 7 <> 0) "
    "SELECT user_id AS target, 'https://x.example/' || event_id AS url, CAST(event_id % 4 AS INTEGER) AS depth, n AS seq, false AS is_seen FROM f "
    "UNION ALL SELECT user_id, event_type, NULL, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1, true FROM s"
)
def saved_frontiers(spark, d):
    """Queues and visited urls of saved crawls; a crawl with a bad entry is left out whole."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    entry = F.struct(F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("https://x.example/"), "event_id")).alias("url"), (F.col("event_id") % 4).alias("depth"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("l"), F.array_sort(F.collect_set("event_type")).alias("seen"))
    state = F.to_json(F.struct("seen", F.col("l.e").alias("frontier")))
    return bronze.frontier_entries(rows.select(F.col("user_id").alias("target"), state.alias("state")))


@query(
    "SELECT CAST(site_id AS VARCHAR) AS domain, CAST(row_id AS VARCHAR) AS key, 'li' AS tag, coalesce(name, '') AS text, CAST(row_id % 9 AS INTEGER) AS sibling_index, CAST(row_id % 2 AS INTEGER) AS classes FROM juice_shop_products WHERE row_id % 6 <> 0"
)
def stored_fingerprints(spark, d):
    """Element fingerprints kept as JSON; those without a tag are skipped, absent fields are empty."""
    p, i = table(spark, d, "juice_shop_products", "row_id", "site_id", "name"), F.col("row_id")
    body = F.struct(F.when(i % 6 != 0, "li").alias("tag"), F.col("name").alias("text"), (i % 9).alias("sibling_index"), F.when(i % 2 == 1, F.array(F.lit("card"))).alias("classes"))
    rows = p.select(F.col("site_id").cast("string").alias("domain"), i.cast("string").alias("key"), F.to_json(body).alias("print"))
    found = bronze.fingerprints_from_json(rows)
    return found.select("domain", "key", "print.tag", "print.text", "print.sibling_index", F.size("print.classes").alias("classes"))


@query("SELECT user_id AS domain, event_type AS key, max(event_id // 2) AS run_seq FROM events GROUP BY ALL")
def prior_fingerprints(spark, d):
    """The last fingerprint of each key before a run."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    return healing.prior(e.select(F.col("user_id").alias("domain"), F.col("event_type").alias("key"), F.floor(F.col("event_id") / 2).alias("run_seq")).distinct(), 1 << 40)


_CHECKED = "(doc_id % 3 = 0 AND doc_id % 2 = 0 OR doc_id % 11 = 0)"


def _validators(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("url", F.col("doc_id").cast("string"))
    i, body = F.col("doc_id"), F.coalesce("text", F.lit("none"))
    known = docs.filter(i % 3 == 0).select("url", F.concat(F.lit("e"), "url").alias("etag"), F.when(i % 4 == 0, "Mon").alias("last_modified"), F.sha2(F.when(i % 2 == 0, body).otherwise("old"), 256).alias("content_hash"))
    responses = docs.select("url", F.when(i % 11 == 0, 304).otherwise(200).alias("status"), body.alias("body"), F.lit("new").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    return docs, known, responses


@query(
    f"SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN {_CHECKED} THEN 'e' || doc_id ELSE 'new' END AS etag, sha256(CASE WHEN {_CHECKED} AND doc_id % 2 = 1 THEN 'old' ELSE coalesce(text, 'none') END) AS content_hash "
    f"FROM documents WHERE NOT ({_CHECKED}) OR doc_id % 3 = 0"
)
def kept_validators(spark, d):
    """Validators after a run: those of changed pages replaced, the others kept."""
    _, known, responses = _validators(spark, d)
    return change.record(responses, known).select("url", "etag", "content_hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 3 = 0 THEN 'e' || doc_id END AS etag, CASE WHEN doc_id % 12 = 0 THEN 'Mon' END AS since FROM documents")
def conditional_requests(spark, d):
    """Headers of conditional requests."""
    docs, known, _ = _validators(spark, d)
    rows = change.request_headers(docs.select("url"), known)
    return rows.select("url", F.try_element_at("headers", F.lit("If-None-Match")).alias("etag"), F.try_element_at("headers", F.lit("If-Modified-Since")).alias("since"))


@query(
    "WITH s AS (SELECT id AS site_id, domain, l FROM sites, (VALUES ('main'), ('shop')) v(l) WHERE (id % 3 <> 0 OR l <> 'shop')) "
    "SELECT domain, l AS label, CASE WHEN site_id % 2 = 0 AND l = 'main' THEN 'new' ELSE 'old' END AS created_at, CASE WHEN site_id % 2 = 0 AND l = 'main' THEN NULL ELSE 'used' END AS last_used_at FROM s"
)
def stored_sessions(spark, d):
    """Stored logins after some were replaced and some dropped."""
    s = table(spark, d, "sites", "id", "domain")
    column = lambda v: F.lit(v)
    both = s.select(F.col("id").alias("site_id"), F.explode(F.array(F.lit("main"), F.lit("shop"))).alias("label"))
    sessions = both.select(F.monotonically_increasing_id().alias("id"), "site_id", "label", column("{}").alias("storage_state_json"), column("old").alias("created_at"), column("used").alias("last_used_at"))
    fresh = both.filter("site_id % 2 = 0 and label = 'main'").select(F.lit(-1).cast("bigint").alias("id"), "site_id", "label", column("{}").alias("storage_state_json"), column("new").alias("created_at"))
    gone = both.filter("site_id % 3 = 0 and label = 'shop'")
    return store.list_sessions(store.drop_session(store.put_session(sessions, fresh), gone), s)


@query(
    "SELECT id, 'c' || i AS name, 'v' || id AS value, CASE WHEN i = 1 THEN domain ELSE '' END AS domain, '/' AS path FROM sites, (VALUES (0), (1)) t(i) WHERE id % 4 <> 0"
)
def session_cookies(spark, d):
    """Cookies of stored logins; broken states and nameless cookies give none."""
    s = table(spark, d, "sites", "id", "domain")
    cookie = lambda i, **more: F.struct(F.lit(f"c{i}").alias("name"), F.concat(F.lit("v"), "id").alias("value"), *(c.alias(n) for n, c in more.items()))
    nothing = F.lit(None).cast("string")
    nameless = F.struct(nothing.alias("name"), F.lit("x").alias("value"), nothing.alias("domain"))
    listed = F.array(cookie(0, domain=nothing), cookie(1, domain=F.col("domain")), nameless)
    state = F.when(F.col("id") % 4 == 0, F.lit('{"cookies": [')).otherwise(F.to_json(F.struct(listed.alias("cookies"))))
    return store.session_cookies(s.select("id", state.alias("storage_state_json")))


@query("SELECT DISTINCT domain FROM (SELECT domain FROM sites UNION ALL SELECT event_type || '.example' FROM events)")
def more_sites(spark, d):
    """Sites after new ones were seen."""
    names = table(spark, d, "events", "event_type").select(F.concat(F.lit("https://"), "event_type", F.lit(".example/a")).alias("url_or_domain"))
    return store.add_sites(table(spark, d, "sites", "id", "domain"), names).select("domain")


# Observed pages -------------------------------------------------------------------

_ROLES = {"view": "link", "click": "button", "error": "video", "purchase": "generic", "signup": "textbox"}
_ROLE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items()) + " END"


def _nodes(spark, d):
    e, i = table(spark, d, "events", "event_id", "event_type"), F.col("event_id")
    role = F.lit(None).cast("string")
    for kind, name in _ROLES.items():
        role = F.when(F.col("event_type") == kind, name).otherwise(role)
    node = (i % 64).cast("int")
    return e.select(
        F.floor(i / 64).alias("state_id"), node.alias("node_id"), F.floor(node / 2).cast("int").alias("parent_id"), node.alias("pos"), role.alias("role"),
        F.concat(F.lit("n"), i).alias("name"), (i % 9 == 0).alias("ignored"), node.alias("backend_id"),
    )


@query(
    f"WITH RECURSIVE n AS (SELECT event_id // 64 AS state_id, event_id % 64 AS node_id, (event_id % 64) // 2 AS parent_id, {_ROLE_SQL} AS role, event_id FROM events), "
    "m AS (SELECT n.state_id, n.node_id FROM n JOIN n p ON p.state_id = n.state_id AND p.node_id = n.parent_id WHERE p.role = 'video' "
    "UNION SELECT n.state_id, n.node_id FROM n JOIN m ON m.state_id = n.state_id AND m.node_id = n.parent_id) "
    "SELECT state_id, CAST(node_id AS INTEGER) AS pos, role, 'n' || event_id AS name, CASE WHEN role = 'link' THEN '/p/' || node_id END AS destination, CASE WHEN role = 'textbox' THEN 'email' END AS input_type "
    "FROM n WHERE role IN ('link', 'button', 'textbox') AND event_id % 9 <> 0 AND NOT EXISTS (SELECT 1 FROM m WHERE m.state_id = n.state_id AND m.node_id = n.node_id)"
)
def accessible_actions(spark, d):
    """What a user can act on in each accessibility tree, with where links lead and what inputs take."""
    nodes = _nodes(spark, d)
    links = nodes.filter("role = 'link'").select("state_id", "backend_id", F.concat(F.lit("/p/"), "backend_id", F.lit("?q=1#x")).alias("href"), F.lit("https://x.example/").alias("base"))
    inputs = nodes.filter("role = 'textbox'").select("state_id", "backend_id", F.lit("email").alias("input_type"))
    return signals.enrich(signals.find_actions(nodes), links, inputs).select("state_id", "pos", "role", "name", "destination", "input_type")


@query("SELECT row_id AS snapshot_id, CAST(row_id * 2 + 1 AS INTEGER) AS backend_id, '/p/' || row_id AS href, CASE WHEN row_id % 3 = 0 THEN 'text' ELSE 'email' END AS input_type FROM juice_shop_products WHERE row_id % 10 <> 0")
def dom_tree_nodes(spark, d):
    """Links and input types out of browser DOM trees, through shadow roots and frames."""
    p, i = table(spark, d, "juice_shop_products", "row_id"), F.col("row_id").cast("string")
    kind = F.when(F.col("row_id") % 3 == 0, F.lit("")).otherwise(F.lit('"type","Email",'))
    leaf = F.concat(F.lit('{"backendNodeId":'), (F.col("row_id") * 2 + 1).cast("string"), F.lit(',"nodeName":"INPUT","attributes":['), kind, F.lit('"href","/p/'), i, F.lit('"]}'))
    wrap = _pick(F.col("row_id"), "children", "shadowRoots", "pseudoElements", "contentDocument")
    inner = F.when(wrap == "contentDocument", leaf).otherwise(F.concat(F.lit("["), leaf, F.lit("]")))
    tree = F.concat(F.lit('{"backendNodeId":0,"nodeName":"HTML","'), wrap, F.lit('":'), inner, F.lit("}"))
    nodes = observed.dom_nodes(p.select(F.col("row_id").alias("snapshot_id"), F.when(F.col("row_id") % 10 == 0, F.lit("{")).otherwise(tree).alias("dom")))
    return observed.hrefs(nodes).join(observed.input_types(nodes), ["snapshot_id", "backend_id"])


_QUAD = "[embedding[{0}]::DOUBLE, embedding[{1}]::DOUBLE, embedding[{2}]::DOUBLE, embedding[{3}]::DOUBLE]"
_XS, _YS = _QUAD.format(1, 3, 5, 7), _QUAD.format(2, 4, 6, 8)


@query(
    f"SELECT vec_id, x, y, width, height FROM (SELECT vec_id, list_min({_XS}) AS x, list_min({_YS}) AS y, list_max({_XS}) - list_min({_XS}) AS width, list_max({_YS}) - list_min({_YS}) AS height FROM embeddings WHERE vec_id % 5 <> 0)"
)
def border_boxes(spark, d):
    """Boxes around quads; what has no area or corners has none."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("q", F.transform("embedding", lambda x: x.cast("double")))
    quad = F.when(F.col("vec_id") % 5 == 0, F.slice("q", 1, 6)).otherwise(F.slice("q", 1, 8))
    return e.select("vec_id", observed.border_box(quad).alias("b")).filter("b is not null").select("vec_id", "b.*")


@query(
    "WITH s AS (SELECT event_id, event_id % 5 - event_id % 7 AS delta, CASE WHEN event_type = 'error' THEN 'boom, late' END AS console, CASE WHEN event_id % 4 = 0 THEN 'a' END AS gone, CASE WHEN event_id % 4 <> 0 THEN 'b' END AS kept, event_id % 2 <> event_id % 4 // 2 AS shot FROM events), "
    "l AS (SELECT event_id, list_filter([CASE WHEN delta <> 0 THEN 'accessibility nodes: ' || CASE WHEN delta > 0 THEN '+' ELSE '' END || delta END, 'console added: ' || console, 'storage added: ' || kept, 'storage removed: ' || gone, "
    "'network added: m', CASE WHEN shot THEN 'screenshot changed' END], lambda x: x IS NOT NULL) AS lines FROM s) SELECT event_id, lines FROM l"
)
def signal_changes(spark, d):
    """What an action changed in a state's signals, as lines."""
    e, i = table(spark, d, "events", "event_id", "event_type"), F.col("event_id")
    strings = lambda *items: F.array(*(x if hasattr(x, "cast") else F.lit(x) for x in items)).cast("array<string>")
    request = F.concat(F.lit("n"), (i % 3).cast("string"))
    before = F.struct((i % 7).alias("ax_node_count"), strings().alias("console_messages"), strings("a").alias("storage_keys"), strings(request).alias("network_requests"), (i % 2).alias("screenshot_hash"))
    console = F.when(F.col("event_type") == "error", strings("boom", "late", "boom")).otherwise(strings())
    storage = F.when(i % 4 == 0, strings()).otherwise(strings("a", "b"))
    after = F.struct((i % 5).alias("ax_node_count"), console.alias("console_messages"), storage.alias("storage_keys"), strings(request, "m").alias("network_requests"), F.floor(i % 4 / 2).alias("screenshot_hash"))
    return e.select("event_id", signals.describe(signals.diff(before, after)).alias("lines"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '' WHEN 2 THEN '' ELSE '12' END AS value FROM events")
def ax_values(spark, d):
    """Strings of accessibility values given as JSON."""
    e = table(spark, d, "events", "event_id", "event_type")
    raw = _pick(F.col("event_id"), F.to_json(F.struct(F.col("event_type").alias("value"))), "{}", F.lit(None).cast("string"), '{"type":"number","value":12}')
    return e.select("event_id", ax_string(raw).alias("value"))


@query(
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN n >= 9223372036854775808 THEN CAST(n - 18446744073709551616 AS BIGINT) ELSE CAST(n AS BIGINT) END AS hash FROM (SELECT event_id, (CAST(event_id AS HUGEINT) * 1844674407370955 * 7) % 18446744073709551616 AS n FROM events)"
)
def hash_texts(spark, d):
    """Unsigned hashes written as text, as signed numbers."""
    e, i = table(spark, d, "events", "event_id"), F.col("event_id")
    n = (i.cast("decimal(20,0)") * F.lit(1844674407370955 * 7).cast("decimal(18,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")
    text = F.when(i % 5 == 0, F.concat(n.cast("decimal(20,0)").cast("string"), F.lit("x"))).otherwise(n.cast("decimal(20,0)").cast("string"))
    return e.select("event_id", signed_hash(text).alias("hash"))


# Maps -----------------------------------------------------------------------------


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE dst IS NOT NULL), r AS (SELECT o_custkey AS node, 0 AS depth FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) "
    "UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3) SELECT CAST(node AS VARCHAR) AS state, min(depth) AS steps, CASE WHEN min(depth) > 0 THEN CAST(node AS VARCHAR) END AS landed FROM r GROUP BY node"
)
def action_paths(spark, d):
    """The actions that lead to each state within three steps: how many, and where the last one lands."""
    edges, roots = _order_graph(spark, d)
    text = lambda c: F.col(c).cast("string").alias(c)
    moves = edges.select(text("src"), text("dst"), "seq", F.lit("link").alias("role"), F.col("seq").cast("string").alias("name"))
    tree = graph.levels(moves, roots.select(text("node"), "seq"), 3)
    steps = graph.paths(tree, moves)
    return steps.select("state", F.size("steps").alias("steps"), F.try_element_at("steps.landed", F.lit(-1)).alias("landed"))


@query("SELECT md5(CAST(doc_id AS VARCHAR)) AS state_id FROM documents WHERE md5(CAST(doc_id AS VARCHAR)) LIKE 'a%' AND source = 'product_page' AND doc_id % 3 = 0 AND doc_id % 2 = 1")
def anchored_states(spark, d):
    """States that four selectors choose together: id, title, url and the way there."""
    docs, i = table(spark, d, "documents", "doc_id", "source"), F.col("doc_id")
    step = lambda n: F.struct(F.lit("link").alias("role"), n.alias("name"))
    states = docs.select(
        F.md5(i.cast("string")).alias("state_id"), F.col("source").alias("title"), F.concat(F.lit("https://x.example/"), (i % 3).cast("string")).alias("url"),
        F.array(step(F.lit("Shop")), step((i % 2).cast("string"))).alias("path"),
    )
    for s in ("id:a", "title:product_page", "url:https://x.example/0", "path:link:Shop > link:1"):
        states = states.filter(graph.parse_selector(s))
    return states.select("state_id")


@query(
    _MAPS + ", k AS (SELECT d.id AS id, x.value AS v FROM d, json_each(CASE json_type(json_extract(j, '$.skipped')) WHEN 'ARRAY' THEN json_extract(j, '$.skipped') WHEN 'OBJECT' THEN json_array(json_extract(j, '$.skipped')) END) AS x WHERE json_type(j) = 'OBJECT' AND x.type = 'OBJECT') "
    "SELECT json_extract_string(v, '$.reason') AS reason, count(*) AS n FROM k GROUP BY 1"
)
def skip_reasons(spark, d):
    """Why actions were skipped, over all stored maps."""
    runs = table(spark, d, "runs", "id", "exploration_json").withColumnRenamed("id", "run_id")
    return stats.skip_breakdown(graph.explode_map(runs)[2])


def _each(name):
    return f"json_each(CASE json_type(json_extract(j, '$.{name}')) WHEN 'ARRAY' THEN json_extract(j, '$.{name}') WHEN 'OBJECT' THEN json_array(json_extract(j, '$.{name}')) END)"


@query(
    _MAPS + f", s AS (SELECT d.id AS id, CAST(x.key AS INTEGER) AS n, json_extract_string(x.value, '$.id') AS state FROM d, {_each('states')} AS x WHERE json_type(j) = 'OBJECT' AND x.type = 'OBJECT'), "
    f"t AS (SELECT d.id AS id, CAST(x.key AS INTEGER) AS seq, json_extract_string(x.value, '$.from') AS a, json_extract_string(x.value, '$.to') AS b, "
    "coalesce(nullif(translate(json_extract_string(x.value, '$.action.name'), '\"|`', '''/'''), ''), '(unnamed)') AS label "
    f"FROM d, {_each('transitions')} AS x WHERE json_type(j) = 'OBJECT' AND x.type = 'OBJECT') "
    "SELECT t.id AS run_id, '    S' || p.n || ' -->|' || label || '| S' || q.n AS line, t.seq AS seq FROM t JOIN s p ON p.id = t.id AND p.state = t.a JOIN s q ON q.id = t.id AND q.state = t.b"
)
def mermaid_lines(spark, d):
    """Lines of a diagram of each stored map."""
    runs = table(spark, d, "runs", "id", "exploration_json").withColumnRenamed("id", "run_id")
    states, transitions, _ = graph.explode_map(runs)
    return graph.mermaid_edges(states, transitions, action_label(mermaid_text(F.col("name"))))


# Counts -----------------------------------------------------------------------------


@query(
    "SELECT user_id AS run_id, count(*) FILTER (event_type = 'view') AS records, count(*) FILTER (event_type = 'click') AS pages, count(*) FILTER (event_type = 'error') AS blockeds, "
    "count(*) FILTER (event_type = 'purchase') AS deads, count(*) FILTER (event_type = 'signup') AS unchangeds, 0 AS retrys FROM events GROUP BY 1"
)
def run_outcomes(spark, d):
    """Counts of each run's outcomes."""
    kinds = {"view": "record", "click": "page", "error": "blocked", "purchase": "dead", "signup": "unchanged"}
    outcome = F.lit(None).cast("string")
    for a, b in kinds.items():
        outcome = F.when(F.col("event_type") == a, b).otherwise(outcome)
    return stats.run_summary(table(spark, d, "events", "user_id", "event_type").select(F.col("user_id").alias("run_id"), outcome.alias("outcome")))


@query("SELECT user_id AS run_id, count(*) AS refs, count(DISTINCT event_type) AS files, count(*) FILTER (event_id % 3 = 0) AS clips FROM events GROUP BY 1")
def image_counts(spark, d):
    """References, files and clips of each run's pictures."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    box = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(1).alias("x")))
    return stats.image_counts(e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("src"), box.alias("box")))


@query(
    "SELECT event_type || ' ' || what AS name, 's' AS unit, round(v, 6) AS value FROM (SELECT event_type, sum(\"value\") AS total, median(\"value\") AS median FROM events GROUP BY 1) UNPIVOT (v FOR what IN (total, median))"
)
def benchmark_rows(spark, d):
    """Timing statistics as rows."""
    s = stats.op_stats(table(spark, d, "events", "event_type", "value"), "event_type", "value").withColumnRenamed("event_type", "op")
    return stats.benchmark_entries(s).withColumn("value", F.round("value", 6))


@query(
    "SELECT user_id AS run_id, CAST(count(*) AS INTEGER) AS cookies, 1 AS origins, CAST(count(*) FILTER (event_id % 2 = 0) AS INTEGER) AS entries, CAST(count(*) + count(*) FILTER (event_id % 2 = 0) AS INTEGER) AS names FROM events GROUP BY 1"
)
def storage_signals(spark, d):
    """Sizes of stored browser states."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    pair = F.struct(F.concat(F.lit("k"), "event_id").alias("name"), F.col("event_type").alias("value"))
    rows = e.groupBy(F.col("user_id").alias("run_id")).agg(F.collect_list(pair).alias("cookies"), F.collect_list(F.when(F.col("event_id") % 2 == 0, pair)).alias("own"))
    origin = F.struct(F.lit("https://x.example").alias("origin"), F.col("own").alias("localStorage"))
    return signals.storage_signal(rows.select("run_id", "cookies", F.array(origin).alias("origins"))).withColumn("names", F.size("names"))


@query(
    "SELECT round_even(event_id % 7000 / 1000.0 + 0.0001, 3) AS start_s, event_type AS op, round_even(\"value\", 4) AS duration_s, 'd' || event_id AS detail, round_even(greatest(event_id, user_id * 100) / 1e6, 1) AS rss_mb FROM events"
)
def resource_rows(spark, d):
    """A run's transactions with rounded figures."""
    e, i = table(spark, d, "events", "event_id", "user_id", "event_type", "value"), F.col("event_id")
    rows = e.select(
        (i % 7000 / 1000.0 + 0.0001).alias("start_offset"), F.col("event_type").alias("op"), F.col("value").alias("duration_s"), F.concat(F.lit("d"), i).alias("detail"),
        i.cast("double").alias("rss_before"), (F.col("user_id") * 100).cast("double").alias("rss_after"),
    )
    return stats.resource_trace(rows)


@query(
    "SELECT 'https://' || 'h' || id || '.example/a/' AS url, kind, 'https://h' || id || '.example' || link AS link FROM sites, (VALUES ('script', '/js/a.js'), ('script', '/a/b.js'), ('spec', '/openapi.json'), ('spec', '/a/v1/swagger.yaml')) t(kind, link) WHERE id % 5 <> 0 OR kind = 'script'"
)
def page_references(spark, d):
    """Own scripts and API descriptions a page refers to."""
    s, i = table(spark, d, "sites", "id"), F.col("id").cast("string")
    spec = F.when(F.col("id") % 5 != 0, F.lit('<div data-x="/openapi.json" y=\'v1/swagger.yaml\'></div><a href="/openapi.json">')).otherwise(F.lit("<p>openapi</p>"))
    html = F.concat(F.lit('<script src="/js/a.js"></script><SCRIPT async src="b.js"></SCRIPT><script src="https://cdn.example/c.js"></script><script>x</script><script src="data:x"></script>'), spec)
    pages = s.select(F.concat(F.lit("https://h"), i, F.lit(".example/a/")).alias("url"), html.alias("html"))
    kinds = ((extract.script_sources, "script"), (extract.spec_candidates, "spec"))
    parts = [fn(pages).select("url", F.lit(kind).alias("kind"), "link") for fn, kind in kinds]
    return parts[0].unionByName(parts[1])


_ACTIONS = "(SELECT user_id, event_id AS seq, ts AS at, 'step ' || event_id AS label FROM events WHERE event_type = 'click')"


@query(
    f"WITH a AS {_ACTIONS}, r AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_type <> 'click'), "
    "h AS (SELECT r.event_id, r.event_type, max_by(a.seq, (a.at, a.seq)) AS seq FROM r JOIN a ON a.user_id = r.user_id AND a.at <= r.ts GROUP BY ALL) "
    "SELECT h.seq AS cseq, 'step ' || h.seq AS label, list_sort(list(DISTINCT 'GET /' || event_type)) AS endpoints, count(*) AS requests FROM h GROUP BY h.seq"
)
def correlated_requests(spark, d):
    """Requests attributed to the action before them."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    marks = e.filter("event_type = 'click'").select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("seq"), F.concat(F.lit("step "), "event_id").alias("label"), F.col("ts").cast("timestamp").alias("at"))
    started = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    requests = e.filter("event_type <> 'click'").select(F.col("user_id").alias("capture_id"), F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type").alias("path"), started.alias("started_at"))
    return api_surface.correlate(marks, requests).select("cseq", "label", "endpoints", "requests")


@query(
    f"WITH a AS {_ACTIONS} SELECT user_id AS capture_id, count(*) AS actions, 'step ' || min(seq) AS first, 'step ' || max(seq) AS last FROM a GROUP BY 1"
)
def correlation_documents(spark, d):
    """The correlation of each capture as one document: its actions in order."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type").filter("event_type = 'click'")
    rows = e.select(F.col("user_id").alias("capture_id"), F.col("event_id").alias("cseq"), F.concat(F.lit("step "), "event_id").alias("label"), F.array(F.lit("GET /a")).alias("endpoints"))
    made = api_surface.correlation_document(rows, "by time")
    parsed = made.select("capture_id", F.from_json("document", "struct<note:string,actions:array<struct<label:string,endpoints:array<string>>>>")["actions"]["label"].alias("l"))
    return parsed.select("capture_id", F.size("l").cast("bigint").alias("actions"), F.element_at("l", 1).alias("first"), F.element_at("l", -1).alias("last"))


@query(
    f"SELECT t.target AS target, s.url AS spec, g.url AS graphql, t.n AS endpoints FROM (SELECT user_id % 60 AS target, count(*) AS n FROM events GROUP BY 1) t "
    f"LEFT JOIN (SELECT target, min_by(url, rank) AS url FROM {_RESPONSES} WHERE status = 200 AND (contains(body, '2.0') OR contains(body, '3.0.1')) GROUP BY 1) s ON s.target = t.target "
    f"LEFT JOIN (SELECT target, min_by(url, rank) AS url FROM {_RESPONSES} WHERE status = 200 AND contains(body, 'types') GROUP BY 1) g ON g.target = t.target"
)
def shared_surfaces(spark, d):
    """What may be shared of each target's API, read back from its document."""
    r = _responses(spark, d)
    count = table(spark, d, "events", "user_id").groupBy((F.col("user_id") % 60).alias("target")).agg(F.count(F.lit(1)).alias("endpoint_count"))
    counted = count.withColumn("request_count", F.col("endpoint_count")).withColumn("action_count", F.lit(1))
    made = api_surface.shareable_surface(api_surface.specs(r), api_surface.graphql(r), counted, counted, counted)
    part = lambda path: F.get_json_object("surface", path)
    return made.select("target", part("$.spec.url").alias("spec"), part("$.graphql.url").alias("graphql"), part("$.bundle_endpoints.endpoint_count").cast("bigint").alias("endpoints"))


@query("SELECT 'https://shop.example/p/' || row_id AS url, nullif(trim(regexp_replace(coalesce(brand, ''), '[ \\t\\r\\n]+', ' ', 'g'), ' '), '') AS brand FROM juice_shop_products")
def tiered_run(spark, d):
    """A run whose plain captures hold nothing and whose rendered ones do."""
    p = table(spark, d, "juice_shop_products", "row_id", "brand")
    url = F.concat(F.lit("https://shop.example/p/"), "row_id")
    escaped = F.replace(F.replace(F.coalesce("brand", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = lambda html: p.select(url.alias("url"), F.lit(200).alias("status"), html.alias("html"))
    job = jobs.job({"target": "https://shop.example/none", "item": "article", "fields": {"brand": {"selector": "b"}}})
    plain, browser = pipeline.Tier("plain", pages(F.lit("<p>x</p>"))), pipeline.Tier("browser", pages(F.concat(F.lit("<article><b>"), escaped, F.lit("</b></article>"))), renders=True)
    tiers = [pipeline.run_tier(t, job, seeds=p.select(url.alias("url")), budget=None) for t in (plain, browser)]
    full = [t for t in tiers if t.records.limit(1).count()]
    return full[0].records.select("url", "brand")


@query(
    "SELECT f AS format, row_id, coalesce(name, '') AS name, price FROM (SELECT row_id, name, price FROM streaming_names), (VALUES ('json'), ('jsonl'), ('csv'), ('parquet')) t(f)".replace(
        "streaming_names", "(SELECT row_id, title AS name, CAST(row_id AS DOUBLE) / 4 AS price FROM streaming_clone_catalog)"
    )
)
def written_records(spark, d):
    """Records written in the four folder formats and read back; null texts are empty here, as in CSV."""
    rows = table(spark, d, "streaming_clone_catalog", "row_id", "title").select("row_id", F.col("title").alias("name"), (F.col("row_id") / 4).alias("price"))
    parts = []
    for kind in ("json", "jsonl", "csv", "parquet"):
        path = staging_path(spark, f"written_{kind}")
        sinks.write_records(rows, rows.schema, path, kind)
        reader = spark.read.schema(rows.schema)
        back = {
            "json": lambda r, p: r.option("multiLine", "true").json(p),
            "jsonl": lambda r, p: r.json(p),
            "csv": lambda r, p: r.options(header="true", multiLine="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(p),
            "parquet": lambda r, p: r.parquet(p),
        }[kind](reader, path)
        parts.append(back.select(F.lit(kind).alias("format"), "row_id", F.coalesce("name", F.lit("")).alias("name"), "price"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "WITH f AS (SELECT id, substr(md5(CAST(id AS VARCHAR)), 1, 32) AS state, id % 8 AS k FROM sites WHERE id % 8 <> 5) "
    "SELECT state, 'n' || id AS name, CASE k WHEN 6 THEN 'failed: value must be a quoted YAML string' WHEN 7 THEN 'failed: no generator available for kind choice' "
    "WHEN 0 THEN 'failed: no path from the root to this state' WHEN 1 THEN 'failed: navigation replay is outside the typing-only scope' WHEN 2 THEN 'failed: no matching field on this state' ELSE 'apply' END AS verdict FROM f"
)
def fill_plans(spark, d):
    """What becomes of each field of a scaffold before anything is typed."""
    s, k = table(spark, d, "sites", "id"), F.col("id") % 8
    state, name = F.md5(F.col("id").cast("string")), F.concat(F.lit("n"), "id")
    nothing = F.lit(None).cast("string")
    fields = s.select(
        state.alias("state_id"), name.alias("name"), F.when(k == 7, "choice").otherwise("email").alias("kind"), F.when(k.isin(4, 5, 7), nothing).otherwise("x").alias("value"),
        (k != 6).alias("is_text"), k.isin(4, 7).alias("generate"),
    )
    actions = s.filter(k != 2).select(state.alias("state_id"), F.lit(0).alias("pos"), F.lit("textbox").alias("role"), name.alias("name"))
    depths = s.filter(k != 0).select(state.alias("state_id"), F.when(k == 1, 2).otherwise(0).alias("depth"))
    plan = observed.fill_plan(fields, s.select(state.alias("state_id")), actions, depths, F.lit(False))
    return plan.select("state", "name", "verdict")
