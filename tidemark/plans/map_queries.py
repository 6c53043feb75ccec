"""Queries on graphs, signals, images, run history and timings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.similarity import added
from ..operators import api_surface, change, frontier, graph, images, jobs, retries, signals, stats, store
from ..operators.history import BLOCK_US, micros, running, with_next
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


_US = "epoch_us(try_cast(captured_at AS TIMESTAMPTZ))"


@query(f"SELECT url, id, tier FROM (SELECT url, id, tier, row_number() OVER (PARTITION BY url ORDER BY {_US} DESC NULLS LAST, id DESC) AS n FROM runs) WHERE n = 1")
def runs_latest(spark, d):
    """The run that stands for each url."""
    return store.latest_runs(table(spark, d, "runs", "url", "id", "captured_at", "tier"), ["tier"])


@query("SELECT DISTINCT domain FROM sites JOIN runs ON runs.site_id = sites.id")
def mapped_domains(spark, d):
    """Domains that have been mapped."""
    return store.domains(table(spark, d, "sites"), table(spark, d, "runs", "site_id"))


@query(f"SELECT url, max({_US}) AS captured_us FROM runs JOIN sites ON runs.site_id = sites.id WHERE domain = (SELECT min(domain) FROM sites JOIN runs ON runs.site_id = sites.id) GROUP BY url")
def domain_urls(spark, d):
    """Urls of one domain with their last capture."""
    sites, runs = table(spark, d, "sites"), table(spark, d, "runs", "site_id", "url", "captured_at")
    return store.urls(sites, runs, store.domains(sites, runs).first()["domain"])


@query(
    "SELECT method, path, list_sort(list(DISTINCT status)) AS statuses, count(*) AS requests FROM (SELECT CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method, "
    "'/api/' || event_type || '/{id}' AS path, 200 + event_id % 3 AS status FROM events WHERE event_id % 4 <> 0) GROUP BY ALL"
)
def endpoint_clusters(spark, d):
    """Endpoints of captured traffic with the statuses seen."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    entries = e.select(
        F.when(F.col("event_type") == "purchase", "post").otherwise("get").alias("method"),
        F.concat(F.lit("https://shop.example/api/"), "event_type", F.lit("/"), "user_id", F.lit("?q=1")).alias("url"),
        (F.lit(200) + F.col("event_id") % 3).alias("status"),
        F.when(F.col("event_id") % 4 == 0, "text/html").otherwise("application/JSON; charset=utf-8").alias("mime"),
    )
    return api_surface.clusters(api_surface.api_requests(entries, F.lit("shop.example")))


_PAIRS = (
    "(SELECT e.event_id, max_by(p.event_id, (epoch_us(p.ts), p.event_id)) AS purchase FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.event_type = 'purchase' "
    "WHERE e.event_type = 'error' GROUP BY e.event_id)"
)


def _as_of(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase"))
    return api_surface.as_of(left, right, ["user_id"], "ts", "at", "purchase", ["purchase"], block_us=86_400_000_000)


@query(f"SELECT * FROM {_PAIRS}")
def as_of_join(spark, d):
    """Each error with the user's last purchase before it."""
    return _as_of(spark, d).select("event_id", "purchase")


@query(f"SELECT purchase, list_sort(list(event_id)) AS errors FROM {_PAIRS} GROUP BY purchase")
def correlation_buckets(spark, d):
    """Errors by the purchase they follow."""
    return _as_of(spark, d).groupBy("purchase").agg(F.array_sort(F.collect_list("event_id")).alias("errors"))


@query('SELECT user_id, event_type AS text, count(*) AS "count", min(event_id) AS first_pos FROM events GROUP BY ALL')
def event_tally(spark, d):
    """Event types per user, counted, in order of first sight."""
    return signals.tally(table(spark, d, "events", "user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


#: Endings of requested urls, one or more of each kind.
_ENDINGS = ("/a", "/a.html", "/a.js", "/a.css", "/a.png?v=1", "/a.woff2", "/a.mp4", "/a.json", "/api/a", "/a.bin", "/a.JPG", "/")
_KIND_SQL = (
    "SELECT user_id, ['/a', '/a.html', '/a.js', '/a.css', '/a.png?v=1', '/a.woff2', '/a.mp4', '/a.json', '/api/a', '/a.bin', '/a.JPG', '/'][event_id % 12 + 1] AS e, event_type, event_id FROM events"
)


@query(
    f"WITH u AS ({_KIND_SQL}), k AS (SELECT *, CASE WHEN e IN ('/a', '/a.html', '/') THEN 'Documents' WHEN e = '/a.js' THEN 'Scripts' WHEN e = '/a.css' THEN 'Styles' WHEN e IN ('/a.png?v=1', '/a.JPG') THEN 'Images' "
    "WHEN e = '/a.woff2' THEN 'Fonts' WHEN e = '/a.mp4' THEN 'Media' WHEN e IN ('/a.json', '/api/a') THEN 'Data' ELSE 'Other' END AS category FROM u) "
    "SELECT user_id, category, count(*) AS total, count(DISTINCT event_type || e) AS texts, list_position(['Documents', 'Scripts', 'Styles', 'Images', 'Fonts', 'Media', 'Data', 'Other'], category) AS rank FROM k GROUP BY user_id, category"
)
def network_kinds(spark, d):
    """Requests of each user by kind, with the different texts of each."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    ending = F.element_at(F.array(*(F.lit(x) for x in _ENDINGS)), (F.col("event_id") % 12 + 1).cast("int"))
    urls = e.select("user_id", F.concat(F.lit("https://shop.example/"), "event_type", ending).alias("item"), F.col("event_id").alias("pos"))
    return signals.network_tally(urls, ["user_id"]).select("user_id", "category", "total", F.size("rows").alias("texts"), F.col("rank").cast("int"))


@query("SELECT user_id AS run_id, count(*) FILTER (event_type <> 'signup') AS messages, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS page_errors FROM events GROUP BY 1")
def console_signal(spark, d):
    """Console messages, errors and page errors."""
    e = table(spark, d, "events", "user_id", "event_type")
    rows = e.select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "signup", "pageerror").otherwise("console").alias("kind"), F.col("event_type").alias("type"))
    return signals.console_signal(rows)


@query(
    "WITH h AS (SELECT user_id AS run_id, lower(CASE event_type WHEN 'view' THEN 'Content-Security-Policy' WHEN 'click' THEN 'X-Frame-Options' WHEN 'error' THEN 'Strict-Transport-Security' ELSE event_type END) AS n FROM events) "
    "SELECT run_id, count(DISTINCT n) AS distinct_headers, bool_or(n = 'content-security-policy') AS has_content_security_policy, bool_or(n = 'strict-transport-security') AS has_strict_transport_security, bool_or(n = 'x-frame-options') AS has_x_frame_options FROM h GROUP BY run_id"
)
def header_signal(spark, d):
    """Header names of a run and the security headers among them."""
    t = F.col("event_type")
    name = F.when(t == "view", "Content-Security-Policy").when(t == "click", "X-FRAME-options").when(t == "error", "strict-transport-security").otherwise(t)
    return signals.header_signal(table(spark, d, "events", "user_id", "event_type").select(F.col("user_id").alias("run_id"), name.alias("name")))


_DAYS = "(SELECT user_id, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, list(event_type || '-' || CAST(value AS INTEGER) % 7 ORDER BY ts, event_id) AS items FROM events GROUP BY ALL)"


@query(
    f"WITH w AS (SELECT user_id, day, items, lag(items) OVER (PARTITION BY user_id ORDER BY day) AS b FROM {_DAYS.replace('CAST(value AS INTEGER) % 7', 'event_id % 7')}) "
    "SELECT user_id, day, list_sort(list_distinct(list_filter(items, lambda x: NOT list_contains(b, x)))) AS added, list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(items, x)))) AS removed FROM w WHERE b IS NOT NULL"
)
def ordered_difference(spark, d):
    """What each day of a user adds to and drops from the day before."""
    e = table(spark, d, "events", "user_id", "ts", "event_type", "event_id").withColumn("item", F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")))
    days = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "item"))).alias("l"))
    days = days.select("user_id", "day", F.col("l.item").alias("items"))
    w = with_next(days, "user_id", "day", ["day", "items"], F.trunc("day", "month")).filter("next is not null")
    b, now = F.col("items"), F.col("next.items")
    return w.select("user_id", F.col("next.day").alias("day"), F.array_sort(added(b, now)).alias("added"), F.array_sort(added(now, b)).alias("removed"))


@query(
    "WITH g AS (SELECT user_id, ts, lead(ts) OVER w AS n, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "a AS (SELECT user_id, min(ts) AS t, min(t0) AS t0 FROM g WHERE n IS NULL OR epoch_us(n) - epoch_us(ts) >= 36000000000 GROUP BY user_id), "
    "b AS (SELECT user_id, t, t0, (epoch_us(t) - epoch_us(t0)) / 1e6 + 36000.0 AS e FROM a) "
    "SELECT b.user_id AS page_id, e <= 200000 AS settled, CASE WHEN e <= 200000 THEN e ELSE 200000.0 END AS elapsed_s, count(*) AS mutations FROM b JOIN events v ON v.user_id = b.user_id "
    "AND epoch_us(v.ts) <= CASE WHEN e <= 200000 THEN epoch_us(t) ELSE epoch_us(t0) + 200000000000 END GROUP BY ALL"
)
def settling(spark, d):
    """When each page's activity pauses long enough, or that it doesn't in time."""
    return signals.settled(table(spark, d, "events", "user_id", "ts").withColumnRenamed("user_id", "page_id"), 36000.0, 200000.0)


@query(
    "WITH r AS (SELECT event_id, user_id, count(*) OVER w AS states, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS requests FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, CASE WHEN states >= 40 THEN 'state budget reached' WHEN requests >= 12 THEN 'request budget reached' END AS reason FROM r"
)
def budget_stop(spark, d):
    """When a run must stop, by running counters."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").withColumn("t", micros(F.col("ts")))
    sums = {"states": F.lit(1), "requests": F.when(F.col("event_type") == "view", 1).otherwise(0)}
    counted = running(e, "user_id", ["t", "event_id"], sums, F.floor(F.col("t") / F.lit(BLOCK_US)))
    return counted.select("event_id", policy.stop_reason(F.lit(False), F.col("states"), F.col("requests"), F.lit(0), max_states=40, max_requests=12).alias("reason"))


@query('SELECT event_type AS op, count(*) AS n, round(sum("value"), 3) AS total, median("value") AS median, quantile_disc("value", 0.95) AS p95 FROM events GROUP BY 1')
def op_stats(spark, d):
    """Count, total, median and nearest-rank 95th percentile per operation."""
    s = stats.op_stats(table(spark, d, "events", "event_type", "value"), "event_type", "value")
    return s.select(F.col("event_type").alias("op"), "n", F.round("total", 3).alias("total"), "median", "p95")


@query('SELECT event_id, "value" AS duration_s FROM events ORDER BY "value" DESC, event_type, event_id LIMIT 8')
def slowest(spark, d):
    """The eight slowest operations."""
    e = table(spark, d, "events", "event_id", "event_type", "value")
    top = stats.slowest(e.select(F.col("value").alias("duration_s"), F.col("event_type").alias("op"), F.col("event_id").alias("detail")))
    return top.select(F.col("detail").alias("event_id"), "duration_s")


@query(
    "WITH h AS (SELECT event_type AS name, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT name, a AS expected, b AS found FROM h WHERE a <> b"
)
def baseline_drift(spark, d):
    """Counters that differ from their baseline."""
    e = table(spark, d, "events", "event_id", "event_type")
    count = lambda odd: e.filter(F.col("event_id") % 2 == odd).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return stats.drift(count(1), count(0))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL AND doc_id % 7 <> 0 OR doc_id % 11 = 0 THEN true ELSE false END AS unchanged FROM documents")
def change_detection(spark, d):
    """Pages against the validators of the run before."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("url", F.col("doc_id").cast("string"))
    known = docs.select("url", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.sha2("text", 256).alias("content_hash"))
    body = F.when(F.col("doc_id") % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    responses = docs.select("doc_id", "url", F.when(F.col("doc_id") % 11 == 0, 304).otherwise(200).alias("status"), body.alias("body"))
    return change.detect(responses, known).select("doc_id", "unchanged")


@query("SELECT sha256(text) AS content_key, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def first_seen(spark, d):
    """Each text once, as it was seen first."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    queue = frontier.first_seen(docs.select(F.sha2("text", 256).alias("url"), F.col("doc_id").alias("seq")))
    return queue.select(F.col("url").alias("content_key"), F.col("seq").alias("doc_id"))


@query("SELECT s.id FROM sites s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.site_id = s.id)")
def unvisited(spark, d):
    """Sites a resumed crawl still visits, those of earlier runs being seen."""
    url = lambda c: F.concat(F.lit("https://x.example/s/"), c)
    sites, seen = table(spark, d, "sites", "id"), table(spark, d, "runs", "site_id").distinct()
    pages = sites.select(url("id").alias("url"), F.lit(200).alias("status"), F.lit("<p>none</p>").alias("html"))
    job = jobs.job({"target": "https://x.example/none", "fields": {"p": {"selector": "p"}}})
    out = frontier.crawl(pages, job, seeds=pages.select("url"), seen=seen.select(url("site_id").alias("url")), budget=None)
    return out["visited"].select(F.substring_index("url", "/", -1).cast("bigint").alias("id"))


#: Customers of consecutive orders form a graph; the walk starts at the customer of the first order.
_EDGES = "(SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM (SELECT * FROM orders) o)"


def _order_graph(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    # the next order's customer, by key arithmetic on order numbers instead of one global window
    numbered = graph.dense_rank(o.withColumn("k", F.col("o_orderkey")), "k", "n")
    nxt = numbered.select((F.col("n") - 1).alias("n"), F.col("o_custkey").alias("dst"))
    edges = numbered.join(nxt, "n").select(F.col("o_custkey").alias("src"), "dst", F.col("n").alias("seq"))
    roots = numbered.filter("n = 1").select(F.col("o_custkey").alias("node"), "n").withColumnRenamed("n", "seq")
    return edges, roots


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE dst IS NOT NULL), r AS (SELECT o_custkey AS node, 0 AS depth FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) "
    "UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 12) SELECT node, min(depth) AS depth FROM r GROUP BY node"
)
def graph_levels(spark, d):
    """Breadth-first depth of every node reached within twelve steps."""
    edges, roots = _order_graph(spark, d)
    return graph.depths(edges, roots, 12)


#: Pages of the order graph that answer 404, and that robots rules close.
_GONE, _CLOSED = 17, 13


@query(
    f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE dst IS NOT NULL), "
    f"r AS (SELECT o_custkey AS node, 0 AS depth FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) "
    f"UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 4 AND r.node % {_GONE} <> 0 AND r.node % {_CLOSED} <> 0) "
    f"SELECT node, min(depth) AS depth, CASE WHEN node % {_CLOSED} = 0 THEN 'blocked' WHEN node % {_GONE} = 0 THEN 'dead' ELSE 'visited' END AS outcome FROM r GROUP BY node"
)
def crawl_walk(spark, d):
    """A whole crawl of pages that link each other, four links deep: what was visited, dead or blocked, and how deep."""
    edges, roots = _order_graph(spark, d)
    url = lambda c: F.concat(F.lit("https://x.example/p/"), c)
    links = edges.select("src", "dst").distinct().groupBy("src").agg(F.array_join(F.collect_list(F.concat(F.lit('<a href="/p/'), "dst", F.lit('">x</a>'))), "").alias("html"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    status = F.when(F.col("node") % _GONE == 0, 404).otherwise(200)
    pages = nodes.join(links, F.col("node") == F.col("src"), "left").select(url("node").alias("url"), status.alias("status"), F.coalesce("html", F.lit("")).alias("html"))
    target = "https://x.example/p/" + str(roots.first()["node"])
    job = jobs.job({"target": target, "crawl": {"max_depth": 4}, "fields": {"a": {"selector": "a"}}})
    number = lambda c: F.substring_index(c, "/", -1).cast("bigint")
    out = frontier.crawl(pages, job, allowed=lambda u: number(u) % _CLOSED != 0, budget=None)
    parts = [out[k].select(number(F.col("url")).alias("node"), "depth", F.lit(k).alias("outcome")) for k in ("visited", "dead", "blocked")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _hashes(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    # eight signs of eight values each, each eight bits wide, so that near duplicates exist
    value = lambda i: F.element_at("embedding", i).cast("double")
    h = F.lit(0).cast("bigint")
    for g in range(8):
        total = value(g * 8 + 1)
        for i in range(2, 9):
            total = total + value(g * 8 + i)
        h = h.bitwiseOR(F.when(total > 0, F.shiftleft(F.lit(255).cast("bigint"), g * 8)).otherwise(F.lit(0).cast("bigint")))
    own = F.col("vec_id") % 5
    noise = F.expr("shiftleft(1L, cast(vec_id % 60 as int))")
    return e.select(F.col("label").alias("grp"), F.col("vec_id").alias("seq"), F.when(own < 2, h).otherwise(h.bitwiseXOR(noise)).alias("hash"))


_H = (
    "(SELECT label AS grp, vec_id AS seq, CASE WHEN vec_id % 5 < 2 THEN h ELSE xor(h, 1::HUGEINT << CAST(vec_id % 60 AS INTEGER)) END AS h FROM (SELECT label, vec_id, "
    "list_sum(list_transform(range(8), lambda g: CASE WHEN embedding[g * 8 + 1]::DOUBLE + embedding[g * 8 + 2]::DOUBLE + embedding[g * 8 + 3]::DOUBLE + embedding[g * 8 + 4]::DOUBLE + embedding[g * 8 + 5]::DOUBLE + embedding[g * 8 + 6]::DOUBLE + embedding[g * 8 + 7]::DOUBLE + embedding[g * 8 + 8]::DOUBLE > 0 "
    "THEN (255::HUGEINT << CAST(g * 8 AS INTEGER)) ELSE 0::HUGEINT END))::HUGEINT AS h FROM embeddings))"
)


@query(
    f"WITH r AS (SELECT grp, h, min(seq) AS seq FROM {_H} GROUP BY ALL) SELECT a.grp, a.seq AS a, b.seq AS b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM r a JOIN r b ON a.grp = b.grp AND a.seq < b.seq AND bit_count(xor(a.h, b.h)) <= 3"
)
def near_hashes(spark, d):
    """Pairs of different hashes within three bits."""
    return images.near_pairs(_hashes(spark, d))


@query()
def picture_reuse(spark, d):
    """The earlier picture each picture reuses (depends on order; checked against brute force in tests)."""
    h = _hashes(spark, d)
    return images.resolve_pictures(h.withColumn("key", F.md5(F.col("hash").cast("string"))))


@query(
    "WITH u AS (SELECT loc, seq // 50 AS part FROM (SELECT url AS loc, row_number() OVER (ORDER BY url) AS seq FROM (SELECT DISTINCT url FROM runs))) SELECT loc AS url FROM u"
)
def sitemap_walk(spark, d):
    """Pages listed by sitemaps below an index."""
    urls = table(spark, d, "runs", "url").distinct().withColumn("part", F.pmod(F.xxhash64("url"), F.lit(20)))
    loc = lambda c: F.concat(F.lit("<url><loc>"), F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = urls.groupBy("part").agg(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.collect_list(loc(F.col("url"))), ""), F.lit("</urlset>")).alias("body"))
    maps = maps.select(F.concat(F.lit("https://x.example/map"), "part").alias("url"), "body")
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    return frontier.sitemap_urls(maps.unionByName(index.select(F.lit("https://x.example/index").alias("url"), "body")), "https://x.example/index", None)


@query(
    "SELECT id, NOT (id % 3 = 0 AND regexp_matches(domain, '^[a-m]')) AND id % 10 <> 0 AS allowed FROM sites"
)
def robots_rules(spark, d):
    """What robots.txt allows."""
    s = table(spark, d, "sites", "id", "domain")
    body = F.when(F.col("id") % 3 == 0, "User-agent: *\nDisallow: /a\nDisallow: /b\nDisallow: /c\nDisallow: /d\nDisallow: /e\nDisallow: /f\nDisallow: /g\nDisallow: /h\nDisallow: /i\nDisallow: /j\nDisallow: /k\nDisallow: /l\nDisallow: /m\n").otherwise("User-agent: *\nAllow: /\n")
    status = F.when(F.col("id") % 10 == 0, 503).otherwise(200)
    verdict = frontier.robots_verdict(body, status, F.concat(F.lit("https://x.example/"), "domain"), F.lit("tidemark"))
    return s.select("id", verdict["allowed"].alias("allowed"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 1.5::DOUBLE AS start_s FROM events")
def dispatch_times(spark, d):
    """When each request of a domain may start."""
    q = table(spark, d, "events", "event_id", "user_id").select("event_id", F.col("user_id").alias("domain"), F.col("event_id").alias("seq"), F.lit(1.5).alias("delay"))
    return frontier.dispatch_times(q).select("event_id", "start_s")


@query("SELECT id, records_json IS NULL AND tier IS NULL AND site_id % 3 <> 0 AND length(url) % 5 <> 0 AS escalate FROM runs WHERE records_json IS NULL OR tier IS NULL")
def escalation(spark, d):
    """Runs whose plain crawl came back with nothing: no record, nothing blocked, dead or unchanged."""
    r = table(spark, d, "runs", "id", "site_id", "url", "tier", "records_json").filter("records_json is null or tier is null")
    n = lambda c: c.cast("int")
    verdict = policy.should_escalate(n(F.col("records_json").isNotNull()), n(F.col("site_id") % 3 == 0), n(F.col("tier").isNotNull()), n(F.length("url") % 5 == 0))
    return r.select("id", verdict.alias("escalate"))


@query(
    "WITH p AS (SELECT DISTINCT substr(md5(CAST(id AS VARCHAR)), 1, 2) AS prefix FROM sites), s AS (SELECT md5(CAST(id AS VARCHAR)) AS state_id FROM sites) "
    "SELECT prefix, CASE WHEN count(DISTINCT state_id) = 1 THEN max(state_id) END AS state_id FROM p JOIN s ON starts_with(state_id, prefix) GROUP BY prefix"
)
def state_prefixes(spark, d):
    """States named by a unique prefix."""
    s = table(spark, d, "sites", "id").select(F.md5(F.col("id").cast("string")).alias("state_id"))
    return graph.unique_prefix(s, s.select(F.substring("state_id", 1, 2).alias("prefix")))


@query(
    "WITH a AS (SELECT user_id AS state_id, event_id AS pos, event_type AS role, CAST(CAST(event_id AS BIGINT) % 20 AS VARCHAR) AS name FROM events), "
    "t AS (SELECT state_id, role, name, max(pos) AS m, min_by(pos * 2, pos) AS dst FROM a WHERE pos % 3 = 0 GROUP BY ALL) "
    "SELECT a.state_id, a.pos, a.role, a.name, t.dst FROM a LEFT JOIN t USING (state_id, role, name)"
)
def actions_with_targets(spark, d):
    """Actions with the transition they fired first."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    a = e.select(F.col("user_id").alias("state_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("role"), (F.col("event_id") % 20).cast("string").alias("name"))
    t = a.filter("pos % 3 = 0").select(F.col("state_id").alias("src"), "role", "name", (F.col("pos") * 2).alias("dst"), F.col("pos").alias("seq"))
    return graph.actions_with_targets(a, t)


@query("SELECT o_custkey AS src, o_orderstatus AS role, o_orderpriority AS name, o_custkey % 10 AS dst FROM orders GROUP BY ALL")
def edge_merge(spark, d):
    """Edges of a saved map and of a resumed walk, each once."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 10).alias("dst"), "o_orderkey")
    known = e.filter("o_orderkey % 2 = 0").drop("o_orderkey").distinct()
    return graph.merge_edges(known, e.filter("o_orderkey % 3 <> 0 or o_orderkey % 2 = 1").drop("o_orderkey"))


_MAPS = (
    "WITH d AS (SELECT id, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) <> 'VARCHAR' THEN CAST(t AS JSON) WHEN json_valid(json_extract_string(t, '$')) THEN CAST(json_extract_string(t, '$') AS JSON) END END AS j "
    "FROM (SELECT id, exploration_json AS t FROM runs)), m AS (SELECT id, json_extract(j, '$.states') AS s FROM d WHERE json_type(j) = 'OBJECT') "
)


@query(
    _MAPS + "SELECT m.id AS run_id, CAST(x.key AS INTEGER) AS seq, json_extract_string(x.value, '$.id') AS state_id, "
    "CASE json_type(json_extract(x.value, '$.actions')) WHEN 'ARRAY' THEN CAST(json_array_length(json_extract(x.value, '$.actions')) AS INTEGER) WHEN 'OBJECT' THEN 1 END AS actions "
    "FROM m, json_each(CASE json_type(s) WHEN 'ARRAY' THEN s WHEN 'OBJECT' THEN json_array(s) END) AS x WHERE x.type = 'OBJECT'"
)
def exploration_states(spark, d):
    """States of stored exploration maps with the sizes of their signals."""
    runs = table(spark, d, "runs", "id", "exploration_json").withColumnRenamed("id", "run_id")
    states, _, _ = graph.explode_map(runs)
    return states.select("run_id", "seq", "state_id", F.size("actions").alias("actions"))


@query(
    "SELECT '/api/' || event_type || '/{id}' AS path, CASE WHEN event_type = 'purchase' THEN 'post' ELSE 'get' END AS method, list_sort(list(DISTINCT CAST(200 + event_id % 3 AS VARCHAR))) AS responses "
    "FROM events WHERE event_id % 4 <> 0 GROUP BY ALL"
)
def synthesized_openapi(spark, d):
    """The OpenAPI document of the observed endpoints, read back operation by operation."""
    document = api_surface.openapi(endpoint_clusters(spark, d), "https://shop.example")
    kind = "struct<paths:map<string,map<string,struct<responses:map<string,struct<description:string>>>>>>"
    paths = document.select(F.explode(F.from_json("document", kind)["paths"]).alias("path", "ops"))
    ops = paths.select("path", F.explode("ops").alias("method", "op"))
    return ops.select("path", "method", F.array_sort(F.map_keys("op.responses")).alias("responses"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS s FROM events), "
    "k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "
    "SELECT user_id AS page_id, epoch_us(min(ts)) AS start_us, count(*) AS mutations FROM k GROUP BY user_id, k"
)
def quiet_sessions(spark, d):
    """Bursts of activity closed by six quiet hours (the streaming operator, over all events at once)."""
    from ..streaming.runs import quiet_sessions as sessions

    e = table(spark, d, "events", "user_id", "ts").withColumnRenamed("user_id", "page_id")
    return sessions(e, 21600.0).select("page_id", micros(F.col("start")).alias("start_us"), "mutations")


_TRIES = (
    "SELECT event_id // 4 AS page, event_id % 4 + 1 AS attempt, CASE WHEN event_id * 7 % 11 < 4 THEN 503 WHEN event_id * 7 % 11 < 6 THEN 429 WHEN event_id * 7 % 11 < 7 THEN 404 ELSE 200 END AS status, event_id FROM events"
)


@query(
    f"WITH t AS (SELECT *, CASE WHEN status = 429 THEN CAST(event_id % 200 AS DOUBLE) END AS after FROM ({_TRIES}) WHERE event_id % 4 < 3), "
    "e AS (SELECT page, coalesce(min(CASE WHEN status IN (200, 404) THEN attempt END), max(attempt)) AS last FROM t GROUP BY page) "
    "SELECT t.page AS page, max(CASE WHEN attempt = last THEN CASE status WHEN 200 THEN 'success' ELSE 'dead' END END) AS outcome, "
    "max(CASE WHEN attempt = last THEN CASE status WHEN 200 THEN '' WHEN 404 THEN 'client error (404)' WHEN 429 THEN 'rate limited (429)' ELSE 'server error (503)' END END) AS reason, "
    "CAST(max(last) AS INTEGER) AS attempts, coalesce(sum(CASE WHEN attempt < last THEN CASE WHEN after IS NOT NULL THEN least(after, 120.0) ELSE 0.5 * pow(2, attempt - 1) END END), 0.0) AS waited_s "
    "FROM t JOIN e ON e.page = t.page GROUP BY t.page"
)
def retry_outcomes(spark, d):
    """How the tries of each page ended, and how long they waited."""
    e, i = table(spark, d, "events", "event_id"), F.col("event_id")
    k = i * 7 % 11
    status = F.when(k < 4, 503).when(k < 6, 429).when(k < 7, 404).otherwise(200)
    tries = e.select(F.floor(i / 4).alias("url"), (i % 4 + 1).cast("int").alias("attempt"), status.alias("status"), F.when(status == 429, (i % 200).cast("double")).alias("retry_after"))
    return retries.outcomes(tries).withColumnRenamed("url", "page")


@query(
    f"SELECT url, tier, (epoch_us(TIMESTAMP '2026-06-01') - us) / 1e6 AS age_seconds FROM (SELECT url, tier, {_US} AS us, row_number() OVER (PARTITION BY url ORDER BY {_US} DESC NULLS LAST, id DESC) AS n FROM runs) WHERE n = 1"
)
def served_maps(spark, d):
    """What is served of each url, with its age on a day."""
    view = store.map_view(table(spark, d, "runs"), F.lit("2026-06-01 00:00:00").cast("timestamp"))
    return view.select("url", "tier", "age_seconds")


_COUNT = "CASE json_type(json_extract(j, '$.{0}')) WHEN 'ARRAY' THEN len(list_filter(CAST(json_extract(j, '$.{0}') AS JSON[]), lambda x: json_type(x) = 'OBJECT')) WHEN 'OBJECT' THEN 1 ELSE 0 END"


@query(
    _MAPS + f"SELECT * FROM (SELECT id AS run_id, {_COUNT.format('states')} AS states, {_COUNT.format('transitions')} AS transitions, {_COUNT.format('skipped')} AS skipped FROM d WHERE json_type(j) = 'OBJECT') WHERE states > 0"
)
def shared_maps(spark, d):
    """The counts of the maps that may be shared."""
    runs = table(spark, d, "runs", "id", "exploration_json").withColumnRenamed("id", "run_id")
    shared = graph.shareable_map(*graph.explode_map(runs))
    return shared.select("run_id", *(F.col(f"exploration.counts.{c}").alias(c if c != "skips" else "skipped") for c in ("states", "transitions", "skipped")))
