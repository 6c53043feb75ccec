"""Queries on urls, texts, policies and safety, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import endpoints, policy, redaction, safety, similarity, text, web
from ..operators.history import with_next
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


_AUTH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
#: All urls of the run history and of the scraped posters.
_URLS = "(SELECT url FROM runs UNION ALL SELECT poster AS url FROM streaming_clone_catalog WHERE poster IS NOT NULL)"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    posters = table(spark, d, "streaming_clone_catalog", "poster").filter("poster is not null").withColumnRenamed("poster", "url")
    return table(spark, d, "runs", "url").unionByName(posters)


@query(
    f"SELECT DISTINCT url, {_AUTH} AS authority, {_PATH} AS path, coalesce(nullif({_PATH}, ''), '/') AS url_path, "
    f"lower(regexp_extract(regexp_replace({_AUTH}, '^.*@', ''), '^([^:]*)', 1)) AS host, "
    f"len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) AS depth FROM {_URLS}"
)
def url_parts(spark, d):
    """Authority, host, path and depth of every url."""
    u = F.col("url")
    cols = dict(authority=web.authority(u), path=web.path(u), url_path=web.url_path(u), host=web.host(u), depth=web.path_depth(web.path(u)).cast("bigint"))
    return _urls(spark, d).distinct().select("url", *(c.alias(n) for n, c in cols.items()))


#: Endings of requested urls and the kinds they stand for.
_REQUESTS = (
    ("/a", "Documents"), ("/a.html", "Documents"), ("/a.mjs", "Scripts"), ("/a.css?x=/b.js", "Styles"), ("/a.JPG", "Images"), ("/a.b/c.woff2", "Fonts"), ("/a.mp4#t.js", "Media"),
    ("/a.xml", "Data"), ("/API/a", "Data"), ("/a.tar.gz", "Other"), ("/api/a.svg", "Images"), ("/a.js/", "Documents"),
)


@query("SELECT event_id, [" + ", ".join(f"'{kind}'" for _, kind in _REQUESTS) + "][event_id % 12 + 1] AS category FROM events")
def request_category(spark, d):
    """The kind of each request."""
    ending = F.element_at(F.array(*(F.lit(e) for e, _ in _REQUESTS)), (F.col("event_id") % 12 + 1).cast("int"))
    e = table(spark, d, "events", "event_id", "event_type")
    return e.select("event_id", web.request_category(F.concat(F.lit("https://shop.example/"), "event_type", ending)).alias("category"))


_TEMPLATE = "array_to_string(list_transform(string_split({p}, '/'), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+|(?i:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})|(?i:[0-9a-f]{{24,}})') THEN '{{id}}' ELSE s END), '/')"
_HEX = "md5(CAST(event_id AS VARCHAR))"
_EVENT_PATH = (
    f"'/users/' || user_id || '/' || event_type || '/' || CASE event_id % 5 WHEN 0 THEN {_HEX} WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'v' || event_id WHEN 3 THEN substr({_HEX}, 1, 23) "
    f"ELSE upper(substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9, 4) || '-' || substr({_HEX}, 13, 4) || '-' || substr({_HEX}, 17, 4) || '-' || substr({_HEX}, 21, 12)) END"
)


@query(f"SELECT event_id, {_TEMPLATE.format(p=_EVENT_PATH)} AS path FROM events")
def path_template(spark, d):
    """Paths with identifiers templated: numbers, long hexadecimals and UUIDs, but no slugs."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    i, h = F.col("event_id"), F.md5(F.col("event_id").cast("string"))
    part = lambda at, n: F.substring(h, at, n)
    uuid = F.upper(F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)))
    last = F.when(i % 5 == 0, h).when(i % 5 == 1, i.cast("string")).when(i % 5 == 2, F.concat(F.lit("v"), i)).when(i % 5 == 3, part(1, 23)).otherwise(uuid)
    path = F.concat(F.lit("/users/"), F.col("user_id"), F.lit("/"), F.col("event_type"), F.lit("/"), last)
    return e.select("event_id", endpoints.template_path(path).alias("path"))


@query(
    "SELECT DISTINCT url FROM runs WHERE regexp_full_match(" + _PATH + ", '(?s)/c/.*') AND NOT regexp_full_match(" + _PATH + ", '(?s)/c/m.*-.*')"
)
def in_scope(spark, d):
    """Urls inside a crawl's scope: include and exclude globs on the path."""
    u = table(spark, d, "runs", "url").distinct()
    return u.filter(web.in_scope(F.col("url"), F.col("url"), include=["/c/*"], exclude=["/c/m*-*"]))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '(?s).*[xz].*') THEN 'skipped: matched an --exclude-element pattern' WHEN NOT regexp_full_match(p_name, '(?s).*a.*') THEN 'skipped: did not match an --include-element pattern' ELSE 'element rules permit this action' END AS reason FROM part")
def element_rules(spark, d):
    """Include and exclude globs on names; exclude wins."""
    return table(spark, d, "part", "p_partkey", "p_name").select("p_partkey", web.element_rule(F.col("p_name"), ["*a*"], ["*[xz]*"])["reason"].alias("reason"))


@query(f"SELECT DISTINCT coalesce(nullif({_AUTH}, ''), url) AS site FROM (SELECT url FROM runs UNION ALL SELECT domain FROM sites)")
def site_of(spark, d):
    """The site of a url or a bare domain."""
    every = table(spark, d, "runs", "url").unionByName(table(spark, d, "sites", "domain").withColumnRenamed("domain", "url"))
    return every.select(web.site_of(F.col("url")).alias("site")).distinct()


@query("SELECT id, 'https://' || domain AS address FROM sites")
def complete_address(spark, d):
    """Addresses with a scheme."""
    return table(spark, d, "sites", "id", "domain").select("id", web.complete_address(F.col("domain")).alias("address"))


@query(
    "WITH t(target, declared) AS (VALUES ('http://localhost:3000/a', false), ('http://127.0.0.9/', false), ('http://[::1]/', false), ('http://10.0.0.5/', true), "
    "('http://10.0.0.5/', false), ('http://10.0.0.5.evil.test/', true), ('https://shop.example/', true), ('http://127.evil.test/', false)) "
    "SELECT target, declared, target IN ('http://localhost:3000/a', 'http://127.0.0.9/', 'http://[::1]/') OR (declared AND target = 'http://10.0.0.5/') AS sandbox FROM t"
)
def sandbox(spark, d):
    """Which targets count as a sandbox."""
    rows = [
        ("http://localhost:3000/a", False), ("http://127.0.0.9/", False), ("http://[::1]/", False), ("http://10.0.0.5/", True), ("http://10.0.0.5/", False),
        ("http://10.0.0.5.evil.test/", True), ("https://shop.example/", True), ("http://127.evil.test/", False),
    ]
    t = spark.createDataFrame(rows, "target string, declared boolean")
    return t.withColumn("sandbox", web.is_sandbox(F.col("target"), F.col("declared")))


@query(
    "SELECT row_id, try_cast(replace(nullif(regexp_extract(name, '(?:(?:^|[^\\pL\\pN_.])(-))?(\\d[\\d,]*(?:\\.\\d+)?|\\.\\d+)', 2), ''), ',', '') AS DOUBLE) * "
    "CASE WHEN regexp_extract(name, '(?:(?:^|[^\\pL\\pN_.])(-))?(\\d[\\d,]*(?:\\.\\d+)?|\\.\\d+)', 1) = '-' THEN -1 ELSE 1 END AS number FROM juice_shop_products"
)
def number_coercion(spark, d):
    """First number in every product name."""
    return table(spark, d, "juice_shop_products", "row_id", "name").select("row_id", text.coerce_number(F.col("name")).alias("number"))


@query("SELECT row_id, trim(regexp_replace(name, '[\\s\\pZ\\x{0085}\\x{000B}]+', ' ', 'g'), ' ') AS name FROM juice_shop_products")
def whitespace_normalise(spark, d):
    """Product names with single blanks."""
    return table(spark, d, "juice_shop_products", "row_id", "name").select("row_id", text.squeeze(F.col("name")).alias("name"))


@query("SELECT row_id, replace(replace(replace(coalesce(name, ''), '\\', '\\\\'), '|', '\\|'), chr(10), ' ') AS cell, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS file FROM juice_shop_products")
def cell_and_file_names(spark, d):
    """Names safe in a Markdown table and as file names."""
    n = F.col("name")
    return table(spark, d, "juice_shop_products", "row_id", "name").select("row_id", text.markdown_cell(n).alias("cell"), text.file_safe(n).alias("file"))


@query(
    "SELECT event_id, CASE WHEN s < 400 THEN 'success' WHEN s = 429 OR s >= 500 THEN 'transient' ELSE 'permanent' END AS kind, "
    "CASE WHEN s < 400 THEN '' WHEN s = 429 THEN 'rate limited (429)' WHEN s >= 500 THEN 'server error (' || s || ')' ELSE 'client error (' || s || ')' END AS reason "
    "FROM (SELECT event_id, 200 + event_id % 400 AS s FROM events)"
)
def status_classify(spark, d):
    """Kind and reason of a status."""
    c = policy.classify_status(F.lit(200) + F.col("event_id") % 400)
    return table(spark, d, "events", "event_id").select("event_id", c["kind"].alias("kind"), c["reason"].alias("reason"))


@query(
    "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN least(CAST(event_id % 200 AS DOUBLE), 120.0) ELSE 0.5 * pow(2, event_id % 5) END AS wait_s FROM events"
)
def retry_wait(spark, d):
    """Seconds before the next try."""
    e = F.col("event_id")
    after = F.when(e % 3 != 0, (e % 200).cast("double"))
    return table(spark, d, "events", "event_id").select("event_id", policy.retry_wait(1 + e % 5, F.lit(0.5), after, F.lit(True)).alias("wait_s"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) ELSE greatest(epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1995-01-01'), 0.0) END AS seconds FROM orders"
)
def retry_after(spark, d):
    """Retry-After headers, as seconds or as dates, in seconds."""
    date = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd MMM yyyy HH:mm:ss")
    raw = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 90).cast("string")).otherwise(F.concat(F.lit("Mon, "), date, F.lit(" GMT")))
    now = F.lit("1995-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", policy.retry_after_seconds(raw, now).alias("seconds"))


_MARK = "list_value(" + ", ".join(f"'{m}'" for _, m in policy.CHALLENGES) + ")[1 + doc_id % 12]"
_HTML = f"coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN upper({_MARK}) ELSE '' END"


@query(
    "SELECT doc_id, vendor, marker FROM (SELECT doc_id, CASE "
    + " ".join(f"WHEN contains(h, '{m}') THEN '{v}'" for v, m in policy.CHALLENGES)
    + " END AS vendor, CASE "
    + " ".join(f"WHEN contains(h, '{m}') THEN '{m}'" for _, m in policy.CHALLENGES)
    + f" END AS marker FROM (SELECT doc_id, lower({_HTML}) AS h FROM documents)) WHERE vendor IS NOT NULL"
)
def challenge_scan(spark, d):
    """Pages that show an anti-bot challenge."""
    marks = F.array(*(F.lit(m) for _, m in policy.CHALLENGES))
    html = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.upper(F.element_at(marks, (F.col("doc_id") % 12 + 1).cast("int")))).otherwise(""))
    rows = table(spark, d, "documents", "doc_id", "text").withColumn("c", policy.detect_challenge(html))
    return rows.filter("c is not null").select("doc_id", "c.vendor", "c.marker")


_SECRET = "coalesce(text, '') || ' password=' || md5(CAST(doc_id AS VARCHAR)) || '; Authorization: Bearer ' || md5('b' || doc_id) || ' key sk-' || md5('k' || doc_id) || ' and AKIA' || upper(substr(md5('a' || doc_id), 1, 16)) || ' end'"


def _redact_sql(expr: str) -> str:
    for pattern, to in redaction.RULES:
        flags = "(?is)" if pattern.startswith("(?iU)") else "(?s)"
        body = pattern[pattern.index(")") + 1 :] if pattern.startswith("(?") and pattern[2] in "iUs" else pattern
        expr = f"regexp_replace({expr}, '{flags}{body}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return expr


@query(f"SELECT doc_id, {_redact_sql(_SECRET)} AS text FROM documents")
def redact_text(spark, d):
    """Documents with planted secrets, redacted."""
    k = F.col("doc_id").cast("string")
    h = lambda p: F.md5(F.concat(F.lit(p), k))
    planted = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" password="), F.md5(k), F.lit("; Authorization: Bearer "), h("b"), F.lit(" key sk-"), h("k"),
        F.lit(" and AKIA"), F.upper(F.substring(h("a"), 1, 16)), F.lit(" end"),
    )
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", redaction.redact(planted).alias("text"))


@query(
    "SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^\\pL\\pN_])(?:" + "|".join(safety.destructive_words()) + ")(?:$|[^\\pL\\pN_])') AS destructive FROM documents WHERE text IS NOT NULL"
)
def destructive_labels(spark, d):
    """Texts with a destructive word in one of seven languages."""
    return table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", safety.is_destructive(F.col("text")).alias("destructive"))


@query(
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not located' WHEN event_id % 5 = 0 THEN 'disabled' WHEN event_id % 3 = 0 THEN 'actuate' ELSE 'covered' END AS verdict FROM events"
)
def actuation(spark, d):
    """What can be done with a control."""
    e = F.col("event_id")
    return table(spark, d, "events", "event_id").select("event_id", safety.actuation(e % 7 != 0, e % 5 == 0, e % 3 == 0).alias("verdict"))


@query(
    "WITH t AS (SELECT event_id, ['textbox', 'combobox', 'listbox'][1 + event_id % 3] AS role, ['email', 'tel', 'date', 'search', 'password', NULL][1 + event_id % 6] AS it FROM events) "
    "SELECT event_id, CASE it WHEN 'email' THEN 'email' WHEN 'tel' THEN 'phone' WHEN 'date' THEN 'date' WHEN 'search' THEN 'text' ELSE CASE WHEN role IN ('combobox', 'listbox') THEN 'choice' ELSE 'unknown' END END AS kind FROM t"
)
def field_kind(spark, d):
    """What a form field asks for."""
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % n + 1).cast("int"))
    kind = safety.field_kind(pick(["textbox", "combobox", "listbox"], 3), pick(["email", "tel", "date", "search", "password", None], 6))
    return table(spark, d, "events", "event_id").select("event_id", kind["kind"].alias("kind"))


@query(
    "SELECT doc_id, CASE WHEN s >= 86400 THEN (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END "
    "WHEN s >= 3600 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END "
    "WHEN s >= 60 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END ELSE 'just now' END AS age "
    "FROM (SELECT doc_id, greatest(CAST(floor(epoch_us(TIMESTAMPTZ '2026-04-15 00:00:00+00') / 1000000.0 - epoch_us(fetched_at) / 1000000.0) AS BIGINT), 0) AS s FROM documents WHERE fetched_at IS NOT NULL)"
)
def human_age(spark, d):
    """Ages in words."""
    s = F.floor(F.unix_micros(F.lit("2026-04-15 00:00:00").cast("timestamp")) / 1e6 - F.unix_micros("fetched_at") / 1e6)
    return table(spark, d, "documents", "doc_id", "fetched_at").filter("fetched_at is not null").select("doc_id", text.human_age(s).alias("age"))


_SCRIPT = "'fetch(\"/api/' || event_type || '/' || user_id || '?x=1\");load(''/static/' || event_type || '.js'');go(`/v1/' || event_type || '`)'"


@query(
    f"SELECT user_id, list_sort(list_distinct(flatten(list([{_TEMPLATE.format(p=chr(39) + '/api/' + chr(39) + ' || event_type || ' + chr(39) + '/' + chr(39) + ' || user_id')}, '/v1/' || event_type])))) AS endpoints FROM events GROUP BY user_id"
)
def quoted_endpoints(spark, d):
    """Endpoint candidates in scripts, one list per user."""
    t, u = F.col("event_type"), F.col("user_id")
    script = F.concat(F.lit('fetch("/api/'), t, F.lit("/"), u, F.lit("?x=1\");load('/static/"), t, F.lit(".js');go(`/v1/"), t, F.lit("`)"))
    rows = table(spark, d, "events", "event_type", "user_id").select("user_id", endpoints.script_endpoints(script).alias("e"))
    return rows.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("e")))).alias("endpoints"))


@query(
    "WITH w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS a, lead(list_distinct(string_split(text, ' '))) OVER (PARTITION BY site_id ORDER BY doc_id) AS b FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard FROM w WHERE b IS NOT NULL"
)
def jaccard_tokens(spark, d):
    """Shared words of consecutive documents of a site."""
    rows = table(spark, d, "documents", "doc_id", "site_id", "text").filter("text is not null").select("doc_id", "site_id", F.array_distinct(F.split("text", " ", -1)).alias("a"))
    w = with_next(rows, "site_id", "doc_id", ["a"], F.floor(F.col("doc_id") / F.lit(10_000))).withColumn("b", F.col("next.a")).filter("b is not null")
    return w.select("doc_id", similarity.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(
    "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM c), "
    "p AS (SELECT x.user_id FROM u x JOIN u y ON y.user_id = x.user_id + 1), t AS (SELECT DISTINCT event_type FROM c) "
    "SELECT p.user_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) / sum(greatest(coalesce(a.n, 0), coalesce(b.n, 0))) AS similarity FROM p CROSS JOIN t "
    "LEFT JOIN c a ON a.user_id = p.user_id AND a.event_type = t.event_type LEFT JOIN c b ON b.user_id = p.user_id + 1 AND b.event_type = t.event_type GROUP BY p.user_id"
)
def multiset_similarity(spark, d):
    """Event mixes of neighbouring users compared as multisets."""
    c = table(spark, d, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    nxt = m.select((F.col("user_id") - 1).alias("user_id"), F.col("m").alias("o"))
    return m.join(nxt, "user_id").select("user_id", similarity.multiset_similarity(F.col("m"), F.col("o")).alias("similarity"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN 1.5 END, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END, 0.0) AS delay FROM orders")
def crawl_delay(spark, d):
    """The delay that applies: configured, robots, none."""
    k = F.col("o_orderkey")
    delay = policy.crawl_delay(F.when(k % 4 == 0, F.lit(1.5)), F.when(k % 3 != 7, (k % 9).cast("double")), k % 2 == 0)
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", delay.alias("delay"))


@query(
    "SELECT vec_id, bit_count(xor(vec_id * 7919, vec_id * 104729)) AS distance, 1 - bit_count(xor(vec_id * 7919, vec_id * 104729)) / 64.0::DOUBLE AS similarity FROM embeddings"
)
def hash_distance(spark, d):
    """Bit distance and similarity of two hashes."""
    a, b = F.col("vec_id") * 7919, F.col("vec_id") * 104729
    return table(spark, d, "embeddings", "vec_id").select("vec_id", similarity.hamming(a, b).alias("distance"), similarity.visual_similarity(a, b).alias("similarity"))
