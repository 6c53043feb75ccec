"""Queries on pages: the products as HTML, extracted, linked, hashed and healed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import extract, healing, jobs
from ..session import staged
from ..sources.tables import table
from .pipeline import Tier, run_tier

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: A listing of cards: one per product, as the scraped sites show them.
CARD = jobs.job(
    {
        "target": "https://shop.example/c/all",
        "item": "li.card",
        "fields": {
            "name": {"selector": ".card-name"},
            "price": {"selector": "[data-price]", "attr": "data-price", "type": "number"},
            "brand": {"selector": "p.brand > b"},
        },
    }
)


def _card(renamed: bool = False):
    name, css = F.coalesce("name", F.lit("")), "title" if renamed else "card-name"
    return F.concat(
        F.lit('<li class="' + ("tile" if renamed else "card") + '"><h2 class="' + css + '">'), _escape(name), F.lit("</h2>"),
        F.when(F.col("price").isNotNull(), F.concat(F.lit('<span data-price="'), F.col("price").cast("string"), F.lit('">now</span>'))).otherwise(""),
        F.lit('<p class="brand">by <b>'), _escape(F.coalesce("brand", F.lit(""))), F.lit("</b>"),
    )


def _pages(spark, d, renamed: bool = False):
    """Pages of at most 100 products in order; a site's rows spread over its pages."""
    p = table(spark, d, "juice_shop_products", "row_id", "site_id", "name", "price", "brand")
    page = F.floor(F.col("row_id") / 100)
    cards = p.groupBy("site_id", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("row_id", _card(renamed).alias("c")))).alias("l"))
    html = F.concat(F.lit("<html><head><title>All</title><body><nav><a href='/'>Home</a><a href='?page=2'>Next</a><a href='/c/x#top'>X</a><a href='https://other.example/c/y'>Y</a></nav><ul>"), F.array_join("l.c", ""), F.lit("</ul>"))
    url = F.concat(F.lit("https://shop.example/c/"), "site_id", F.lit("/"), "page")
    return cards.select(url.alias("url"), F.col("l.row_id").alias("ids"), html.alias("html"))


_XML = "trim(regexp_replace(name, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


@query(f"SELECT row_id, nullif({_XML}, '') AS name, price, nullif({_XML.replace('name', 'brand')}, '') AS brand FROM juice_shop_products")
def extract_listing(spark, d):
    """Records out of listing pages, typed; the products come back as they were shown."""
    pages = _pages(spark, d)
    rows = extract.extract(pages, CARD)
    ids = pages.select("url", F.posexplode("ids").alias("pos", "row_id"))
    return ids.join(rows, ["url", "pos"]).select("row_id", "name", "price", "brand")


@query("SELECT DISTINCT 'https://shop.example/c/' || site_id || '/' || (row_id // 100) AS url, 'All' AS heading, CAST(NULL AS VARCHAR) AS missing FROM juice_shop_products")
def extract_page(spark, d):
    """One record per page where a job has no item selector."""
    job = jobs.job({"target": "https://shop.example/", "fields": {"heading": {"selector": "title"}, "missing": {"selector": "h1#none"}}})
    return extract.extract(_pages(spark, d), job).select("url", "heading", "missing")


@query(
    "WITH p AS (SELECT DISTINCT site_id AS s, row_id // 100 AS g FROM juice_shop_products) "
    "SELECT 'https://shop.example/c/' || s || '/' || g AS url, unnest(['https://shop.example/', 'https://shop.example/c/' || s || '/' || g || '?page=2', 'https://shop.example/c/x#top']) AS link, 1 AS depth FROM p"
)
def discover_links(spark, d):
    """In-scope links of every page, one deeper."""
    job = jobs.job({"target": "https://shop.example/", "crawl": {"max_depth": 2}})
    return extract.discover_links(_pages(spark, d).select("url", "html", F.lit(0).alias("depth")), job).select("url", "link", "depth")


@query(
    "WITH p AS (SELECT 'https://shop.example/c/' || site_id || '/' || (row_id // 100) AS page, count(*) AS n, count(price) AS m FROM juice_shop_products GROUP BY 1) "
    "SELECT page, unnest(['li', 'h2', 'b', 'span', 'a']) AS tag, unnest([n, n, n, m, 4]) AS elements FROM p"
)
def element_counts(spark, d):
    """Elements of every page by tag."""
    e = extract.elements(_pages(spark, d)).filter(F.col("tag").isin("li", "h2", "b", "span", "a"))
    have = e.groupBy("page", "tag").agg(F.count(F.lit(1)).alias("elements"))
    want = _pages(spark, d).select(F.col("url").alias("page"), F.explode(F.array(*(F.lit(t) for t in ("li", "h2", "b", "span", "a")))).alias("tag"))
    return want.join(have, ["page", "tag"], "left").fillna(0, ["elements"])


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(coalesce(source, 'none'), '\\s+', ' ', 'g')))) AS first_id FROM documents")
def page_states(spark, d):
    """The first page of each page's state: pages that differ in volatile text only share one."""
    docs = table(spark, d, "documents", "doc_id", "source", "fetched_at")
    html = F.concat(F.lit("<body><h1>"), F.lower(F.trim(F.coalesce("source", F.lit("none")))), F.lit("</h1><p>seen "), F.coalesce(F.col("fetched_at").cast("string"), F.lit("2026-01-01")), F.lit(" row "), "doc_id", F.lit("</p>"))
    states = staged(extract.state_ids(docs.select("doc_id", html.alias("html")), "doc_id"), "page_states")
    first = states.groupBy("state_id").agg(F.min("doc_id").alias("first_id"))
    return states.join(first, "state_id").select("doc_id", "first_id")


@query(f"SELECT row_id, name FROM (SELECT row_id, nullif({_XML}, '') AS name, count(*) OVER (PARTITION BY site_id, row_id // 100) AS n FROM juice_shop_products) WHERE n >= 2")
def heal_listing(spark, d):
    """Listing pages whose classes were renamed, read through the fingerprints of an earlier run;
    a lone row is no listing and stays unread."""
    site = lambda pages, seq: pages.select(web.authority(F.col("url")).alias("domain"), seq.alias("seq"), "html")
    before = healing.remember(site(_pages(spark, d), F.lit(1)), CARD)
    changed = _pages(spark, d, renamed=True).withColumn("seq", F.xxhash64("url"))
    got = healing.heal_extract(site(changed, F.col("seq")), CARD, before)
    ids = changed.select("seq", F.posexplode("ids").alias("pos", "row_id"))
    return ids.join(got.filter("field = 'name'"), ["seq", "pos"]).select("row_id", F.col("value").alias("name"))


@query(f"SELECT row_id, name, price, brand FROM (SELECT row_id, nullif({_XML}, '') AS name, price, nullif({_XML.replace('name', 'brand')}, '') AS brand, count(*) OVER (PARTITION BY site_id, row_id // 100) AS n FROM juice_shop_products) WHERE n >= 2")
def healed_records(spark, d):
    """A whole run over listing pages whose classes were renamed: healed values stand in the records."""
    before = healing.remember(_pages(spark, d).select(web.authority(F.col("url")).alias("domain"), F.lit(1).alias("seq"), "html"), CARD)
    changed = staged(_pages(spark, d, renamed=True), "renamed_pages")
    pages = changed.select("url", F.lit(200).alias("status"), "html")
    run = run_tier(Tier("plain", pages), CARD, fingerprints=before, seeds=pages.select("url"), budget=None)
    ids = changed.select("url", F.posexplode("ids").alias("pos", "row_id"))
    return ids.join(run.records, ["url", "pos"]).select("row_id", "name", "price", "brand")
