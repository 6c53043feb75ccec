"""Records, links and states out of pages, by declarative selectors."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..functions.arrow import column_map
from ..functions.text import coerce_number
from . import dom
from .jobs import Field, Job


def value_of(node: dom.Node | None, spec: Field) -> str | None:
    """Text or attribute of an element, still as text; an absent or empty text is null."""
    if node is None:
        return None
    if spec.attr is not None:
        return node.attrs.get(spec.attr)
    return dom.normal_text(node) or None


def first(root: dom.Node, selector: str) -> dom.Node | None:
    return next(dom.matching(root, selector), None)


def typed(job: Job, value: Column) -> list[Column]:
    """Columns of a job's fields out of an array of texts, numbers coerced."""
    out = []
    for i, (name, spec) in enumerate(job.fields.items()):
        text = value[i]
        out.append((coerce_number(text) if spec.type == "number" else text).alias(name))
    return out


def extract(pages: DataFrame, job: Job, key: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, fields...): one row per item, in document order, or one per page.

    Without an item selector every page gives one row, all null where nothing matches;
    with one, a page without matches gives none. A null page counts as empty.
    """
    specs = list(job.fields.values())
    for spec in specs:
        dom.compile_selector(spec.selector)
    schema = pa.schema([("k", pa.string()), ("pos", pa.int32()), ("v", pa.list_(pa.string()))])

    def walk(keys, texts):
        out: list[list] = [[], [], []]
        for k, text in zip(keys, texts):
            page = dom.parse(text)
            roots = dom.select(page, job.item) if job.item else [page]
            for pos, root in enumerate(roots):
                for c, v in zip(out, (k, pos, [value_of(first(root, s.selector), s) for s in specs])):
                    c.append(v)
        return out

    kind = dict(pages.dtypes)[key]
    slim = pages.select(F.col(key).cast("string").alias("k"), F.col(html).cast("string").alias("html"))
    rows = slim.mapInArrow(column_map(walk, schema, 128), "k string, pos int, v array<string>")
    return rows.select(F.col("k").cast(kind).alias(key), "pos", *typed(job, F.col("v")))


_LINKS = pa.schema([("url", pa.string()), ("pos", pa.int32()), ("link", pa.string()), ("is_next", pa.bool_())])


def page_links(pages: DataFrame, next_selector: str | None = None) -> DataFrame:
    """(url, pos, link, is_next): resolved links in document order, the first of each kept, and
    the pagination link at position -1."""

    def walk(urls, texts):
        out: list[list] = [[], [], [], []]
        for url, text in zip(urls, texts):
            page = dom.parse(text)
            seen = {}
            for node in dom.select(page, "a[href]"):
                try:
                    seen.setdefault(urljoin(url, node.attrs["href"]), len(seen))
                except ValueError:
                    continue
            for link, pos in seen.items():
                for c, v in zip(out, (url, pos, link, False)):
                    c.append(v)
            if next_selector:
                node = first(page, next_selector)
                if node is not None and node.attrs.get("href"):
                    for c, v in zip(out, (url, -1, urljoin(url, node.attrs["href"]), True)):
                        c.append(v)
        return out

    return pages.select("url", "html").mapInArrow(column_map(walk, _LINKS, 128), "url string, pos int, link string, is_next boolean")


def discover_links(pages: DataFrame, job: Job) -> DataFrame:
    """(url, link, depth, pos): what a crawl follows from each page.

    Pages deeper than the limit are filtered before any HTML is parsed; scope is
    decided by built-in expressions on the links.
    """
    limit = job.get("crawl", "max_depth")
    crawling = job.options.get("crawl") is not None
    if not crawling and not job.get("pagination", "next"):  # no link would be kept: nothing is parsed
        return pages.filter(F.lit(False)).select("url", F.lit(None).cast("string").alias("link"), F.col("depth").cast("int"), F.lit(0).alias("pos"))
    deep = pages.filter(F.col("depth") + 1 <= limit) if crawling and limit is not None else pages
    links = page_links(deep if crawling else pages, job.get("pagination", "next"))
    if crawling and limit is not None and job.get("pagination", "next"):
        rest = page_links(pages.filter(F.col("depth") + 1 > limit), job.get("pagination", "next")).filter("is_next")
        links = links.unionByName(rest)
    scope = web.in_scope(
        F.col("link"), F.lit(job.target), job.get("crawl", "include", ()), job.get("crawl", "exclude", ()), job.get("crawl", "same_origin", True)
    )
    kept = links.filter(F.col("is_next") | (F.lit(crawling) & scope))
    depth = F.when(F.col("is_next"), F.col("depth")).otherwise(F.col("depth") + 1)
    return kept.join(pages.select("url", "depth"), "url").select("url", "link", depth.alias("depth"), "pos")


_ELEMENTS = pa.schema(
    [
        ("page", pa.string()), ("idx", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("element_id", pa.string()),
        ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
        ("ancestors", pa.list_(pa.string())), ("sibling_index", pa.int32()), ("descendants", pa.map_(pa.string(), pa.int32())),
    ]
)
ELEMENTS_DDL = (
    "page string, idx int, parent int, depth int, tag string, element_id string, classes array<string>, attrs map<string,string>, "
    "text string, ancestors array<string>, sibling_index int, descendants map<string,int>"
)


def elements(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Every element of every page with its fingerprint, in document order by ``idx``."""

    def walk(keys, texts):
        out: list[list] = [[] for _ in _ELEMENTS]
        for k, text in zip(keys, texts):
            root = dom.parse(text)
            prints = dom.fingerprints(root)
            for i, node in enumerate(root.iter()):
                p = prints[id(node)]
                node.index = i
                row = (
                    k, i, node.parent.index if node.parent is not None else None, node.depth, p["tag"], p["element_id"], p["classes"],
                    list(p["attrs"].items()), p["text"], p["ancestors"], p["sibling_index"], list(p["descendants"].items()),
                )
                for c, v in zip(out, row):
                    c.append(v)
        return out

    slim = pages.select(F.col(key).cast("string").alias("page"), F.col(html).cast("string").alias("html"))
    return slim.mapInArrow(column_map(walk, _ELEMENTS, 64), ELEMENTS_DDL)


def state_ids(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, state_id) of every page."""
    schema = pa.schema([("k", pa.string()), ("state_id", pa.string())])
    walk = lambda keys, texts: [keys, [dom.state_id(t) for t in texts]]
    slim = pages.select(F.col(key).cast("string").alias("k"), F.col(html).cast("string").alias("html"))
    rows = slim.mapInArrow(column_map(walk, schema, 128), "k string, state_id string")
    return rows.select(F.col("k").cast(dict(pages.dtypes)[key]).alias(key), "state_id")


SPEC_REFERENCE = r"""(?i)["']([^"'\s]*(?:openapi|swagger|api[-_]?docs)[^"'\s]*)["']"""
SPEC_ATTRIBUTE = r"""(?i)spec-url\s*=\s*["']([^"']+)["']"""
SCRIPT_SOURCE = r"""(?i)<script\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""


def _references(pages: DataFrame, patterns: list[str]) -> DataFrame:
    found = F.concat(*(F.regexp_extract_all("html", F.lit(p)) for p in patterns))
    refs = pages.select("url", F.posexplode(found).alias("pos", "ref")).withColumn("ref", F.trim("ref"))
    refs = refs.filter((F.col("ref") != "") & ~F.col("ref").rlike("^(#|data:|javascript:)"))
    links = refs.withColumn("link", web.resolve(F.col("url"), F.col("ref"))).filter(F.col("link").rlike("^https?://"))
    return links.groupBy("url", "link").agg(F.min("pos").alias("pos"))


def spec_candidates(pages: DataFrame) -> DataFrame:
    """(url, link, pos): API description files a page's HTML refers to, first mention counts."""
    return _references(pages, [SPEC_ATTRIBUTE, SPEC_REFERENCE])


def script_sources(pages: DataFrame) -> DataFrame:
    """(url, link, pos): scripts a page loads from its own host."""
    links = _references(pages, [SCRIPT_SOURCE])
    return links.filter(web.authority(F.col("link")) == web.authority(F.col("url")))


