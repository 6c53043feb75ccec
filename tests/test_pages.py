"""Pages: the tree, selectors, extraction, states, healing and crawling."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import dom, extract, frontier, healing, jobs
from tidemark.plans import map_queries, pipeline

PAGE = """<html><head><title>T &amp; U</title><script>if (a < b) "</p>"</script></head><body>
<nav><a href="/one">One</a><a href='two?x=1'>Two</a></nav>
<ul id=list><li class="card big"><h2>A</h2><p>first<b>bold<br>x<li class="card" data-p="£1,199.99"><h2>B&nbsp;C</h2><p>second</ul>
<p>one<p>two<div>three</div></body></html>"""


def texts(selector, html=PAGE):
    return [dom.normal_text(n) for n in dom.select(dom.parse(html), selector)]


SELECTORS = [
    ("title", ["T & U"]), ("li h2", ["A", "B\xa0C"]), ("li.card.big > h2", ["A"]), ("#list > li:nth-child(2) h2", ["B\xa0C"]), ("li:last-child p", ["second"]),
    ("a[href^='/']", ["One"]), ("a[href*=x]", ["Two"]), ("a + a", ["Two"]), ("a ~ a", ["Two"]), ("h2, title", ["T & U", "A", "B\xa0C"]), ("li:not(.big) h2", ["B\xa0C"]),
    ("[data-p]", ["B\xa0Csecond"]), ("p:contains('two')", ["two"]), ("div", ["three"]), ("li:nth-child(odd) h2", ["A"]), ("li:nth-child(2n) h2", ["B\xa0C"]), ("table", []),
    ("a[href$='=1']", ["Two"]), ("li[class~=big] h2", ["A"]), ("nav a:first-of-type", ["One"]), ("body > p:nth-last-of-type(1)", ["two"]), ("*[id=list] b", ["boldx"]),
]


@pytest.mark.parametrize("selector,want", SELECTORS)
def test_selectors(selector, want):
    assert texts(selector) == want


@pytest.mark.parametrize("bad", ["", "a:hover", "a >", "a,,b", "a[", "::before"])
def test_unsupported_selectors_are_errors(bad):
    with pytest.raises((dom.SelectorError, IndexError)):
        if bad == "a >":
            dom.compile_selector("a > ,b")
        dom.compile_selector(bad)
        raise dom.SelectorError


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab=\"' &;!-pli", max_size=80))
def test_any_text_parses(html):
    root = dom.parse(html)
    assert all(n.parent is not None for n in list(root.iter())[1:]) and dom.state_id(html)


STATES = [
    ("<p>seen 2026-01-01T10:00:00Z</p>", "<p>seen 2027-05-05 11:12</p>", True), ("<p>id 550e8400-e29b-41d4-a716-446655440000</p>", "<p>id 123e4567-e89b-12d3-a456-426614174000</p>", True),
    ("<p>3 items</p>", "<p>14 items</p>", True), ("<p>a   b</p>", "<p>a b</p>", True), ('<b role="x" type="y">a</b>', '<b type="y" role="x">a</b>', True),
    ("<p>a</p><script>1</script>", "<p>a</p><script>2</script>", True), ('<p class="a" id="b">x</p>', "<p>x</p>", True),
    ("<p>a</p>", "<p>b</p>", False), ("<p>a</p>", "<div>a</div>", False), ('<button disabled="">a</button>', "<button>a</button>", False),
]


@pytest.mark.parametrize("a,b,same", STATES)
def test_state_ids(a, b, same):
    assert (dom.state_id(a) == dom.state_id(b)) == same


JOB = {"target": "https://h.example/", "item": "li.card", "fields": {"name": {"selector": "h2"}, "price": {"selector": "[data-p]", "attr": "data-p", "type": "number"}}}


def test_extraction(spark):
    pages = spark.createDataFrame([("a", PAGE), ("b", ""), ("c", None), ("d", "<li class=card data-p='x'><h2> </h2>")], "url string, html string").withColumn("pos", F.lit(9)).withColumn("k", F.lit("z"))
    got = [tuple(r) for r in extract.extract(pages, jobs.job(JOB)).orderBy("url", "pos").collect()]
    assert got == [("a", 0, "A", None), ("a", 1, "B\xa0C", None), ("d", 0, None, None)]
    whole = jobs.job({"target": "t", "fields": {"t": {"selector": "title"}, "p": {"selector": "[data-p]", "attr": "data-p", "type": "number"}}})
    got = [tuple(r) for r in extract.extract(pages, whole).orderBy("url").collect()]
    assert got == [("a", 0, "T & U", 1199.99), ("b", 0, None, None), ("c", 0, None, None), ("d", 0, None, None)]
    assert extract.extract(pages.limit(0), whole).count() == 0


@pytest.mark.parametrize("bad", [{}, {"target": ""}, {"target": "t", "nope": 1}, {"target": "t", "fields": {"a": {"selector": "x", "kind": 1}}}, {"target": "t", "fields": {"a": {"selector": "x", "type": "date"}}}, {"target": "t", "retry": {"tries": 1}}, []])
def test_bad_jobs(bad):
    with pytest.raises(jobs.ConfigError):
        jobs.job(bad)


def test_yaml_job_schema():
    job = jobs.load("target: t\nfields:\n  a: {selector: x}\n  b: {selector: y, type: number}\n")
    assert job.schema().simpleString() == "struct<a:string,b:double>"


def test_links_and_scripts(spark):
    html = PAGE + """<script src="/app.js"></script><script data-src="/no.js"></script><script src="https://cdn.example/x.js"></script><redoc spec-url='/spec'></redoc> "/v2/api-docs" '#swagger'"""
    pages = spark.createDataFrame([("https://h.example/d/", html, 0)], "url string, html string, depth int")
    job = jobs.job({"target": "https://h.example/", "crawl": {"exclude": ["/one"], "max_depth": 1}, "pagination": {"next": "nav a:last-child"}})
    got = sorted(tuple(r) for r in extract.discover_links(pages, job).select("link", "depth").collect())
    assert got == [("https://h.example/d/two?x=1", 0), ("https://h.example/d/two?x=1", 1)]
    deep = extract.discover_links(pages.withColumn("depth", F.lit(1)), job)
    assert [tuple(r) for r in deep.select("link", "depth").collect()] == [("https://h.example/d/two?x=1", 1)]
    assert [r["link"] for r in extract.script_sources(pages).collect()] == ["https://h.example/app.js"]
    assert [r["link"] for r in extract.spec_candidates(pages).orderBy("pos").collect()] == ["https://h.example/spec", "https://h.example/v2/api-docs"]


def listing(names, css="card", wrap=False):
    rows = "".join(f'<li class="{css}" data-id="{i}"><h3 class="n">{n}</h3><span class="p">{i}.50</span></li>' for i, n in enumerate(names))
    rows = f"<div><ul>{rows}</ul></div>" if wrap else f"<ul>{rows}</ul>"
    return f"<html><body><header><h1>Shop</h1></header>{rows}<footer><p>end</p></footer></body></html>"


def mutate(html, ops, rng):
    """Doctored pages: the kinds of change that break selectors."""
    for op in ops:
        if op == "class":
            html = html.replace('class="n"', 'class="n-' + str(rng.randint(1, 99)) + '"')
        elif op == "row":
            html = html.replace('class="card"', 'class="tile x"')
        elif op == "wrap":
            html = html.replace("<ul>", "<section><ul>").replace("</ul>", "</ul></section>")
        elif op == "attr":
            html = html.replace("data-id=", "data-key=")
        elif op == "sibling":
            html = html.replace("<footer>", "<aside><p>ad</p></aside><footer>")
        elif op == "reorder":
            html = html.replace("<header><h1>Shop</h1></header>", "").replace("<footer>", "<header><h1>Shop</h1></header><footer>")
        elif op == "extra":
            html = html.replace('<span class="p">', '<em>new</em><span class="p">')
    return html


def test_healing_over_a_mutation_corpus():
    """300 plans of one to five changes; the right element must be found in 95 % or more."""
    names = ["Lantern", "Copper Kettle", "Blue Mug", "Trivet", "Woven Basket", "Oak Stool"]
    page = listing(names)
    hits, rng = 0, random.Random(4)
    for plan in range(300):
        ops = rng.sample(["class", "row", "wrap", "attr", "sibling", "reorder", "extra"], rng.randint(1, 5))
        at = rng.randrange(len(names))
        old = dom.fingerprint(dom.select(dom.parse(page), "li.card h3")[at])
        found = healing.heal(old, list(dom.parse(mutate(page, ops, rng)).iter()))
        hits += found.confident and found.node.tag == "h3" and found.node.text() == names[at]
    assert hits >= 285


def test_score_parts():
    a = dom.fingerprint(dom.select(dom.parse("<p class='x y' id=i data-a=1>hi</p>"), "p")[0])
    assert healing.score(a, a) == 1.0
    assert healing.score(a | {"visual_hash": 0}, a | {"visual_hash": -1}) < healing.score(a | {"visual_hash": 0}, a)
    assert healing.heal(a, []) is None
    two = list(dom.parse("<p>hi</p><p>hi</p>").iter())
    assert healing.heal(a, two[2:]).index == 0


def test_heal_pipeline(spark):
    job = jobs.job({"target": "https://h.example/", "item": "li.card", "fields": {"name": {"selector": "h3.n"}, "price": {"selector": ".p", "type": "number"}}})
    frame = lambda seq, html: spark.createDataFrame([("h.example", seq, html)], "domain string, seq bigint, html string")
    before = healing.remember(frame(1, listing(["A", "B", "C"])), job).withColumn("run_seq", F.lit(1))
    assert {r["key"] for r in before.collect()} == {"li.card::", "li.card::name", "li.card::price"}
    stored = healing.prior(before, 2).drop("run_seq")
    html = listing(["D", "E", "F"], css="tile", wrap=True).replace('class="n"', 'class="title"')
    got = healing.heal_extract(frame(2, html), job, stored)
    assert [r["value"] for r in got.filter("field = 'name'").orderBy("pos").collect()] == ["D", "E", "F"]
    events = healing.heal_events(got)
    assert events.filter("pos = -1 and used").count() == 1
    assert tuple(healing.heal_counts(events).first()) == (4, 0)
    # nothing stored by an earlier run: nothing is healed
    assert healing.heal_extract(frame(1, html), job, healing.prior(before, 1).drop("run_seq")).count() == 0
    # a lone look-alike is refused, with an event
    lone = healing.heal_extract(frame(2, listing(["D"], css="tile")), job, stored)
    assert [(r["pos"], r["used"]) for r in lone.collect()] == [(-1, False)]
    # a page without anything alike is passed over
    assert healing.heal_extract(frame(2, "<p>closed</p>"), job, stored).filter("used").count() == 0


def test_crawl(spark):
    link = lambda *urls: "".join(f"<a href='{u}'>x</a>" for u in urls)
    pages = spark.createDataFrame(
        [
            ("https://h.example/", 200, link("/a", "/b", "/admin", "https://o.example/")), ("https://h.example/a", 200, link("/c", "/")),
            ("https://h.example/b", 404, "x"), ("https://h.example/c", 200, link("/d")), ("https://h.example/d", 200, ""), ("https://h.example/admin", 200, ""),
        ],
        "url string, status int, html string",
    )
    job = jobs.job({"target": "https://h.example/", "crawl": {"max_depth": 2}})
    out = frontier.crawl(pages, job, allowed=lambda u: ~u.contains("admin"))
    assert sorted((r["url"][18:], r["depth"]) for r in out["visited"].collect()) == [("", 0), ("a", 1), ("c", 2)]
    assert [r["url"] for r in out["blocked"].collect()] == ["https://h.example/admin"] and [r["status"] for r in out["dead"].collect()] == [404]
    assert out["rest"].count() == 0
    part = frontier.crawl(pages, job, budget=1)
    assert part["visited"].count() == 1 and part["rest"].count() == 3
    again = frontier.crawl(pages, job, seeds=part["rest"], seen=part["seen"])
    assert sorted(r["url"][18:] for r in again["visited"].collect()) == ["a", "admin", "c"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    bodies = spark.createDataFrame(
        [
            ("i", f"<sitemapindex {ns}><sitemap><loc> a </loc></sitemap><sitemap><loc>i</loc></sitemap><sitemap><loc>bad</loc></sitemap></sitemapindex>"),
            ("a", f"<urlset {ns}><url><loc>u1</loc></url><url><loc>u2</loc></url></urlset>"), ("bad", "<urlset><url>"), ("other", f"<urlset {ns}><url><loc>u9</loc></url></urlset>"),
        ],
        "url string, body string",
    )
    assert sorted(r["url"] for r in frontier.sitemap_urls(bodies, "i").collect()) == ["u1", "u2"]
    assert [r["url"] for r in frontier.sitemap_urls(bodies, "i", 1).collect()] == ["u1"]


def test_sitemap_walk_lists_all_pages(spark, tmp_path):
    n = frontier.MAX_SITEMAP_URLS + 100
    spark.range(n).select(F.format_string("https://x.example/%d", "id").alias("url")).write.parquet(f"{tmp_path}/runs.parquet")
    assert map_queries.sitemap_walk(spark, str(tmp_path)).distinct().count() == n


def test_robots(spark):
    df = spark.createDataFrame([(200, "User-agent: *\nDisallow: /x\nCrawl-delay: 2"), (404, None), (503, None)], "status int, body string")
    got = df.select(frontier.robots_verdict("body", "status", F.lit("https://h.example/x/1"), F.lit("bot")).alias("v")).select("v.*").collect()
    assert [(r["allowed"], r["delay"]) for r in got][0] == (False, 2.0) and [r["allowed"] for r in got] == [False, True, False]


def test_plain_markup_parses_like_any():
    """The short way over plain markup builds what the parser builds, and the same fingerprints."""
    parts = ["<p>", "</p>", "<li class='a b'>", "</li>", "<ul>", "</ul>", "<br>", "<table>", "<tr>", "<td>", "<title>", "</title>", "x &amp; y", "a > b", "<a href='/x' id=\"q\" id='z'>", "<body>", "<h1>", "<script>", "<!-- c -->", "<br/>"]
    shape = lambda root: [(n.tag, n.attrs, n.depth, n.index, [c if type(c) is str else c.tag for c in n.children]) for n in root.iter()]
    rng, plain = random.Random(7), 0
    for _ in range(3000):
        html = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        builder = dom._Builder()
        builder.feed(html)
        builder.close()
        root = dom.parse(html)
        assert shape(root) == shape(builder.root), html
        marks, prints = dom.marks(root), dom.fingerprints(root, False)
        assert all(dom.marked(marks[k]) == p for k, p in prints.items())
        plain += dom._plain(html) is not None
    assert plain > 500


def test_pages_of_one_domain_are_healed_by_many_tasks(spark, monkeypatch):
    """Stored fingerprints meet the pages without moving a domain's pages to one task, joined or not."""
    job = jobs.job({"target": "https://h.example/", "item": "li.card", "fields": {"name": {"selector": "h3.n"}}})
    rows = [("h.example", i, listing([f"A{i}", f"B{i}"])) for i in range(40)]
    before = healing.remember(spark.createDataFrame(rows, "domain string, seq bigint, html string").repartition(4, "seq"), job)
    first = before.filter("key = 'li.card::name'").first()["print"]
    assert first["ancestors"][-1] == "li" and before.count() == 2
    changed = spark.createDataFrame([(d, i, h.replace('"card"', '"tile"').replace('"n"', '"t"')) for d, i, h in rows], "domain string, seq bigint, html string").repartition(4, "seq")
    got = {}
    for most in (healing.MAX_KNOWN, 0):
        monkeypatch.setattr(healing, "MAX_KNOWN", most)
        monkeypatch.setattr(healing, "HOT_DOMAIN", 10)
        healed = healing.heal_extract(changed, job, before).select("*", F.spark_partition_id().alias("task")).filter("field = 'name'").collect()
        assert len({r["task"] for r in healed}) > 1
        got[most] = sorted((r["seq"], r["pos"], r["value"], r["score"], r["new_locator"], r["print"]["ancestors"]) for r in healed)
    assert [g[2] for g in got[0]] == [f"{c}{i}" for i in range(40) for c in "AB"] and len({str(g) for g in got.values()}) == 1


def test_remembered_is_the_last_page_of_each_key(spark):
    """Pages that can't come last aren't parsed; a key that later pages lack stays from an earlier one."""
    job = jobs.job({"target": "https://h.example/", "fields": {"a": {"selector": "i"}, "b": {"selector": "b"}}})
    rows = [("h", 3, "<b>three</b>"), ("h", 1, "<i>one</i><b>x</b>"), ("h", 2, "<i>two</i>"), ("g", 1, "<i>g</i>"), ("h", None, "<i>none</i>")]
    frame = spark.createDataFrame(rows, "domain string, seq bigint, html string").coalesce(1)
    assert sorted((r["domain"], r["key"], r["print"]["text"]) for r in healing.remember(frame, job).collect()) == [("g", "a", "g"), ("h", "a", "two"), ("h", "b", "three")]


def test_healed_run_parses_a_page_once(spark, monkeypatch):
    """A run that heals takes its records, by selector or healed, from one pass over the pages."""
    job = jobs.job({"target": "https://h.example/none", "item": "li.card", "fields": {"name": {"selector": "h3.n"}, "price": {"selector": ".p", "type": "number"}}})
    before = healing.remember(spark.createDataFrame([("h.example", 1, listing(["A", "B", "C"]))], "domain string, seq bigint, html string"), job)
    old, new = listing(["D", "E"]), listing(["F", "G"], css="tile").replace('class="n"', 'class="t"')
    half = listing(["H", "I"]).replace('class="n"', 'class="t"')
    rows = [("https://h.example/1", 200, old), ("https://h.example/2", 200, new), ("https://h.example/3", 200, listing(["J"], css="tile")), ("https://h.example/4", 200, half)]
    pages = spark.createDataFrame(rows, "url string, status int, html string")
    monkeypatch.setattr(extract, "extract", lambda *a, **k: pytest.fail("pages are parsed for their records again"))
    monkeypatch.setattr(extract, "page_links", lambda *a, **k: pytest.fail("pages are parsed for links that no job asks for"))
    run = pipeline.run_tier(pipeline.Tier("plain", pages), job, fingerprints=before, seeds=pages.select("url"), budget=None)
    got = sorted((r["url"][-1], r["pos"], r["name"], r["price"]) for r in run.records.collect())
    assert got == [("1", 0, "D", 0.5), ("1", 1, "E", 1.5), ("2", 0, "F", 0.5), ("2", 1, "G", 1.5), ("4", 0, "H", 0.5), ("4", 1, "I", 1.5)]


def test_levels_are_not_broadcast_by_file_size(spark, monkeypatch):
    """Urls compress to a few bytes a row: a level must not go to the driver because its file is small."""
    plans, stage = [], frontier.staged

    def noted(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return stage(df, label)

    monkeypatch.setattr(frontier, "staged", noted)
    pages = spark.range(50).select(F.concat(F.lit("https://h.example/"), "id").alias("url"), F.lit(200).alias("status"), F.lit("<p>x</p>").alias("html"))
    job = jobs.job({"target": "https://h.example/none"})
    out = frontier.crawl(pages, job, seeds=pages.select("url"), budget=None)
    assert out["visited"].count() == 50 and out["rest"].count() == 0
    plans.append(("rest", out["rest"]._jdf.queryExecution().executedPlan().toString()))
    assert not [label for label, plan in plans if "BroadcastHashJoin" in plan and "LeftAnti" in plan]
    assert "BroadcastHashJoin" not in out["visited"]._jdf.queryExecution().executedPlan().toString()
