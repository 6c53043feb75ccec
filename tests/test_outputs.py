"""Readers of adapter tables, reports, and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, healing, jobs
from tidemark.plans import pipeline
from tidemark.sources import bronze, render


def test_contracts_are_empty_tables_at_first(spark, tmp_path):
    for name in bronze.CONTRACTS:
        assert bronze.bronze(spark, f"file://{tmp_path}", name).count() == 0
    bronze.bronze(spark, f"file://{tmp_path}", "checkpoints").write.parquet(f"file://{tmp_path}/checkpoints")
    assert bronze.bronze(spark, f"file://{tmp_path}", "checkpoints").columns == ["capture_id", "seq", "label", "at"]


def test_har_files(spark, tmp_path):
    (tmp_path / "a.har").write_text('{"log":\n{"entries":[]}}')
    assert bronze.har_files(spark, f"file://{tmp_path}/*.har").first()["har"].startswith('{"log"')


def test_frontier_states(spark):
    good = {"seen": ["a", "b"], "frontier": [{"url": "c", "depth": 1}, {"url": "d", "depth": 0}]}
    bad = {"seen": ["a"], "frontier": [{"url": "c"}]}
    df = spark.createDataFrame([("t", json.dumps(good)), ("u", json.dumps(bad)), ("v", "["), ("w", None)], "target string, state string")
    got = sorted((r["target"], r["url"], r["depth"], r["seq"], r["is_seen"]) for r in bronze.frontier_entries(df).collect())
    assert got == [("t", "a", None, 0, True), ("t", "b", None, 1, True), ("t", "c", 1, 0, False), ("t", "d", 0, 1, False)]


def test_fingerprints(spark):
    df = spark.createDataFrame([("d", "k", '{"tag":"p","classes":["a"]}'), ("d", "x", "{"), ("d", "y", '{"text":"no tag"}')], "domain string, key string, print string")
    got = bronze.fingerprints_from_json(df).collect()
    assert len(got) == 1 and got[0]["print"]["classes"] == ["a"] and got[0]["print"]["descendants"] == {} and got[0]["print"]["visual_hash"] is None


def test_pattern_files(tmp_path):
    (tmp_path / "p").write_text("a*\n\n# no\n b \n")
    assert bronze.patterns(["x", f"@{tmp_path}/p"]) == ["x", "a*", "b"]


def test_scaffolds(spark):
    pytest.importorskip("yaml")
    text = "fields:\n- {state: s, name: n, value: 42}\n- {state: s, name: m, generate: true, kind: email}\n- {state: 1}\n- bad\n"
    assert [(r["name"], r["value"], r["is_text"], r["generate"]) for r in bronze.scaffold(spark, text).orderBy("name").collect()] == [("m", None, False, True), ("n", "42", False, False)]
    assert bronze.scaffold(spark, "- 1").count() == 0
    actions = spark.createDataFrame([("s" * 64, 0, "textbox", "Mail", "email"), ("s" * 64, 1, "textbox", "Key", "password"), ("s" * 64, 2, "button", "Delete password=abc", None), ("s" * 64, 3, "link", "x", None)], "state_id string, pos int, role string, name string, input_type string")
    out = render.scaffold(actions)
    import yaml

    data = yaml.safe_load(out)
    assert [f["kind"] for f in data["fields"]] == ["email"] and len(data["login_points"]) == 1 and "[REDACTED]" in data["destructive_actions"][0]["name"]
    assert render.scaffold(actions.limit(0)) is None


MAP = {"states": [{"id": "s0" * 32, "actions": [{"role": "link", "name": "Go | <x>"}]}, {"id": "s1" * 32, "actions": []}],
       "transitions": [{"from": "s0" * 32, "action": {"role": "link", "name": "Go | <x>"}, "to": "s1" * 32}], "skipped": [{"from": "s1" * 32, "action": {"role": "button", "name": "Pay"}, "reason": "held"}]}


def test_wiki_and_suite(spark, tmp_path):
    runs = spark.createDataFrame([(1, json.dumps(MAP))], "run_id bigint, exploration_json string")
    parts = graph.explode_map(runs)
    names = render.wiki(*parts, str(tmp_path / "w"), "https://h.example/")
    assert names == ["index.html", "state-0.html", "state-1.html", "transition-0.html"]
    index = (tmp_path / "w/index.html").read_text()
    assert "S0 -->" in index and "<x>" not in index and "held" in (tmp_path / "w/state-1.html").read_text()
    t = parts[1].select("src", "dst", F.col("seq").cast("bigint").alias("seq"), "role", "name")
    tree = graph.levels(t, spark.createDataFrame([("s0" * 32, 0)], "node string, seq bigint"))
    made = render.test_suite(graph.paths(tree, t), t, str(tmp_path / "t"))
    assert made == ["conftest.py", "test_transition_0.py"]
    compile((tmp_path / "t/test_transition_0.py").read_text(), "x", "exec")
    assert render.test_suite(graph.paths(tree, t), t.limit(0), str(tmp_path / "z")) == []


def test_wiki_of_many_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(render, "PAGE_STATES", 1)
    parts = graph.explode_map(spark.createDataFrame([(1, json.dumps(MAP))], "run_id bigint, exploration_json string"))
    names = render.wiki(*parts, str(tmp_path / "w"), "https://h.example/")
    assert names == ["index-2.html", "index.html", "state-0.html", "state-1.html", "transition-0.html"]
    assert "index-2.html" in (tmp_path / "w/index.html").read_text() and "transition-0.html" in (tmp_path / "w/state-0.html").read_text()
    assert render.wiki(*(p.limit(0) for p in parts), str(tmp_path / "e"), "t") == ["index.html"]


def test_reports(spark):
    e = spark.createDataFrame([("d", "a|b", "h3.x", True, 0.9), ("d", "c", None, False, 0.5)], "domain string, field string, new_locator string, used boolean, score double")
    text = render.healing_report(e)
    assert "1 confidently, 1 to review" in text and "a\\|b" in text and text.index("Confident") < text.index("Uncertain")
    assert render.healing_report(e.limit(0)) is None
    assert "challenge: X" in render.run_summary({"records": 2}, ("X", "m")) and "deads" not in render.run_summary({})
    assert "<td>1</td>" in render.resource_report(spark.createDataFrame([(1,)], "n int"), "t")


def test_runs(spark):
    page = lambda css: f"<ul><li class='{css}'><b class='n'>A</b></li><li class='{css}'><b class='n'>B</b></li></ul>"
    job = jobs.job({"target": "https://h.example/", "item": "li.card", "fields": {"n": {"selector": ".n"}}, "change_detection": True})
    frame = lambda css: spark.createDataFrame([("https://h.example/", 200, page(css))], "url string, status int, html string")
    none = spark.createDataFrame([], "url string, etag string, last_modified string, content_hash string")
    plain, browser = pipeline.Tier("plain", frame("other")), pipeline.Tier("browser", frame("card"), renders=True)
    got = pipeline.run_job(job, [plain, browser], validators=none)
    assert got.attempts == ["plain", "browser"] and sorted(r["n"] for r in got.records.collect()) == ["A", "B"]
    again = pipeline.run_job(job, [browser], validators=got.validators)
    assert again.records.count() == 0 and again.outcomes["unchanged"].count() == 1
    hooked = pipeline.run_job(job, [plain], on_response=lambda p: p.withColumn("html", F.replace("html", F.lit("other"), F.lit("card"))))
    assert hooked.records.count() == 2
    scroll = jobs.job({"target": "https://h.example/", "pagination": {"infinite_scroll": True}})
    with pytest.raises(ValueError):
        pipeline.run_job(scroll, [plain])
    before = healing.remember(frame("card").select(F.lit("h.example").alias("domain"), F.lit(1).alias("seq"), "html"), job)
    healed = pipeline.run_tier(pipeline.Tier("plain", frame("tile")), job, fingerprints=before).healed
    assert sorted(r["value"] for r in healed.filter("field = 'n'").collect()) == ["A", "B"]
