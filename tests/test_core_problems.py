"""Nested records, snapshot changes and schema drift, against brute force and edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.jsontext import canonical, decode
from tidemark.operators import nested, schema_drift, snapshots
from tidemark.operators.delivery import SnapshotIndex
from tidemark.operators.flooding import flood, name_similarity

from . import brute

SF = "/root/testdata/sf0.001"
RUNS = "id bigint, site_id bigint, url string, captured_at string, tier int, records_json string, api_surface_json string, exploration_json string, config_json string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def runs(spark, data):
    names = [c.split()[0] for c in RUNS.split(", ")]
    return spark.createDataFrame([tuple({"site_id": 1, "url": "u", "captured_at": f"2026-01-0{i + 1}T00:00:00Z"} .get(n) if n not in r else r[n] for n in names) for i, r in enumerate(data)], RUNS)


@pytest.fixture(scope="module")
def real(spark):
    df = spark.read.parquet(f"{SF}/runs.parquet")
    return df, [r.asDict() for r in df.collect()]


def test_nested_equals_brute_force(real):
    df, data = real
    got = rows(nested.nested_objects(df), "run_id", "json_col", "path", "parent_path")
    assert got == sorted(brute.nested(data))


def test_changes_equal_brute_force(real):
    df, data = real
    assert rows(snapshots.snapshot_changes(df), "run_id", "sku", "change_kind") == sorted(brute.changed(data))


def test_drift_equals_brute_force(real):
    df, data = real
    want, open_steps = brute.drift(data)
    assert not open_steps
    assert rows(schema_drift.drift_report(df), "run_id", "json_col", "field", "old_field", "change_kind") == sorted(want)


NESTED = [
    ({"records_json": '[{"sku":"a","variants":{"code":1,"offers":[null,{"ships":{"days":2}}]}},null,{"x":[[{"y":1}]]}]'},
     {("[0]", ""), ("[0].variants[0]", "[0]"), ("[0].variants[0].offers[1]", "[0].variants[0]"), ("[0].variants[0].offers[1].ships", "[0].variants[0].offers[1]"), ("[2]", ""), ("[2].x[0][0]", "[2]")}),
    ({"records_json": '{"sku":"a"}'}, {("[0]", "")}),
    ({"records_json": json.dumps('[{"sku":"a"}]')}, {("[0]", "")}),
    ({"records_json": '[{"sku":"a"'}, set()),
    ({"records_json": ""}, set()),
    ({"records_json": "null"}, set()),
    ({"records_json": '"plain"'}, set()),
    ({"records_json": "[" * 100000 + "]" * 100000}, set()),
    ({"records_json": '[{"k\\ud800":{"a":1}}]'}, {("[0]", ""), ("[0].k\\ud800", "[0]")}),
    ({"api_surface_json": '{"spec":{"kind":"x"},"n":1}'}, {("spec", "")}),
    ({"exploration_json": '{"states":[{"actions":{"role":"r"}}],"transitions":[{"action":{"role":"r"}}]}'},
     {("states[0]", ""), ("states[0].actions[0]", "states[0]"), ("transitions[0]", ""), ("transitions[0].action", "transitions[0]")}),
]


@pytest.mark.parametrize("row,want", NESTED)
def test_nested_cases(spark, row, want):
    got = nested.nested_objects(runs(spark, [{"id": 1, **row}]))
    assert {(r["path"], r["parent_path"]) for r in got.collect()} == want


def test_nested_long_text_repeated_rows_and_clashing_columns(spark):
    text = json.dumps([{"sku": "s" * 50_000, "variants": [{"code": i} for i in range(3000)]}])
    df = runs(spark, [{"id": 7, "records_json": text}]).withColumn("run_id", F.lit(1)).withColumn("tag", F.lit("x")).withColumn("path", F.lit("x"))
    got = nested.emit_tagged(df.unionByName(df))
    assert got.count() == 2 * 3001 and {r["run_id"] for r in got.select("run_id").distinct().collect()} == {7}


def test_tables_by_tag(spark, tmp_path, real):
    df, data = real
    emitted = nested.emit_tagged(df)
    nested.write_tables(emitted, f"file://{tmp_path}/t")
    offers = nested.read_table(spark, f"file://{tmp_path}/t", "offer")
    want = [p for p in brute.nested(data) if p[2].endswith("]") and ".offers[" in p[2].rsplit(".", 1)[0] + "." + p[2].rsplit(".", 1)[-1] and p[2].rsplit(".", 1)[-1].startswith("offers")]
    assert offers.count() == len(want) and "seller" in offers.columns
    variants = nested.read_table(spark, f"file://{tmp_path}/t", "variant")
    orphans = offers.join(variants, (offers.run_id == variants.run_id) & (offers.parent_path == variants.path), "left_anti")
    assert orphans.count() == 0


def snap(*records):
    return json.dumps(list(records))


CHANGES = [
    # equal numbers in other spelling; null and absent are the same
    ([snap({"sku": "a", "p": 12.5, "q": None}), snap({"sku": "a", "p": "12.50"})], []),
    ([snap({"sku": "a", "p": "x", "q": 1}, {"sku": "b", "q": 2}), snap({"sku": "a", "p": "x", "q": 1}, {"sku": "b", "q": 3})], [(1, "b", "changed")]),
    # a field only one snapshot has is not compared
    ([snap({"sku": "a", "p": 1}), snap({"sku": "a", "z": 2})], []),
    ([snap({"sku": "a", "p": 1}), snap({"sku": "c", "p": 1})], [(1, "a", "removed"), (1, "c", "added")]),
    # a value that comes or goes in a field both have
    ([snap({"sku": "a", "p": 1}, {"sku": "b", "p": 2}), snap({"sku": "a"}, {"sku": "b", "p": 2})], [(1, "a", "changed")]),
    # objects are not compared, the first record of a sku stands, null skus are left out
    ([snap({"sku": "a", "v": {"x": 1}}), snap({"sku": "a", "v": {"x": 2}}, {"sku": "a", "p": 9}, {"sku": None, "p": 1})], []),
    ([snap({"sku": "a", "p": 1}), "broken", "[]", None, snap({"sku": "a", "p": 2})], [(4, "a", "changed")]),
    ([snap({"sku": "a", "p": True}), snap({"sku": "a", "p": False})], []),
]


@pytest.mark.parametrize("texts,want", CHANGES)
def test_change_cases(spark, texts, want):
    df = runs(spark, [{"id": i, "records_json": t} for i, t in enumerate(texts)])
    assert rows(snapshots.snapshot_changes(df), "run_id", "sku", "change_kind") == want


def test_same_instant_is_one_run_and_order_is_by_time(spark):
    data = [
        {"id": 5, "captured_at": "2026-01-02T01:00:00+01:00", "records_json": snap({"sku": "a", "p": 1})},
        {"id": 6, "captured_at": "2026-01-02T00:00:00.000000Z", "records_json": snap({"sku": "a", "p": 2})},
        {"id": 1, "captured_at": "2026-01-03T00:00:00Z", "records_json": snap({"sku": "a", "p": 3})},
        {"id": 9, "captured_at": "2026-01-01T23:00:00-00:30", "records_json": snap({"sku": "a", "p": 2})},
        {"id": 10, "captured_at": None, "records_json": snap({"sku": "z"})},
        {"id": 11, "captured_at": "soon", "records_json": snap({"sku": "z"})},
        {"id": 12, "url": None, "records_json": snap({"sku": "z"})},
    ]
    assert rows(snapshots.snapshot_changes(runs(spark, data)), "run_id", "sku", "change_kind") == [(1, "a", "changed")]


def test_highest_id_stands_even_when_broken(spark):
    data = [
        {"id": 1, "captured_at": "2026-01-01T00:00:00Z", "records_json": snap({"sku": "a", "p": 1})},
        {"id": 2, "captured_at": "2026-01-02T00:00:00Z", "records_json": snap({"sku": "b"})},
        {"id": 3, "captured_at": "2026-01-02T00:00:00Z", "records_json": "{"},
        {"id": 4, "captured_at": "2026-01-03T00:00:00Z", "records_json": snap({"sku": "a", "p": 2})},
    ]
    assert rows(snapshots.snapshot_changes(runs(spark, data)), "run_id", "sku", "change_kind") == [(4, "a", "changed")]


def test_hot_url_over_many_blocks(spark):
    data = [{"id": i, "captured_at": f"20{10 + i // 12:02d}-{1 + i % 12:02d}-01T00:00:00Z", "records_json": snap({"sku": "a", "p": i // 2})} for i in range(60)]
    got = rows(snapshots.snapshot_changes(runs(spark, data)), "run_id", "sku", "change_kind")
    assert got == [(i, "a", "changed") for i in range(2, 60, 2)]


@pytest.mark.parametrize("op", [nested.nested_objects, snapshots.snapshot_changes, schema_drift.drift_report, schema_drift.unify_records, schema_drift.unify_config])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], RUNS)).count() == 0


def test_clashing_columns(spark, real):
    df, data = real
    extra = df.withColumns({c: F.lit("x") for c in ("run_id", "ts", "keys", "vals", "new_id", "prev_id", "_block", "sku", "fields", "options")})
    assert rows(snapshots.snapshot_changes(extra), "run_id", "sku", "change_kind") == sorted(brute.changed(data))
    assert schema_drift.drift_report(extra).count() == len(brute.drift(data)[0])


def config(**options):
    return json.dumps({"target": "t", **options})


DRIFT = [
    ([config(resume=True, change_detection=True), config(resume_crawl=True)],
     [("resume_crawl", "resume", "renamed"), ("change_detection", "change_detection", "removed")]),
    ([config(retry={"backoff": 2.5}), config(retry={"backoff": "2.5s"})], [("retry.backoff", "retry.backoff", "retyped")]),
    ([config(crawl={"include": ["/c/*"]}), config(crawl={"allow": ["/c/*"]})], [("crawl.allow", "crawl.include", "renamed")]),
    ([config(crawl={"include": ["/c/*"]}), config(limits={"include": ["/c/*"]})],
     [("crawl.include", "crawl.include", "removed"), ("limits.include", "limits.include", "added")]),
    ([config(fields={"a": {"selector": ".x", "attr": "h"}}), config(fields={"b": {"selector": ".x", "attr": "h", "type": "number"}})],
     [("fields.b", "fields.a", "renamed"), ("fields.b", "fields.a", "retyped")]),
    ([config(fields={"a": {"selector": ".x"}}), config(fields={"a": {"selector": ".y", "type": "string"}})], []),
    ([config(pagination=None), config()], []),
    ([config(x=1), "[1]", None, "{", config(x=2)], []),
    ([config(retry={"max": 3}), config(retry={"most": "3.0"})], [("retry.most", "retry.max", "renamed"), ("retry.most", "retry.max", "retyped")]),
]


@pytest.mark.parametrize("texts,want", DRIFT)
def test_config_drift_cases(spark, texts, want):
    df = runs(spark, [{"id": i, "config_json": t} for i, t in enumerate(texts)])
    got = schema_drift.drift_report(df)
    assert rows(got, "field", "old_field", "change_kind") == sorted(want)


def test_record_drift(spark):
    old = [{"sku": str(i), "price": i + 0.5, "old": "x"} for i in range(5)]
    new = [{"sku": str(i), "cost": f"{i}.50", "fresh": i} for i in range(5)]
    df = runs(spark, [{"id": 0, "records_json": json.dumps(old)}, {"id": 1, "records_json": json.dumps(new)}])
    assert rows(schema_drift.drift_report(df), "field", "old_field", "change_kind") == [
        ("cost", "price", "renamed"), ("cost", "price", "retyped"), ("fresh", "fresh", "added"), ("old", "old", "removed"),
    ]


def test_one_consistent_table(spark):
    a = [{"sku": "1", "price": 2.5, "name": "n"}]
    b = [{"sku": "1", "cost": "2.50", "name": "m", "odd": "x"}]
    c = [{"sku": "1", "cost": "n/a", "name": None}]
    df = runs(spark, [{"id": i, "records_json": json.dumps(x)} for i, x in enumerate((a, a, b, c))])
    got = schema_drift.unify_records(df).orderBy("run_id").collect()
    value = "cost" if "cost" in got[0].asDict() else "price"
    assert [r["name"] for r in got] == ["n", "n", "m", None] and len(got) == 4
    assert got[0][value] is not None and got[2][value] is not None


def test_unified_tables_keep_every_record(real):
    df, data = real
    want = sum(isinstance(x, dict) for r in data for x in (brute.records(r["records_json"]) or []))
    assert schema_drift.unify_records(df).count() == want
    assert schema_drift.unify_config(df).count() == sum(isinstance(brute.load(r["config_json"]), dict) for r in data)


def found_again(texts, got):
    """Runs with an option whose value is neither in its row's columns nor in not_cast."""
    number = lambda t: str(float(t)) if canonical(t)[0] == "n" else t
    want = {i: sorted(number(c if s == "fields" else c[1:]) for _, s, _, c in schema_drift.options_of(decode(t)) or ()) for i, t in texts}
    have = {}
    for r in (r.asDict() for r in got.collect()):
        cells = [*(r.pop("not_cast", None) or {}).values(), *(v for k, v in r.items() if k != "run_id" and v is not None)]
        have[r["run_id"]] = sorted(number(v) for v in cells)
    return [i for i in want if want[i] != have.get(i, [])]


def test_unified_config_keeps_every_value(real):
    df, data = real
    assert found_again([(r["id"], r["config_json"]) for r in data], schema_drift.unify_config(df)) == []


def test_unified_config_keeps_retyped_texts(spark):
    values = [1.5, 2, "1.0s", "30d", "5f", "3 per domain", "4", True, None, [1], 0.5, 3, 7, 8]
    texts = [(i, config(retry={"backoff": v})) for i, v in enumerate(values)]
    got = schema_drift.unify_config(runs(spark, [{"id": i, "config_json": t} for i, t in texts]))
    assert found_again(texts, got) == []
    kept = {r["run_id"]: r["not_cast"] for r in got.collect() if r["not_cast"]}
    assert kept == {i: {"retry.backoff": t} for i, t in ((2, "1.0s"), (3, "30d"), (4, "5f"), (5, "3 per domain"), (7, "true"), (9, "[1]"))}
    assert {r["run_id"]: r["retry.backoff"] for r in got.collect() if r["run_id"] in (0, 6)} == {0: 1.5, 6: 4.0}


def test_flooding_prefers_connected_and_alike():
    left = [("root", "has", "price"), ("root", "has", "name")]
    right = [("root", "has", "cost_price"), ("root", "has", "title")]
    seed = {("root", "root"): 1.0} | {(a, b): 0.1 + name_similarity(a, b) for a in ("price", "name") for b in ("cost_price", "title")}
    score = flood(left, right, seed)
    assert score["price", "cost_price"] > score["price", "title"] and max(score.values()) == 1.0
    assert flood([], [], {}) == {}


def test_flooding_overrides_the_best_seed():
    """Names say x and y the other way round; types and the content they hold carry the pairs."""
    lost = (("item_cost", "", "number"), ("item_title", "", "string"))
    came = (("item_titles", "", "number"), ("item_costs", "", "string"))
    by_name = max(((name_similarity(a[0], b[0]), (i, j)) for i, a in enumerate(lost) for j, b in enumerate(came)))[1]
    assert by_name in ((0, 1), (1, 0))
    got = schema_drift.correspondences(lost, came, (), ((0, 0, 0.9), (0, 1, 0.55), (1, 1, 0.9), (1, 0, 0.55)))
    assert {p[:2] for p in got[:2]} == {(0, 0), (1, 1)}
    assert schema_drift.correspondences(lost, came, (), ((0, 0, 0.9),))[0][:2] == (0, 0)


def test_ambiguous_renames_are_settled_by_flooding(spark):
    """Both lost fields hold what both new ones hold: types of the fields decide."""
    old = [{"sku": str(i), "alpha": 5, "beta": "5"} for i in range(4)]
    new = [{"sku": str(i), "betas": 5, "alphas": "5"} for i in range(4)]
    df = runs(spark, [{"id": 0, "records_json": json.dumps(old)}, {"id": 1, "records_json": json.dumps(new)}])
    got = {(r["old_field"], r["field"]) for r in schema_drift.drift_report(df).filter("change_kind = 'renamed'").collect()}
    assert len(got) == 2 and {a for a, _ in got} == {"alpha", "beta"}


def test_fields_beyond_the_columns_are_kept(spark, monkeypatch):
    records = [[{"sku": "1", "a": 1, "b": "x", "c": True, "d": [1], "e": {"f": 2}, "g": None}], [{"sku": "1", "a": 2}], [{"sku": "2", "a": "n/a", "h": 5}]]
    df = runs(spark, [{"id": i, "url": f"u{i}", "records_json": json.dumps(x), "config_json": config(x=i, **({"y": 1} if i else {}))} for i, x in enumerate(records)])
    full = {r["run_id"]: r for r in schema_drift.unify_records(df).collect()}
    assert full[0]["nested"] == {"c": "true", "d": "[1]", "e": '{"f": 2}'} and full[0]["others"] is None and full[2]["not_cast"] == {"a": "n/a"}
    monkeypatch.setattr(schema_drift, "MAX_NAMES", 2)
    few = {r["run_id"]: r for r in schema_drift.unify_records(df).collect()}
    assert [c for c in few[0].asDict() if c not in ("run_id", "pos", "not_cast", "nested", "others")] == ["a", "sku"]
    assert few[0]["others"] == {"b": "x"} and few[2]["others"] == {"h": "5"} and few[1]["a"] == 2.0
    options = {r["run_id"]: r for r in schema_drift.unify_config(df).collect()}
    assert all(set(options[i].asDict()) == {"run_id", "target", "x", "not_cast", "others"} for i in options) and options[1]["others"] == {"y": "1"}


def test_many_names_need_no_pairs(spark):
    """Names of one snapshot are compared with each other only where a rename links them."""
    wide = [{"sku": "1", **{f"f{i}": i for i in range(300)}, "old": "v"}]
    df = runs(spark, [{"id": 0, "records_json": json.dumps(wide)}, {"id": 1, "records_json": json.dumps([{**{k: v for k, v in wide[0].items() if k != "old"}, "fresh": "v"}])}])
    got = schema_drift.unify_records(df)
    assert len(got.columns) == 5 + 302 and got.filter("coalesce(fresh, old) = 'v'" if {"fresh", "old"} <= set(got.columns) else f"{'fresh' if 'fresh' in got.columns else 'old'} = 'v'").count() == 2


def test_a_step_of_many_changed_keys(spark):
    n = 100_000
    make = lambda v: json.dumps([{"sku": f"k{i}", "p": v} for i in range(n)])
    df = runs(spark, [{"id": 0, "records_json": make(1)}, {"id": 1, "records_json": make(2)}])
    got = snapshots.snapshot_changes(df).groupBy("change_kind").count().collect()
    assert [(r["change_kind"], r["count"]) for r in got] == [("changed", n)]


def test_the_index_is_bucketed_by_key(spark, real):
    snaps = snapshots.read_snapshots(real[0])
    before = set(spark.catalog.listTables() and [t.name for t in spark.catalog.listTables()])
    snapshots.changes(snaps)
    made = [t.name for t in spark.catalog.listTables() if t.name not in before and t.name.startswith("snapshot_index")]
    assert len(made) == 1
    shown = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {made[0]}").collect()}
    assert "prev_id" in shown["Bucket Columns"] and "sku" in shown["Bucket Columns"]
    from tidemark.session import release_staged

    release_staged(spark)
    assert not [t for t in spark.catalog.listTables() if t.name == made[0]]


def test_tables_keep_unknown_fields_and_a_bounded_set_of_tags(spark, tmp_path):
    text = json.dumps([{"sku": "a", "odd": 1, "list": [1, 2], "gone": None, "ships": {"to": "x"}, "paths": {"/a/b": {"get": {}}}}])
    df = runs(spark, [{"id": 7, "records_json": text}])
    where = f"file://{tmp_path}/t"
    nested.write_tables(nested.emit_tagged(df), where, rebalance=True)
    assert {r["tag"] for r in spark.read.parquet(where).select("tag").distinct().collect()} == {"record", "other"}
    (row,) = nested.read_table(spark, where, "record").collect()
    assert row["sku"] == "a" and row["rest"] == {"odd": "1", "list": "[1,2]"} and row["name"] is None
    (row,) = nested.nested_table(df, "record", ("records_json",)).collect()
    assert row["path"] == "[0]" and row["run_id"] == 7


def test_deliveries_swap_the_index(spark, tmp_path):
    index = SnapshotIndex(spark, f"file://{tmp_path}/ix", "k", 4)
    day = lambda data: spark.createDataFrame(data, "k string, v int, w string")
    kinds = lambda df: rows(df, "k", "change_kind")
    assert kinds(index.apply(day([("a", 1, "x"), ("b", 2, None), (None, 3, "y")]))) == [("a", "added"), ("b", "added")]
    second = index.apply(day([("a", 1, "x"), ("b", 3, None), ("c", 1, "z")]))
    assert kinds(second) == [("b", "changed"), ("c", "added")]
    assert [(r["old"], r["new"]) for r in second.filter("k = 'b'").collect()][0][0]["v"] == 2
    third = index.apply(day([("a", 1, "x")]))
    assert kinds(third) == [("b", "removed"), ("c", "removed")] and index.version() == 3
    plan = third._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
