"""Graphs, signals, traffic, images, history, sinks and streams."""

import json
import random
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import api_surface, change, graph, images, signals, stats, store
from tidemark.sources import sinks
from tidemark.streaming import runs as streams


def test_levels_and_paths(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", i) for i in range(90)]
    e = spark.createDataFrame(edges, "src string, dst string, seq bigint").withColumn("role", F.lit("link")).withColumn("name", F.col("seq").cast("string"))
    tree = graph.levels(e, spark.createDataFrame([("n0", 0)], "node string, seq bigint"))
    # breadth first by hand
    queue, prev = ["n0"], {"n0": None}
    for node in queue:
        for s, d, i in edges:
            if s == node and d not in prev:
                prev[d] = (node, i)
                queue.append(d)
    got = {r["node"]: (r["parent"], r["edge"]) if r["parent"] else None for r in tree.collect()}
    assert got == prev

    def steps(n):
        return [] if prev[n] is None else steps(prev[n][0]) + [(str(prev[n][1]), n)]

    for r in graph.paths(tree, e).collect():
        assert [(s["name"], s["landed"]) for s in r["steps"]] == steps(r["state"])


def test_merge_and_anchor(spark):
    known = spark.createDataFrame([("a", "b", "x", "c", None)], "src string, role string, name string, dst string, fill_value string")
    fresh = spark.createDataFrame([("a", "b", "x", "c", None), ("a", "b", "y", "c", None), ("a", "b", "y", "c", None), ("a", "f", "n", "a", "v"), ("a", "f", "n", "d", "v")], known.schema)
    assert graph.merge_edges(known, fresh).count() == 4
    assert graph.merge_edges(known, fresh, ("src", "role", "name", "dst", "fill_value")).count() == 3
    states = spark.createDataFrame([("abc", "T", "/u", [("link", "x")]), ("abd", None, None, [])], "state_id string, title string, url string, path array<struct<role:string,name:string>>")
    assert graph.resolve_anchor(states, ["id:abc"]) == "abc" and graph.resolve_anchor(states, ["title:T", "path:link:x"]) == "abc"
    for bad in (["id:ab"], ["title:U"], [], ["id:"], ["color:x"]):
        with pytest.raises(ValueError):
            graph.resolve_anchor(states, bad)


def test_map_round_trip(spark):
    m = {"states": [{"id": "s0", "actions": [{"role": "link", "name": "x"}], "signals": {"ax_node_count": 3}}, {"id": "s1", "actions": [], "signals": None}],
         "transitions": [{"from": "s0", "action": {"role": "link", "name": "x"}, "to": "s1", "changed": None}], "skipped": [{"from": "s1", "action": {"role": "b", "name": "pay"}, "reason": "r"}]}
    runs = spark.createDataFrame([(1, json.dumps(m)), (2, "{"), (3, None)], "run_id bigint, exploration_json string")
    parts = graph.explode_map(runs)
    assert [p.count() for p in parts] == [2, 1, 1]
    out = graph.shareable_map(*parts).first()["exploration"]
    assert [s["id"] for s in out["states"]] == ["s0", "s1"] and out["counts"]["transitions"] == 1
    assert [r["line"] for r in graph.mermaid_edges(parts[0], parts[1], F.col("name")).collect()] == ["    S0 -->|x| S1"]


def states_of(texts):
    """(run_id, seq, state_id, actions, transitions, skips) by brute force, from (run_id, text)."""
    listed = lambda v: [v] if isinstance(v, dict) else v or []
    out = []
    for run, text in texts:
        try:
            m = json.loads(text)
            m = json.loads(m) if isinstance(m, str) else m
        except (ValueError, TypeError):
            continue
        more = [sum(x is not None for x in listed(m.get(k))) for k in ("transitions", "skipped")]
        for seq, s in enumerate(listed(m.get("states"))):
            if s is not None:
                actions = s.get("actions")
                out.append((run, seq, s["id"], None if actions is None else [(a["role"], a["name"]) for a in listed(actions)], *more))
    return sorted(out, key=lambda r: r[:2])


def exploded(spark, texts):
    runs = spark.createDataFrame(texts, "run_id bigint, exploration_json string")
    states, transitions, skips = graph.explode_map(runs)
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    df = states.join(count(transitions, "t"), "run_id", "left").join(count(skips, "k"), "run_id", "left").fillna(0, ["t", "k"])
    return [
        (r["run_id"], r["seq"], r["state_id"], None if r["actions"] is None else [(a["role"], a["name"]) for a in r["actions"]], r["t"], r["k"])
        for r in df.orderBy("run_id", "seq").collect()
    ]


def test_maps_encoded_twice_and_bare_objects(spark):
    a, b = {"role": "link", "name": "x"}, {"role": "button", "name": "y \" \u00e9"}
    hop, skip = {"from": "s0", "action": a, "to": "s1", "changed": {"u": 1}}, {"from": "s1", "action": b, "reason": "r"}
    full = {"states": [{"id": "s0", "actions": [a, b]}, None, {"id": "s1", "actions": b}, {"id": "s2"}], "transitions": [hop, None], "skipped": [skip]}
    bare = {"states": {"id": "s0", "actions": a}, "transitions": hop, "skipped": skip}
    texts = [json.dumps(full), json.dumps(json.dumps(full)), json.dumps(bare), json.dumps(json.dumps(bare)), " " + json.dumps(json.dumps({"states": [{"id": "s", "actions": []}]})), "{", '"{"', None, '"x"']
    texts = list(enumerate(texts))
    got = exploded(spark, texts)
    assert got == states_of(texts) and len(got) == 9


def test_stored_maps_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/runs.parquet").select("id", "exploration_json").collect()
    texts = [(r["id"], r["exploration_json"]) for r in rows]
    assert exploded(spark, texts) == states_of(texts)


SIGNALS = "struct<ax_node_count:int,console_messages:array<string>,storage_keys:array<string>,network_requests:array<string>,screenshot_hash:string>"


def test_signal_diff(spark):
    df = spark.createDataFrame([((3, ["a"], ["k"], ["u"], None), (7, ["a", "b", "b"], [], ["u"], "1"))], f"b {SIGNALS}, a {SIGNALS}")
    r = df.select(signals.diff(F.col("b"), F.col("a")).alias("d")).select("d", signals.describe(F.col("d")).alias("t"), signals.counts(F.lit(None).cast(SIGNALS)).alias("n")).first()
    assert tuple(r["d"]) == (4, ["b"], [], ["k"], [], True)
    assert r["t"] == ["accessibility nodes: +4", "console added: b", "storage removed: k", "screenshot changed"]


def test_actions(spark):
    nodes = spark.createDataFrame(
        [("s", "1", None, "RootWebArea", False, 0, "r", 1), ("s", "2", "1", "video", False, 1, "v", 2), ("s", "3", "2", "group", False, 2, "", 3), ("s", "4", "3", "button", False, 3, "Play", 4),
         ("s", "5", "1", "button", False, 4, None, 5), ("s", "6", "1", "link", True, 5, "x", 6), ("s", "7", "8", "link", False, 6, "y", 7), ("s", "8", "7", "link", False, 7, "z", 8)],
        "state_id string, node_id string, parent_id string, role string, ignored boolean, pos int, name string, backend_id int",
    )
    assert [(r["role"], r["name"]) for r in signals.find_actions(nodes).orderBy("pos").collect()] == [("button", ""), ("link", "y"), ("link", "z")]


def test_settling(spark):
    at = lambda *ms: [("p" + str(len(ms)), m / 1000) for m in ms]
    data = at(0, 100, 300, 900) + [("q", i * 0.3) for i in range(60)]
    e = spark.createDataFrame(data, "page_id string, s double").select("page_id", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    got = {r["page_id"]: (r["settled"], round(r["elapsed_s"], 3), r["mutations"]) for r in signals.settled(e).collect()}
    assert got["p4"] == (True, 0.7, 3) and got["q"][:2] == (False, 10.0)


def test_har(spark):
    entry = lambda url, mime="application/json", t="2026-01-01T00:00:05Z", status=200, m="get": {"startedDateTime": t, "request": {"method": m, "url": url}, "response": {"status": status, "content": {"mimeType": mime}}}
    har = {"log": {"entries": [entry("https://h.example/users/1"), entry("https://h.example/users/2", status=404), entry("https://h.example/x", "text/html"), entry("https://o.example/users/1"), entry("https://h.example/late", t="never"), None]}}
    hars = spark.createDataFrame([(1, json.dumps(har)), (2, "[]"), (3, None), (4, "{")], "capture_id int, har string")
    req = api_surface.api_requests(api_surface.har_entries(hars), F.lit("h.example"))
    got = {(r["method"], r["path"]): (r["statuses"], r["requests"]) for r in api_surface.clusters(req).collect()}
    assert got == {("GET", "/users/{id}"): ([200, 404], 2), ("GET", "/late"): ([200], 1)}
    doc = json.loads(api_surface.openapi(api_surface.clusters(req), "https://h.example").first()["document"])
    assert doc["paths"]["/users/{id}"]["get"]["responses"] == {"200": {"description": ""}, "404": {"description": ""}} and doc["servers"][0]["url"] == "https://h.example"
    marks = spark.createDataFrame([(1, 0, "load", 1), (1, 1, "scroll", 5), (1, 2, "tie", 5), (1, 3, "after", 9)], "capture_id int, seq int, label string, s int")
    marks = marks.select("capture_id", "seq", "label", F.timestamp_seconds(F.lit(1767225600) + F.col("s")).alias("at"))
    actions = api_surface.correlate(marks, req).collect()
    assert [(a["label"], a["endpoints"], a["requests"]) for a in actions] == [("tie", ["GET /users/{id}"], 2)]


def test_probes(spark):
    r = spark.createDataFrame([("t", 0, "a", 200, "<html>"), ("t", 1, "b", 200, '{"swagger":"2.0"}'), ("t", 2, "c", 200, '{"openapi":"3.1.0"}'), ("u", 0, "d", 404, '{"openapi":"3.0"}')], "target string, rank int, url string, status int, body string")
    assert [tuple(x) for x in api_surface.specs(r).collect()] == [("t", "swagger", "2.0", "b")]
    g = spark.createDataFrame([("t", 0, "a", 200, "{}"), ("t", 1, "b", 200, '{"data":{"__schema":{"types":[1,2]}}}')], r.schema)
    assert [tuple(x) for x in api_surface.graphql(g).collect()] == [("t", "b", 2)]


def png(image: np.ndarray, kind: int = 0) -> bytes:
    h, w, c = image.shape
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    flat = image.reshape(h, w * c).astype(np.int32)
    rows = b""
    for y in range(h):
        up = flat[y - 1] if y else np.zeros(w * c, np.int32)
        left = np.concatenate([np.zeros(c, np.int32), flat[y][:-c]])
        corner = np.concatenate([np.zeros(c, np.int32), up[:-c]])
        p = left + up - corner
        a, b, d = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        rows += bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (7, 9, channels), dtype=np.uint8)
    got = images.decode_png(png(image, kind))
    assert np.array_equal(got, np.repeat(image, 3, 2) if channels == 1 else image[:, :, :3])
    assert images.decode_png(b"no") is None and images.decode_png(png(image, kind)[:40]) is None


def test_hash_and_crop(spark):
    ramp = np.repeat(np.arange(0, 252, 4, dtype=np.uint8)[None, :, None], 32, 0).repeat(3, 2)
    assert images.dhash(ramp) == -1 and images.dhash(ramp[:, ::-1]) == 0
    big = np.random.default_rng(1).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    assert images.find_crop(big[5:9, 7:12], big) == (7, 5) and images.find_crop(big, big[:5]) is None
    flat = np.zeros((200, 200, 3), np.uint8)
    flat[150, 160] = 9
    assert images.find_crop(flat[140:155, 150:165], flat) == (150, 140)  # past thousands of places with the same corner
    assert images.find_crop(flat[140:155, 150:165], flat, images.MAX_POSITIONS) is None
    df = spark.createDataFrame([(bytearray(png(big[2:6, 3:8])), bytearray(png(big))), (bytearray(b"x"), None)], "c binary, p binary")
    got = [tuple(r["v"]) for r in df.select(images.crop_position("c", "p").alias("v")).collect()]
    assert got == [(3, 2), (None, None)]
    assert [r["h"] for r in df.select(images.perceptual_hash("p").alias("h")).collect()][1] is None


def test_picture_reuse(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(6)]
    shots = []
    for i in range(120):
        h = rng.choice(base)
        for _ in range(rng.randrange(5)):
            h ^= 1 << rng.randrange(63)
        if i % 17 == 0:
            h = 0
        shots.append(("g" if i % 2 else "k", i, f"{h}-{rng.randrange(2)}", h))
    df = spark.createDataFrame(shots, "grp string, seq bigint, key string, hash bigint")
    want = {}
    for grp in "gk":
        by_key, kept = {}, []
        for g, seq, key, h in shots:
            if g != grp:
                continue
            if key in by_key:
                want[seq] = by_key[key]
                continue
            hit = next((s for k, s in kept if h and (k ^ h).bit_count() <= 3), None)
            if hit is None:
                hit = seq
                if h:
                    kept.append((h, seq))
            want[seq] = by_key[key] = hit
    assert {r["seq"]: r["kept"] for r in images.resolve_pictures(df).collect()} == want


def test_history(spark):
    runs = spark.createDataFrame([(1, 1, "u", "2026-01-02T00:00:00Z"), (2, 1, "u", "2026-01-02T01:00:00+01:00"), (3, 1, "u", "2026-01-01T00:00:00Z"), (4, 2, "v", None)], "id bigint, site_id bigint, url string, captured_at string")
    assert {(r["url"], r["id"]) for r in store.latest_runs(runs).collect()} == {("u", 2), ("v", 4)}
    sites = spark.createDataFrame([(1, "a.example"), (2, "b.example"), (3, "c.example")], store.SITES_DDL)
    assert [r["domain"] for r in store.domains(sites, runs).collect()] == ["a.example", "b.example"]
    more = store.add_sites(sites, spark.createDataFrame([("https://d.example:8/x",), ("a.example",)], "url_or_domain string"))
    assert more.count() == 4 and more.select("id").distinct().count() == 4 and more.filter("domain = 'd.example:8'").count() == 1
    s = spark.createDataFrame([(1, 1, "x", '{"cookies":[{"name":"a","value":"b"},{"name":"c"}]}', "t", "t")], store.SESSIONS_DDL)
    put = store.put_session(s, spark.createDataFrame([(2, 1, "x", "{}", "t2", "t2"), (3, 1, "y", "{}", "t", None)], store.SESSIONS_DDL))
    assert sorted((r["label"], r["created_at"], r["last_used_at"]) for r in put.collect()) == [("x", "t2", None), ("y", "t", None)]
    assert store.drop_session(put, put.filter("label = 'x'")).count() == 1 and store.list_sessions(put, sites).count() == 2
    assert [tuple(r) for r in store.session_cookies(s).collect()] == [(1, "a", "b", "", "/")]


def test_change_rounds(spark):
    v = spark.createDataFrame([], "url string, etag string, last_modified string, content_hash string")
    r = spark.createDataFrame([("a", 200, "x", "e", None), ("b", 304, None, None, None)], "url string, status int, body string, etag string, last_modified string")
    assert {(x["url"], x["unchanged"]) for x in change.detect(r, v).collect()} == {("a", False), ("b", True)}
    after = change.record(r, v)
    assert after.count() == 1 and change.detect(r, after).filter("url = 'a' and unchanged").count() == 1
    heads = {x["url"]: x["headers"] for x in change.request_headers(r.select("url"), after).collect()}
    assert heads == {"a": {"If-None-Match": "e"}, "b": {}}


def test_stats(spark):
    s = spark.createDataFrame([("a", float(i), "d") for i in range(1, 21)] + [("b", 5.0, "x")], "op string, duration_s double, detail string")
    got = {r["op"]: (r["n"], r["median"], r["p95"]) for r in stats.op_stats(s).collect()}
    assert got == {"a": (20, 10.5, 19.0), "b": (1, 5.0, 5.0)}
    assert [r["duration_s"] for r in stats.slowest(s, 2).collect()] == [20.0, 19.0] and stats.benchmark_entries(stats.op_stats(s)).count() == 4


SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType())])


@pytest.mark.parametrize("ending", ["json", "jsonl", "csv", "md", "sqlite", "parquet"])
def test_sinks(spark, tmp_path, ending):
    df = spark.createDataFrame([("a|b\n", 1.5), (None, None), ("password=abc", 2.0)], SCHEMA)
    path = str(tmp_path / f"out.{ending}")
    assert sinks.write_records(df.select("price", "name"), SCHEMA, path, merged=True) == ending
    if ending == "json":
        got = json.load(open(path))
        assert got[1] == {"name": None, "price": None} and got[2]["name"] == "password=[REDACTED]"
    elif ending == "csv":
        assert open(path, newline="").read().startswith("name,price\r\n")
    elif ending == "md":
        assert open(path).read().splitlines()[2:4] == ["| a\\|b  | 1.5 |", "|  |  |"]
    elif ending == "sqlite":
        assert sqlite3.connect(path).execute("select count(*), sum(price) from records").fetchone() == (3, 3.5)
    elif ending == "jsonl":
        assert spark.read.json(path).count() == 3
    else:
        assert spark.read.parquet(path).columns == ["name", "price"]


def test_sinks_in_parts(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5), (None, None), ("password=abc", 2.0), ('q "x", y', 3.0)], SCHEMA).repartition(2)
    at = lambda name: f"file://{tmp_path}/{name}"
    parts = lambda name: [p.read_text() for p in sorted((tmp_path / name).glob("part-*")) if p.read_text()]
    for name in ("o.json", "o.csv", "o.md"):
        sinks.write_records(df, SCHEMA, at(name))
    rows = [r for text in parts("o.json") for r in json.loads(text)]
    assert len(rows) == 4 and {"name": None, "price": None} in rows and {"name": "password=[REDACTED]", "price": 2.0} in rows
    back = spark.read.option("header", "true").option("escape", '"').csv(at("o.csv"))
    assert back.columns == ["name", "price"] and back.filter("""name = 'q "x", y'""").count() == 1 and back.count() == 4
    assert all(t.startswith("| name | price |\n| --- | --- |\n") for t in parts("o.md")) and sum(t.count("\n") - 2 for t in parts("o.md")) == 4


def test_depths_equal_levels(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", i) for i in range(110)]
    e = spark.createDataFrame(edges, "src string, dst string, seq bigint")
    roots = spark.createDataFrame([("n0", 0), ("n0", 1)], "node string, seq bigint")
    both = [sorted((r["node"], r["depth"]) for r in df.collect()) for df in (graph.levels(e, roots, 5), graph.depths(e, roots, 5))]
    assert both[0] == both[1] and graph.depths(e, roots.limit(0)).count() == 0


def test_two_levels_equal_one(spark):
    """Running totals and next rows over blocks equal those over whole keys, with null keys and gaps."""
    from pyspark.sql import Window

    from tidemark.operators import history

    rng = random.Random(9)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), i * rng.choice([1, 1]), rng.randrange(5)) for i in range(300) if i % 50 > 4]
    df = spark.createDataFrame(data, "k string, t bigint, v int")
    w = Window.partitionBy("k").orderBy("t")
    block = F.floor(F.col("t") / 7)
    want = sorted(df.select("k", "t", F.sum("v").over(w).alias("s"), F.lead("v").over(w).alias("n")).collect(), key=str)
    got = history.with_next(history.running(df, "k", ["t"], {"s": F.col("v")}, block), "k", "t", ["v"], block)
    assert sorted(got.select("k", "t", "s", F.col("next.v").alias("n")).collect(), key=str) == want


def test_sink_checks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "name string, price string")
    for bad in (df, df.drop("price"), df.withColumn("z", F.lit(1))):
        with pytest.raises(ValueError):
            sinks.write_records(bad, SCHEMA, str(tmp_path / "x.csv"))
    assert not (tmp_path / "x.csv").exists()
    with pytest.raises(ValueError):
        sinks.resolve_format("x.xlsx")
    with pytest.raises(ValueError):
        sinks.resolve_format("x.csv", "xlsx")


def test_streams(spark, tmp_path):
    src = tmp_path / "pages"
    pages = spark.createDataFrame([("a", 1, 200, "x"), ("a", 2, 200, "x"), ("a", 3, 304, None), ("a", 4, 200, "y"), ("b", 1, 304, None)], "url string, seq bigint, status int, body string")
    pages.coalesce(1).write.parquet(f"{src}/1")
    pages.limit(1).selectExpr("'a' as url", "5L as seq", "200 as status", "'y' as body").write.parquet(f"{src}/2")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = streams.changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["url"], r["seq"]): r["changed"] for r in spark.table("changes").collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("a", 4): True, ("a", 5): False, ("b", 1): False}


def test_streaming_sessions_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"))
    batch = streams.quiet_sessions(e, 21600.0)
    e.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    seen = []
    q = streams.each_batch(streams.quiet_sessions(stream, 21600.0), lambda df, _: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    done = {tuple(r) for r in batch.collect()}
    assert seen and {tuple(r) for r in seen} <= done
