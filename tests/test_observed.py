"""DOM snapshots, clips, visual states and fill plans."""

import json

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import observed

from .test_maps import png


def test_dom_snapshots(spark):
    tree = {"nodeName": "HTML", "backendNodeId": 1, "children": [
        {"nodeName": "A", "backendNodeId": 2, "attributes": ["class", "x", "href", "/a"]},
        {"nodeName": "IFRAME", "backendNodeId": 3, "contentDocument": {"nodeName": "INPUT", "backendNodeId": 4, "attributes": ["type", "EMAIL"]}},
        {"nodeName": "DIV", "backendNodeId": 5, "shadowRoots": [{"nodeName": "INPUT", "backendNodeId": 6, "attributes": "bad"}]}, "junk"]}
    nodes = observed.dom_nodes(spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None)], "snapshot_id bigint, dom string"))
    assert nodes.count() == 6
    assert [tuple(r) for r in observed.hrefs(nodes).collect()] == [(1, 2, "/a")]
    assert sorted(tuple(r) for r in observed.input_types(nodes).collect()) == [(1, 4, "email"), (1, 6, "text")]


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 1.0, 4.0, 1.0, 4.0, 3.0, 0.0, 3.0],), ([0.0] * 8,), ([1.0],), (None,)], "q array<double>")
    got = [r["b"] and tuple(r["b"]) for r in df.select(observed.border_box(F.col("q")).alias("b")).collect()]
    assert got == [(0.0, 1.0, 4.0, 2.0), None, None, None]


def test_clips(spark):
    page = np.random.default_rng(2).integers(0, 256, (12, 14, 3), dtype=np.uint8)
    other = np.zeros((3, 3, 3), np.uint8)
    rows = [("s", 0, bytearray(png(page[4:7, 5:9])), bytearray(png(page)), "p.png", "c0.png"), ("s", 1, bytearray(png(other)), bytearray(png(page)), "p.png", "c1.png")]
    df = spark.createDataFrame(rows, "state_id string, pos int, clip binary, page binary, page_src string, own_src string")
    assert [tuple(r)[2:] for r in observed.clips(df).orderBy("pos").collect()] == [("p.png", 5, 4), ("c1.png", None, None)]


def test_visual_states(spark):
    rows = [("d", 1, 0b1111), ("d", 2, 0b1110), ("d", 3, 0xFF00), ("d", 4, 0xFF01), ("d", 5, None), ("e", 6, 0b1111), ("d", 7, -1)]
    got = {r["seq"]: r["state_id"] for r in observed.visual_states(spark.createDataFrame(rows, "dom_id string, seq bigint, hash bigint")).collect()}
    assert got[1] == got[2] == got[5] == "d" and got[3] == got[4] and len(got[3]) == 64 and got[6] == "e" and got[7] not in (got[3], "d")


def test_fill_plan(spark):
    fields = spark.createDataFrame(
        [("s0", "Mail", None, "a@b.test", True, False), ("s0", "Age", None, "42", False, False), ("s0", "Web", "url", None, False, True), ("s0", "Odd", "choice", None, False, True), ("s0", "Gone", None, "x", True, False),
         ("s", "Mail", None, "x", True, False), ("s1", "Mail", None, "x", True, False), ("s0", "Blank", None, None, False, False), ("s0", "Delete me", None, "x", True, False)],
        "state_id string, name string, kind string, value string, is_text boolean, generate boolean",
    )
    states = spark.createDataFrame([("s0aa",), ("s1bb",)], "state_id string")
    actions = spark.createDataFrame([("s0aa", 0, "textbox", n) for n in ("Mail", "Web", "Delete me")] + [("s1bb", 0, "textbox", "Mail")], "state_id string, pos int, role string, name string")
    depths = spark.createDataFrame([("s0aa", 0), ("s1bb", 1)], "state_id string, depth int")
    got = {(r["state"], r["name"]): r for r in observed.fill_plan(fields, states, actions, depths, F.lit(False)).collect()}
    verdict = {k: r["verdict"].removeprefix("failed: ") for k, r in got.items()}
    assert verdict["s0", "Mail"] == "apply" and verdict["s0", "Web"] == "apply" and got["s0", "Web"]["value"].startswith("https://")
    assert "quoted" in verdict["s0", "Age"] and "choice" in verdict["s0", "Odd"] and "no matching" in verdict["s0", "Gone"] and "exactly one" in verdict["s", "Mail"]
    assert "typing-only" in verdict["s1", "Mail"] and "destructive" in verdict["s0", "Delete me"] and ("s0", "Blank") not in verdict


def test_run_ids(spark):
    r = spark.range(2).select(observed.run_id(F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("r")).collect()
    assert r[0]["r"].startswith("20260102T030405-") and r[0]["r"] != r[1]["r"]
