"""State graphs: states, transitions and skips as tables, and walks over them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import column_map
from ..functions.jsontext import MISSING, decode
from ..session import staged


def first_by(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key by ``seq``."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    best = F.min(F.struct(seq, *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("_b")[seq].alias(seq), *(F.col("_b")[c].alias(c) for c in rest)).select(*df.columns)


def depths(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): breadth-first depths from ``roots``, where neither order nor ways matter.

    ``edges``: src, dst; ``roots``: node. Each level is written once, by a join and an anti join
    with the levels before; nothing is sorted.
    """
    spark = edges.sparkSession
    frontier = staged(roots.select("node").distinct().withColumn("depth", F.lit(0)), "depths")
    links = edges.select("src", "dst").distinct()
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = _union(spark, parts).select(F.col("node").alias("dst"))
        hops = frontier.join(links, F.col("node") == F.col("src")).select("dst").distinct()
        frontier = staged(hops.join(seen, "dst", "left_anti").select(F.col("dst").alias("node"), F.lit(depth).alias("depth")), "depths")
        if frontier.limit(1).count() == 0:
            break
        parts.append(frontier)
    return _union(spark, parts)


def levels(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, order, parent, edge): breadth-first levels from ``roots``.

    ``edges``: src, dst, seq; ``roots``: node, seq. A node belongs to its first level; of
    several ways there the one from the earliest parent, then the earliest edge, is kept.
    Each level is one join and one anti join, written to the shared folder, so the plan
    doesn't grow with depth and a lost executor costs one level at most.
    """
    spark = edges.sparkSession
    start = roots.groupBy("node").agg(F.min("seq").alias("seq")).select("node", F.struct("seq", "node").alias("_k"))
    none = lambda kind: F.lit(None).cast(kind)
    kinds = dict(edges.dtypes)
    frontier = dense_rank(start, "_k", "order").select("node", F.lit(0).alias("depth"), "order", none(kinds["src"]).alias("parent"), none(kinds["seq"]).alias("edge"))
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = _union(spark, parts).select(F.col("node").alias("dst"))
        hops = frontier.join(edges, F.col("node") == F.col("src")).select("dst", "order", F.col("src").alias("parent"), F.col("seq").alias("edge"))
        fresh = hops.join(seen, "dst", "left_anti")
        best = fresh.groupBy("dst").agg(F.min(F.struct("order", "edge", "parent")).alias("b"))
        nxt = best.select(
            F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.struct("b.order", "b.edge").alias("_k"), F.col("b.parent").alias("parent"), F.col("b.edge").alias("edge")
        )
        found, total = ranked(nxt, "_k", "order")
        if not total:
            break
        frontier = found.select("node", "depth", "order", "parent", "edge")
        parts.append(frontier)
    return _union(spark, parts)


def ranked(df: DataFrame, key: str, out: str) -> tuple[DataFrame, int]:
    """Rows numbered from 1 by ``key`` over all partitions, and how many there are.

    A range sort, one staged write with each row's place in its partition, and the
    partitions' counts: as many numbers for the driver as there are partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id()).drop(key), "ranked")
    part = F.shiftright("_m", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in before or [0])), (part + 1).cast("int"))
    return placed.withColumn(out, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + offset + 1).drop("_m"), total


def dense_rank(df: DataFrame, key: str, out: str) -> DataFrame:
    return ranked(df, key, out)[0]


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def paths(tree: DataFrame, transitions: DataFrame) -> DataFrame:
    """(state, steps): the actions from the root to each state, as (role, name, landed).

    ``tree`` is :func:`levels`; one join per depth prepends nothing but appends a step,
    going down level by level.
    """
    step = transitions.select(F.col("seq").alias("edge"), F.struct("role", "name", F.col("dst").alias("landed")).alias("step"))
    depth = tree.agg(F.max("depth").alias("d")).first()["d"] or 0
    done = tree.filter("depth = 0").select(F.col("node").alias("state"), F.array().cast("array<struct<role:string,name:string,landed:string>>").alias("steps"))
    parts = [done]
    for d in range(1, depth + 1):
        here = tree.filter(F.col("depth") == d).join(step, "edge").select(F.col("node").alias("_n"), F.col("parent").alias("state"), "step")
        done = here.join(parts[-1], "state").select(F.col("_n").alias("state"), F.array_append("steps", F.col("step")).alias("steps"))
        parts.append(done)
    return _union(tree.sparkSession, parts)


def merge(known: DataFrame, observed: DataFrame, key: list[str]) -> DataFrame:
    """Known rows, and the observed ones whose key is new; each once."""
    return known.unionByName(observed.dropDuplicates(key).join(known.select(*key), key, "left_anti"))


def merge_edges(known: DataFrame, observed: DataFrame, key: tuple[str, ...] = ("src", "role", "name", "dst")) -> DataFrame:
    """Edges of a resumed walk added to a saved map, each once; nulls in the key are equal.

    With ``fill_value`` in the key, a fill that leads nowhere is no edge.
    """
    fresh = observed.filter(F.col("src") != F.col("dst")) if "fill_value" in key else observed
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
    return known.unionByName(fresh.dropDuplicates(list(key)).alias("o").join(known.alias("k"), same, "left_anti"))


# Choosing states ------------------------------------------------------------


def parse_selector(text: str) -> Column:
    """A predicate on state_id, title, url and path from ``kind:value``."""
    kind, colon, value = text.partition(":")
    if not colon or not value:
        raise ValueError(f"a selector is kind:value, not {text!r}")
    if kind == "id":
        return F.col("state_id").startswith(value)
    if kind in ("title", "url"):
        return F.coalesce(F.col(kind) == value, F.lit(False))
    if kind == "path":
        steps = [s.partition(":") for s in value.split(" > ")]
        want = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(n).alias("name")) for r, _, n in steps))
        return F.coalesce(F.col("path") == want, F.lit(False))
    raise ValueError(f"unknown selector kind {kind!r}")


def resolve_anchor(candidates: DataFrame, selectors: list[str]) -> str:
    """The one state that all selectors choose; none or several is an error, never a guess."""
    if not selectors:
        raise ValueError("no selector given")
    chosen = candidates
    for s in selectors:
        chosen = chosen.filter(parse_selector(s))
    found = [r["state_id"] for r in chosen.select("state_id").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("no state matches" if not found else "several states match")
    return found[0]


def unique_prefix(states: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, state_id) where exactly one state starts with the prefix, else null.

    An equi join: states are cut to the lengths that occur among the prefixes, at most
    as many as an id has characters.
    """
    lengths = [r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]
    cut = states.select("state_id", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n")).select("state_id", F.expr("substring(state_id, 1, n)").alias("prefix"))
    hits = prefixes.select("prefix").distinct().join(cut, "prefix", "left")
    return hits.groupBy("prefix").agg(F.when(F.count_distinct("state_id") == 1, F.max("state_id")).alias("state_id"))


# Views ----------------------------------------------------------------------


def actions_with_targets(actions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Each action with the first transition it fired; transitions without an action follow.

    ``actions``: state_id, pos, role, name; ``transitions``: src, role, name, dst, seq.
    """
    first = first_by(transitions.select(F.col("src").alias("state_id"), "role", "name", "dst", "seq"), ["state_id", "role", "name"], "seq")
    left = actions.join(first, ["state_id", "role", "name"], "left").select("state_id", "pos", "role", "name", "dst")
    rest = first.join(actions, ["state_id", "role", "name"], "left_anti").select("state_id", F.lit(None).cast("int").alias("pos"), "role", "name", "dst")
    return left.unionByName(rest)


def replay_baseline(path_steps: DataFrame, edge_signals: DataFrame) -> DataFrame:
    """(edge, items): everything seen on the way to a transition, as one set.

    ``path_steps``: edge, on_edge (edges replayed before it); ``edge_signals``: on_edge, items.
    """
    return path_steps.join(edge_signals, "on_edge").groupBy("edge").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


_TEXTS = pa.schema([("run_id", pa.int64()), ("text", pa.string())])


def _listed(node: dict, *keys: str) -> bool:
    """Bare objects under ``keys`` become lists of one; True if there were any."""
    bare = [k for k in keys if type(node.get(k)) is dict]
    for k in bare:
        node[k] = [node[k]]
    return bool(bare)


def map_text(text: str | None) -> str | None:
    """The JSON text of a stored map, encoded once and with a list wherever one belongs; None if it doesn't parse."""
    value = decode(text)
    if value is MISSING:
        return None
    if type(value) is not dict:
        return json.dumps(value)
    changed = _listed(value, "states", "transitions", "skipped")
    for state in value["states"] if type(value.get("states")) is list else ():
        changed |= type(state) is dict and _listed(state, "actions")
    if changed:
        return json.dumps(value)
    return json.loads(text) if text.lstrip().startswith('"') else text


def explode_map(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """States, transitions and skips of stored exploration maps, each with its order.

    ``runs``: run_id, exploration_json. What doesn't parse gives no rows; a map encoded
    twice is decoded twice, and a bare object in place of a list is a list of one.
    """
    action = "struct<role:string,name:string,fill_value:string>"
    schema = (
        f"struct<states:array<struct<id:string,actions:array<{action}>,signals:struct<ax_node_count:bigint,console_count:bigint,storage_count:bigint,network_count:bigint>>>,"
        f"transitions:array<struct<`from`:string,action:{action},`to`:string,changed:string>>,"
        f"skipped:array<struct<`from`:string,action:{action},reason:string>>>"
    )
    texts = runs.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("exploration_json").alias("text"))
    decoded = texts.mapInArrow(column_map(lambda ids, ts: [ids, [map_text(t) for t in ts]], _TEXTS), "run_id bigint, text string")
    m = decoded.select("run_id", F.from_json("text", schema).alias("m"))
    at = lambda name: m.select("run_id", F.posexplode(f"m.{name}").alias("seq", "x")).filter(F.col("x").isNotNull())
    states = at("states").select("run_id", "seq", F.col("x.id").alias("state_id"), "x.actions", "x.signals")
    transitions = at("transitions").select(
        "run_id", "seq", F.col("x.from").alias("src"), "x.action.role", "x.action.name", "x.action.fill_value", F.col("x.to").alias("dst"), "x.changed"
    )
    skips = at("skipped").select("run_id", "seq", F.col("x.from").alias("src"), "x.action.role", "x.action.name", "x.reason")
    return states, transitions, skips


def shareable_map(states: DataFrame, transitions: DataFrame, skips: DataFrame) -> DataFrame:
    """(run_id, exploration): one nested value per run, everything in its order."""
    listed = lambda df, name, *cols: df.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*cols).alias("v")))), lambda x: x["v"]).alias(name)
    )
    action = F.struct("role", "name").alias("action")
    s = listed(states, "states", F.col("state_id").alias("id"), "actions", "signals")
    t = listed(transitions, "transitions", F.col("src").alias("from"), action, F.col("dst").alias("to"), "changed")
    k = listed(skips, "skipped", F.col("src").alias("from"), action, "reason")
    joined = s.join(t, "run_id", "left").join(k, "run_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(c)
    counts = F.struct(*(size(c) for c in ("states", "transitions", "skipped"))).alias("counts")
    return joined.select("run_id", F.struct("states", "transitions", "skipped", counts).alias("exploration"))


def mermaid_edges(states: DataFrame, transitions: DataFrame, label: Column) -> DataFrame:
    """(run_id, line, seq): lines of a Mermaid diagram whose two ends are known states."""
    index = states.select("run_id", "state_id", F.col("seq").alias("n"))
    a, b = index.select("run_id", F.col("state_id").alias("src"), F.col("n").alias("a")), index.select("run_id", F.col("state_id").alias("dst"), F.col("n").alias("b"))
    rows = transitions.join(a, ["run_id", "src"]).join(b, ["run_id", "dst"])
    return rows.select("run_id", F.format_string("    S%d -->|%s| S%d", "a", label, "b").alias("line"), "seq")


def field_actions(fields: DataFrame, actions: DataFrame, roles) -> DataFrame:
    """Each scaffold field with the first typed control of its name in its state."""
    pool = first_by(actions.filter(F.col("role").isin(*roles)).select("state_id", "name", "pos", "role"), ["state_id", "name"], "pos")
    return fields.join(pool, ["state_id", "name"], "left")
