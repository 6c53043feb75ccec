"""What browser adapters record, made relational: DOM snapshots, clips, visual states, fills."""

from __future__ import annotations

import json
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import safety
from ..functions.arrow import column_map
from .graph import field_actions, unique_prefix
from .images import NEAR_BITS, crop_position, near_pairs, resolve_pictures

_NODES = pa.schema([("snapshot_id", pa.int64()), ("backend_id", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])
NODES_DDL = "snapshot_id bigint, backend_id int, tag string, attrs map<string,string>"
_BELOW = ("children", "shadowRoots", "pseudoElements")


def dom_nodes(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, backend_id, tag, attrs) of browser DOM trees given as JSON, through shadow roots
    and frames. ``snapshots``: snapshot_id, dom. What doesn't parse gives no rows."""

    def walk(ids, texts):
        out: list[list] = [[], [], [], []]
        for snap, text in zip(ids, texts):
            try:
                todo = [json.loads(text)] if text is not None else []
            except (ValueError, RecursionError):
                continue
            while todo:
                node = todo.pop()
                if type(node) is not dict:
                    continue
                flat = node.get("attributes")
                flat = flat if type(flat) is list else []
                pairs = {}
                for name, value in zip(flat[::2], flat[1::2]):
                    if type(name) is str and type(value) is str:
                        pairs.setdefault(name, value)
                if type(node.get("backendNodeId")) is int:
                    for c, v in zip(out, (snap, node["backendNodeId"], str(node.get("nodeName") or "").lower(), list(pairs.items()))):
                        c.append(v)
                for key in _BELOW:
                    if type(node.get(key)) is list:
                        todo.extend(node[key])
                todo.append(node.get("contentDocument"))
        return out

    return snapshots.select(F.col("snapshot_id").cast("bigint"), "dom").mapInArrow(column_map(walk, _NODES, 32), NODES_DDL)


def hrefs(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, backend_id, href) of the elements that carry one."""
    return nodes.select("snapshot_id", "backend_id", F.col("attrs")["href"].alias("href")).filter("href is not null")


def input_types(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, backend_id, input_type) of input elements, text where none is given."""
    kind = F.coalesce(F.nullif(F.lower(F.col("attrs")["type"]), F.lit("")), F.lit("text"))
    return nodes.filter("tag = 'input'").select("snapshot_id", "backend_id", kind.alias("input_type"))


def border_box(quad: Column) -> Column:
    """struct(x, y, width, height) around a border quad of four corners; null without an area."""
    xs, ys = (F.array(*(F.try_element_at(quad, F.lit(i)) for i in range(start, 9, 2))) for start in (1, 2))
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), w.alias("width"), h.alias("height"))
    return F.when((F.size(quad) >= 8) & (w > 0) & (h > 0), box)


def clips(shots: DataFrame) -> DataFrame:
    """(state_id, pos, src, x, y) of element pictures: a place in the state's picture, else a file of their own.

    ``shots``: state_id, pos, clip, page, page_src, own_src.
    """
    at = shots.withColumn("at", crop_position("clip", "page"))
    inside = F.col("at.x").isNotNull()
    return at.select("state_id", "pos", F.when(inside, F.col("page_src")).otherwise(F.col("own_src")).alias("src"), F.when(inside, F.col("at.x")).alias("x"), F.when(inside, F.col("at.y")).alias("y"))


def visual_states(seen: DataFrame) -> DataFrame:
    """(seq, state_id): states that share a DOM id, told apart by how they look.

    ``seen``: dom_id, seq, hash. The first look of a DOM id keeps the id; a look more than
    three bits from every earlier one is a state of its own. Without a picture the id stays.
    """
    flat = F.col("hash") == 0
    shots = seen.select(F.col("dom_id").alias("grp"), "seq", F.when(F.col("hash").isNull(), F.lit("none")).otherwise(F.col("hash").cast("string")).alias("key"), F.when(~flat, F.col("hash")).alias("hash"))
    kept = resolve_pictures(shots.filter("key != 'none'"))
    named = seen.select(F.col("seq").alias("kept"), F.col("hash").alias("kept_hash"))
    first = seen.filter("hash is not null").groupBy(F.col("dom_id").alias("grp")).agg(F.min("seq").alias("first"))
    rows = kept.join(named, "kept").join(first, "grp")
    unsigned = F.col("kept_hash").cast("decimal(20,0)") + F.when(F.col("kept_hash") < 0, F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(F.lit(0))
    own = F.sha2(F.concat_ws(":", "grp", unsigned.cast("decimal(20,0)").cast("string")), 256)
    state = F.when(F.col("kept") == F.col("first"), F.col("grp")).otherwise(own)
    return rows.select("seq", state.alias("state_id")).unionByName(seen.filter("hash is null").select("seq", F.col("dom_id").alias("state_id")))


def alike(seen: DataFrame) -> DataFrame:
    """Pairs of looks within three bits; see :func:`.images.near_pairs`."""
    return near_pairs(seen, NEAR_BITS)


@F.pandas_udf(T.StringType())
def generated_value(kind: pd.Series) -> pd.Series:
    """A fresh value of a kind, null for kinds that can't be made up."""
    pick, n = random.choice, random.randint
    words = "amber birch cedar delta ember fjord grove harbor inlet juniper".split()
    make = {
        "email": lambda: f"{pick(words)}.{pick(words)}{n(1, 99)}@example.com",
        "phone": lambda: f"+1-555-01{n(0, 99):02d}",
        "url": lambda: f"https://{pick(words)}.example/{pick(words)}",
        "number": lambda: str(n(1, 1000)),
        "date": lambda: f"20{n(0, 30):02d}-{n(1, 12):02d}-{n(1, 28):02d}",
        "text": lambda: " ".join(random.sample(words, 4)).capitalize(),
    }
    return kind.map(lambda k: make[k]() if k in make else None, na_action="ignore")


def fill_plan(fields: DataFrame, states: DataFrame, actions: DataFrame, depths: DataFrame, sandbox: Column) -> DataFrame:
    """(state, name, value, verdict): what becomes of each field of a scaffold before anything is typed.

    ``fields`` as read by ``sources.bronze.scaffold``; ``states``: state_id; ``actions``: state_id,
    pos, role, name; ``depths``: state_id, depth. Only fields of the root state are typed.
    """
    what = safety.field_to_apply(F.col("value"), F.col("is_text"), F.col("generate"), F.col("kind"))
    f = fields.withColumn("what", what).filter("what != 'skipped'").withColumnRenamed("state_id", "prefix")
    value = F.when(F.col("what") == "generate", generated_value(F.col("kind"))).otherwise(F.col("value"))
    f = f.withColumn("value", value).join(unique_prefix(states, f.select("prefix")), "prefix", "left").join(depths, "state_id", "left")
    g = field_actions(f, actions, safety.FIELD_ROLES)
    gate = safety.gate(F.col("name"), F.col("role"), sandbox)
    verdict = (
        F.when(F.col("what").startswith("failed"), F.col("what"))
        .when(F.col("state_id").isNull(), "failed: state prefix did not resolve to exactly one mapped state")
        .when(F.col("depth").isNull(), "failed: no path from the root to this state")
        .when(F.col("depth") > 0, "failed: navigation replay is outside the typing-only scope")
        .when(F.col("role").isNull(), "failed: no matching field on this state")
        .when(~gate["allowed"], F.concat(F.lit("failed: "), gate["reason"]))
        .otherwise("apply")
    )
    return g.select(F.col("prefix").alias("state"), "name", "value", verdict.alias("verdict"))


def run_id(now: Column) -> Column:
    """A new run's id: its time and eight random hex digits."""
    return F.concat_ws("-", F.date_format(now, "yyyyMMdd'T'HHmmss"), F.substring(F.uuid(), 1, 8))
