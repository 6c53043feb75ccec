"""Nested records to flat related tables, by one depth-first tagged emission.

Every JSON object below the top of a column becomes one row ``(tag, key, parent
key, payload)``. The visitor parses each text once and emits the rows of all
tables in the same pass; :func:`write_tables` then lays them out by tag and
:func:`read_table` applies a table's schema.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import column_map
from ..functions.jsontext import MISSING, decode
from ..session import staging_path

#: Keys whose value is a list even where a bare object stands for a list of one.
LIST_KEYS = frozenset({"variants", "offers", "seasons", "episodes", "actions", "skipped"})
#: Table of an object by the last key of its path.
TAGS = {
    "": "record",
    "variants": "variant",
    "offers": "offer",
    "seasons": "season",
    "episodes": "episode",
    "states": "state",
    "actions": "action",
    "transitions": "transition",
    "skipped": "skip",
}
#: Table of all objects that have no table of their own; so data decides no names of tables.
OTHER = "other"
#: Bytes of a row group; a task holds one for each table it writes.
ROW_GROUP = 16 << 20
COLUMNS = ("records_json", "api_surface_json", "exploration_json")
#: Columns of which the outermost object is the container and no row of its own.
CONTAINERS = frozenset({"api_surface_json", "exploration_json"})

EMITTED = "run_id bigint, json_col string, tag string, path string, parent_path string, payload string"

#: Typed payloads of the known tables.
SCHEMAS = {
    "record": "sku string, name string, title string, price string, category string, brand string",
    "variant": "code string, size string",
    "offer": "seller string, price double",
    "season": "no int",
    "episode": "no int, minutes int, note string",
    "state": "id string",
    "action": "role string, name string, fill_value string",
    "transition": "`from` string, `to` string",
    "skip": "`from` string, reason string",
}


def visit(value: object, container: bool, emit) -> None:
    """Depth-first walk; calls ``emit(object, key, path, parent_path)`` for each case."""
    if type(value) is dict:
        stack = [(value, "", "", "", container)] if container else [(value, "", "[0]", "", False)]
    elif type(value) is list:
        stack = [(value, "", "", "", False)]
    else:
        return
    while stack:
        node, key, path, parent, top = stack.pop()
        if type(node) is list:
            for i in range(len(node) - 1, -1, -1):
                child = node[i]
                if type(child) is dict or type(child) is list:
                    stack.append((child, key, f"{path}[{i}]", parent, False))
            continue
        if not top:
            emit(node, key, path, parent)
            parent, prefix = path, path + "."
        else:
            prefix = ""
        for name, child in reversed(node.items()):
            if type(child) is dict:
                at = f"{prefix}{name}[0]" if name in LIST_KEYS else prefix + name
                stack.append((child, name, at, parent, False))
            elif type(child) is list:
                stack.append((child, name, prefix + name, parent, False))


def _own(node: dict) -> dict:
    """An object without the objects below it, which have rows of their own."""
    return {
        k: v
        for k, v in node.items()
        if type(v) is not dict and not (type(v) is list and any(type(x) in (dict, list) for x in v))
    }


def _tag(col: str, key: str) -> str:
    return TAGS.get(key, OTHER) if key or col == "records_json" else OTHER


def emit_tagged(
    runs: DataFrame, columns: tuple[str, ...] = COLUMNS, run_id: str = "id", payload: bool = True
) -> DataFrame:
    """One row per nested object of ``columns``: tag, key (run, column, path), parent key, payload.

    ``path`` counts null elements; a null or unparsable text, a bare scalar and an
    empty list give no rows. Keys of ``runs`` may repeat: each row is walked by
    itself. ``payload=False`` leaves the payload out where only keys are needed.
    """
    schema = pa.schema(
        [("run_id", pa.int64()), ("json_col", pa.string()), ("tag", pa.string()), ("path", pa.string()), ("parent_path", pa.string())]
        + [("payload", pa.string())] * payload
    )

    def walk(ids: list, *texts: list) -> list[list]:
        out: list[list] = [[] for _ in schema]
        o_run, o_col, o_tag, o_path, o_parent = out[:5]
        for col, column in zip(columns, texts):
            container = col in CONTAINERS
            for run, text in zip(ids, column):
                value = decode(text)
                if value is MISSING:
                    continue

                def emit(node, key, path, parent):
                    o_run.append(run)
                    o_col.append(col)
                    o_tag.append(_tag(col, key))
                    o_path.append(path)
                    o_parent.append(parent)
                    if payload:
                        out[5].append(json.dumps(_own(node), ensure_ascii=False))

                visit(value, container, emit)
        return out

    spark_schema = EMITTED if payload else EMITTED.rsplit(",", 1)[0]
    picked = runs.select(F.col(run_id).cast("bigint").alias("run_id"), *(F.col(c).cast("string").alias(c) for c in columns))
    return picked.mapInArrow(column_map(walk, schema), spark_schema)


def write_tables(emitted: DataFrame, path: str, rebalance: bool = False) -> None:
    """Write the emission laid out by tag, one folder for each of the tables of ``TAGS`` and ``OTHER``.

    A task writes all its tables side by side, without sorting. ``rebalance`` first moves rows
    into files of even size per table, split or merged by size, where a scan has many small tasks.
    """
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    spark = emitted.sparkSession
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(len(TAGS) + 2))
    try:
        rows = emitted.hint("rebalance", "tag") if rebalance else emitted
        writer = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
        writer.partitionBy("tag").parquet(path)
    finally:
        spark.conf.set(setting, before)


def typed(emitted: DataFrame, tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The rows of one table with its payload as typed columns, prefixed by their keys.

    Fields the schema doesn't name stay in ``rest``, by name, as text.
    """
    kind = T.StructType.fromDDL(schema or SCHEMAS[tag]) if not isinstance(schema, T.StructType) else schema
    known = [f.name for f in kind]
    rows = emitted.filter(F.col("tag") == tag).withColumns({"p": F.from_json("payload", kind), "m": F.from_json("payload", "map<string,string>")})
    rest = F.map_filter("m", lambda k, v: ~k.isin(known) & v.isNotNull()).alias("rest")
    return rows.select("run_id", "json_col", "path", "parent_path", *(F.col("p")[n].alias(n) for n in known), rest)


def read_table(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One table written by :func:`write_tables`; only its folder is read."""
    return typed(spark.read.schema(EMITTED).parquet(path), tag, schema)


def staged_tables(runs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The emission of ``runs``, written by tag into the shared folder and read back."""
    spark = runs.sparkSession
    path = staging_path(spark, "nested")
    write_tables(emit_tagged(runs, columns), path)
    return spark.read.schema(EMITTED).parquet(path)


def nested_table(runs: DataFrame, tag: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """One of the tables of ``runs`` with its links to run and parent, and its fields typed."""
    return typed(staged_tables(runs, columns), tag)


def nested_objects(runs: DataFrame) -> DataFrame:
    """Keys and parent keys of every nested object of ``runs``, over all its tables.

    Every row counts, repeated runs too. Null, empty, unparsable and scalar texts give no
    rows, as does an empty table; keys keep their text, with lone surrogates escaped.
    Other columns of ``runs`` are not read, whatever their names.
    """
    return staged_tables(runs).select("run_id", "json_col", "path", "parent_path")
