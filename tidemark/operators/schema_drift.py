"""Schemas that drift between snapshots: a report of every change, and one table of all.

Every snapshot's schema is a small graph of sections, fields, types and content.
For two consecutive snapshots whose schemas differ, match scores of old and new
nodes start from name, type and content similarity, are flooded through the graphs
until they settle, and the best consistent one-to-one correspondences become the
renames; the rest is added, removed or retyped. The same correspondences, taken over
all snapshots, name the columns into which :func:`unify_records` and
:func:`unify_config` cast and union every version.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import column_map
from ..functions.jsontext import canonical, canonical_any, decode, key_text, records_of
from ..session import small, staged
from . import snapshots
from .flooding import flood, name_similarity
from .history import consecutive, instant_us, standing

REPORT = "run_id bigint, json_col string, field string, old_field string, change_kind string"
_REPORT = pa.schema(
    [("run_id", pa.int64()), *((c, pa.string()) for c in ("json_col", "field", "old_field", "change_kind"))]
)
#: Most distinct field names that become columns; values of rarer ones stay in a map.
MAX_NAMES = 20_000
#: A text that is a number and nothing else; a cast alone would read ``30d`` and ``5f`` as numbers too.
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

Field = tuple[str, str, str]  # name, section, type


#: Flooded score, of the best pair's, that a pair needs to be proposed as a rename.
PROPOSED = 0.2


@lru_cache(maxsize=4096)
def correspondences(lost: tuple[Field, ...], came: tuple[Field, ...], kept: tuple[Field, ...], evidence: tuple) -> tuple:
    """Pairs of a lost and a came field of one section that may be a rename, best first.

    ``evidence`` holds (old index, new index, share of equal content) of the pairs with
    some content in common. Every pair takes part, seeded by its names alone: content is a
    node that both fields hold, weighted by its share, and reaches the pair by flooding,
    as do types, sections and their other fields.
    """
    edges = ([], [])
    seed = {("root", "root"): 1.0}
    for side, fields in enumerate((lost + kept, came + kept)):
        for name, section, kind in fields:
            edges[side].append(("root", "nests", f"section {section}"))
            edges[side].append((f"section {section}", "has", f"field {name}"))
            edges[side].append((f"field {name}", "is", f"type {kind}"))
        edges[side][:] = dict.fromkeys(edges[side])
    for name, section, kind in kept:
        seed[f"field {name}", f"field {name}"] = 1.0
    for _, section, kind in lost + kept:
        seed[f"section {section}", f"section {section}"] = 1.0
        for _, _, other in came + kept:
            seed[f"type {kind}", f"type {other}"] = 1.0 if kind == other else 0.3
    possible = {}
    for i, (a, section, _) in enumerate(lost):
        for j, (b, other, _) in enumerate(came):
            if section == other:
                pair = f"field {a}", f"field {b}"
                possible[pair] = (i, j)
                seed[pair] = 0.25 * name_similarity(a, b)
    for i, j, share in evidence:
        for k, (n, side) in enumerate(((lost[i][0], edges[0]), (came[j][0], edges[1]))):
            side.append((f"field {n}", f"holds {i}-{j}", f"content {i}-{j}"))
        seed[f"content {i}-{j}", f"content {i}-{j}"] = CONTENT * share
    score = flood(*edges, seed)
    top = max((score[p] for p in possible), default=0.0)
    ranked = sorted(possible, key=lambda p: (-score[p], p))
    return tuple((*possible[p], round(score[p], 4)) for p in ranked if score[p] >= PROPOSED * top)


#: Weight of wholly equal content against that of an equal name.
CONTENT = 4.0


def _differences(run: int, col: str, old: dict[str, tuple[str, str]], new: dict[str, tuple[str, str]], same, out) -> None:
    """Append the report rows of one step; ``old``/``new``: name to (section, type).

    Flooding proposes the renames, best first; a proposal stands if both fields are
    free still and more than half of their content is equal.
    """
    lost = tuple((n, *old[n]) for n in old if n not in new)
    came = tuple((n, *new[n]) for n in new if n not in old)
    kept = tuple((n, *new[n]) for n in new if n in old)
    shares = {}
    for i, (a, section, _) in enumerate(lost):
        for j, (b, other, _) in enumerate(came):
            if section == other and (share := same(a, b)) > 0:
                shares[i, j] = share
    renamed, gone, made = [], set(), set()
    proposals = correspondences(lost, came, kept, tuple((i, j, round(s, 2)) for (i, j), s in shares.items())) if shares else ()
    for i, j, _ in proposals:
        a, b = lost[i][0], came[j][0]
        if a not in gone and b not in made and shares.get((i, j), 0.0) > 0.5:
            renamed.append((a, b))
            gone.add(a)
            made.add(b)

    def put(field, old_field, kind):
        for column, value in zip(out, (run, col, field, old_field, kind)):
            column.append(value)

    for a, b in renamed:
        put(b, a, "renamed")
        if old[a][1] != new[b][1]:
            put(b, a, "retyped")
    for n, *_ in came:
        if n not in made:
            put(n, n, "added")
    for n, *_ in lost:
        if n not in gone:
            put(n, n, "removed")
    for n, _, kind in kept:
        if old[n][1] != kind:
            put(n, n, "retyped")


def _record_steps(*columns: list) -> list[list]:
    out: list[list] = [[] for _ in _REPORT]
    for run, nf, nk, nkeys, nvals, of, ok, okeys, ovals in zip(*columns):
        new_at = {k: i for i, k in enumerate(nkeys)}
        both = [(i, new_at[k]) for i, k in enumerate(okeys) if k in new_at]
        opos, npos = {f: i for i, f in enumerate(of)}, {f: i for i, f in enumerate(nf)}

        def same(a, b):
            x, y, equal, n = opos[a], npos[b], 0, 0
            for i, j in both:
                u, v = ovals[i][x], nvals[j][y]
                if u is not None or v is not None:
                    n += 1
                    equal += u == v
            return equal / n if n else 0.0

        _differences(
            run, "records_json", {f: ("", k) for f, k in zip(of, ok)}, {f: ("", k) for f, k in zip(nf, nk)}, same, out
        )
    return out


def _both_sides(index: DataFrame, pairs: DataFrame, shape: Column, columns: dict[str, Column]) -> DataFrame:
    """Steps whose two sides differ in ``shape``, with ``columns`` of both as ``n_...`` and ``o_...``.

    Shapes meet as hashes; only the sides of steps that differ are fetched.
    """
    shapes = index.select("run_id", shape.alias("s"))
    new, old = (shapes.select(F.col("run_id").alias(k), F.col("s").alias(f"_{k}")) for k in ("new_id", "prev_id"))
    steps = staged(pairs.join(new, "new_id").join(old, "prev_id").filter("_new_id <> _prev_id").select("new_id", "prev_id"), "schema_steps")
    few = small(steps)
    side = lambda key, mark: index.join(few, F.col("run_id") == F.col(key)).select("new_id", *(c.alias(f"{mark}_{n}") for n, c in columns.items()))
    return side("new_id", "n").join(side("prev_id", "o"), "new_id")


def record_changes(index: DataFrame) -> DataFrame:
    """Report rows of the record fields, from the snapshots of :mod:`.snapshots`.

    Only steps whose field lists or types differ fetch their values.
    """
    shape = F.xxhash64(F.concat_ws("\x1f", "fields"), F.concat_ws("\x1f", "kinds"))
    columns = {"fields": F.col("fields"), "kinds": F.col("kinds"), "keys": F.col("keys.sku"), "vals": F.col("vals")}
    rows = _both_sides(index, snapshots.steps(index), shape, columns)
    picked = rows.select("new_id", *(f"{side}_{c}" for side in "no" for c in columns))
    return picked.mapInArrow(column_map(_record_steps, _REPORT, 64), REPORT)


def _json_kind(value: object) -> str:
    if type(value) is bool:
        return "boolean"
    if type(value) in (int, float):
        return "number"
    return {str: "string", list: "array"}.get(type(value), "object")


def options_of(config: object) -> list[tuple[str, str, str, str]] | None:
    """(name, section, type, content) of every field and option; None if not an object."""
    if type(config) is not dict:
        return None
    found = []
    for key, value in config.items():
        if value is None:
            continue
        if key == "fields" and type(value) is dict:
            for name, spec in value.items():
                if spec is None:
                    continue
                spec = spec if type(spec) is dict else {"selector": spec}
                kind = spec.get("type")
                content = json.dumps([canonical_any(spec.get("selector")), canonical_any(spec.get("attr"))])
                found.append((f"fields.{name}", "fields", kind if type(kind) is str else "string", content))
        elif type(value) is dict:
            for name, inner in value.items():
                if inner is not None:
                    found.append((f"{key}.{name}", key, _json_kind(inner), canonical_any(inner)))
        else:
            found.append((key, "", _json_kind(value), canonical_any(value)))
    return sorted(found)


_OPTION = pa.struct([(c, pa.string()) for c in ("name", "section", "kind", "content")])
_CONFIG = pa.schema([("run_id", pa.int64()), ("url", pa.string()), ("ts", pa.int64()), ("options", pa.list_(_OPTION))])
CONFIG_DDL = (
    "run_id bigint, url string, ts bigint, options array<struct<name:string,section:string,kind:string,content:string>>"
)


def config_rows(runs: DataFrame) -> DataFrame:
    """One row per run with its url, instant and options (null where the config is no object)."""

    def walk(ids, urls, times, texts):
        options = []
        for text in texts:
            found = options_of(decode(text))
            options.append(None if found is None else [dict(zip(("name", "section", "kind", "content"), o)) for o in found])
        return [ids, urls, times, options]

    slim = runs.select(
        F.col("id").cast("bigint").alias("run_id"), "url", instant_us(F.col("captured_at")).alias("ts"), "config_json"
    )
    return slim.mapInArrow(column_map(walk, _CONFIG), CONFIG_DDL)


def build_config_index(runs: DataFrame) -> DataFrame:
    return staged(config_rows(runs), "config_index")


def _config_steps(runs: list, news: list, olds: list) -> list[list]:
    out: list[list] = [[] for _ in _REPORT]
    for run, new, old in zip(runs, news, olds):
        content_new = {o["name"]: o["content"] for o in new}
        content_old = {o["name"]: o["content"] for o in old}
        _differences(
            run,
            "config_json",
            {o["name"]: (o["section"], o["kind"]) for o in old},
            {o["name"]: (o["section"], o["kind"]) for o in new},
            lambda a, b: 1.0 if content_old[a] == content_new[b] else 0.0,
            out,
        )
    return out


def config_changes(index: DataFrame) -> DataFrame:
    """Report rows of the config's fields and options between consecutive config snapshots."""
    slim = index.select("run_id", "url", "ts", F.col("options").isNotNull().alias("valid"))
    pairs = consecutive(standing(slim, "url", "ts", "run_id").filter("valid"), "url", "ts", "run_id")
    shape = F.xxhash64(F.concat_ws("\x1f", "options.name"), F.concat_ws("\x1f", "options.kind"))
    rows = _both_sides(index, pairs, shape, {"options": F.col("options")})
    return rows.select("new_id", "n_options", "o_options").mapInArrow(column_map(_config_steps, _REPORT, 64), REPORT)


def drift_report(runs: DataFrame) -> DataFrame:
    """Every added, removed, renamed or retyped field of records and config, step by step.

    A step is a snapshot and the nearest earlier one of the same url; the first snapshot
    of a url has no rows. Rows with null url or unreadable time, and texts that are null,
    empty or don't parse, make no snapshot; of rows with one url and instant the highest
    id stands. Of several possible renames the flooded score decides, ties go by name.
    An empty table gives no rows; other columns of ``runs`` are not read.
    """
    return record_changes(snapshots.read_snapshots(runs)).unionByName(config_changes(build_config_index(runs)))


# One consistent table -------------------------------------------------------


def naming(report: DataFrame, names: DataFrame) -> dict[str, str]:
    """One canonical name per field name of one column, for the ``MAX_NAMES`` most used names.

    ``report``: that column's report rows; ``names``: (run_id, name). Renames join two
    names unless some snapshot has both, most frequent first; a class takes the name
    most snapshots use. The driver sees names and renames; which names occur together is
    asked in Spark, and only of names that renames link.
    """
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(MAX_NAMES)
    used = {r["name"]: r["n"] for r in counted.collect()}
    renames = [
        r for r in report.filter(F.col("change_kind") == "renamed").groupBy("field", "old_field").agg(F.count(F.lit(1)).alias("n")).collect()
        if r["field"] in used and r["old_field"] in used
    ]
    group = {x: x for r in renames for x in (r["field"], r["old_field"])}

    def root(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for r in renames:
        group[root(r["field"])] = root(r["old_field"])
    together = set()
    if group:
        linked = names.sparkSession.createDataFrame([(x, root(x)) for x in sorted(group)], "name string, linked string")
        sets = names.join(linked, "name").groupBy("run_id", "linked").agg(F.sort_array(F.collect_set("name")).alias("s")).filter(F.size("s") > 1)
        both = sets.select("s").distinct().select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).filter("a < b").distinct()
        together = {(r["a"], r["b"]) for r in both.collect()}
    classes = {n: {n} for n in used}
    for r in sorted(renames, key=lambda r: (-r["n"], r["field"], r["old_field"])):
        x, y = classes[r["field"]], classes[r["old_field"]]
        if x is y or any((min(a, b), max(a, b)) in together for a in x for b in y):
            continue
        x |= y
        for n in y:
            classes[n] = x
    return {n: max(c, key=lambda m: (used[m], m)) for n, c in classes.items()}


def _renamed_map(col: str, names: dict[str, str], target: str) -> F.Column:
    """The value of ``target`` in a map column, under whichever of its names is present."""
    own = sorted((n for n, t in names.items() if t == target), key=lambda n: (n != target, n))
    return F.coalesce(*(F.try_element_at(F.col(col), F.lit(n)) for n in own))


def _cast_columns(names: dict[str, str], kinds: dict[str, str], col: str) -> list:
    out = []
    for target in sorted(set(names.values())):
        value = _renamed_map(col, names, target)
        out.append((value.try_cast("double") if kinds.get(target) == "number" else value).alias(target))
    return out


_VALUES = pa.schema(
    [("run_id", pa.int64()), ("pos", pa.int32()), ("vals", pa.map_(pa.string(), pa.string())), ("nested", pa.map_(pa.string(), pa.string()))]
)


def record_values(runs: DataFrame) -> DataFrame:
    """(run_id, pos, vals, nested): every record with its text and number fields as text, and
    its other values (booleans, lists and objects) as JSON text."""

    def walk(ids, texts):
        out: list[list] = [[], [], [], []]
        for run, text in zip(ids, texts):
            for pos, record in enumerate(records_of(text) or ()):
                if type(record) is dict:
                    own, rest = {}, {}
                    for k, v in record.items():
                        if type(v) is str:
                            own[k] = v
                        elif (scalar := canonical(v)) is not None:
                            own[k] = scalar[1:]
                        elif v is not None:
                            rest[k] = json.dumps(v, ensure_ascii=False)
                    for c, v in zip(out, (run, pos, list(own.items()), list(rest.items()))):
                        c.append(v)
        return out

    slim = runs.select(F.col("id").cast("bigint").alias("run_id"), "records_json")
    return slim.mapInArrow(column_map(walk, _VALUES), "run_id bigint, pos int, vals map<string,string>, nested map<string,string>")


def _majority(kinds: DataFrame, names: dict[str, str]) -> dict[str, str]:
    votes: dict[str, dict[str, int]] = {}
    for r in kinds.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["name"] not in names:
            continue
        kind = votes.setdefault(names[r["name"]], {})
        kind[r["kind"]] = kind.get(r["kind"], 0) + r["n"]
    return {n: max(v, key=lambda k: (v[k], k)) for n, v in votes.items()}


def _split(vals: DataFrame, names: dict[str, str], types: dict[str, str], odd, whole: bool) -> tuple[DataFrame, list]:
    """Columns of a ``vals`` map: one per canonical name, what isn't of its type in ``not_cast``,
    and what has no column in ``others``."""
    numeric = sorted(n for n, t in names.items() if types.get(t) == "number")
    empty = F.lit(None).cast("map<string,string>")
    left = F.map_filter("vals", lambda k, v: k.isin(numeric) & odd(v)) if numeric else empty
    kept = F.map_filter("vals", lambda k, v: ~(k.isin(numeric) & odd(v))) if numeric else F.col("vals")
    others = empty if whole else F.map_filter("vals", lambda k, v: ~k.isin(sorted(names)))
    return vals.withColumns({"_left": left, "_others": others, "vals": kept}), _cast_columns(names, types, "vals")


def unify_records(runs: DataFrame) -> DataFrame:
    """All records of all versions in one table: ``run_id``, ``pos`` and one column per field.

    Renamed fields share a column; a column is double where most snapshots hold it
    as a number. What doesn't cast stays as text in ``not_cast``, booleans, lists and objects
    as JSON text in ``nested``, and fields beyond the ``MAX_NAMES`` most used in ``others``.
    """
    index = snapshots.read_snapshots(runs)
    kinds = index.select("run_id", F.inline(F.arrays_zip(F.col("fields").alias("name"), F.col("kinds").alias("kind"))))
    names = naming(record_changes(index), kinds.select("run_id", "name"))
    types = _majority(kinds, names)
    rows, columns = _split(record_values(runs), names, types, lambda v: v.try_cast("double").isNull(), _all_named(kinds, names))
    return rows.select("run_id", "pos", *columns, F.col("_left").alias("not_cast"), "nested", F.col("_others").alias("others"))


def _all_named(kinds: DataFrame, names: dict[str, str]) -> bool:
    return len(names) < MAX_NAMES or kinds.select("name").distinct().count() == len(names)


def unify_config(runs: DataFrame) -> DataFrame:
    """All job configs in one table: ``run_id`` and one column per field or option.

    A ``fields.*`` column holds selector and attr as JSON, any other its value; it is
    double where most snapshots hold it as a number. What is no plain number there
    stays as text, under its own name, in ``not_cast``, options beyond the ``MAX_NAMES`` most
    used in ``others``. Of options that repeat in a config the last stands.
    """
    index = build_config_index(runs)
    rows = index.filter(F.col("options").isNotNull())
    flat = rows.select("run_id", F.inline("options"))
    names = naming(config_changes(index), flat.select("run_id", "name"))
    kinds = flat.select("name", F.when(F.col("section") == "fields", "string").otherwise(F.col("kind")).alias("kind"))
    types = _majority(kinds, names)
    text = lambda o: F.when(o["section"] == "fields", o["content"]).otherwise(F.substring(o["content"], 2, 1 << 30))
    vals = rows.select("run_id", F.map_from_entries(F.transform("options", lambda o: F.struct(o["name"].alias("k"), text(o).alias("v")))).alias("vals"))
    table, columns = _split(vals, names, types, lambda v: ~v.rlike(_NUMBER), _all_named(kinds, names))
    return table.select("run_id", *columns, F.col("_left").alias("not_cast"), F.col("_others").alias("others"))
