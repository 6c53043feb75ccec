"""Named queries of the core problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, schema_drift, snapshots
from ..sources.tables import spread_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every nested object of the run history with its key and its parent's key."""
    return nested.nested_objects(spread_table(spark, folder, "runs", "id", *nested.COLUMNS))


def _nested(tag: str, column: str, *fields: str):
    """A query for one of the nested tables of one column."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = nested.nested_table(spread_table(spark, folder, "runs", "id", column), tag, (column,))
        return rows.select("run_id", "path", "parent_path", *fields)

    return query


#: Nested tables: query, tag, column and the fields put out.
NESTED = {
    "p1_records": ("record", "records_json", "sku", "name", "title"),
    "p1_variants": ("variant", "records_json", "code", "size"),
    "p1_offers": ("offer", "records_json", "seller", "price"),
    "p1_seasons": ("season", "records_json", "no"),
    "p1_episodes": ("episode", "records_json", "no", "minutes", "note"),
    "p1_states": ("state", "exploration_json", "id"),
    "p1_actions": ("action", "exploration_json", "role", "name", "fill_value"),
    "p1_transitions": ("transition", "exploration_json", "from", "to"),
    "p1_skips": ("skip", "exploration_json", "from", "reason"),
}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots of a url."""
    return snapshots.snapshot_changes(spread_table(spark, folder, "runs", "id", "url", "captured_at", "records_json"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of records and config that was added, removed, renamed or retyped."""
    runs = spread_table(spark, folder, "runs", "id", "url", "captured_at", "records_json", "config_json")
    return schema_drift.drift_report(runs)


def p5_records_table(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all schema versions in one table."""
    return schema_drift.unify_records(spread_table(spark, folder, "runs", "id", "url", "captured_at", "records_json"))


def p5_records_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per run how many records, and texts and numbers in them, the one table holds."""
    return _audit(p5_records_table(spark, folder), ("pos", "nested"), F.count(F.lit(1)).alias("records"))


def p5_config_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per run how many options the one table holds."""
    return _audit(p5_config_table(spark, folder), ())


def _audit(rows: DataFrame, beside: tuple[str, ...], *more) -> DataFrame:
    own = [c for c in rows.columns if c not in ("run_id", "not_cast", "others", *beside)]
    filled = sum((F.col(f"`{c}`").isNotNull().cast("bigint") for c in own), F.lit(0))
    held = filled + F.coalesce(F.size("not_cast"), F.lit(0)) + F.coalesce(F.size("others"), F.lit(0))
    return rows.groupBy("run_id").agg(*more, F.sum(held).alias("values"))


def p5_config_table(spark: SparkSession, folder: str) -> DataFrame:
    """All job configs of all schema versions in one table."""
    return schema_drift.unify_config(spread_table(spark, folder, "runs", "id", "url", "captured_at", "config_json"))


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_records_table": p5_records_table,
    "p5_config_table": p5_config_table,
    "p5_records_audit": p5_records_audit,
    "p5_config_audit": p5_config_audit,
} | {name: _nested(*parts) for name, parts in NESTED.items()}

#: A JSON text as a value; text inside text is parsed once more, what doesn't parse is null.
_DECODE = (
    "CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) <> 'VARCHAR' THEN CAST(t AS JSON) "
    "WHEN json_valid(json_extract_string(t, '$')) THEN CAST(json_extract_string(t, '$') AS JSON) END END"
)
_LIST = r"\.(variants|offers|seasons|episodes|actions|skipped)(\.|$)"

_P1 = rf"""
WITH s AS (SELECT id, 'records_json' AS col, records_json AS t FROM runs UNION ALL SELECT id, 'api_surface_json', api_surface_json FROM runs
           UNION ALL SELECT id, 'exploration_json', exploration_json FROM runs),
d AS (SELECT id, col, {_DECODE} AS j FROM s),
n AS (SELECT d.id AS id, col, json_type(j) AS top, x.fullkey AS k FROM d, json_tree(d.j) AS x WHERE x.type = 'OBJECT' AND json_type(j) IN ('OBJECT', 'ARRAY')
      AND (col = 'records_json' OR json_type(j) = 'ARRAY' OR x.fullkey <> '$')),
r AS (SELECT id, col, regexp_replace(regexp_replace(CASE WHEN col = 'records_json' AND top = 'OBJECT' THEN '[0]' ELSE '' END || substr(k, 2), '{_LIST}', '.\1[0]\2', 'g'), '{_LIST}', '.\1[0]\2', 'g') AS p FROM n)
SELECT id AS run_id, col AS json_col, ltrim(p, '.') AS path,
  CASE WHEN contains(p, '.') THEN ltrim(regexp_replace(p, '\.[^.\[\]]+(\[[0-9]+\])*$', ''), '.') ELSE '' END AS parent_path FROM r
"""

_P4 = rf"""
WITH d AS (SELECT id, url, epoch_us(try_cast(captured_at AS TIMESTAMPTZ)) AS ts, {_DECODE} AS j FROM (SELECT *, records_json AS t FROM runs)),
k AS (SELECT url, ts, max(id) AS id FROM d WHERE url IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
l AS (SELECT id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN json_array(j) END AS a FROM d SEMI JOIN k USING (id)),
e AS (SELECT l.id AS id, CAST(x.key AS INTEGER) AS pos, x.value AS r, json_extract_string(x.value, '$.sku') AS sku FROM l, json_each(l.a) AS x WHERE x.type = 'OBJECT'),
f AS (SELECT e.id, e.pos, e.sku, x.key AS field, x.type, json_extract_string(x.value, '$') AS v FROM e, json_each(e.r) AS x WHERE x.type IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')),
c AS (SELECT id, pos, sku, field, CASE WHEN type <> 'VARCHAR' OR regexp_full_match(v, '[+-]?[0-9]+(\.[0-9]+)?') THEN coalesce('n' || try_cast(v AS DECIMAL(38, 12)), 's' || v) ELSE 's' || v END AS v FROM f),
o AS (SELECT id, sku, min(pos) AS pos FROM e WHERE sku IS NOT NULL GROUP BY ALL),
v AS (SELECT c.id, c.sku, c.field, c.v FROM c JOIN o USING (id, sku, pos)),
g AS (SELECT DISTINCT id, field FROM c),
p AS (SELECT id, lag(id) OVER (PARTITION BY url ORDER BY ts) AS prev FROM k WHERE id IN (SELECT id FROM o)),
q AS (SELECT * FROM p WHERE prev IS NOT NULL),
b AS (SELECT q.id, q.prev, n.sku FROM q JOIN o n ON n.id = q.id JOIN o m ON m.id = q.prev AND m.sku = n.sku),
h AS (SELECT q.id, q.prev, x.field FROM q JOIN g x ON x.id = q.id JOIN g y ON y.id = q.prev AND y.field = x.field)
SELECT q.id AS run_id, n.sku, 'added' AS change_kind FROM q JOIN o n ON n.id = q.id WHERE NOT EXISTS (SELECT 1 FROM o m WHERE m.id = q.prev AND m.sku = n.sku)
UNION ALL SELECT q.id, m.sku, 'removed' FROM q JOIN o m ON m.id = q.prev WHERE NOT EXISTS (SELECT 1 FROM o n WHERE n.id = q.id AND n.sku = m.sku)
UNION ALL SELECT DISTINCT b.id, b.sku, 'changed' FROM b JOIN h USING (id, prev) LEFT JOIN v x ON x.id = b.id AND x.sku = b.sku AND x.field = h.field
  LEFT JOIN v y ON y.id = b.prev AND y.sku = b.sku AND y.field = h.field WHERE x.v IS DISTINCT FROM y.v
"""

_CANON = (
    "CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR (type = 'VARCHAR' AND regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?')) "
    "THEN coalesce('n' || try_cast(v AS DECIMAL(38, 12)), 's' || v) WHEN type = 'VARCHAR' THEN 's' || v ELSE 'j' || v END"
)

_P5 = rf"""
WITH s AS (SELECT id, url, epoch_us(try_cast(captured_at AS TIMESTAMPTZ)) AS ts, records_json, config_json FROM runs),
k AS (SELECT url, ts, max(id) AS id FROM s WHERE url IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
rd AS (SELECT id, {_DECODE} AS j FROM (SELECT id, records_json AS t FROM s SEMI JOIN k USING (id))),
l AS (SELECT id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN json_array(j) END AS a FROM rd),
e AS (SELECT l.id AS id, CAST(x.key AS INTEGER) AS pos, x.value AS r, json_extract_string(x.value, '$.sku') AS sku FROM l, json_each(l.a) AS x WHERE x.type = 'OBJECT'),
f AS (SELECT e.id AS id, e.pos, e.sku, x.key AS name, x.type AS type, json_extract_string(x.value, '$') AS v FROM e, json_each(e.r) AS x WHERE x.type IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')),
o AS (SELECT id, sku, min(pos) AS pos FROM e WHERE sku IS NOT NULL GROUP BY ALL),
val AS (SELECT f.id, f.sku, f.name, {_CANON} AS c FROM f JOIN o USING (id, sku, pos)),
cd AS (SELECT id, {_DECODE} AS j FROM (SELECT id, config_json AS t FROM s SEMI JOIN k USING (id))),
co AS (SELECT id, j FROM cd WHERE json_type(j) = 'OBJECT'),
t1 AS (SELECT co.id AS id, x.key AS key, x.type AS type, x.value AS value FROM co, json_each(co.j) AS x WHERE x.type <> 'NULL'),
t2 AS (SELECT t1.id AS id, t1.key AS section, x.key AS key, x.type AS type, x.value AS value FROM t1, json_each(t1.value) AS x WHERE t1.type = 'OBJECT' AND x.type <> 'NULL'),
t3 AS (SELECT id, 'fields.' || key AS name, 'fields' AS section, coalesce(json_extract_string(value, '$.type'), 'string') AS kind, to_json([json_extract_string(value, '$.selector'), json_extract_string(value, '$.attr')])::VARCHAR AS content FROM t2 WHERE section = 'fields'
  UNION ALL SELECT id, name, section, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END, {_CANON} FROM (
    SELECT id, section || '.' || key AS name, section, type, json_extract_string(value, '$') AS v FROM t2 WHERE section <> 'fields'
    UNION ALL SELECT id, key, '', type, json_extract_string(value, '$') FROM t1 WHERE type <> 'OBJECT')),
op AS (SELECT 'config_json' AS col, id, name, section, kind FROM t3
  UNION ALL SELECT 'records_json', id, name, '', CASE WHEN bool_or(type = 'VARCHAR') THEN 'string' ELSE 'number' END FROM f GROUP BY id, name),
p AS (SELECT 'records_json' AS col, id, lag(id) OVER (PARTITION BY url ORDER BY ts) AS prev FROM k WHERE id IN (SELECT id FROM o)
  UNION ALL SELECT 'config_json', id, lag(id) OVER (PARTITION BY url ORDER BY ts) FROM k WHERE id IN (SELECT id FROM co)),
q AS (SELECT * FROM p WHERE prev IS NOT NULL),
lost AS (SELECT q.col, q.id, q.prev, a.name, a.section, a.kind FROM q JOIN op a ON a.col = q.col AND a.id = q.prev WHERE NOT EXISTS (SELECT 1 FROM op b WHERE b.col = q.col AND b.id = q.id AND b.name = a.name)),
came AS (SELECT q.col, q.id, q.prev, b.name, b.section, b.kind FROM q JOIN op b ON b.col = q.col AND b.id = q.id WHERE NOT EXISTS (SELECT 1 FROM op a WHERE a.col = q.col AND a.id = q.prev AND a.name = b.name)),
pair AS (SELECT l.col, l.id, l.prev, l.name AS a, c.name AS b, l.kind AS ka, c.kind AS kb FROM lost l JOIN came c USING (col, id, prev, section)),
hit AS (SELECT pair.* FROM pair JOIN t3 x ON x.id = pair.prev AND x.name = pair.a JOIN t3 y ON y.id = pair.id AND y.name = pair.b WHERE col = 'config_json' AND x.content = y.content
  UNION ALL SELECT pair.col, pair.id, pair.prev, a, b, ka, kb FROM pair JOIN o m ON m.id = pair.prev JOIN o n ON n.id = pair.id AND n.sku = m.sku
    LEFT JOIN val x ON x.id = pair.prev AND x.sku = m.sku AND x.name = pair.a LEFT JOIN val y ON y.id = pair.id AND y.sku = m.sku AND y.name = pair.b
    WHERE col = 'records_json' GROUP BY ALL HAVING 2 * count(*) FILTER (x.c = y.c) > count(*) FILTER (x.c IS NOT NULL OR y.c IS NOT NULL)),
u AS (SELECT id, col, b AS field, a AS old_field, 'renamed' AS change_kind FROM hit
  UNION ALL SELECT id, col, b, a, 'retyped' FROM hit WHERE ka <> kb
  UNION ALL SELECT id, col, name, name, 'added' FROM came c WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.col = c.col AND hit.id = c.id AND hit.b = c.name)
  UNION ALL SELECT id, col, name, name, 'removed' FROM lost c WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.col = c.col AND hit.id = c.id AND hit.a = c.name)
  UNION ALL SELECT q.id, q.col, a.name, a.name, 'retyped' FROM q JOIN op a ON a.col = q.col AND a.id = q.prev JOIN op b ON b.col = q.col AND b.id = q.id AND b.name = a.name WHERE a.kind <> b.kind)
SELECT id AS run_id, col AS json_col, field, old_field, change_kind FROM u
"""

_OWN_RECORDS = rf"""
WITH d AS (SELECT id, {_DECODE} AS j FROM (SELECT id, records_json AS t FROM runs)),
l AS (SELECT id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN json_array(j) END AS a FROM d),
e AS (SELECT l.id AS id, x.value AS r FROM l, json_each(l.a) AS x WHERE x.type = 'OBJECT')
SELECT e.id AS run_id, count(*) AS records,
  CAST(sum(len(list_filter(json_keys(r), lambda k: json_type(json_extract(r, '$."' || k || '"')) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')))) AS BIGINT) AS values
FROM e GROUP BY e.id
"""
_OWN_OPTIONS = rf"""
WITH d AS (SELECT id, {_DECODE} AS j FROM (SELECT id, config_json AS t FROM runs)),
o AS (SELECT id, j FROM d WHERE json_type(j) = 'OBJECT'),
n AS (SELECT o.id AS id, CASE WHEN x.type = 'OBJECT' THEN len(list_filter(json_keys(x.value), lambda k: json_type(json_extract(x.value, '$."' || k || '"')) <> 'NULL'))
  WHEN x.type = 'NULL' THEN 0 ELSE 1 END AS n FROM o, json_each(o.j) AS x)
SELECT o.id AS run_id, CAST(coalesce((SELECT sum(n.n) FROM n WHERE n.id = o.id), 0) AS BIGINT) AS values FROM o
"""
#: Objects of one table of one column: where in the path they stand, and the last key of it.
_PLACES = {
    "record": r"regexp_full_match(p, '(\[[0-9]+\])+')",
    "state": r"regexp_full_match(p, '(.*\.)?states(\[[0-9]+\])*')",
    "transition": r"regexp_full_match(p, '(.*\.)?transitions(\[[0-9]+\])*')",
    "skip": r"regexp_full_match(p, '(.*\.)?skipped(\[[0-9]+\])*')",
} | {t: rf"regexp_full_match(p, '(.*\.)?{t}s(\[[0-9]+\])*')" for t in ("variant", "offer", "season", "episode", "action")}
_NUMBERS = {"price": "DOUBLE", "no": "INTEGER", "minutes": "INTEGER"}


def _nested_sql(tag: str, column: str, *fields: str) -> str:
    taken = ", ".join(
        f"try_cast(json_extract_string(v, '$.{f}') AS {_NUMBERS[f]}) AS {f}" if f in _NUMBERS and not (f == "price" and tag == "record") else f"json_extract_string(v, '$.\"{f}\"') AS \"{f}\""
        for f in fields
    )
    return _P1_ROWS.format(column=column) + rf"""
SELECT id AS run_id, ltrim(p, '.') AS path,
  CASE WHEN contains(p, '.') THEN ltrim(regexp_replace(p, '\.[^.\[\]]+(\[[0-9]+\])*$', ''), '.') ELSE '' END AS parent_path, {taken}
FROM r WHERE {_PLACES[tag].replace("(p,", "(ltrim(p, '.'),")}
"""


_P1_ROWS = (
    "WITH d AS (SELECT id, '{{column}}' AS col, {decode} AS j FROM (SELECT id, {{column}} AS t FROM runs)),\n"
    "n AS (SELECT d.id AS id, col, json_type(j) AS top, x.fullkey AS k, x.value AS v FROM d, json_tree(d.j) AS x WHERE x.type = 'OBJECT' AND json_type(j) IN ('OBJECT', 'ARRAY')\n"
    "  AND (col = 'records_json' OR json_type(j) = 'ARRAY' OR x.fullkey <> '$')),\n"
    "r AS (SELECT id, v, regexp_replace(regexp_replace(CASE WHEN col = 'records_json' AND top = 'OBJECT' THEN '[0]' ELSE '' END || substr(k, 2), "
    "'{lists}', '.\\1[0]\\2', 'g'), '{lists}', '.\\1[0]\\2', 'g') AS p FROM n)"
).format(decode=_DECODE, lists=_LIST)

SQL: dict[str, str] = {"p1_found": _P1, "p4_found": _P4, "p5_found": _P5, "p5_records_audit": _OWN_RECORDS, "p5_config_audit": _OWN_OPTIONS} | {
    name: _nested_sql(*parts) for name, parts in NESTED.items()
}
