"""The text queries: SQL twins over whole small tables, and rows of the rest."""

import pytest

from tidemark.llm import queries

from ..test_queries import SF, con, lines  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):  # noqa: F811
    got = lines(r.asDict() for r in queries.QUERIES[name](spark, SF).collect())
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert got == lines(dict(zip(names, r)) for r in cur.fetchall())


COLUMNS = {
    "p2_found": ["listing", "keep_id", "row_id"], "p3_found": ["tbl", "row_id", "pos"], "p6_found": ["doc_id"], "p7_found": ["source_name"],
    "p8_found": ["doc_id", "start_pos", "end_pos", "pii_kind"],
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)) + sorted(COLUMNS))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() >= 0
