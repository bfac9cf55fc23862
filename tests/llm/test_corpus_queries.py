"""Every pN_ query runs over its whole tables; those with SQL give the rows of the SQL; found-queries have the columns asked for."""

import pytest

from sutraloom.llm import queries, scans
from tests import oracle

COLUMNS = {
    "p1_found": {"tab", "row_id"}, "p2_found": {"rec_id", "line_no"}, "p3_found": {"rec_id", "noise"}, "p4_found": {"rec_id"}, "p5_found": {"rec_id", "kind"},
    "p6_found": {"tab", "row_id", "lang"}, "p7_found": {"tab", "first_id", "copy_id"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id", "kind", "found_text"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    oracle.check(spark, oracle.connect(data), data, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries_give_cases_once(spark, data, name):
    df = queries.QUERIES[name](spark, data).cache()
    assert set(df.columns) == COLUMNS[name] and df.count() > 0 and df.count() == df.distinct().count()
    df.unpersist()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(COLUMNS) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["p3_found", "p3_repaired"])
def test_scans_have_one_result_at_every_size(spark, data, monkeypatch, name):
    ways = []
    for most in (scans.BROADCAST_ROWS, -1):
        monkeypatch.setattr(scans, "BROADCAST_ROWS", most)
        ways.append(sorted(map(tuple, queries.QUERIES[name](spark, data).collect()), key=str))
    assert ways[0] == ways[1] and ways[0]
