from datetime import datetime as D

import pytest

from stratagraph.operators import orphans
from stratagraph.operators.orphans import orphan_references, orphan_report

NODES = "id string, created_at timestamp, updated_at timestamp, deleted_at timestamp, ref string, deleted string"
EDGES = "id string, source_id string, target_id string, created_at timestamp, side string, ref string, kind string"


def test_kinds_periods_and_odd_rows(spark):
    day = lambda m, d: D(2024, m, d)
    nodes = [("live", day(1, 1), day(1, 1), None), ("dead", day(1, 1), day(2, 1), day(2, 1)), ("dead", day(1, 1), day(1, 5), None), ("back", day(1, 1), day(1, 2), day(1, 2)), ("back", day(1, 3), day(3, 1), None), ("late", day(5, 1), day(5, 1), None), (None, day(1, 1), day(1, 1), None), ("undated", None, None, None)]
    edges = [("e1", "live", "gone", day(1, 2)), ("e1", "live", "gone", day(1, 2)), ("e2", "dead", "late", day(4, 1)), ("e3", "late", "back", day(6, 1)), ("e4", None, None, day(6, 1)), ("e5", "late", "gone", None), ("e6", "undated", "live", day(1, 1)), ("e7", "LIVE", "live ", day(1, 1))]
    n = spark.createDataFrame([(*r, "x", "y") for r in nodes], NODES)
    e = spark.createDataFrame([(*r, "a", "b", "c") for r in edges], EDGES)
    want = {("e1", "target", "missing", "2024-01"), ("e2", "source", "deleted", "2024-04"), ("e2", "target", "late", "2024-04"), ("e5", "target", "missing", None), ("e7", "source", "missing", "2024-01"), ("e7", "target", "missing", "2024-01")}
    found = orphan_references(e, n).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert sum(r.n for r in orphan_report(e, n).collect()) == len(want)


def test_empty_tables(spark):
    n, e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    assert orphan_references(e, n).count() == 0
    one = spark.createDataFrame([("e", "a", "b", D(2024, 1, 1), "", "", "")], EDGES)
    assert orphan_references(one, n).count() == 2


@pytest.mark.parametrize("few", [0, 200_000])
def test_hot_key(spark, monkeypatch, few):
    monkeypatch.setattr(orphans, "FEW_KEYS", few)
    e = spark.range(3000).selectExpr("cast(id as string) id", "concat('s', id) source_id", "if(id % 3 = 0, 'hot', 'ok') target_id", "timestamp'2024-01-01' created_at", "'' side", "'' ref", "'' kind")
    n = spark.createDataFrame([("ok", D(2023, 1, 1), D(2023, 1, 1), None, "", "")], NODES)
    assert {(r.side, r.kind): r.n for r in orphan_report(e, n).collect()} == {("source", "missing"): 3000, ("target", "missing"): 1000}
