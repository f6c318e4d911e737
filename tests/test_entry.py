import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratagraph.operators import build as B
from stratagraph.operators.vectors import hashing_embedder

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        name = f.split(".")[0]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name in entry.oracle_sql():
        got = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in got.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).columns


def test_no_query_pairs_everything(spark):
    for name, f in entry.queries().items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_pushdown_reaches_the_scan(spark):
    plan = entry.queries()["p6_found"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "attributes" not in plan


def test_chains_and_descendants_of_every_commit(spark):
    q = entry.queries()
    found = {r.commit_id: r.depth for r in q["p1_found"](spark, SF).collect() if r.depth >= 0}
    chains = {r.commit_id: r.path.split("/") for r in q["p1_chains"](spark, SF).collect()}
    assert {c: len(p) - 1 for c, p in chains.items()} == found
    below = [(r.commit_id, r.descendant_id) for r in q["p1_below"](spark, SF).collect()]
    assert len(below) == len(set(below)) and set(below) == {(a, c) for c, p in chains.items() for a in p[:-1]}


def test_all_item_kinds_are_embedded_in_chunks(spark, duck):
    embed, rows = hashing_embedder(), []
    for node, kind, text in duck.execute(f"SELECT node_id, node_type, text FROM ({entry.oracle_sql()['v4_index_items']})").fetchall():
        rows += [(node, i, kind, [float(x) for x in v]) for i, v in enumerate(embed(text))]
    want = spark.createDataFrame(rows, "node_id string, chunk_id int, node_type string, embedding array<float>").select("node_id", "chunk_id", "node_type", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("digest"))
    assert {r[2] for r in rows} == {"SYMBOL", "COMMIT_MESSAGE", "COMMIT_SYMBOLS"} and max(r[1] for r in rows) > 0
    assert sorted(map(tuple, entry.queries()["v5_embed_symbols"](spark, SF).collect())) == sorted(map(tuple, want.collect()))


def test_dependencies_of_every_type(spark):
    q = entry.queries()
    every = q["d1_all_dependencies"](spark, SF)
    nodes = B.present(spark.read.parquet(f"{SF}/nodes.parquet")).select("id", "type")
    assert {"FILE", "FUNCTION", "SYMBOL", "COMMIT"} <= {r.type for r in every.join(nodes, "id").select("type").distinct().collect()}
    assert q["d1_dependencies"](spark, SF).exceptAll(every).count() == 0
