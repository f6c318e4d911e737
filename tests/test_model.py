from pyspark.sql import functions as F

from stratagraph.model.merge import edge_id, merge_edges, merge_nodes
from stratagraph.model.sanitize import sanitize, sanitize_map
from stratagraph.operators.prefix import exclusive_prefix_sum

NODE = "id string, type string, attributes map<string,string>, seq bigint"
EDGE = "source_id string, target_id string, type string, weight double, attributes map<string,string>, seq bigint"


def table(df):
    return {(r.type, r.id): r.attributes for r in df.collect()}


def test_last_write_wins_per_attribute_in_any_order(spark):
    rows = [("n", "FILE", {"a": "1", "b": "2"}, 1), ("n", "FILE", {"a": "3", "c": None}, 2), ("n", "FILE", {}, 3), ("m", "FILE", None, 1), (None, "FILE", {"a": "1"}, 1)]
    want = {("FILE", "n"): {"a": "3", "b": "2", "c": None}, ("FILE", "m"): {}}
    once = merge_nodes(spark.createDataFrame(rows, NODE))
    assert table(once) == want == table(merge_nodes(spark.createDataFrame(rows[::-1] + rows, NODE)))
    assert table(merge_nodes(once.withColumn("seq", F.lit(1).cast("bigint")))) == want
    assert table(merge_nodes(spark.createDataFrame(rows, NODE), null_deletes=True))[("FILE", "n")] == {"a": "3", "b": "2"}


def test_ids_collide_only_without_type_keys(spark):
    rows = spark.createDataFrame([("f", "SYMBOL", {"name": "f"}, 1), ("f", "FUNCTION", {"name": "g"}, 2)], NODE)
    assert set(table(merge_nodes(rows))) == {("SYMBOL", "f"), ("FUNCTION", "f")}
    assert table(merge_nodes(rows, by_type=False)) == {("SYMBOL", "f"): {"name": "g"}}


def test_edges_keep_the_largest_weight(spark):
    rows = spark.createDataFrame([("a", "b", "T", 3.0, {"x": "1"}, 1), ("a", "b", "T", 1.0, {"x": "2"}, 2), ("a", None, "T", None, None, 1)], EDGE)
    got = {(r.source_id, r.target_id): r for r in merge_edges(rows).collect()}
    assert got["a", "b"].weight == 3.0 and got["a", "b"].attributes == {"x": "2"} and got["a", None].weight == 1.0
    assert got["a", "b"].id == spark.range(1).select(edge_id(F.lit("a"), F.lit("b"), F.lit("T"))).head()[0]
    assert merge_edges(spark.createDataFrame([], EDGE)).count() == 0


def test_credentials_are_masked(spark):
    text = "see https://user:tok@github.com/a/b and X-Access-Token:zz@GitHub.com/c but http://github.com/d"
    row = spark.createDataFrame([(text, {"k": text})], "t string, m map<string,string>").select(sanitize(F.col("t")).alias("t"), sanitize_map(F.col("m")).alias("m")).head()
    assert row.t == row.m["k"] == "see x-access-token:*@github.com/a/b and x-access-token:*@github.com/c but http://github.com/d"


def test_prefix_sums(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 2) g", "id", "if(id % 7 = 0, null, id) v")
    got = exclusive_prefix_sum(df, ["g"], "id", "v", "before", F.floor(F.col("id") / 100), "whole").collect()
    sums = {}
    for r in sorted(got, key=lambda r: r.id):
        assert r.before == sums.get(r.g, 0)
        sums[r.g] = sums.get(r.g, 0) + (r.v or 0)
    assert all(r.whole == sums[r.g] for r in got) and len(got) == 1000
