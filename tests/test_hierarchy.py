import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators.hierarchy import build_hierarchy, first_parent_links

LINKS = "id string, parent_id string, jump string, size int, done string"


def brute(links):
    """{id: (root, depth)} by walking; loops give their smallest id and -1."""
    parents = {}
    for i, p in links:
        if i is not None:
            parents[i] = min([x for x in (parents.get(i), p) if x is not None], default=None)
    out = {}
    for i in parents:
        path, at = [], i
        while at not in path:
            path.append(at)
            nxt = parents[at]
            if nxt is None or nxt not in parents:
                out[i] = (at, len(path) - 1)
                break
            at = nxt
        else:
            out[i] = (min(path[path.index(at) :]), -1)
    return out


def check(spark, links):
    df = spark.createDataFrame([(i, p, "x", 1, None) for i, p in links], LINKS)
    tree = build_hierarchy(df)
    rows = {r.id: r for r in tree.nodes.collect()}
    want = brute(links)
    assert {i: (r.root_id, r.depth) for i, r in rows.items()} == want
    up = {i: r.parent_id for i, r in rows.items()}
    for i, r in rows.items():
        if r.on_loop:
            assert (r.lo, r.hi, r.descendants) == (None, None, None)
            continue
        below = {j for j, s in rows.items() if s.root_id == r.root_id and not s.on_loop and r.lo < s.lo < r.hi}
        chain = lambda j: [] if up[j] is None else [up[j], *chain(up[j])]
        assert below == {j for j in rows if not rows[j].on_loop and i in chain(j)}
        assert r.descendants == len(below)
    return tree, rows


@pytest.mark.parametrize("seed", range(3))
def test_random_forests_with_loops(spark, seed):
    rng = random.Random(seed)
    n = 60
    links = [(f"n{i:02}", rng.choice([None, "gone", *[f"n{rng.randrange(max(1, i)):02}"] * 8])) for i in range(n)]
    links += [(f"l{i}", f"l{(i + 1) % 5}") for i in range(5)] + [("t1", "l3"), ("t2", "t1"), ("self", "self"), ("s2", "self")]
    links += rng.sample(links, 10)
    check(spark, links)


def test_deep_chain_and_wide_star(spark):
    chain = [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(130)]
    star = [("hub", None)] + [(f"s{i:03}", "hub") for i in range(150)]
    tree, rows = check(spark, chain + star)
    ids = spark.createDataFrame([("c129",), ("s007",), ("hub",)], "id string")
    paths = {r.id: r.path for r in tree.paths(ids).collect()}
    assert paths["c129"] == [f"c{i:03}" for i in range(130)]
    assert paths["s007"] == ["hub", "s007"] and paths["hub"] == ["hub"]
    below = tree.descendants(spark.createDataFrame([("hub",), ("c100",)], "id string")).groupBy("id").count()
    assert {r["id"]: r["count"] for r in below.collect()} == {"hub": 150, "c100": 29}


def test_empty_null_and_only_loops(spark):
    assert build_hierarchy(spark.createDataFrame([], LINKS)).nodes.count() == 0
    check(spark, [("a", "b"), ("b", "a"), (None, "a")])
    check(spark, [("a", None)])


def test_present_first_parents(spark):
    rows = [("c", ["x", "y"], 1), ("c", ["a"], 2), ("a", [""], 1), ("b", None, 1), ("d", [], 1), ("e", [None, "a"], 1), (None, ["a"], 1)]
    df = spark.createDataFrame(rows, "id string, parents array<string>, at int").withColumn("scanned_at", F.timestamp_seconds("at")).withColumn("c", F.lit(1))
    assert {tuple(r) for r in first_parent_links(df).collect()} == {("c", "a"), ("a", None), ("b", None), ("d", None), ("e", None)}
