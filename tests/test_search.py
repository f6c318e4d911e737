import math
import random

import pytest

from stratagraph.functions.text import query_words, stop_words
from stratagraph.operators import expand as E
from stratagraph.operators import search as S

NODES = "id string, type string, attributes map<string,string>"
EDGES = "id string, source_id string, target_id string, type string"
VECTORS = "node_id string, chunk_id int, node_type string, embedding array<float>"


def random_graph(seed):
    rng = random.Random(seed)
    words = ["cache", "graph", "lock", "nightly", "parser"]
    nodes = [(f"c{i:02}", "COMMIT", {"message": " ".join(rng.sample(words, 2)), "author_name": rng.choice(["Ann", "Bob"]), "timestamp": "2024"}) for i in range(12)]
    nodes += [(f"f{i}_{rng.choice(words)}.py", "FILE", {"name": "x"}) for i in range(14)]
    nodes += [(f"S.{rng.choice(words)}{i}", "SYMBOL", {}) for i in range(5)] + [(f"KEYWORD:{w}", "KEYWORD", {"term": w}) for w in words]
    nodes += [("ann@x", "AUTHOR", {"name": "Ann"}), ("2024-01", "TIME_BUCKET", {}), ("repo", "REPOSITORY", {"name": "demo"}), ("fn", "FUNCTION", None)]
    ids = [n[0] for n in nodes]
    edges = []
    for c in ids[:12]:
        for f in rng.sample(ids[12:26], rng.choice([1, 3, 12])):
            edges.append((c, f, "MODIFIED_FILE"))
        edges += [(c, "repo", "PART_OF_REPO")] if rng.random() < 0.7 else []
        edges += [(c, "ann@x", "AUTHORED_BY"), (c, "2024-01", "OCCURRED_IN"), (rng.choice(ids[26:31]), c, "MODIFIED_SYMBOL"), (c, "missing", "PARENT_OF")]
    for w in words:
        edges += [(rng.choice(ids), f"KEYWORD:{w}", "HAS_KEYWORD") for _ in range(4)]
    edges = sorted({e for e in edges if e[0] != e[1]})
    return nodes, [(f"e{i}", *e) for i, e in enumerate(edges)]


def model(nodes, edges, words, negative=(), minimum=0.0):
    """Keyword scores as the rules say, node by node."""
    kinds = {i: t for i, t, _ in nodes}
    around = {}
    for _, a, b, t in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)

    def hits(w):
        for i, t, a in sorted(nodes):
            if any(w in (x or "").lower() for x in [i, *[(a or {}).get(f) for f in S.FIELDS]]):
                yield i, t

    def commits(i, t):
        found = [i] if t == "COMMIT" else [a for _, a, b, k in edges if b == i and k == "HAS_KEYWORD"] if t == "KEYWORD" else around.get(i, ())
        return {c for c in found if kinds.get(c) == "COMMIT"}

    score = {}
    for w in words:
        seen = {}
        for i, t in hits(w):
            for c in commits(i, t):
                seen[c] = seen.get(c, 0) + 1
                score[c] = score.get(c, 0) + {"COMMIT": 10, "KEYWORD": 8}.get(t, 5) / seen[c]
    for w in negative:
        for i, t in hits(w):
            for c in commits(i, t):
                score.pop(c, None)
    for c in score:
        n = sum(1 for _, a, _, t in edges if a == c and t == "MODIFIED_FILE")
        score[c] /= max(1.0, math.log10(n)) if n else 1.0
    return {c: s for c, s in score.items() if s >= minimum}


@pytest.mark.parametrize("seed", range(2))
def test_keyword_scores_follow_the_model(spark, seed):
    nodes, edges = random_graph(seed)
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = {r.id: r.relevance for r in S.search(g, "cache Graph", min_score=0, top_n=100).collect()}
    assert got == pytest.approx(model(nodes, edges, ["cache", "graph"]), abs=1e-5)
    got = {r.id: r.relevance for r in S.search(g, "cache graph", negative_query="nightly", min_score=6, top_n=100).collect()}
    assert got == pytest.approx(model(nodes, edges, ["cache", "graph"], ["nightly"], 6), abs=1e-5)


def test_filters_repository_exclusions_and_pages(spark):
    nodes, edges = random_graph(3)
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    inside = {a for _, a, b, t in edges if b == "repo" and t == "PART_OF_REPO"}
    every = [r.id for r in S.search(g, "cache", min_score=0, top_n=100).collect()]
    assert [r.id for r in S.search(g, "cache", repo_name="demo", min_score=0, top_n=100).collect()] == [i for i in every if i in inside]
    assert S.search(g, "cache", repo_name="unknown", min_score=0).count() == 0
    assert [r.id for r in S.search(g, "cache", min_score=0, top_n=3, offset=2).collect()] == every[2:5]
    assert every[0] not in [r.id for r in S.search(g, "cache", min_score=0, top_n=100, excluded_commits=[every[0][:3]]).collect()]
    only = S.search(g, filters={"AUTHOR": "ann", "REPOSITORY": "demo"}, min_score=0, top_n=100).collect()
    assert {r.id for r in only} == inside and {r.reasons[0] for r in only} == {"passes the filters AUTHOR=ann, REPOSITORY=demo"}
    assert S.search(g, "cache", filters={"AUTHOR": "nobody"}, min_score=0).count() == 0


def test_vectors_add_and_negative_vectors_only_subtract(spark):
    nodes = [("c1", "COMMIT", {}), ("c2", "COMMIT", {"message": "m", "author": "A"}), ("fn", "FUNCTION", {}), ("sym", "SYMBOL", {})]
    edges = [("1", "c1", "fn", "MODIFIED_FUNCTION"), ("2", "sym", "c1", "MODIFIED_SYMBOL"), ("3", "c2", "sym", "MODIFIED_SYMBOL")]
    vectors = [("fn", 0, "FUNCTION", [1.0, 0.0]), ("fn", 1, "FUNCTION", [0.0, 1.0]), ("sym", 0, "SYMBOL", [0.8, 0.6]), ("c2", 0, "COMMIT_MESSAGE", [0.6, 0.8]), ("zero", 0, "COMMIT", [0.0, 0.0]), ("wide", 0, "COMMIT", [1.0, 0.0, 0.0])]
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(vectors, VECTORS))
    got = {r.id: r for r in S.search(g, query_vector=[1.0, 0.0], min_score=0).collect()}
    assert got["c1"].relevance == pytest.approx(20 * 1.0 + 20 * 0.8 / 2) and got["c2"].relevance == pytest.approx(20 * 0.6)
    assert (got["c1"].message, got["c1"].author, got["c2"].author) == ("No message", "Unknown", "A")
    got = {r.id: r.relevance for r in S.search(g, query_vector=[1.0, 0.0], negative_vector=[0.0, 1.0], min_score=-1e9).collect()}
    assert got["c2"] == pytest.approx(12 - 200 * 0.8) and got["c1"] == pytest.approx(28 - 200 * 1.0 - 200 * 0.6)
    assert S.search(g, min_score=0).count() == 0


def test_penalty_begins_above_ten_files(spark):
    nodes = [(f"c{n}", "COMMIT", {"message": "cache"}) for n in (9, 10, 11, 100)]
    edges = [(f"{n}-{i}", f"c{n}", f"f{i}", "MODIFIED_FILE") for n in (9, 10, 11, 100) for i in range(n)]
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = {r.id: r.relevance for r in S.search(g, "cache", min_score=0, top_n=9).collect()}
    assert got == pytest.approx({"c9": 10, "c10": 10, "c11": 10 / math.log10(11), "c100": 5}, abs=1e-5)


def test_wildcards_only_where_asked_for(spark):
    nodes = spark.createDataFrame([("a_b", "FILE", {}), ("axb", "FILE", {}), ("a!b", "FILE", None), ("a\\b", "FILE", {})], NODES)
    hits = lambda w, f: {r.node_id for r in S.keyword_hits(nodes, [w], f).collect()}
    assert hits("A_B", False) == {"a_b"} and hits("A_B", True) == {"a_b", "axb", "a!b", "a\\b"} and hits("a!b", True) == {"a!b"} and hits("a\\b", True) == {"a\\b"}


def test_query_words(spark):
    stops = stop_words(spark)
    assert query_words("the Cache of the graph cache", stops) == ["cache", "graph"] and query_words("the of", stops) == ["the", "of"] and query_words("", stops) == []


def walk(nodes, edges, start, depth, all_matches, gate):
    kinds = {i: t for i, t, _ in nodes}
    around = {}
    for _, a, b, _t in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    queue, seen, out = [(start, 0)], {start}, {}
    while queue:
        at, d = queue.pop(0)
        if d >= depth:
            continue
        for n in around.get(at, ()):
            if n in seen:
                continue
            seen.add(n)
            if n not in kinds or not (all_matches or gate(n)):
                continue
            out[n] = d + 1
            if kinds[n] not in E.NO_EXPAND:
                queue.append((n, d + 1))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_expansion_follows_a_plain_walk(spark, depth):
    nodes, edges = random_graph(7)
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    starts = spark.createDataFrame([("c00",), ("c05",)], "id string")
    for all_matches in (True, False):
        got = {}
        for r in E.expand(g, starts, E.gates(g, ["cache"]), depth, all_matches=all_matches).collect():
            got.setdefault(r.start, {})[r.id] = r.distance
        relevant = {r.id for r in E.gates(g, ["cache"]).where("relevant").collect()}
        for s in ("c00", "c05"):
            assert got.get(s, {}) == walk(nodes, edges, s, depth, all_matches, relevant.__contains__)


def test_gates_triggers_and_type_lists(spark):
    nodes = [("c", "COMMIT", {}), ("KEYWORD:cache", "KEYWORD", {"term": "cache"}), ("s", "SYMBOL", {}), ("f", "FILE", {}), ("g", "FILE", {}), ("x", "COMMENT", {"content": "bad cache"}), ("a", "AUTHOR", {}), ("t", "TIME_BUCKET", {})]
    edges = [("1", "c", "KEYWORD:cache", "HAS_KEYWORD"), ("2", "s", "c", "MODIFIED_SYMBOL"), ("3", "c", "f", "MODIFIED_FILE"), ("4", "c", "g", "MODIFIED_FILE"), ("5", "f", "KEYWORD:cache", "HAS_KEYWORD"), ("6", "x", "c", "HAS_COMMENT"), ("7", "c", "a", "AUTHORED_BY"), ("8", "c", "t", "OCCURRED_IN")]
    g = S.Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    start = spark.createDataFrame([("c",)], "id string")
    run = lambda gate, **k: {r.id: r.distance for r in E.expand(g, start, gate, 1, **k).collect()}
    assert run(E.gates(g, ["cache"])) == {"KEYWORD:cache": 1, "f": 1, "x": 1, "a": 1, "t": 1}
    assert run(E.gates(g, ["cache"], ["bad"])) == {"KEYWORD:cache": 1, "f": 1, "a": 1, "t": 1}
    assert set(run(E.gates(g, ["cache"], all_files=True))) == {"KEYWORD:cache", "f", "g", "x", "a", "t"}
    assert set(run(E.gates(g, ["cache"]), exclude_types=["authors", "Time Buckets"])) == {"KEYWORD:cache", "f", "x"}
    near = spark.createDataFrame([("s",)], "node_id string")
    assert "s" in run(E.gates(g, [], semantic=near)) and "s" not in run(E.gates(g, [], negative_semantic=near), all_matches=True)
    trigger = spark.createDataFrame([("c", "s")], "start string, id string")
    assert run(E.gates(g, ["cache"]), triggers=trigger)["s"] == 0
    empty = S.Graph(g.nodes.limit(0), g.edges.limit(0))
    assert E.expand(empty, start, E.gates(empty, ["cache"]), 2).count() == 0
