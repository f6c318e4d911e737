import os
import subprocess

import pytest

from stratagraph.api import Engine, file_text
from stratagraph.model.store import Catalog
from stratagraph.operators import enrich as P
from stratagraph.operators.amend import replayed
from stratagraph.operators.changefeed import normalise_changes
from stratagraph.plans import samples
from stratagraph.sources.gitsource import acquire

FEED = "id string, timestamp double, action string, entity_type string, payload string, reverted int, received_at timestamp"
NODES, EDGES = "id string, type string, attributes map<string,string>", "source_id string, target_id string, type string, weight double, attributes map<string,string>"


def state(spark, feed, nodes=(), edges=()):
    rows = [(f"{i:03}", float(t), action, kind, payload, reverted, None) for i, (t, action, kind, payload, reverted) in enumerate(feed)]
    n, e = replayed(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(edges), EDGES), normalise_changes(spark.createDataFrame(rows, FEED)))
    return {(r.type, r.id): r.attributes for r in n.collect()}, {(r.source_id, r.target_id): r.weight for r in e.collect()}


def test_what_was_said_before_a_deletion_is_gone(spark):
    feed = [(1, "add_node", "N", '{"id": "x", "attributes": {"a": "1"}}', 0), (2, "delete_node", "N", '{"id": "x"}', 0), (3, "Add Node", "N", '{"data": {"id": "x", "attributes": {"b": 2}}}', None)]
    assert state(spark, feed)[0] == {("N", "x"): {"b": "2"}}
    assert state(spark, feed, [("x", "N", {"c": "3"})])[0] == {("N", "x"): {"b": "2"}}
    assert state(spark, feed[:2], [("x", "N", {"c": "3"}), ("y", "N", None)])[0] == {("N", "y"): {}}
    undone = [*feed[:1], (2, "delete_node", "N", '{"id": "x"}', 1), *feed[2:]]
    assert state(spark, undone)[0] == {("N", "x"): {"a": "1", "b": "2"}}


def test_a_deleted_node_takes_its_edges_along(spark):
    edges = [("x", "y", "L", 1.0, None), ("y", "z", "L", 2.0, None), ("x", "z", "L", None, None)]
    feed = [(1, "add_edge", "L", '{"source_id": "w", "target_id": "y"}', 0), (2, "delete_node", "N", '{"id": "y"}', 0), (3, "add_edge", "L", '{"source_id": "y", "target_id": "w", "weight": 4.5}', 0)]
    assert state(spark, feed, edges=edges)[1] == {("x", "z"): 1.0, ("y", "w"): 4.5}


def test_ends_may_hold_bars_and_ties_go_to_the_smaller_id(spark):
    feed = [(1, "add_edge", "L", '{"source_id": "p|q", "target_id": "r"}', 0), (5, "update_node", "N", '{"id": "x", "attributes": {"k": "first", "gone": null}}', 0), (5, "update_node", "N", '{"id": "x", "attributes": {"k": "second", "gone": "y"}}', 0), (6, "odd", "N", '{"id": "u"}', 0), (7, "add_node", "N", "no json", 0), (None or 8, "add_node", "N", None, 0)]
    nodes, edges = state(spark, feed)
    assert edges == {("p|q", "r"): 1.0} and nodes == {("N", "x"): {"k": "first"}}
    assert state(spark, []) == ({}, {})


def test_a_plugin_that_fails_as_it_runs_is_reported(spark):
    from pyspark.sql import functions as F

    commits = spark.createDataFrame([("c", "Fix #1", "git@github.com:acme/demo.git")], "id string, message string, remote string")
    registry = P.Registry()
    registry.register("Late", lambda c, _: (c.select(F.raise_error(F.lit("late"))), c))
    assert registry.run("build", commits) == [] and len(registry.errors) == 1 and "Late" in registry.errors[0]


def test_repositories_are_cloned_and_pulled(tmp_path):
    origin = samples.repository(str(tmp_path / "origin"))
    assert acquire(origin, str(tmp_path)) == origin
    path = acquire(f"file://{origin}", str(tmp_path / "cache"))
    assert path == str(tmp_path / "cache" / "demo") and os.path.isfile(os.path.join(path, "main.py"))
    with open(os.path.join(origin, "more.txt"), "w") as f:
        f.write("x")
    subprocess.run(["git", "-C", origin, "add", "."], check=True)
    subprocess.run(["git", "-C", origin, "-c", "user.name=A", "-c", "user.email=a@x", "commit", "-qm", "more"], check=True)
    assert acquire(f"file://{origin}", str(tmp_path / "cache")) == path and os.path.isfile(os.path.join(path, "more.txt"))
    for bad in ("nowhere", f"file://{tmp_path}/missing"):
        with pytest.raises(ValueError):
            acquire(bad, str(tmp_path / "cache"))


def test_files_are_read_from_head_the_tree_and_history(tmp_path):
    path = samples.repository(str(tmp_path))
    with open(os.path.join(path, "new.py"), "w") as f:
        f.write("fresh = 1\n")
    assert file_text(path, "main.py").startswith("import os") and file_text(path, "new.py") == "fresh = 1\n"
    assert "func Lex" in file_text(path, "core/lex.go")  # gone since, as its last commit left it
    assert file_text(path, "../outside") == "" and file_text(path, "none.py") == ""


def test_limit_attributes_and_texts_embedded_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "g"))
    assert engine.index(samples.repository(str(tmp_path))) > 10
    page = engine.query("parser", min_score=0, depth=1, top_n=5, limit=1).collect()
    assert len(page) == 1 and any('"month":"01"' in (c.attributes or "") for c in page[0].connections)
    assert engine.query("parser", min_score=0, depth=0, limit=1).count() == 1
    before = engine.catalog.state["embeddings"]
    engine.catalog.compact()
    engine.index("")
    assert engine.catalog.state["embeddings"] == before  # nothing new to embed


def test_tools_answer_lines(spark, tmp_path):
    import io
    import json

    from stratagraph.tools import serve

    engine, out = Engine(spark, str(tmp_path / "t")), io.StringIO()
    lines = [{"tool": "index", "arguments": {"repositories": samples.repository(str(tmp_path))}}, {"tool": "query", "arguments": {"query": "parser", "limit": 1, "depth": 1}}, {"tool": "dependencies", "arguments": {"node": "main.py"}}, {"tool": "node_types"}, {"tool": "edge_types"}, {"tool": "amend", "arguments": {"action": "add_node", "entity_type": "NOTE", "data": '{"id": "n"}'}}, {"tool": "history", "arguments": {"function": "main"}}, {"tool": "syntax_tree", "arguments": {"node": "main.py"}}, {"tool": "odd"}, {"tool": "history", "arguments": {"function": "nobody"}}, 3]
    serve(engine, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nno json\n"), out)
    index, page, near, kinds, links, note, text, tree, odd, none, three, bad = map(json.loads, out.getvalue().splitlines())
    assert index["nodes"] > 10 and len(page["results"]) == 1 and page["results"][0]["related"][0]["attributes"] is not None
    assert {"COMMIT", "FILE"} <= set(kinds) and "MODIFIED_FILE" in links and note["id"] and "V2 (" in text and any(n["type"] == "function_definition" for n in tree) and near
    assert all("error" in x for x in (odd, none, three, bad))


def test_compacted_types_are_split_into_files(spark, tmp_path, monkeypatch):
    from stratagraph.model import store

    monkeypatch.setattr(store, "FILE_ROWS", 10)
    c = Catalog(spark, str(tmp_path / "s"))
    c.append(spark.range(100).selectExpr("cast(id as string) id", "'FILE' type", "map('a', 'b') attributes", "0L seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be merged into one file
    c.compact()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert c.of_type("FILE").count() == 100 and len(c.of_type("FILE").inputFiles()) > 1
