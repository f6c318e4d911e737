import os
import subprocess

import pytest
from pyspark.sql import functions as F

from stratagraph.api import Engine
from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.model.store import Catalog
from stratagraph.operators import enrich as P
from stratagraph.operators.lookup import Ambiguous, resolve
from stratagraph.sources.gitsource import history
from stratagraph.streaming.ingest import follow_repository, sessions, windowed_counts


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("git") / "demo"
    root.mkdir()

    def git(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann B", "-c", "user.email=ann@x.test", *args], check=True, capture_output=True)

    def commit(message, **files):
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(exist_ok=True)
            path.write_text(text)
        git("add", ".")
        git("commit", "-qm", message)

    git("init", "-q")
    git("remote", "add", "origin", "https://tok@github.com/acme/demo.git")
    commit("Initial parser\n\nBody |~| line\n:odd", main_dot_py="import os\nfrom utils import helper\n\ndef main():\n    key = os.getenv('DB_PASS')\n    return helper(key)\n", utils_dot_py="def helper(x):\n    return x\n")
    commit("Change parser helper #12", utils_dot_py="def helper(x):\n    y = x + 1\n    return y\n\nclass Processor:\n    # speaks\n    def new_helper(self):\n        return 2\n")
    commit("Add lexer core", core__logic_dot_py="def logic():\n    return 'lexer'\n", app_dot_tsx="export const App = () => {\n  return 1;\n};\n")
    git("-c", "user.name=dependabot[bot]", "commit", "-q", "--allow-empty", "-m", "Bump")
    return str(root), commit


@pytest.fixture(scope="module")
def engine(spark, repo, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("graph") / "g"))
    assert e.index(repo[0]) > 20
    return e


def test_source_reads_whole_messages_and_diffs(spark, repo):
    rows = history(spark, repo[0], batch=2).orderBy("seq").collect()
    assert [r.message.split("\n")[0] for r in rows] == ["Initial parser", "Change parser helper #12", "Add lexer core", "Bump"]
    assert rows[0].message.endswith("Body |~| line\n:odd") and rows[1].parents == [rows[0].id] and rows[0].parents == []
    assert {d.b_path for d in rows[0].diffs} == {"main.py", "utils.py"} and rows[3].diffs == [] and "+    y = x + 1" in rows[1].diffs[0].patch
    assert history(spark, os.path.dirname(repo[0])).count() == 0


def test_graph_holds_what_was_committed(engine):
    g = engine.catalog.graph()
    ids = lambda kind: {r.id for r in g.nodes.where(F.col("type") == kind).collect()}
    assert ids("FILE") == {"main.py", "utils.py", "core/logic.py", "app.tsx"} and ids("REPOSITORY") == {"demo"} and ids("SECRET") == {"ENV:DB_PASS"}
    assert {"main", "helper", "Processor", "Processor.new_helper", "logic", "App"} <= ids("SYMBOL") and len(ids("COMMIT")) == 3
    touched = g.edges.where("type = 'MODIFIED_SYMBOL' AND source_id = 'helper'").count()
    assert touched == 2 and ids("KEYWORD") >= {"KEYWORD:parser", "KEYWORD:helper"}
    repo = g.nodes.where("type = 'REPOSITORY'").head().attributes
    assert "tok@" not in repo["remotes"]


def test_index_again_adds_nothing(engine, repo):
    before = engine.catalog.count_nodes(), engine.catalog.edges().count()
    engine.index(repo[0], vectors=False)
    assert (engine.catalog.count_nodes(), engine.catalog.edges().count()) == before


def test_query_history_tree_and_dependencies(engine):
    found = engine.query("parser helper", min_score=0, depth=2).collect()
    assert found[0].message.startswith("Change parser helper") and found[0].relevance >= found[-1].relevance
    assert {c.type for c in found[0].connections} & {"FILE", "KEYWORD", "SYMBOL", "FUNCTION", "COMMIT_MESSAGE"}
    page = engine.query("parser", min_score=0, depth=1)
    assert "1. " in engine.text(page) and engine.text(page.limit(0)) == "No results."
    assert engine.query("zzzz", min_score=5, depth=0).count() == 0
    text = engine.history("helper")
    assert "V1 (" in text and "V2 (" in text and "y = x + 1" in text
    kinds = [n["type"] for n in engine.syntax_tree("utils.py")]
    assert "function_definition" in kinds and "return_statement" in kinds and engine.syntax_tree("helper")
    out = {(r.direction, r.edge_type, r.name) for r in engine.dependencies("core/logic.py").collect()}
    assert ("out", "HAS_SYMBOL", "logic") in out and any(d == "in" and n == "Add lexer core" for d, _, n in out)
    assert "COMMIT" in engine.node_types() and "MODIFIED_FILE" in engine.edge_types()


def test_fuzzy_ids(engine):
    nodes = engine.catalog.nodes()
    assert resolve(nodes, "logic.py") == "core/logic.py" and resolve(nodes, "main") == "main"
    with pytest.raises(Ambiguous) as e:
        resolve(nodes, "elp", options=2)
    assert len(e.value.options) == 2
    with pytest.raises(Ambiguous):
        resolve(nodes, "nothing like it")


def test_enrichment_links_only_known_records(spark, engine):
    g = engine.catalog.graph()
    commits = P.in_context(g)
    prs = spark.createDataFrame([("acme", "demo", 12, "Title", "b", "open", "u", "ann", "2024")], "owner string, repo string, number int, title string, body string, state string, url string, author string, created_at string")
    nodes, edges = P.pull_requests(prs)(commits.withColumn("remote", F.lit("git@github.com:acme/demo.git")), {})
    assert merge_nodes(nodes).head().id == "PR:acme/demo#12" and merge_edges(edges).count() == 1
    assert P.pull_requests(prs, edges)(commits.withColumn("remote", F.lit("git@github.com:acme/demo.git")), {})[1].count() == 0
    work = spark.createDataFrame([("lexer", "T", "done", "u", "d", "t")], "id string, title string, status string, url string, description string, team_id string")
    registry = P.Registry()
    registry.register("Tasks", P.tasks(work), "run")
    registry.register("Broken", lambda c, k: 1 / 0, "run")
    (found,) = registry.run("run", commits, [r"Tasks:regex=Add (\w+)"])
    assert found[1].count() == 1 and len(registry.errors) == 1
    assert P.tasks(work)(commits, {})[1].count() == 0


def test_amendments_replay_and_revert(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        c.amend("add_node", "NOTE", {})
    with pytest.raises(ValueError):
        c.amend("paint_node", "NOTE", {"id": "x"})
    first = c.amend("add_node", "NOTE", {"id": "x", "attributes": {"a": "1", "url": "https://t@github.com/z"}})
    second = c.amend("update_node", "NOTE", {"id": "x", "attributes": {"a": "2"}})
    c.amend("add_edge", "LINK", {"source_id": "x", "target_id": "y"})
    node = lambda: {r.id: r.attributes for r in c.amended().nodes.collect()}
    assert node() == {"x": {"a": "2", "url": "x-access-token:*@github.com/z"}} and c.amended().edges.count() == 1
    c.revert(second)
    assert node()["x"]["a"] == "1"
    c.amend("delete_node", "NOTE", {"id": "x"})
    assert node() == {}
    c.revert(first)
    assert node() == {}


def test_store_versions(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "s"))
    assert c.count_nodes() == 0 and c.get_node("n") is None
    rows = "id string, type string, attributes map<string,string>, seq bigint"
    c.append(spark.createDataFrame([("n", "FILE", {"a": "1"}, 0)], rows))
    c.append(spark.createDataFrame([("n", "FILE", {"a": "2"}, 0)], rows))
    assert c.get_node("n")["attributes"] == {"a": "2"}
    c.compact()
    c.append(spark.createDataFrame([("n", "FILE", {"b": "3"}, 0)], rows))
    assert c.get_node("n")["attributes"] == {"a": "2", "b": "3"} and c.of_type("FILE").count() == 1
    stale = c.state
    c.compact()
    with pytest.raises(RuntimeError):
        c._commit(stale)
    assert Catalog(spark, str(tmp_path / "s")).count_nodes() == 1 and Catalog(spark, str(tmp_path / "s"), overwrite=True).count_nodes() == 0


def test_streaming_follows_new_commits(spark, repo, tmp_path):
    path, commit = repo
    c = Catalog(spark, str(tmp_path / "live"))
    follow_repository(spark, path, c, str(tmp_path / "cp")).awaitTermination()
    before = c.of_type("COMMIT").count()
    commit("Later change", later_dot_py="def later():\n    return 3\n")
    follow_repository(spark, path, c, str(tmp_path / "cp")).awaitTermination()
    assert before == 3 and c.of_type("COMMIT").count() == 4
    commit("Change it again", utils_dot_py="def helper(x):\n    y = x + 2\n    return y\n")
    follow_repository(spark, path, c, str(tmp_path / "cp")).awaitTermination()
    helper = c.edges().where("type = 'HAS_HISTORY' AND source_id = 'helper'")
    assert helper.count() == 1 and c.edges().join(helper.select(F.col("target_id").alias("h")), F.col("source_id") == F.col("h")).where("type = 'HAS_VERSION'").count() == 3


def test_windows_are_the_same_in_batch_and_stream(spark, tmp_path):
    data = spark.range(500).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id % 72 as int), 0, 0) ts", "concat('t', id % 3) event_type", "cast(id as double) value", "id % 5 user_id")
    data.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "events"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in windowed_counts(data).collect()}
    assert windowed_counts(data, width="1 day", slide="12 hours").count() > windowed_counts(data).count() and sessions(data, "2 hours").agg(F.sum("n")).head()[0] == 500
