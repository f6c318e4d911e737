"""Enrichment: functions from commits in context to further nodes and edges, at build or at query time."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators.build import edge, node, undirected
from stratagraph.operators.search import Graph
from stratagraph.session import Scratch

#: (commits (id, message, remote), config) to node rows and edge rows, as the builders give them.
Enricher = Callable[[DataFrame, dict], tuple[DataFrame, DataFrame]]


@dataclass
class Plugin:
    name: str
    run: Enricher
    kind: str = "build"


class Registry:
    """Plugins by name: registered functions, or ``module:function`` import paths; a failing one is reported and skipped."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}
        self.errors: list[str] = []

    def register(self, name: str, run: Enricher, kind: str = "build") -> None:
        self.plugins[name] = Plugin(name, run, kind)

    def load(self, path: str, kind: str = "build") -> None:
        module, _, name = path.partition(":")
        self.register(path, getattr(importlib.import_module(module), name), kind)

    def run(self, kind: str, commits: DataFrame, parameters: list[str] | None = None) -> list[tuple[DataFrame, DataFrame]]:
        """The rows of every plugin of a kind; ``parameters`` are ``Plugin:Key=Value``."""
        scratch = Scratch(commits.sparkSession, "plugins")
        config, out = X.parse_parameters(parameters or []), []
        for p in self.plugins.values():
            if p.kind != kind:
                continue
            try:  # rows are written here, so that a plugin that fails as it runs is caught as well
                rows = p.run(commits, config.get(p.name, {}))
                out.append(tuple(scratch.write(r, "rows") for r in rows))
            except Exception as e:  # noqa: BLE001 - one plugin must not stop the others
                self.errors.append(f"{p.name}: {e}")
        return out


def in_context(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, message, remote): commits (all, or those of ``ids``) with their message and their repository's first remote."""
    commits = graph.commits if ids is None else graph.commits.join(ids.select("id").distinct(), "id", "left_semi")
    repos = graph.nodes.where("type = 'REPOSITORY'").select(F.col("id").alias("repo_id"), F.get_json_object(F.col("attributes")["remotes"], "$[0]").alias("remote"))
    of = graph.edges.where("type = 'PART_OF_REPO'").select(F.col("source_id").alias("id"), F.col("target_id").alias("repo_id")).join(repos, "repo_id").groupBy("id").agg(F.min("remote").alias("remote"))
    return commits.select("id", F.col("attributes")["message"].alias("message")).join(of, "id", "left")


def context(graph: Graph, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes one step from the given commits, and the edges between."""
    wanted = ids.select(F.col("id").alias("a")).distinct()
    around = undirected(graph.edges).join(wanted, "a", "left_semi").select(F.col("b").alias("id")).distinct()
    edges = graph.edges.join(wanted, F.col("source_id") == F.col("a"), "left_semi").unionByName(graph.edges.join(wanted, F.col("target_id") == F.col("a"), "left_semi")).distinct()
    return graph.nodes.join(around, "id", "left_semi"), edges


def pull_requests(table: DataFrame, linked: DataFrame | None = None) -> Enricher:
    """Link ``#123`` in messages to rows of a table (owner, repo, number, title, body, state, url, author, created_at).

    References of commits without a known remote, to numbers the table lacks, or already linked (source_id,
    target_id of ``linked``) give nothing.
    """

    def run(commits: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
        refs = commits.select("id", X.remote(F.col("remote")).alias("r"), F.explode(X.numbers(F.col("message"))).alias("number")).select("id", "r.owner", "r.repo", "number").where("owner IS NOT NULL")
        known = table.select("owner", "repo", F.col("number").cast("string").alias("number"), *[c for c in ("title", "body", "state", "url", "author", "created_at")]).dropDuplicates(["owner", "repo", "number"])
        found = refs.join(known, ["owner", "repo", "number"]).withColumn("node", F.concat(F.lit("PR:"), "owner", F.lit("/"), "repo", F.lit("#"), "number"))
        if linked is not None:
            found = found.join(linked.select(F.col("source_id").alias("id"), F.col("target_id").alias("node")), ["id", "node"], "left_anti")
        zero = F.lit(0).cast("bigint")
        return (
            node(found, "PULL_REQUEST", F.col("node"), zero, number=F.col("number"), title=F.col("title"), body=F.col("body"), state=F.col("state"), url=F.col("url"), author=F.col("author"), created_at=F.col("created_at")),
            edge(found, "RELATED_TO_PR", F.col("id"), F.col("node"), zero),
        )

    return run


def tasks(table: DataFrame, linked: DataFrame | None = None) -> Enricher:
    """Link task ids that ``config['regex']`` finds in messages to rows of a table (id, title, status, url, description, team_id)."""

    def run(commits: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
        pattern = config.get("regex") or "(?!)"
        refs = commits.select(F.col("id").alias("commit_id"), F.explode(X.references(F.col("message"), pattern)).alias("task")).where("task != ''")
        known = table.select(F.col("id").cast("string").alias("task"), "title", "status", "url", "description", "team_id").dropDuplicates(["task"])
        found = refs.join(known, "task").withColumn("node", F.concat(F.lit("CLICKUP_TASK:"), "task"))
        if linked is not None:
            found = found.join(linked.select(F.col("source_id").alias("commit_id"), F.col("target_id").alias("node")), ["commit_id", "node"], "left_anti")
        zero = F.lit(0).cast("bigint")
        return (
            node(found, "CLICKUP_TASK", F.col("node"), zero, id=F.col("task"), title=F.col("title"), status=F.col("status"), url=F.col("url"), description=F.col("description"), team_id=F.col("team_id")),
            edge(found, "RELATED_TO_TASK", F.col("commit_id"), F.col("node"), zero),
        )

    return run
