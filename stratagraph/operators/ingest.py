"""From repository history to graph rows: every builder applied, bots and known commits left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.functions.syntax import analyse_changes
from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.operators import build as B
from stratagraph.operators.search import Graph
from stratagraph.operators.versions import match_versions, open_histories, version_graph
from stratagraph.session import Scratch
from stratagraph.sources.gitsource import blobs, changes, history, remotes


def added_text(patch):
    """The added lines of a patch column: those that begin with + behind the first hunk header of each file."""
    hunks = F.filter(F.split(F.coalesce(patch, F.lit("")), r"\n(?=diff --git )"), lambda p: p.contains("@@"))
    bodies = F.transform(hunks, lambda p: F.regexp_replace(p, r"(?s)^.*?(?=^@@ |\n@@ )", ""))
    lines = F.filter(F.flatten(F.transform(bodies, lambda p: F.split(p, "\n"))), lambda x: x.startswith("+"))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, 2, 2**31 - 1)), "\n")


def repository(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The repository's node: name, root path and remotes (a JSON list, credentials masked)."""
    import json
    import os

    root = os.path.abspath(path)
    one = spark.createDataFrame([(os.path.basename(root), root, json.dumps(remotes(path)))], "name string, root_path string, remotes string")
    none = B.edge(one.where("false"), "PART_OF_REPO", F.col("name"), F.col("name"), F.lit(0).cast("bigint"))
    return B.node(one, "REPOSITORY", F.col("name"), F.lit(0).cast("bigint"), name=F.col("name"), root_path=F.col("root_path"), remotes=F.col("remotes")), none


def rows_of(spark: SparkSession, commits: DataFrame, path: str, known: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of commits of one repository (columns of the git source); function histories of ``known`` go on."""
    scratch = Scratch(spark, "ingest")
    commits = scratch.write(commits, "commits")
    stops = X.stop_words(spark)
    changed = changes(commits)
    live = changed.where("b_path IS NOT NULL")
    contents = live.join(blobs(live, path), "b_blob_sha", "left")
    files = contents.select("commit_id", "seq", F.col("b_path").alias("path"), X.language_of(X.extension(F.col("b_path"))).alias("language"), "content", "patch")
    seen = scratch.write(analyse_changes(files.where("language IS NOT NULL AND content IS NOT NULL")), "analysed")

    definitions = seen.select("seq", F.col("path").alias("file"), F.explode("definitions").alias("name"))
    touched = seen.select("commit_id", "seq", F.col("path").alias("file"), F.explode("touched").alias("name"))
    comments = seen.select("commit_id", "seq", F.col("path").alias("file"), F.explode("comments").alias("c")).select("commit_id", "seq", "file", "c.text", "c.kind", "c.line")
    functions = seen.select("commit_id", "seq", F.col("path").alias("file_path"), F.explode("functions").alias("f")).select(F.col("f.name").alias("function"), "seq", "commit_id", "file_path", F.col("f.text").alias("content"))
    words = lambda column, code: X.keywords(column, stops, is_code=code)
    sources = B.union(
        commits.select(F.col("id").alias("node_id"), "seq", words(F.col("message"), False).alias("terms")), live.select(F.col("b_path").alias("node_id"), "seq", words(X.base_name(F.col("b_path")), True).alias("terms")),
        definitions.select(F.col("name").alias("node_id"), "seq", words(F.col("name"), True).alias("terms")), live.select(F.col("commit_id").alias("node_id"), "seq", words(added_text(F.col("patch")), True).alias("terms")),
    )
    parts = [B.commit_graph(commits), repository(spark, path), B.file_graph(changed), B.secret_graph(contents.select("commit_id", "seq", "content")), B.symbol_graph(definitions, touched), B.comment_graph(comments), version_graph(match_versions(functions, open_histories(known.nodes, known.edges) if known else None)), B.keyword_graph(scratch.write(sources, "sources"))]
    return scratch.write(B.union(*[n for n, _ in parts]), "nodes"), scratch.write(B.union(*[e for _, e in parts]), "edges")


def ingest(spark: SparkSession, path: str, known: Graph | None = None, skip_bots: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) rows of a repository, without commits that the graph ``known`` already holds."""
    commits = history(spark, path)
    if skip_bots:
        commits = B.without_bots(commits)
    if known is not None:
        commits = B.unseen(commits, known.nodes)
    return rows_of(spark, commits, path, known)


def graph_of(spark: SparkSession, path: str, skip_bots: bool = True) -> tuple[DataFrame, DataFrame]:
    """The merged node and edge tables of a repository."""
    nodes, edges = ingest(spark, path, skip_bots=skip_bots)
    return merge_nodes(nodes), merge_edges(edges)
