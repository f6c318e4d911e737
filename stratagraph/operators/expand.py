"""Breadth-first expansion around the top commits, gated by relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.model.schemas import NO_EXPAND
from stratagraph.operators.build import undirected
from stratagraph.operators.search import Graph
from stratagraph.session import Scratch

TEXT_GATED = ["COMMIT", "COMMIT_MESSAGE", "COMMENT", "SECRET", "FUNCTION", "PULL_REQUEST", "CLICKUP_TASK"]
FILE_LINKS = ["HAS_SYMBOL", "HAS_KEYWORD", "MODIFIED_SYMBOL"]


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.lower(text).contains(w.lower()), F.lit(False))
    return out


def normalise_types(names: Sequence[str]) -> list[str]:
    """Upper case, plural S off."""
    return [n.strip().upper().rstrip("S") for n in names or []]


def gates(graph: Graph, words: Sequence[str], negative: Sequence[str] = (), semantic: DataFrame | None = None, negative_semantic: DataFrame | None = None, all_files: bool = False) -> DataFrame:
    """(id, type, attributes, relevant, avoided) for every node; computed once, whatever the number of start commits.

    ``semantic`` and ``negative_semantic`` have node_id. A node without attributes has no text.
    """
    spark = graph.nodes.sparkSession
    none = spark.createDataFrame([], "node_id string")
    near = (semantic or none).select(F.col("node_id").alias("s_id")).distinct()
    far = (negative_semantic or none).select(F.col("node_id").alias("n_id")).distinct()
    values = F.concat_ws(" ", F.map_values("attributes"))
    e = graph.edges.where(F.col("type").isin(FILE_LINKS))
    around = undirected(e).select(F.col("a").alias("f_id"), F.col("b").alias("l_id")).join(near, F.col("l_id") == F.col("s_id"), "left").where(F.col("s_id").isNotNull() | _any(F.col("l_id"), words)).select("f_id").distinct()
    rows = graph.nodes.join(near, F.col("id") == F.col("s_id"), "left").join(far, F.col("id") == F.col("n_id"), "left").join(around, F.col("id") == F.col("f_id"), "left")
    avoided = F.col("n_id").isNotNull() | _any(F.concat_ws(" ", "id", values), negative)
    relevant = (
        F.when(F.col("s_id").isNotNull(), True).when(F.col("type") == "KEYWORD", _any(F.col("id"), words) | _any(F.col("attributes")["name"], words)).when(F.col("type") == "SYMBOL", False)
        .when((F.col("type") == "FILE") & F.lit(not all_files), F.col("f_id").isNotNull()).when(F.col("type").isin(TEXT_GATED), _any(values, words)).otherwise(True)
    )
    return rows.select("id", "type", "attributes", relevant.alias("relevant"), avoided.alias("avoided"))


def expand(graph: Graph, starts: DataFrame, gate: DataFrame, depth: int = 1, traverse_types: Sequence[str] = (), exclude_types: Sequence[str] = (), all_matches: bool = False, triggers: DataFrame | None = None) -> DataFrame:
    """(start, id, type, distance): the nodes connected to each start within ``depth`` steps.

    A node is visited once per start, at its least distance, and stays so even if rejected. Nodes that are
    avoided, of an excluded type or (unless ``all_matches``) not relevant are dropped and not passed
    through. With ``traverse_types`` a walk goes on from commits and these types; without, from all but
    authors, months and repositories. ``triggers`` (start, id) need no relevance and keep distance 0.
    """
    spark = graph.nodes.sparkSession
    scratch = Scratch(spark, "expand")
    allowed = [t for t in normalise_types(traverse_types) if t != "AST_NODE"]
    excluded = normalise_types(exclude_types)
    excluded_type = F.greatest(*[F.lit(False)] * 2, *[(F.col("type") == x) | (F.translate("type", "_", " ") == x) | (F.translate("type", "_", "") == x) for x in excluded])
    onward = (F.col("type") == "COMMIT") | F.col("type").isin(allowed) if allowed else ~F.col("type").isin(NO_EXPAND)
    around = undirected(graph.edges).select(F.col("a").alias("at"), F.col("b").alias("id"))
    if depth > 1:  # read once a step; repeats vanish after each step's join
        gate = scratch.write(gate.select("id", "type", "relevant", "avoided"), "gate")
    hits = (triggers if triggers is not None else spark.createDataFrame([], "start string, id string")).select("start", "id").distinct().withColumn("trigger", F.lit(True))
    first = starts.select(F.col("id").alias("start")).distinct()
    visited = scratch.write(first.select("start", F.col("start").alias("id")), "visited")
    frontier, found = visited, []
    for step in range(1, depth + 1):
        reached = frontier.withColumnRenamed("id", "at").join(around, "at").select("start", "id").distinct().join(visited, ["start", "id"], "left_anti")
        reached = scratch.write(reached, "reached")
        tested = reached.join(gate, "id").join(hits, ["start", "id"], "left").withColumn("trigger", F.coalesce("trigger", F.lit(False)))
        kept = tested.where((F.lit(all_matches) | F.col("trigger") | F.col("relevant")) & ~F.col("avoided") & ~excluded_type)
        kept = scratch.write(kept.select("start", "id", "type", F.when(F.col("trigger"), 0).otherwise(step).alias("distance")), "kept")
        found.append(kept)
        frontier = kept.where(onward).select("start", "id")
        if step == depth or not frontier.head(1):
            break
        visited = scratch.write(visited.unionByName(reached), "visited")
    out = found[0] if found else spark.createDataFrame([], "start string, id string, type string, distance int")
    for f in found[1:]:
        out = out.unionByName(f)
    return out
