"""Hybrid search: keyword and vector hits led to commits, scored with diminishing returns, penalised, ranked.

Nodes are (id, type, attributes), edges (id, source_id, target_id, type, weight), embeddings as stored. The
order in which hits count is that of node ids (keyword hits) and of similarity, then id (vector hits).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.text import query_words, stop_words
from stratagraph.model.schemas import SELF_HITS, VECTOR_HITS
from stratagraph.operators.build import ranked, undirected
from stratagraph.operators.vectors import CANDIDATES, FLOOR, SCORED, top_similar

FIELDS = ["name", "message", "content", "author_name", "author_email", "body", "description"]
BASES = {"COMMIT": 10.0, "KEYWORD": 8.0}
OTHER_BASE, FILTER_BONUS, SEMANTIC_BASE, AVOID_BASE = 5.0, 5.0, 20.0, 200.0


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None = None

    @property
    def commits(self) -> DataFrame:
        return self.nodes.where("type = 'COMMIT'")


def contains(text: Column, word: str, wildcards: bool = False) -> Column:
    """Case-insensitive substring; null contains nothing. % and _ are literal unless ``wildcards``."""
    if wildcards:
        pattern = F.lit("%" + word.lower().replace("!", "!!") + "%")  # ! escapes, so that a backslash of the user stays one
        return F.coalesce(F.call_function("like", F.lower(text), pattern, F.lit("!")), F.lit(False))
    return F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))


def keyword_hits(nodes: DataFrame, words: Sequence[str], wildcards: bool = False) -> DataFrame:
    """(node_id, type, attributes, word): nodes whose id or a text attribute contains a word; one scan for all words."""
    fields = [F.col("id"), *[F.col("attributes")[f] for f in FIELDS]]
    any_ = lambda w: F.greatest(*[contains(f, w, wildcards) for f in fields])
    matched = F.filter(F.array(*[F.when(any_(w), F.lit(w)) for w in words]), lambda w: w.isNotNull())
    return nodes.select(F.col("id").alias("node_id"), "type", "attributes", F.explode(matched).alias("word"))


def hits_to_commits(hits: DataFrame, graph: Graph) -> DataFrame:
    """(commit_id, node_id, type, word): a commit is its own, a keyword leads to what it is linked from, others to every neighbour."""
    ids = graph.commits.select(F.col("id").alias("commit_id"))
    own = hits.where("type = 'COMMIT'").select(F.col("node_id").alias("commit_id"), "node_id", "type", "word")
    links = graph.edges.where("type = 'HAS_KEYWORD'").select(F.col("source_id").alias("commit_id"), F.col("target_id").alias("node_id"))
    keyword = hits.where("type = 'KEYWORD'").select("node_id", "type", "word").join(links, "node_id").select("commit_id", "node_id", "type", "word")
    around = undirected(graph.edges).select(F.col("a").alias("node_id"), F.col("b").alias("commit_id"))
    other = hits.where("type NOT IN ('COMMIT', 'KEYWORD')").select("node_id", "type", "word").join(around, "node_id").select("commit_id", "node_id", "type", "word")
    return own.unionByName(keyword.unionByName(other).join(ids, "commit_id", "left_semi")).distinct()


def triggers(reached: DataFrame) -> DataFrame:
    """(start, id): the hits other than commits that led to a commit, which are connected to it at distance 0."""
    return reached.where("type != 'COMMIT'").select(F.col("commit_id").alias("start"), F.col("node_id").alias("id")).distinct()


def keyword_scores(reached: DataFrame) -> DataFrame:
    """(commit_id, score, reasons): the i-th hit of a word on a commit adds base / i."""
    base = F.lit(OTHER_BASE)
    for kind, value in BASES.items():
        base = F.when(F.col("type") == kind, value).otherwise(base)
    numbered = ranked(reached, ["commit_id", "word"], [F.col("node_id")], "i")
    reason = F.format_string("word %s found in %s %s", "word", "type", "node_id")
    return numbered.groupBy("commit_id").agg(F.sum(base / F.col("i")).alias("score"), F.array_sort(F.collect_set(reason)).alias("reasons"))


def filtered_commits(graph: Graph, filters: dict[str, str]) -> DataFrame:
    """(commit_id): commits next to a node of every filter's type whose id, name or content contains its value."""
    around = undirected(graph.edges).select(F.col("a").alias("id"), F.col("b").alias("commit_id"))
    ids = graph.commits.select(F.col("id").alias("commit_id"))
    out = None
    for kind, value in filters.items():
        matched = graph.nodes.where(F.col("type") == kind).where(contains(F.col("id"), value) | contains(F.col("attributes")["name"], value) | contains(F.col("attributes")["content"], value))
        near = around.join(matched.select("id"), "id", "left_semi").select("commit_id").join(ids, "commit_id", "left_semi").distinct()
        out = near if out is None else out.intersect(near)
    return out


def repository_commits(graph: Graph, name: str) -> DataFrame:
    """(commit_id) of the repositories of exactly that name; none if it is unknown."""
    repos = graph.nodes.where("type = 'REPOSITORY'").where(F.col("attributes")["name"] == name).select(F.col("id").alias("target_id"))
    return graph.edges.where("type = 'PART_OF_REPO'").join(repos, "target_id", "left_semi").select(F.col("source_id").alias("commit_id")).distinct()


def vector_commits(hits: DataFrame, graph: Graph) -> DataFrame:
    """(commit_id, node_id, node_type, similarity): the commits vector hits lead to."""
    own = hits.where(F.col("node_type").isin(SELF_HITS)).select(F.col("node_id").alias("commit_id"), "node_id", "node_type", "similarity")
    for kind, edge, outgoing in VECTOR_HITS:
        node, commit = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
        links = graph.edges.where(F.col("type") == edge).select(F.col(node).alias("node_id"), F.col(commit).alias("commit_id"))
        own = own.unionByName(hits.where(F.col("node_type") == kind).join(links, "node_id").select("commit_id", "node_id", "node_type", "similarity"))
    return own.join(graph.commits.select(F.col("id").alias("commit_id")), "commit_id", "left_semi").distinct()


def semantic_scores(reached: DataFrame) -> DataFrame:
    """(commit_id, score, reasons): the i-th most similar hit of a commit adds 20 * similarity / i."""
    numbered = ranked(reached, ["commit_id"], [F.desc("similarity"), F.col("node_id"), F.col("node_type")], "i")
    reason = F.format_string("close in meaning: %s %s, cosine %.2f", "node_type", "node_id", "similarity")
    return numbered.groupBy("commit_id").agg(F.sum(SEMANTIC_BASE * F.col("similarity") / F.col("i")).alias("score"), F.array_sort(F.collect_set(reason)).alias("reasons"))


def file_counts(edges: DataFrame) -> DataFrame:
    """(commit_id, files): MODIFIED_FILE edges per commit."""
    return edges.where("type = 'MODIFIED_FILE'").groupBy(F.col("source_id").alias("commit_id")).agg(F.count("*").alias("files"))


def search(
    graph: Graph, query: str = "", query_vector: Sequence[float] | None = None, repo_name: str | None = None, filters: dict[str, str] | None = None, semantic_only: bool = False,
    negative_query: str = "", negative_vector: Sequence[float] | None = None, excluded_commits: Sequence[str] = (), min_score: float = 10.0, top_n: int = 5, offset: int = 0,
) -> DataFrame:
    """(id, message, author, date, relevance, reasons): the ranked commits.

    In order: repository and filters, a bonus for filters alone, positive words, negative words (which
    remove commits outright), vector hits, negative vector hits (which only subtract), the penalty for
    touching many files, exclusions (full ids or prefixes), threshold, order by relevance and id, slice. An
    unknown repository or a filter without a match gives nothing. ``query`` and the vectors may be empty.
    """
    spark = graph.nodes.sparkSession
    stops = stop_words(spark)
    scope = None
    if repo_name:
        scope = repository_commits(graph, repo_name)
    if filters:
        strict = filtered_commits(graph, filters)
        scope = strict if scope is None else scope.intersect(strict)
    inside = (lambda df: df) if scope is None else (lambda df: df.join(scope, "commit_id", "left_semi"))
    empty = spark.createDataFrame([], "commit_id string, score double, reasons array<string>")

    scored = empty
    if filters and not query.strip():
        said = F.lit("passes the filters " + ", ".join(f"{k}={v}" for k, v in filters.items()))
        scored = scope.select("commit_id", F.lit(FILTER_BONUS).alias("score"), F.array(said).alias("reasons"))
    if query.strip() and not semantic_only:
        scored = scored.unionByName(keyword_scores(inside(hits_to_commits(keyword_hits(graph.nodes, query_words(query, stops)), graph))))
    if negative_query.strip() and not semantic_only:
        scored = scored.join(hits_to_commits(keyword_hits(graph.nodes, query_words(negative_query, stops)), graph).select("commit_id"), "commit_id", "left_anti")
    if query_vector is not None and graph.embeddings is not None:
        near = top_similar(graph.embeddings, query_vector, CANDIDATES).where(F.col("similarity") >= FLOOR).orderBy(F.desc("similarity"), "node_id").limit(SCORED)
        scored = scored.unionByName(semantic_scores(inside(vector_commits(near, graph))))
    total = scored.groupBy("commit_id").agg(F.sum("score").alias("score"), F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons"))
    if negative_vector is not None and graph.embeddings is not None:
        far = vector_commits(top_similar(graph.embeddings, negative_vector, CANDIDATES).where(F.col("similarity") >= FLOOR), graph).groupBy("commit_id").agg(F.sum(AVOID_BASE * F.col("similarity")).alias("minus"), F.max("similarity").alias("worst"))
        said = F.format_string("close to what is to be avoided: cosine %.2f, minus %.2f", "worst", "minus")
        total = total.join(far, "commit_id", "left").select("commit_id", (F.col("score") - F.coalesce("minus", F.lit(0.0))).alias("score"), F.when(F.col("minus").isNotNull(), F.concat("reasons", F.array(said))).otherwise(F.col("reasons")).alias("reasons"))
    penalty = F.greatest(F.lit(1.0), F.log10("files"))
    said = F.format_string("touches %d files: relevance divided by %.2f", "files", penalty)
    total = total.join(file_counts(graph.edges), "commit_id", "left").select(
        "commit_id", F.round(F.col("score") / F.coalesce(penalty, F.lit(1.0)), 6).alias("relevance"), F.when(F.col("files") > 10, F.concat("reasons", F.array(said))).otherwise(F.col("reasons")).alias("reasons")
    )
    for prefix in excluded_commits:
        total = total.where(~F.col("commit_id").startswith(prefix))
    best = total.where(F.col("relevance") >= min_score).orderBy(F.desc("relevance"), "commit_id").offset(offset).limit(top_n)
    a = lambda *names: F.coalesce(*[F.col("attributes")[n] for n in names[:-1]], F.lit(names[-1]))
    rows = graph.commits.select(F.col("id").alias("commit_id"), a("message", "No message").alias("message"), a("author_name", "author", "Unknown").alias("author"), a("timestamp", "date", "Unknown").alias("date"))
    return best.join(rows, "commit_id").select(F.col("commit_id").alias("id"), "message", "author", "date", "relevance", "reasons").orderBy(F.desc("relevance"), "id")
