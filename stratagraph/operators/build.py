"""Graph building: commits, changes, symbols, comments and keywords as node and edge rows.

Every builder returns rows (id, type, attributes, seq) or (source_id, target_id, type, weight, attributes,
seq) that ``model.merge`` makes into tables; all are plain projections of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.model.sanitize import sanitize, sanitize_map

NO_ATTRIBUTES = "map<string,string>"
KEYWORDS_KEPT, KEYWORD_LEAST = 100, 2


def attributes(**columns: Column) -> Column:
    """A map of the given columns, sanitised; null values are left out."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), sanitize(c.cast("string")).alias("value")) for k, c in columns.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def node(rows: DataFrame, kind: str, id_: Column, seq: Column, **attrs: Column) -> DataFrame:
    a = attributes(**attrs) if attrs else F.create_map().cast(NO_ATTRIBUTES)
    return rows.select(id_.alias("id"), F.lit(kind).alias("type"), a.alias("attributes"), seq.alias("seq")).where("id IS NOT NULL")


def edge(rows: DataFrame, kind: str, source: Column, target: Column, seq: Column, weight: Column | None = None, **attrs: Column) -> DataFrame:
    a = attributes(**attrs) if attrs else F.create_map().cast(NO_ATTRIBUTES)
    return rows.select(source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"), (weight if weight is not None else F.lit(1.0)).alias("weight"), a.alias("attributes"), seq.alias("seq")).where("source_id IS NOT NULL AND target_id IS NOT NULL")


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


BOT = r"\[bot\]|dependabot|greenkeeper"


def without_bots(commits: DataFrame) -> DataFrame:
    """Commits whose author's name marks no automation account; a null name is none."""
    return commits.where(~F.coalesce(F.lower("author_name"), F.lit("")).rlike(BOT))


def unseen(commits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Commits that are no nodes yet."""
    return commits.join(nodes.where("type = 'COMMIT'").select("id"), "id", "left_anti")


def message_id(message: Column) -> Column:
    return F.concat(F.lit("MSG:"), F.sha2(F.coalesce(message, F.lit("")), 256))


def commit_graph(commits: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of commits (id, repo, message, timestamp, author_*, committer_*, parents, seq).

    Each commit gives itself, its repository, message (equal messages share a node), author, committer
    and month, and edges to them and to its parents (blank parents are none). A null or blank e-mail
    gives no author; a null message counts as empty; an unreadable date falls into 2000-01.
    """
    s = F.col(seq)
    repo, bucket = F.col("repo"), X.time_bucket(F.col("timestamp"))
    mail = lambda c: F.when(F.trim(c) != "", F.col(c))
    nodes = union(
        node(commits, "COMMIT", F.col("id"), s, message=F.coalesce("message", F.lit("")), timestamp=F.col("timestamp"), author_name=F.col("author_name"), author_email=F.col("author_email"), committer_name=F.col("committer_name"), committer_email=F.col("committer_email"), committer_date=F.col("committer_date"), parents=F.to_json("parents")),
        node(commits, "REPOSITORY", repo, s, name=repo),
        node(commits, "COMMIT_MESSAGE", message_id(F.col("message")), s, content=F.coalesce("message", F.lit(""))),
        node(commits, "AUTHOR", mail("author_email"), s, name=F.col("author_name")),
        node(commits, "AUTHOR", mail("committer_email"), s, name=F.col("committer_name")),
        node(commits, "TIME_BUCKET", bucket, s, year=F.substring(bucket, 1, 4), month=F.substring(bucket, 6, 2)),
    )
    parents = commits.select("id", F.explode("parents").alias("parent"), s.alias("seq")).where("trim(parent) != ''")
    edges = union(
        edge(commits, "PART_OF_REPO", F.col("id"), repo, s), edge(parents, "PARENT_OF", F.col("id"), F.col("parent"), F.col("seq")),
        edge(commits, "HAS_MESSAGE", F.col("id"), message_id(F.col("message")), s), edge(commits, "AUTHORED_BY", F.col("id"), mail("author_email"), s),
        edge(commits, "COMMITTED_BY", F.col("id"), mail("committer_email"), s), edge(commits, "OCCURRED_IN", F.col("id"), bucket, s),
    )
    return nodes, edges


def file_graph(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of changes (commit_id, a_path, b_path, change_type, seq); deletions (no b_path) give nothing."""
    live = changes.where("b_path IS NOT NULL")
    p, s = F.col("b_path"), F.col("seq")
    source = F.when(F.col("a_path") != p, F.col("a_path"))
    return node(live, "FILE", p, s, name=X.base_name(p), extension=X.extension(p)), edge(live, "MODIFIED_FILE", F.col("commit_id"), p, s, change_type=F.col("change_type"), source_path=source)


def secret_graph(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Environment variables read by the contents (commit_id, content, seq) of changed files."""
    found = contents.select("commit_id", "seq", F.explode(X.secrets(F.col("content"))).alias("variable"))
    id_ = F.concat(F.lit("ENV:"), F.col("variable"))
    return node(found, "SECRET", id_, F.col("seq"), variable=F.col("variable")), edge(found, "REFERENCES_ENV", id_, F.col("commit_id"), F.col("seq"))


def symbol_graph(definitions: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of definitions (file, name, seq) and of touched ones (commit_id, file, name, seq), which may be imported."""
    s = F.col("seq")
    named = lambda df: node(df, "SYMBOL", F.col("name"), s, name=F.col("name"), file=F.col("file"))
    return union(named(definitions), named(touched)), union(edge(definitions, "HAS_SYMBOL", F.col("file"), F.col("name"), s), edge(touched, "MODIFIED_SYMBOL", F.col("name"), F.col("commit_id"), s))


def comment_graph(comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comments (commit_id, file, line, text, kind, seq); the id hashes file, line and text."""
    id_ = F.concat(F.lit("COMMENT:"), F.substring(F.sha2(F.concat_ws(":", "file", "line", "text"), 256), 1, 12))
    s = F.col("seq")
    nodes = node(comments, "COMMENT", id_, s, content=F.col("text"), type=F.col("kind"), file=F.col("file"), line=F.col("line"))
    return nodes, union(edge(comments, "HAS_COMMENT", id_, F.col("commit_id"), s), edge(comments, "CONTAINS_COMMENT", F.col("file"), id_, s))


def keyword_terms(sources: DataFrame, kept: int = KEYWORDS_KEPT, least: int = KEYWORD_LEAST) -> DataFrame:
    """(term, frequency): the terms of sources (node_id, terms, seq) that occur most, ties by first occurrence, then name."""
    counted = sources.select("seq", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("frequency"), F.min("seq").alias("first_seq"))
    return counted.where(F.col("frequency") >= least).orderBy(F.desc("frequency"), "first_seq", "term").limit(kept).select("term", "frequency")


def keyword_graph(sources: DataFrame, kept: int = KEYWORDS_KEPT, least: int = KEYWORD_LEAST) -> tuple[DataFrame, DataFrame]:
    """Keyword nodes and HAS_KEYWORD edges from every node that holds one of the kept terms (at most ``kept`` rows broadcast)."""
    terms = keyword_terms(sources, kept, least)
    id_ = F.concat(F.lit("KEYWORD:"), F.col("term"))
    pairs = sources.select("node_id", "seq", F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(terms.select("term")), "term")
    return node(terms, "KEYWORD", id_, F.lit(0).cast("bigint"), term=F.col("term"), frequency=F.col("frequency")), edge(pairs, "HAS_KEYWORD", F.col("node_id"), id_, F.col("seq"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, type, out): every edge from both ends; an edge without one end is left out."""
    e = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    return e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "type", F.lit(True).alias("out")).unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "type", F.lit(False).alias("out")))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, side, n): edges whose end is no node."""
    ids = nodes.select("id").distinct()
    ends = edges.select("type", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("id")))).alias("e")).select("type", "e.*").where("id IS NOT NULL")
    return ends.join(ids, "id", "left_anti").groupBy("type", "side").agg(F.count("*").alias("n"))


def present(nodes: DataFrame) -> DataFrame:
    """(id, type, attributes) of the stored nodes that are not deleted: per id the row updated last, JSON attributes as a map.

    Null, empty and unreadable attributes give an empty map.
    """
    last = nodes.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("type", "attributes", "deleted_at"), F.struct("updated_at", "type", "attributes")).alias("n")).where("n.deleted_at IS NULL")
    parsed = F.from_json("n.attributes", "map<string,string>")
    return last.select("id", "n.type", F.coalesce(sanitize_map(parsed), F.create_map().cast(NO_ATTRIBUTES)).alias("attributes"))


def present_commits(commits: DataFrame) -> DataFrame:
    """The commits as scanned last, numbered by time: seq orders by scan time, then id, without a global sort."""
    columns = [c for c in commits.columns if c != "id"]
    last = commits.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*columns), "scanned_at").alias("c")).select("id", "c.*")
    return last.withColumn("seq", F.coalesce(F.unix_micros(F.col("scanned_at").cast("timestamp")), F.lit(0)))


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of each group from 1."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
