"""Queries of the graph, search, vector, history and lookup operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.model.sanitize import sanitize
from stratagraph.operators import build as B
from stratagraph.operators import expand as E
from stratagraph.operators import lookup as L
from stratagraph.operators import search as S
from stratagraph.operators import vectors as V
from stratagraph.operators.versions import match_versions, ordered_versions, quick_ratio_column, version_graph
from stratagraph.session import Scratch

QUERIES, SQL = {}, {}
WORDS, AVOID = ["cache", "graph"], "nightly"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stored_graph(spark: SparkSession, sf_dir: str) -> S.Graph:
    """``graph`` written out once, for queries that read its nodes and edges several times."""
    g, scratch = graph(spark, sf_dir), Scratch(spark, "graph")
    return S.Graph(scratch.write(g.nodes, "nodes"), scratch.write(g.edges, "edges"), g.embeddings)


def graph(spark: SparkSession, sf_dir: str) -> S.Graph:
    """Present nodes (commits with what the commit table says of them), edges once each, vectors."""
    nodes = B.present(_t(spark, sf_dir, "nodes"))
    c = B.present_commits(_t(spark, sf_dir, "commits"))
    said = c.select(F.col("id").alias("c_id"), B.attributes(message=F.col("message"), author_name=F.col("author_name"), author_email=F.col("author_email"), timestamp=F.col("timestamp")).alias("said"))
    rows = nodes.join(said, (F.col("id") == F.col("c_id")) & (F.col("type") == "COMMIT"), "left")
    merged = F.when(F.col("said").isNotNull(), F.map_concat(F.map_filter("attributes", lambda k, _: ~k.isin("message", "author_name", "author_email", "timestamp")), "said")).otherwise(F.col("attributes"))
    edges = _t(spark, sf_dir, "edges").select("id", "source_id", "target_id", "type").distinct()
    return S.Graph(rows.select("id", "type", merged.alias("attributes")), edges, _t(spark, sf_dir, "node_vectors"))


_G = """
n0 AS (SELECT id, arg_max(struct_pack(t := type, a := attributes, d := deleted_at), updated_at) AS s FROM nodes WHERE id IS NOT NULL GROUP BY id),
c0 AS (SELECT id, arg_max(struct_pack(message := message, author_name := author_name, author_email := author_email, ts := "timestamp", repo := repo, parents := parents, committer_email := committer_email), scanned_at) AS c FROM commits WHERE id IS NOT NULL GROUP BY id),
g AS (SELECT n0.id, n0.s.t AS type, CASE WHEN json_valid(n0.s.a) THEN n0.s.a ->> '$.name' END AS name, CASE WHEN json_valid(n0.s.a) THEN n0.s.a ->> '$.repo' END AS repo, CASE WHEN json_valid(n0.s.a) THEN n0.s.a ->> '$.extension' END AS extension,
        c0.c.message AS message, c0.c.author_name AS author_name, c0.c.author_email AS author_email, c0.c.ts AS ts
      FROM n0 LEFT JOIN c0 ON c0.id = n0.id AND n0.s.t = 'COMMIT' WHERE n0.s.d IS NULL),
e AS (SELECT DISTINCT id, source_id, target_id, type FROM edges),
u AS (SELECT source_id AS a, target_id AS b, type FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL UNION ALL SELECT target_id, source_id, type FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"""


def _has(word: str) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{word}')" for c in ("g.id", "name", "message", "author_name", "author_email")) + ")"


_BUCKET = "coalesce(strftime(try_strptime(substr({}, 1, 10), '%Y-%m-%d'), '%Y-%m'), '2000-01')"
_C = "WITH" + _G + ", c AS (SELECT id, c.message AS message, c.author_email AS author_email, c.committer_email AS committer_email, c.repo AS repo, c.parents AS parents, c.ts AS ts FROM c0)"


@query(_C + f"""
SELECT 'COMMIT' AS type, count(*) AS n FROM c UNION ALL SELECT 'REPOSITORY', count(DISTINCT repo) FROM c UNION ALL SELECT 'COMMIT_MESSAGE', count(DISTINCT coalesce(message, '')) FROM c
UNION ALL SELECT 'AUTHOR', count(DISTINCT m) FROM (SELECT author_email AS m FROM c UNION ALL SELECT committer_email FROM c) WHERE trim(m) <> ''
UNION ALL SELECT 'TIME_BUCKET', count(DISTINCT {_BUCKET.format('ts')}) FROM c""")
def g1_nodes_by_type(spark, sf_dir):
    nodes, _ = B.commit_graph(B.present_commits(_t(spark, sf_dir, "commits")))
    return merge_nodes(nodes).groupBy("type").agg(F.count("*").alias("n"))


@query(_C + f"""
SELECT type, count(*) AS n FROM (
  SELECT DISTINCT * FROM (
    SELECT 'PART_OF_REPO' AS type, id AS a, repo AS b FROM c UNION ALL SELECT 'HAS_MESSAGE', id, coalesce(message, '') FROM c UNION ALL SELECT 'AUTHORED_BY', id, author_email FROM c WHERE trim(author_email) <> ''
    UNION ALL SELECT 'COMMITTED_BY', id, committer_email FROM c WHERE trim(committer_email) <> '' UNION ALL SELECT 'OCCURRED_IN', id, {_BUCKET.format('ts')} FROM c
    UNION ALL SELECT 'PARENT_OF', id, p FROM (SELECT id, unnest(parents) AS p FROM c) WHERE trim(p) <> '') WHERE b IS NOT NULL) GROUP BY type""")
def g1_edges_by_type(spark, sf_dir):
    _, edges = B.commit_graph(B.present_commits(_t(spark, sf_dir, "commits")))
    return merge_edges(edges).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT sha256(concat(coalesce(source_id, ''), '|', coalesce(target_id, ''), '|', coalesce(type, ''))) AS id, source_id, target_id, type, max(coalesce(weight, 1.0)) AS weight FROM edges GROUP BY source_id, target_id, type""")
def g2_merged_edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "edges").select("source_id", "target_id", "type", "weight", F.from_json("attributes", "map<string,string>").alias("attributes"), F.col("created_at").alias("seq"))
    return merge_edges(rows).select("id", "source_id", "target_id", "type", "weight")


@query(_C + " SELECT 'MSG:' || sha256(coalesce(message, '')) AS message_id, count(*) AS commits FROM c GROUP BY 1")
def g3_messages(spark, sf_dir):
    return B.present_commits(_t(spark, sf_dir, "commits")).groupBy(B.message_id(F.col("message")).alias("message_id")).agg(F.count("*").alias("commits"))


@query(_C + f" SELECT {_BUCKET.format('ts')} AS bucket, count(*) AS commits FROM c GROUP BY 1")
def g4_commits_per_month(spark, sf_dir):
    return B.present_commits(_t(spark, sf_dir, "commits")).groupBy(X.time_bucket(F.col("timestamp")).alias("bucket")).agg(F.count("*").alias("commits"))


_TOKENS = "list_filter(string_split_regex(regexp_replace(lower(regexp_replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]', ' ', 'g')), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.DOMAIN_STOP_WORDS) + "], w))"


@query(f"""WITH {_G}, s AS (SELECT id, row_number() OVER (ORDER BY id) AS seq, unnest({_TOKENS.format("coalesce(name, id)")}) AS term FROM g WHERE type IN ('SYMBOL', 'FUNCTION', 'FILE'))
SELECT term, count(*) AS frequency FROM s GROUP BY term HAVING count(*) >= 2 ORDER BY 2 DESC, min(id), term LIMIT 100""")
def g5_keywords(spark, sf_dir):
    rows = graph(spark, sf_dir).nodes.where(F.col("type").isin("SYMBOL", "FUNCTION", "FILE"))
    terms = X.keywords(F.coalesce(F.col("attributes")["name"], F.col("id")), X.DOMAIN_STOP_WORDS, is_code=True, lemmas=False)
    return B.keyword_terms(rows.select(F.col("id").alias("node_id"), F.col("id").alias("seq"), terms.alias("terms")))


@query("""WITH kv AS (SELECT id, updated_at, unnest(json_keys(attributes)) AS k, attributes FROM nodes WHERE json_valid(attributes) AND id IS NOT NULL)
SELECT id, k, arg_max(struct_pack(v := json_extract_string(attributes, concat('$."', k, '"'))), struct_pack(s := updated_at, v := json_extract_string(attributes, concat('$."', k, '"')))).v AS v FROM kv GROUP BY id, k""")
def g6_attribute_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "nodes").select("id", "type", F.from_json("attributes", "map<string,string>").alias("attributes"), F.col("updated_at").alias("seq"))
    return merge_nodes(rows, by_type=False).select("id", F.explode("attributes").alias("k", "v"))


@query(f"""WITH {_G}, r AS (SELECT source_id AS id, 'source' AS side, type FROM e UNION ALL SELECT target_id, 'target', type FROM e)
SELECT type, side, count(*) AS n FROM r WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM g) GROUP BY ALL""")
def g7_integrity(spark, sf_dir):
    g = graph(spark, sf_dir)
    return B.integrity(g.nodes, g.edges)


_REACHED = _G + """, hits AS (""" + " UNION ALL ".join(f"SELECT g.id, g.type, '{w}' AS word FROM g WHERE {_has(w)}" for w in WORDS) + """),
reached AS (SELECT DISTINCT * FROM (
  SELECT id AS commit_id, id AS node_id, type, word FROM hits WHERE type = 'COMMIT'
  UNION ALL SELECT e.source_id, h.id, h.type, h.word FROM hits h JOIN e ON e.target_id = h.id AND e.type = 'HAS_KEYWORD' WHERE h.type = 'KEYWORD'
  UNION ALL SELECT u.b, h.id, h.type, h.word FROM hits h JOIN u ON u.a = h.id WHERE h.type NOT IN ('COMMIT', 'KEYWORD'))
  WHERE commit_id IN (SELECT id FROM g WHERE type = 'COMMIT')),
kw AS (SELECT commit_id, sum(base / i) AS score FROM (SELECT *, CASE type WHEN 'COMMIT' THEN 10.0::DOUBLE WHEN 'KEYWORD' THEN 8.0::DOUBLE ELSE 5.0::DOUBLE END AS base, row_number() OVER (PARTITION BY commit_id, word ORDER BY node_id) AS i FROM reached) GROUP BY commit_id),
files AS (SELECT source_id AS commit_id, count(*) AS files FROM e WHERE type = 'MODIFIED_FILE' GROUP BY 1)"""


@query(f"WITH {_REACHED} SELECT commit_id AS id, round(score / greatest(1.0, coalesce(log10(files), 1.0)), 6) AS relevance FROM kw LEFT JOIN files USING (commit_id) WHERE round(score / greatest(1.0, coalesce(log10(files), 1.0)), 6) >= 10 ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5")
def s1_keyword_search(spark, sf_dir):
    return S.search(stored_graph(spark, sf_dir), " ".join(WORDS), top_n=20, offset=5).select("id", "relevance")


@query(f"WITH {_REACHED} SELECT commit_id, word, count(*) AS hits FROM reached GROUP BY ALL")
def s1_hits_per_commit(spark, sf_dir):
    g = graph(spark, sf_dir)
    return S.hits_to_commits(S.keyword_hits(g.nodes, WORDS), g).groupBy("commit_id", "word").agg(F.count("*").alias("hits"))


def _near(kind: str, value: str) -> str:
    return f"SELECT DISTINCT u.b AS commit_id FROM u JOIN g m ON m.id = u.a JOIN g c ON c.id = u.b AND c.type = 'COMMIT' WHERE m.type = '{kind}' AND (contains(lower(m.id), '{value}') OR contains(lower(coalesce(m.name, '')), '{value}'))"


@query(f"WITH {_G} {_near('FILE', 'core')} INTERSECT {_near('AUTHOR', 'er')}")
def s2_strict_filters(spark, sf_dir):
    return S.filtered_commits(stored_graph(spark, sf_dir), X.parse_filters(["file:core", "Author:er"]))


@query(f"WITH {_G}, r AS (SELECT name FROM e JOIN g ON g.id = e.target_id WHERE e.type = 'PART_OF_REPO' AND g.type = 'REPOSITORY' AND name IS NOT NULL GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) SELECT DISTINCT e.source_id AS commit_id FROM e JOIN g ON g.id = e.target_id WHERE e.type = 'PART_OF_REPO' AND g.type = 'REPOSITORY' AND g.name = (SELECT name FROM r)")
def s3_repository_scope(spark, sf_dir):
    g = graph(spark, sf_dir)
    repos = g.nodes.where("type = 'REPOSITORY'").select(F.col("id").alias("target_id"), F.col("attributes")["name"].alias("name")).where("name IS NOT NULL")
    largest = g.edges.where("type = 'PART_OF_REPO'").join(repos, "target_id").groupBy("name").count().orderBy(F.desc("count"), "name").limit(1).collect()
    return S.repository_commits(g, largest[0]["name"] if largest else "")


_V = """valid AS (SELECT node_id, chunk_id, node_type, embedding::DOUBLE[] AS v FROM node_vectors WHERE len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
q AS (SELECT v FROM valid ORDER BY node_id, chunk_id LIMIT 1),
bad AS (SELECT v FROM valid ORDER BY node_id DESC, chunk_id DESC LIMIT 1),
sims AS (SELECT node_id, max(struct_pack(s := round(list_dot_product(valid.v, q.v) / (sqrt(list_dot_product(valid.v, valid.v)) * sqrt(list_dot_product(q.v, q.v))), 6), t := node_type)) AS b FROM valid, q GROUP BY node_id),
best AS (SELECT node_id, b.t AS node_type, b.s AS similarity FROM sims)"""


_SYMBOLS = "FROM valid, q WHERE node_type = 'SYMBOL' GROUP"


def _query_vector(vectors: DataFrame, last: bool = False) -> list[float]:
    """The vector of the smallest (or largest) key: the query of the examples, one row."""
    order = [F.desc("node_id"), F.desc("chunk_id")] if last else ["node_id", "chunk_id"]
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return [float(x) for x in vectors.where(F.size("embedding") == 384).where(good).orderBy(*order).select("embedding").head()[0]]


@query(f"WITH {_V} SELECT * FROM best ORDER BY similarity DESC, node_id LIMIT 20")
def v1_top_cosine(spark, sf_dir):
    v = _t(spark, sf_dir, "node_vectors")
    return V.top_similar(v, _query_vector(v), 20)


@query(f"WITH {_V.replace('FROM valid, q GROUP', _SYMBOLS)} SELECT * FROM best ORDER BY similarity DESC, node_id LIMIT 20")
def v2_top_cosine_of_type(spark, sf_dir):
    v = _t(spark, sf_dir, "node_vectors")
    return V.top_similar(v, _query_vector(v), 20, ["SYMBOL"])


@query("""WITH v AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM node_vectors WHERE len(embedding) = 384)
SELECT CAST(pos AS INTEGER) AS pos, round(avg(CASE WHEN isfinite(x) THEN x::DOUBLE END), 6) AS value FROM v GROUP BY pos""")
def v3_mean_vector(spark, sf_dir):
    rows = _t(spark, sf_dir, "node_vectors").where(F.size("embedding") == 384).select(F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)).alias("embedding"))
    return V.mean_vector(rows).select("pos", F.round("value", 6).alias("value"))


@query(f"WITH {_G} SELECT id AS node_id, 'SYMBOL' AS node_type, coalesce(name, id) AS text FROM g WHERE type = 'SYMBOL' AND trim(coalesce(name, id)) <> '' UNION ALL SELECT id, 'COMMIT_MESSAGE', message FROM g WHERE type = 'COMMIT' AND trim(message) <> '' UNION ALL SELECT target_id, 'COMMIT_SYMBOLS', string_agg(DISTINCT source_id, ' ' ORDER BY source_id) FROM e WHERE type = 'MODIFIED_SYMBOL' AND target_id IN (SELECT id FROM g WHERE type = 'COMMIT') GROUP BY target_id")
def v4_index_items(spark, sf_dir):
    g = graph(spark, sf_dir)
    return V.items(g.nodes, g.edges)


@query()
def v5_embed_symbols(spark, sf_dir):
    """Vectors of all item kinds, not of symbols only; the digest stands for the numbers of a vector."""
    g = graph(spark, sf_dir)
    return V.embed_items(V.items(g.nodes, g.edges)).select("node_id", "chunk_id", "node_type", F.size("embedding").alias("width"), F.xxhash64("embedding").alias("digest"))


_SEM = f"""{_V}, near AS (SELECT * FROM best WHERE similarity >= 0.2 ORDER BY similarity DESC, node_id LIMIT 20),
links AS (SELECT node_id AS commit_id, node_id, node_type, similarity FROM near WHERE node_type IN ('COMMIT', 'COMMIT_MESSAGE', 'COMMIT_SYMBOLS')
  UNION SELECT e.target_id, n.node_id, n.node_type, n.similarity FROM near n JOIN e ON e.source_id = n.node_id AND e.type = 'MODIFIED_SYMBOL' WHERE n.node_type = 'SYMBOL'
  UNION SELECT e.source_id, n.node_id, n.node_type, n.similarity FROM near n JOIN e ON e.target_id = n.node_id AND e.type = 'MODIFIED_FUNCTION' WHERE n.node_type = 'FUNCTION'),
sem AS (SELECT commit_id, sum(20.0::DOUBLE * similarity / i) AS score FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY similarity DESC, node_id, node_type) AS i FROM links WHERE commit_id IN (SELECT id FROM g WHERE type = 'COMMIT')) GROUP BY commit_id)"""


@query(f"WITH {_G}, {_SEM} SELECT commit_id, round(score, 6) AS score FROM sem")
def s4_semantic_scores(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    near = V.top_similar(g.embeddings, _query_vector(g.embeddings), 200).where("similarity >= 0.2").orderBy(F.desc("similarity"), "node_id").limit(20)
    return S.semantic_scores(S.vector_commits(near, g)).select("commit_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_REACHED}, minus AS (SELECT id AS commit_id FROM g WHERE type = 'COMMIT' AND {_has(AVOID)} UNION SELECT u.b FROM g JOIN u ON u.a = g.id WHERE g.type NOT IN ('COMMIT', 'KEYWORD') AND {_has(AVOID)})
SELECT commit_id AS id, round(score / greatest(1.0, coalesce(log10(files), 1.0)), 6) AS relevance FROM kw LEFT JOIN files USING (commit_id) WHERE commit_id NOT IN (SELECT commit_id FROM minus WHERE commit_id IS NOT NULL) AND score / greatest(1.0, coalesce(log10(files), 1.0)) >= 5 ORDER BY 2 DESC, 1 LIMIT 50""")
def s5_negative_words(spark, sf_dir):
    return S.search(stored_graph(spark, sf_dir), " ".join(WORDS), negative_query=AVOID, min_score=5, top_n=50).select("id", "relevance")


_FAR = """far0 AS (SELECT node_id, max(struct_pack(s := round(list_dot_product(valid.v, bad.v) / (sqrt(list_dot_product(valid.v, valid.v)) * sqrt(list_dot_product(bad.v, bad.v))), 6), t := node_type)) AS b FROM valid, bad GROUP BY node_id),
far1 AS (SELECT node_id, b.t AS node_type, b.s AS similarity FROM far0 ORDER BY b.s DESC, node_id LIMIT 200),
far2 AS (SELECT * FROM far1 WHERE similarity >= 0.2),
far3 AS (SELECT node_id AS commit_id, node_id, node_type, similarity FROM far2 WHERE node_type IN ('COMMIT', 'COMMIT_MESSAGE', 'COMMIT_SYMBOLS')
  UNION SELECT e.target_id, n.node_id, n.node_type, n.similarity FROM far2 n JOIN e ON e.source_id = n.node_id AND e.type = 'MODIFIED_SYMBOL' WHERE n.node_type = 'SYMBOL'
  UNION SELECT e.source_id, n.node_id, n.node_type, n.similarity FROM far2 n JOIN e ON e.target_id = n.node_id AND e.type = 'MODIFIED_FUNCTION' WHERE n.node_type = 'FUNCTION'),
far AS (SELECT commit_id, sum(200.0::DOUBLE * similarity) AS minus FROM far3 GROUP BY commit_id)"""


@query(f"""WITH {_REACHED}, {_SEM}, {_FAR}, total AS (SELECT commit_id, sum(score) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY commit_id),
final AS (SELECT commit_id AS id, round((score - coalesce(minus, 0)) / greatest(1.0, coalesce(log10(files), 1.0)), 6) AS relevance FROM total LEFT JOIN far USING (commit_id) LEFT JOIN files USING (commit_id))
SELECT f.id, coalesce(g.message, 'No message') AS message, coalesce(g.author_name, 'Unknown') AS author, coalesce(g.ts, 'Unknown') AS date, f.relevance FROM final f JOIN g ON g.id = f.id WHERE relevance >= 1 ORDER BY relevance DESC, f.id LIMIT 25""")
def s6_hybrid_search(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return S.search(g, " ".join(WORDS), _query_vector(g.embeddings), negative_vector=_query_vector(g.embeddings, last=True), min_score=1, top_n=25).drop("reasons")


_STARTS = "starts AS (SELECT source_id AS id FROM e WHERE type = 'MODIFIED_FILE' AND source_id IN (SELECT id FROM g WHERE type = 'COMMIT') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)"


def _starts(g: S.Graph) -> DataFrame:
    return S.file_counts(g.edges).withColumnRenamed("commit_id", "id").join(g.commits.select("id"), "id", "left_semi").orderBy(F.desc("files"), "id").limit(5).select("id")


@query(f"""WITH {_G}, {_STARTS}, l1 AS (SELECT DISTINCT s.id AS start, u.b AS id FROM starts s JOIN u ON u.a = s.id WHERE u.b <> s.id), k1 AS (SELECT l1.start, l1.id, g.type FROM l1 JOIN g ON g.id = l1.id),
l2 AS (SELECT DISTINCT k1.start, u.b AS id FROM k1 JOIN u ON u.a = k1.id WHERE k1.type NOT IN ('AUTHOR', 'TIME_BUCKET', 'REPOSITORY') AND u.b <> k1.start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = k1.start AND l1.id = u.b))
SELECT start, id, type, 1 AS distance FROM k1 UNION ALL SELECT l2.start, l2.id, g.type, 2 FROM l2 JOIN g ON g.id = l2.id""")
def t1_expand_all(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return E.expand(g, _starts(g), E.gates(g, []), depth=2, all_matches=True)


_TEXT = "lower(concat_ws(' ', name, repo, extension, message, author_name, author_email, ts))"


@query(f"""WITH {_G}, {_STARTS}, fl AS (SELECT DISTINCT a FROM u WHERE type IN ('HAS_SYMBOL', 'HAS_KEYWORD', 'MODIFIED_SYMBOL') AND contains(lower(b), 'cache')),
gate AS (SELECT id, type, CASE type WHEN 'KEYWORD' THEN contains(lower(id), 'cache') OR contains(lower(coalesce(name, '')), 'cache') WHEN 'SYMBOL' THEN false WHEN 'FILE' THEN id IN (SELECT a FROM fl) WHEN 'COMMIT' THEN contains({_TEXT}, 'cache') WHEN 'FUNCTION' THEN contains({_TEXT}, 'cache') ELSE true END AS ok FROM g),
l1 AS (SELECT DISTINCT s.id AS start, u.b AS id FROM starts s JOIN u ON u.a = s.id WHERE u.b <> s.id), k1 AS (SELECT l1.start, l1.id, gate.type FROM l1 JOIN gate ON gate.id = l1.id WHERE ok),
l2 AS (SELECT DISTINCT k1.start, u.b AS id FROM k1 JOIN u ON u.a = k1.id WHERE k1.type NOT IN ('AUTHOR', 'TIME_BUCKET', 'REPOSITORY') AND u.b <> k1.start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = k1.start AND l1.id = u.b))
SELECT start, id, type, 1 AS distance FROM k1 UNION ALL SELECT l2.start, l2.id, gate.type, 2 FROM l2 JOIN gate ON gate.id = l2.id WHERE ok""")
def t2_expand_gated(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return E.expand(g, _starts(g), E.gates(g, ["cache"]), depth=2)


_NAME = "coalesce(nullif(m.name, ''), CASE m.type WHEN 'FILE' THEN list_extract(string_split(m.id, '/'), -1) WHEN 'COMMIT' THEN coalesce(nullif(trim(string_split(m.message, chr(10))[1]), ''), substr(m.id, 1, 8)) END, m.id)"


@query(f"""WITH {_G}, w AS (SELECT id FROM g WHERE type = 'FUNCTION'), d AS (SELECT source_id AS id, 'out' AS direction, type AS edge_type, target_id AS other_id FROM e WHERE type NOT IN ('CONTAINS_COMMENT', 'HAS_KEYWORD') UNION SELECT target_id, 'in', type, source_id FROM e WHERE type NOT IN ('CONTAINS_COMMENT', 'HAS_KEYWORD'))
SELECT d.id, direction, edge_type, other_id, m.type AS other_type, {_NAME} AS name FROM d JOIN w ON w.id = d.id JOIN g m ON m.id = d.other_id""")
def d1_dependencies(spark, sf_dir):
    g = graph(spark, sf_dir)
    return L.neighbours(g, g.nodes.where("type = 'FUNCTION'"))


@query(f"""WITH {_G}, d AS (SELECT source_id AS id, 'out' AS direction, type AS edge_type, target_id AS other_id FROM e WHERE type NOT IN ('CONTAINS_COMMENT', 'HAS_KEYWORD') UNION SELECT target_id, 'in', type, source_id FROM e WHERE type NOT IN ('CONTAINS_COMMENT', 'HAS_KEYWORD'))
SELECT d.id, direction, edge_type, other_id, m.type AS other_type, {_NAME} AS name FROM d JOIN (SELECT DISTINCT id FROM g) w ON w.id = d.id JOIN g m ON m.id = d.other_id""")
def d1_all_dependencies(spark, sf_dir):
    """The dependencies of all present nodes, whatever their type."""
    g = graph(spark, sf_dir)
    return L.neighbours(g, g.nodes)


@query(f"WITH {_G} SELECT id, type, (ends_with(id, '/cache') OR ends_with(id, '.cache')) AS suffix FROM g WHERE type IN ('FILE', 'FUNCTION', 'SYMBOL', 'COMMIT') AND contains(lower(id), 'cache')")
def d2_fuzzy_candidates(spark, sf_dir):
    return L.candidates(graph(spark, sf_dir).nodes, "cache").withColumn("suffix", F.col("id").endswith("/cache") | F.col("id").endswith(".cache"))


@query(f"WITH {_G} SELECT DISTINCT type FROM g WHERE type IS NOT NULL")
def a9_node_types(spark, sf_dir):
    return L.types(graph(spark, sf_dir).nodes)


@query("SELECT DISTINCT type FROM edges WHERE type IS NOT NULL")
def a9_edge_types(spark, sf_dir):
    return L.types(_t(spark, sf_dir, "edges"))


@query(f"WITH {_G} SELECT source_id AS commit_id, count(*) AS files FROM e WHERE type = 'MODIFIED_FILE' GROUP BY 1")
def a2_files_per_commit(spark, sf_dir):
    return S.file_counts(graph(spark, sf_dir).edges)


def _function_versions(spark, sf_dir) -> DataFrame:
    """Function texts as the tables allow: each commit that modified a function, with the commit's message as content."""
    c = B.present_commits(_t(spark, sf_dir, "commits")).select(F.col("id").alias("commit_id"), "seq", F.col("repo").alias("file_path"), F.col("message").alias("content"))
    touched = _t(spark, sf_dir, "edges").where("type = 'MODIFIED_FUNCTION'").select(F.col("source_id").alias("commit_id"), F.col("target_id").alias("function")).distinct()
    return touched.join(c, "commit_id").select("function", "seq", "commit_id", "file_path", "content")


@query()
def h1_matched_versions(spark, sf_dir):
    return match_versions(_function_versions(spark, sf_dir)).drop("content")


@query(f"WITH {_G}, v AS (SELECT DISTINCT e.target_id AS function, e.source_id AS commit_id, x.repo AS file_path FROM e JOIN (SELECT id, c.repo AS repo FROM c0) x ON x.id = e.source_id WHERE e.type = 'MODIFIED_FUNCTION' AND e.target_id IS NOT NULL) SELECT function, count(*) AS versions, count(DISTINCT commit_id) AS commits FROM v GROUP BY function")
def h1_versions_per_function(spark, sf_dir):
    return match_versions(_function_versions(spark, sf_dir)).groupBy("function").agg(F.count("*").alias("versions"), F.countDistinct("commit_id").alias("commits"))


@query()
def h2_version_order(spark, sf_dir):
    _, edges = version_graph(match_versions(_function_versions(spark, sf_dir)))
    return ordered_versions(merge_edges(edges))


@query("""WITH p AS (SELECT x.doc_id, x.text AS a, y.text AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id - 1)
SELECT doc_id, round(CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * list_sum(list_transform(list_distinct(list_filter(string_split(a, ''), lambda c: c <> '')), lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))) / (length(a) + length(b)) END, 6) AS ratio FROM p WHERE length(a) > 0 AND length(b) > 0""")
def h3_history_similarity(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    before = docs.select((F.col("doc_id") + 1).alias("next_id"), F.col("text").alias("b"))
    pairs = docs.select("doc_id", F.col("text").alias("a")).join(before, F.col("doc_id") == F.col("next_id")).where("length(a) > 0 AND length(b) > 0")
    return pairs.select("doc_id", F.round(quick_ratio_column(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '#(\\d+)', 1))) AS ref FROM documents WHERE text IS NOT NULL")
def x1_references(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(X.numbers(F.col("text"))).alias("ref"))


@query("SELECT doc_id, unnest(list_distinct(regexp_extract_all(concat('v = os.getenv(\"KEY_', doc_id, '\") ', text), '(?:os\\.getenv|getenv)\\(\\s*[\"'']([A-Za-z_][A-Za-z0-9_]*)[\"'']', 1))) AS variable FROM documents WHERE text IS NOT NULL")
def x1_secrets(spark, sf_dir):
    text = F.concat(F.lit('v = os.getenv("KEY_'), "doc_id", F.lit('") '), "text")
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.secrets(text)).alias("variable"))


@query("SELECT doc_id, sha256(regexp_replace(concat('https://t', doc_id, '@github.com/x.git ', text), '(?:https?://|x-ac{1,2}ess-token:)[^@/ ]*@github\\.com', 'x-access-token:*@github.com', 'gi')) AS h FROM documents WHERE text IS NOT NULL")
def x2_sanitised(spark, sf_dir):
    text = F.concat(F.lit("https://t"), "doc_id", F.lit("@github.com/x.git "), "text")
    return _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(sanitize(text), 256).alias("h"))


@query(f"WITH {_G} SELECT id, array_to_string({_TOKENS.format('coalesce(name, id)')}, ' ') AS tokens FROM g WHERE type IN ('SYMBOL', 'FUNCTION')")
def x3_code_tokens(spark, sf_dir):
    rows = graph(spark, sf_dir).nodes.where(F.col("type").isin("SYMBOL", "FUNCTION"))
    return rows.select("id", F.concat_ws(" ", X.keywords(F.coalesce(F.col("attributes")["name"], F.col("id")), X.DOMAIN_STOP_WORDS, True, False)).alias("tokens"))


@query(f"WITH {_G}, f AS (SELECT id, list_extract(string_split(id, '/'), -1) AS name FROM g WHERE type = 'FILE'), x AS (SELECT id, name, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS extension FROM f) SELECT id, name, extension, CASE lower(extension) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.LANGUAGES.items()) + " END AS language FROM x")
def x4_paths(spark, sf_dir):
    rows = graph(spark, sf_dir).nodes.where("type = 'FILE'")
    return rows.select("id", X.base_name(F.col("id")).alias("name"), X.extension(F.col("id")).alias("extension"), X.language_of(X.extension(F.col("id"))).alias("language"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def j1_json_projection(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def w1_daily_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.date_format(F.window(F.col("ts").cast("timestamp"), "1 day").start, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {_G} SELECT c.id AS commit_id FROM c0 JOIN (SELECT id, c FROM c0) c USING (id) WHERE NOT regexp_matches(lower(coalesce(c.c.author_name, '')), '\\[bot\\]|dependabot|greenkeeper') AND c.id NOT IN (SELECT id FROM g WHERE type = 'COMMIT')")
def i1_unseen_commits(spark, sf_dir):
    commits = B.without_bots(B.present_commits(_t(spark, sf_dir, "commits")))
    return B.unseen(commits, graph(spark, sf_dir).nodes).select(F.col("id").alias("commit_id"))
