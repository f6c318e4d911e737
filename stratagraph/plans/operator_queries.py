"""Queries of the operators that need texts, patches, sources, stores or options of their own, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.functions.patch import parse_patch
from stratagraph.functions.syntax import analyse_changes, parse, trees
from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.model.store import Catalog
from stratagraph.operators import build as B
from stratagraph.operators import enrich as P
from stratagraph.operators import expand as E
from stratagraph.operators import lookup as L
from stratagraph.operators import search as S
from stratagraph.operators import vectors as V
from stratagraph.operators.amend import replayed
from stratagraph.operators.changefeed import normalise_changes
from stratagraph.operators.ingest import added_text, graph_of
from stratagraph.operators.versions import history_text, match_versions, open_histories, ordered_versions, version_graph
from stratagraph.plans import samples
from stratagraph.plans.graph_queries import _FAR, _G, _REACHED, _SEM, _STARTS, _TEXT, _V, AVOID, WORDS, _has, _near, _query_vector, _starts, _t, graph, stored_graph
from stratagraph.session import Scratch, shared_dir
from stratagraph.sources.gitsource import blobs, changes, history

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(*rows: tuple) -> str:
    """Rows as a VALUES list."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


# ---- search options ------------------------------------------------------------------------------------

_PENALTY = "greatest(1.0, coalesce(log10(files), 1.0))"
_FILES = "files AS (SELECT source_id AS commit_id, count(*) AS files FROM e WHERE type = 'MODIFIED_FILE' GROUP BY 1)"


@query(f"WITH {_G}, {_FILES}, ok AS ({_near('FILE', 'core')} INTERSECT {_near('AUTHOR', 'er')}) SELECT commit_id AS id, round(5.0::DOUBLE / {_PENALTY}, 6) AS relevance FROM ok LEFT JOIN files USING (commit_id) ORDER BY 2 DESC, 1 LIMIT 40")
def s7_filters_alone(spark, sf_dir):
    return S.search(stored_graph(spark, sf_dir), filters={"FILE": "core", "AUTHOR": "er"}, min_score=0, top_n=40).select("id", "relevance")


@query(f"WITH {_REACHED} SELECT DISTINCT commit_id, concat('word ', word, ' found in ', type, ' ', node_id) AS reason FROM reached")
def s8_reasons(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return S.keyword_scores(S.hits_to_commits(S.keyword_hits(g.nodes, WORDS), g)).select("commit_id", F.explode("reasons").alias("reason"))


@query(f"WITH {_REACHED} SELECT commit_id AS id, round(score / {_PENALTY}, 6) AS relevance FROM kw LEFT JOIN files USING (commit_id) WHERE round(score / {_PENALTY}, 6) >= 5 AND NOT starts_with(commit_id, '0') AND NOT starts_with(commit_id, 'ab') ORDER BY 2 DESC, 1 LIMIT 50")
def s9_excluded_commits(spark, sf_dir):
    return S.search(stored_graph(spark, sf_dir), " ".join(WORDS), min_score=5, top_n=50, excluded_commits=["0", "ab"]).select("id", "relevance")


@query(f"WITH {_G}, {_FILES}, {_SEM} SELECT commit_id AS id, round(score / {_PENALTY}, 6) AS relevance FROM sem LEFT JOIN files USING (commit_id) WHERE round(score / {_PENALTY}, 6) >= 0 ORDER BY 2 DESC, 1 LIMIT 30")
def s10_meaning_alone(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return S.search(g, " ".join(WORDS), _query_vector(g.embeddings), semantic_only=True, min_score=0, top_n=30).select("id", "relevance")


@query(f"WITH {_REACHED} SELECT DISTINCT commit_id AS start, node_id AS id FROM reached WHERE type <> 'COMMIT'")
def s11_triggers(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return S.triggers(S.hits_to_commits(S.keyword_hits(g.nodes, WORDS), g))


@query(f"WITH {_G} SELECT g.id AS node_id FROM g WHERE " + " OR ".join(f"lower({c}) LIKE '%ca_he%r%'" for c in ("g.id", "name", "message", "author_name", "author_email")))
def s12_wildcards(spark, sf_dir):
    return S.keyword_hits(graph(spark, sf_dir).nodes, ["ca_he%r"], wildcards=True).select("node_id")


@query(f"WITH {_G}, {_V}, {_FAR} SELECT commit_id, round(minus, 6) AS minus FROM far WHERE commit_id IN (SELECT id FROM g WHERE type = 'COMMIT')")
def s13_avoided_meaning(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    far = S.vector_commits(V.top_similar(g.embeddings, _query_vector(g.embeddings, last=True), V.CANDIDATES).where(F.col("similarity") >= V.FLOOR), g)
    return far.groupBy("commit_id").agg(F.round(F.sum(S.AVOID_BASE * F.col("similarity")), 6).alias("minus"))


# ---- expansion options ---------------------------------------------------------------------------------

_STEP1 = "l1 AS (SELECT DISTINCT s.id AS start, u.b AS id FROM starts s JOIN u ON u.a = s.id WHERE u.b <> s.id)"


@query(f"""WITH {_G}, {_STARTS}, {_STEP1}, k1 AS (SELECT l1.start, l1.id, g.type FROM l1 JOIN g ON g.id = l1.id WHERE g.type NOT IN ('KEYWORD', 'TIME_BUCKET')),
l2 AS (SELECT DISTINCT k1.start, u.b AS id FROM k1 JOIN u ON u.a = k1.id WHERE k1.type IN ('COMMIT', 'FILE') AND u.b <> k1.start AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.start = k1.start AND l1.id = u.b))
SELECT start, id, type, 1 AS distance FROM k1 UNION ALL SELECT l2.start, l2.id, g.type, 2 FROM l2 JOIN g ON g.id = l2.id WHERE g.type NOT IN ('KEYWORD', 'TIME_BUCKET')""")
def t3_expand_types(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    return E.expand(g, _starts(g), E.gates(g, []), 2, traverse_types=["Files", "AST_NODE"], exclude_types=["keywords", "time bucket"], all_matches=True)


@query(f"""WITH {_G}, {_STARTS}, {_STEP1}, {_V}, {_FAR}
SELECT l1.start, l1.id, g.type, 1 AS distance FROM l1 JOIN g ON g.id = l1.id WHERE NOT contains(lower(concat_ws(' ', g.id, {_TEXT})), '{AVOID}') AND l1.id NOT IN (SELECT node_id FROM far2)""")
def t4_expand_avoided(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    far = V.top_similar(g.embeddings, _query_vector(g.embeddings, last=True), V.CANDIDATES).where(F.col("similarity") >= V.FLOOR)
    return E.expand(g, _starts(g), E.gates(g, [], [AVOID], negative_semantic=far), 1, all_matches=True)


_SEMSET = "semset AS (SELECT node_id FROM (SELECT * FROM best ORDER BY similarity DESC, node_id LIMIT 200) WHERE similarity >= 0.2)"


@query(f"""WITH {_G}, {_STARTS}, {_STEP1}, {_V}, {_SEMSET}, fl AS (SELECT DISTINCT a FROM u WHERE type IN ('HAS_SYMBOL', 'HAS_KEYWORD', 'MODIFIED_SYMBOL') AND b IN (SELECT node_id FROM semset))
SELECT l1.start, l1.id, g.type, 1 AS distance FROM l1 JOIN g ON g.id = l1.id WHERE l1.id IN (SELECT node_id FROM semset) OR CASE g.type WHEN 'KEYWORD' THEN false WHEN 'SYMBOL' THEN false WHEN 'FILE' THEN l1.id IN (SELECT a FROM fl) WHEN 'COMMIT' THEN false WHEN 'FUNCTION' THEN false ELSE true END""")
def t5_expand_by_meaning(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    near = V.top_similar(g.embeddings, _query_vector(g.embeddings), V.CANDIDATES).where(F.col("similarity") >= V.FLOOR)
    return E.expand(g, _starts(g), E.gates(g, [], semantic=near), 1)


@query(f"""WITH {_G}, {_STARTS}, {_STEP1}, k1 AS (SELECT l1.start AS id, g.type, l1.id AS other, row_number() OVER (PARTITION BY l1.start, g.type ORDER BY l1.id) AS i FROM l1 JOIN g ON g.id = l1.id)
SELECT id, type, string_agg(CASE WHEN type <> 'KEYWORD' OR i <= 5 THEN other END, ',' ORDER BY other) AS shown, count(*) FILTER (type = 'KEYWORD' AND i > 5) AS more FROM k1 GROUP BY ALL""")
def k1_connections(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    found = E.expand(g, _starts(g), E.gates(g, []), 1, all_matches=True)
    return L.grouped(found.select(F.col("start").alias("id"), "type", F.col("id").alias("other")), {"KEYWORD": 5}).select("id", "type", F.concat_ws(",", "shown").alias("shown"), "more")


@query(f"""WITH {_G}, {_STARTS}, around AS (SELECT DISTINCT u.b AS id FROM u JOIN starts s ON s.id = u.a)
SELECT 'node' AS kind, count(*) AS n FROM g WHERE id IN (SELECT id FROM around) UNION ALL SELECT 'edge', count(*) FROM e WHERE source_id IN (SELECT id FROM starts) OR target_id IN (SELECT id FROM starts)""")
def j1_context(spark, sf_dir):
    g = stored_graph(spark, sf_dir)
    nodes, edges = P.context(g, _starts(g))
    return nodes.select(F.lit("node").alias("kind")).unionByName(edges.select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


# ---- identifiers ---------------------------------------------------------------------------------------

_ASKED = ["cache", "README.md", "zzz-nothing", "core"]
_LIKE = "contains(lower(g.id), lower(a.text))"


@query(f"""WITH {_G}, a AS (SELECT unnest({_ASKED!r}) AS text UNION ALL SELECT min(id) FROM g WHERE type = 'FILE' UNION ALL SELECT substr(max(id), 2) FROM g WHERE type = 'SYMBOL'),
m AS (SELECT DISTINCT a.text, g.id FROM a JOIN g ON g.type IN ('FILE', 'FUNCTION', 'SYMBOL', 'COMMIT') AND {_LIKE}),
s AS (SELECT text, min(id) AS one, count(*) AS n FROM m GROUP BY text), x AS (SELECT text, min(id) AS one, count(*) AS n FROM m WHERE ends_with(id, '/' || text) OR ends_with(id, '.' || text) GROUP BY text),
o AS (SELECT text, string_agg(id, ',' ORDER BY id) AS options FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS i FROM m) WHERE i <= 5 GROUP BY text)
SELECT a.text, CASE WHEN a.text IN (SELECT id FROM g) THEN a.text WHEN s.n = 1 THEN s.one WHEN x.n = 1 THEN x.one END AS found, CASE WHEN a.text IN (SELECT id FROM g) OR s.n = 1 OR x.n = 1 THEN '' ELSE coalesce(options, '') END AS options
FROM a LEFT JOIN s USING (text) LEFT JOIN x USING (text) LEFT JOIN o USING (text)""")
def d3_resolved_ids(spark, sf_dir):
    nodes, rows = stored_graph(spark, sf_dir).nodes, []
    first = nodes.agg(F.min(F.when(F.col("type") == "FILE", F.col("id"))).alias("a"), F.max(F.when(F.col("type") == "SYMBOL", F.col("id"))).alias("z")).head()
    for text in [*_ASKED, first["a"], first["z"][1:]]:
        try:
            rows.append((text, L.resolve(nodes, text), ""))
        except L.Ambiguous as e:
            rows.append((text, None, ",".join(e.options)))
    return spark.createDataFrame(rows, "text string, found string, options string")


@query(f"""WITH {_G}, a AS (SELECT unnest({_ASKED!r}) AS text UNION ALL SELECT max(id) FROM g WHERE type = 'FUNCTION'),
m AS (SELECT DISTINCT a.text, g.id, g.type FROM a JOIN g ON g.type IN ('FILE', 'FUNCTION', 'FUNCTION_VERSION') AND {_LIKE}),
x AS (SELECT text, min(id) AS id, min(type) AS type FROM m WHERE id = text GROUP BY text),
f AS (SELECT text, min(id) AS id, 'FILE' AS type, count(*) AS n FROM m WHERE type = 'FILE' GROUP BY text),
t AS (SELECT text, min(id) AS id, min(type) AS type, count(*) AS n FROM m WHERE list_extract(string_split(id, '/'), -1) = text GROUP BY text),
o AS (SELECT text, min(id) AS id, min(type) AS type, count(*) AS n FROM m GROUP BY text)
SELECT a.text, CASE WHEN x.id IS NOT NULL THEN x.id WHEN f.n = 1 THEN f.id WHEN t.n = 1 THEN t.id WHEN o.n = 1 THEN o.id END AS found, CASE WHEN x.id IS NOT NULL THEN x.type WHEN f.n = 1 THEN f.type WHEN t.n = 1 THEN t.type WHEN o.n = 1 THEN o.type END AS type
FROM a LEFT JOIN x USING (text) LEFT JOIN f USING (text) LEFT JOIN t USING (text) LEFT JOIN o USING (text)""")
def d4_resolved_for_trees(spark, sf_dir):
    nodes, rows = stored_graph(spark, sf_dir).nodes, []
    for text in [*_ASKED, nodes.where("type = 'FUNCTION'").agg(F.max("id")).head()[0]]:
        try:
            rows.append((text, *L.resolve_for_tree(nodes, text)))
        except L.Ambiguous:
            rows.append((text, None, None))
    return spark.createDataFrame(rows, "text string, found string, type string")


# ---- stores and merges ---------------------------------------------------------------------------------

def _catalog(spark) -> Catalog:
    return Catalog(spark, Scratch(spark, "catalog").path("graph"))


@query("""SELECT type, count(DISTINCT id) AS n, CAST(sum(one) AS BIGINT) AS read_again FROM (SELECT type, id, CASE WHEN row_number() OVER (PARTITION BY type, id) = 1 THEN 1 ELSE 0 END AS one FROM nodes WHERE id IS NOT NULL) GROUP BY type""")
def k2_catalog_nodes(spark, sf_dir):
    """Nodes appended in two parts, compacted, counted, and read type by type."""
    rows = _t(spark, sf_dir, "nodes").select("id", "type", F.from_json("attributes", "map<string,string>").alias("attributes"), F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)).alias("seq"))
    c = _catalog(spark)
    early = F.pmod(F.xxhash64("id", "seq"), F.lit(2)) == 0
    c.append(rows.where(early))
    c.compact()
    c.append(rows.where(~early))
    counted = c.nodes().groupBy("type").agg(F.count("*").alias("n"))
    c.compact()
    again = c.of_type("FILE").unionByName(c.nodes().where("type != 'FILE'")).groupBy("type").agg(F.count("*").alias("read_again"))
    return counted.join(again, "type")


@query("SELECT type, count(*) AS n, sum(w) AS weight FROM (SELECT source_id, target_id, type, max(coalesce(weight, 1.0)) AS w FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL) GROUP BY type")
def k3_catalog_edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "edges").where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id", "type", "weight", F.from_json("attributes", "map<string,string>").alias("attributes"), F.lit(0).cast("bigint").alias("seq"))
    c = _catalog(spark)
    c.append(edges=rows)
    c.compact()
    c.append(edges=rows.where("weight > 1"))
    return c.edges().groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("""WITH new AS (SELECT DISTINCT node_id, node_type FROM node_vectors WHERE chunk_id = 0 AND node_type = 'SYMBOL'), kept AS (SELECT v.* FROM node_vectors v LEFT JOIN new USING (node_id, node_type) WHERE new.node_id IS NULL)
SELECT node_type, 'old' AS came, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT node_type, 'new', count(*) FROM new GROUP BY ALL""")
def k4_upserted_vectors(spark, sf_dir):
    c, stored = _catalog(spark), _t(spark, sf_dir, "node_vectors").select("node_id", "chunk_id", "node_type", "embedding")
    c.put_embeddings(stored)
    c.put_embeddings(stored.where("chunk_id = 0 AND node_type = 'SYMBOL'").select("node_id", F.lit(99).alias("chunk_id"), "node_type", F.array(F.lit(1.0).cast("float")).alias("embedding")).distinct())
    return c.embeddings().groupBy("node_type", F.when(F.col("chunk_id") == 99, "new").otherwise("old").alias("came")).agg(F.count("*").alias("n"))


_AMENDED = f"""{_G},
p0 AS (SELECT *, lower(regexp_replace(trim(action), '[^A-Za-z]+', '_', 'g')) AS act, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload ->> '$') THEN payload ->> '$' END ELSE payload END END AS doc,
  CAST(round(CASE WHEN abs(timestamp) < 1e11 THEN timestamp * 1e6 WHEN abs(timestamp) < 1e14 THEN timestamp * 1e3 WHEN abs(timestamp) < 1e17 THEN timestamp ELSE timestamp / 1e3 END) AS BIGINT) AS tm FROM amendments),
p1 AS (SELECT DISTINCT ON (id) id, tm, act, entity_type AS type, CASE WHEN act LIKE '%node' THEN coalesce(doc ->> '$.id', doc ->> '$.data.id') END AS nid, CASE WHEN act LIKE '%edge' THEN coalesce(doc ->> '$.source_id', doc ->> '$.data.source_id') END AS sid, CASE WHEN act LIKE '%edge' THEN coalesce(doc ->> '$.target_id', doc ->> '$.data.target_id') END AS tid,
  coalesce(doc -> '$.attributes', doc -> '$.data.attributes') AS attrs FROM p0 WHERE id NOT IN (SELECT id FROM amendments WHERE reverted = 1)),
c1 AS (SELECT *, row_number() OVER (ORDER BY tm, id DESC) AS o FROM p1 WHERE nid IS NOT NULL OR (sid IS NOT NULL AND tid IS NOT NULL)),
nd AS (SELECT type, nid, max(o) AS o FROM c1 WHERE act = 'delete_node' GROUP BY ALL), dead AS (SELECT nid, max(o) AS o FROM nd GROUP BY nid), ed AS (SELECT type, sid, tid, max(o) AS o FROM c1 WHERE act = 'delete_edge' GROUP BY ALL),
nadd AS (SELECT c1.* FROM c1 LEFT JOIN nd USING (type, nid) WHERE c1.nid IS NOT NULL AND act NOT LIKE 'delete%' AND (nd.o IS NULL OR c1.o > nd.o)),
eadd AS (SELECT c1.* FROM c1 LEFT JOIN ed USING (type, sid, tid) LEFT JOIN dead a ON a.nid = c1.sid LEFT JOIN dead z ON z.nid = c1.tid WHERE c1.sid IS NOT NULL AND act NOT LIKE 'delete%' AND c1.o > greatest(coalesce(ed.o, 0), coalesce(a.o, 0), coalesce(z.o, 0)))"""


def _amended(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes = B.present(_t(spark, sf_dir, "nodes"))
    edges = _t(spark, sf_dir, "edges").where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id", "type", "weight", F.from_json("attributes", "map<string,string>").alias("attributes"))
    return replayed(nodes, edges, normalise_changes(_t(spark, sf_dir, "amendments")))


@query(f"WITH {_AMENDED} SELECT type, id FROM (SELECT type, id FROM g WHERE (type, id) NOT IN (SELECT (type, nid) FROM nd) UNION SELECT type, nid FROM nadd)")
def r1_amended_nodes(spark, sf_dir):
    return _amended(spark, sf_dir)[0].select("type", "id")


@query(f"""WITH {_AMENDED} SELECT type, source_id, target_id FROM (
  SELECT DISTINCT type, source_id, target_id FROM e WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id NOT IN (SELECT nid FROM dead) AND target_id NOT IN (SELECT nid FROM dead) AND NOT EXISTS (SELECT 1 FROM ed WHERE ed.type = e.type AND ed.sid = e.source_id AND ed.tid = e.target_id)
  UNION SELECT type, sid, tid FROM eadd)""")
def r2_amended_edges(spark, sf_dir):
    return _amended(spark, sf_dir)[1].select("type", "source_id", "target_id")


@query(f"""WITH {_AMENDED}, kv AS (SELECT type, nid AS id, o, unnest(json_keys(attrs)) AS k, attrs FROM nadd WHERE json_type(attrs) = 'OBJECT'), w AS (SELECT type, id, k, arg_max(struct_pack(v := json_extract_string(attrs, concat('$."', k, '"'))), o).v AS v FROM kv GROUP BY ALL)
SELECT type, id, k, v FROM w WHERE v IS NOT NULL""")
def r3_amended_attributes(spark, sf_dir):
    """The attributes that the feed gave to nodes which the graph does not hold otherwise, or which it deleted before."""
    feed = normalise_changes(_t(spark, sf_dir, "amendments"))
    none = B.present(_t(spark, sf_dir, "nodes")).where("false")
    edges = spark.createDataFrame([], "source_id string, target_id string, type string, weight double, attributes map<string,string>")
    return replayed(none, edges, feed)[0].select("type", "id", F.explode("attributes").alias("k", "v"))


# ---- function histories --------------------------------------------------------------------------------

_RATIO = "CASE WHEN length(a.content) + length(b.content) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(list_filter(string_split(a.content, ''), lambda c: c <> '')), lambda c: least(length(a.content) - length(replace(a.content, c, '')), length(b.content) - length(replace(b.content, c, ''))))), 0) / (length(a.content) + length(b.content)) END"
_HISTORIES = f"""d AS (SELECT doc_id, concat('fn', doc_id // 2) AS fn, sha256(CAST(doc_id AS VARCHAR)) AS commit_id, coalesce(source, '') AS file, coalesce(text, '') AS content FROM documents),
s AS (SELECT b.doc_id, b.fn, b.commit_id, b.file, b.content, a.doc_id AS before, a.commit_id AS a_commit, a.file AS a_file, a.content AS a_content, CASE WHEN a.doc_id IS NOT NULL THEN {_RATIO} + CASE WHEN a.file = b.file THEN 1.0 ELSE 0.0 END END AS score FROM d b LEFT JOIN d a ON a.fn = b.fn AND a.doc_id < b.doc_id),
h AS (SELECT *, before IS NOT NULL AND (a_file = file OR score > 0.6) AS same FROM s),
v AS (SELECT doc_id, fn, commit_id, content, same, score, concat('HISTORY:', fn, ':', substr(sha256(CASE WHEN same THEN concat(fn, chr(31), a_commit, chr(31), a_file) ELSE concat(fn, chr(31), commit_id, chr(31), file) END), 1, 8)) AS history_id, a_commit, a_content FROM h),
r AS (SELECT *, concat('VERSION:', history_id, ':', commit_id, ':', substr(sha256(content), 1, 8)) AS version_id, CASE WHEN same THEN concat('VERSION:', history_id, ':', a_commit, ':', substr(sha256(a_content), 1, 8)) END AS previous_id FROM v)"""


def _text_versions(spark, sf_dir) -> DataFrame:
    """Documents as versions of functions, two to a function."""
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("fn"), F.floor(F.col("doc_id") / 2)).alias("function"), F.col("doc_id").alias("seq"), F.sha2(F.col("doc_id").cast("string"), 256).alias("commit_id"), F.col("source").alias("file_path"), F.col("text").alias("content"))


@query(f"WITH {_HISTORIES} SELECT doc_id AS seq, fn AS function, history_id, version_id, previous_id, CASE WHEN same THEN round(score, 6) END AS score FROM r")
def h4_text_histories(spark, sf_dir):
    return match_versions(_text_versions(spark, sf_dir)).select("seq", "function", "history_id", "version_id", "previous_id", F.round("score", 6).alias("score"))


@query(f"WITH {_HISTORIES} SELECT doc_id AS seq, history_id, previous_id FROM r WHERE doc_id % 2 = 1")
def h5_continued_histories(spark, sf_dir):
    """The second versions of all functions, matched with histories that were stored before."""
    rows = _text_versions(spark, sf_dir)
    nodes, edges = version_graph(Scratch(spark, "histories").write(match_versions(rows.where("seq % 2 = 0"))))
    return match_versions(rows.where("seq % 2 = 1"), open_histories(merge_nodes(nodes), merge_edges(edges))).select("seq", "history_id", "previous_id")


@query(f"WITH {_HISTORIES} SELECT history_id, version_id, CASE WHEN same THEN 2 ELSE 1 END AS place, sha256(concat('V', CASE WHEN same THEN 2 ELSE 1 END, ' (', substr(commit_id, 1, 8), '): ', CASE WHEN doc_id % 2 = 0 THEN concat('made ', doc_id) ELSE 'Unknown' END, chr(10), content)) AS digest FROM r")
def h6_history_texts(spark, sf_dir):
    rows = _text_versions(spark, sf_dir)
    nodes, edges = version_graph(Scratch(spark, "histories").write(match_versions(rows)))
    known = B.node(rows.where("seq % 2 = 0"), "COMMIT", F.col("commit_id"), F.col("seq"), message=F.concat(F.lit("made "), "seq"))
    nodes, edges = Scratch(spark, "histories").write(merge_nodes(nodes.unionByName(known))), Scratch(spark, "histories").write(merge_edges(edges))
    placed = ordered_versions(edges)
    return placed.join(history_text(nodes, edges), ["history_id", "place"]).select("history_id", "version_id", "place", F.sha2("text", 256).alias("digest"))


@query(f"WITH {_HISTORIES} SELECT fn AS function_id, version_id FROM r WHERE version_id NOT IN (SELECT previous_id FROM r WHERE previous_id IS NOT NULL)")
def h7_latest_versions(spark, sf_dir):
    nodes, edges = version_graph(Scratch(spark, "histories").write(match_versions(_text_versions(spark, sf_dir))))
    return V.latest_versions(merge_nodes(nodes), merge_edges(edges)).select("function_id", "version_id")


# ---- texts, patches and sources ------------------------------------------------------------------------

@query("SELECT doc_id, len(l) AS lines, CAST(7 AS BIGINT) AS first, CAST(6 + len(l) AS BIGINT) AS last, sha256(array_to_string(l, chr(10))) AS added FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def x5_patch_lines(spark, sf_dir):
    """Every document as an added block of lines, read back from its patch."""
    lines = F.split("text", "\n", -1)
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("@@ -0,0 +7,"), F.size(lines).cast("string"), F.lit(" @@\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n")).alias("patch"))

    @F.udf("struct<lines:bigint,first:bigint,last:bigint>", useArrow=True)
    def touched(patch):
        at = parse_patch(patch)[0]
        return len(at), at[0], at[-1]

    return rows.select("doc_id", touched("patch").alias("t"), F.sha2(added_text(F.col("patch")), 256).alias("added")).select("doc_id", "t.*", "added")


@query(f"SELECT CAST(i AS BIGINT) AS i, lines, added FROM {_values(*[(i, ','.join(map(str, at)), added) for i, (_, at, added) in enumerate(samples.PATCHES)])} AS t(i, lines, added)")
def x6_patch_cases(spark, sf_dir):
    rows = spark.createDataFrame([(i, p, ",".join(map(str, parse_patch(p)[0]))) for i, (p, _, _) in enumerate(samples.PATCHES)], "i bigint, patch string, lines string")
    return rows.select("i", "lines", added_text(F.col("patch")).alias("added"))


def _sources(spark) -> DataFrame:
    """One source of every language, with a patch of all its lines."""
    rows = [("c", 0, f"f.{lang}", lang, text, f"@@ -0,0 +1,{text.count(chr(10)) + 1} @@\n" + "".join(f"+{x}\n" for x in text.split("\n"))) for lang, (text, *_) in samples.SOURCES.items()]
    return spark.createDataFrame(rows, "commit_id string, seq bigint, path string, language string, content string, patch string")


def _expected(part: int) -> str:
    rows = [(lang, x) for lang, row in samples.SOURCES.items() for x in row[part]]
    return f"SELECT 'f.' || t.language AS path, t.name FROM {_values(*rows)} AS t(language, name)"


@query(_expected(1))
def x7_definitions(spark, sf_dir):
    return analyse_changes(_sources(spark)).select("path", F.explode("definitions").alias("name"))


@query(_expected(2))
def x8_touched_functions(spark, sf_dir):
    return analyse_changes(_sources(spark)).select("path", F.explode("functions.name").alias("name"))


@query(_expected(3))
def x9_touched_comments(spark, sf_dir):
    return analyse_changes(_sources(spark)).select("path", F.explode("comments.text").alias("name"))


@query(f"SELECT language, alias, name FROM {_values(*samples.IMPORTS)} AS t(language, alias, name)")
def x10_imports(spark, sf_dir):
    return spark.createDataFrame([(lang, a, n) for lang, (text, *_) in samples.SOURCES.items() for a, n in parse(text, lang).imports.items()], "language string, alias string, name string")


@query(f"SELECT type, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n FROM {_values(*samples.TREE)} AS t(type, depth, n)")
def x11_tree_nodes(spark, sf_dir):
    rows = trees(spark.createDataFrame([("box.py", "python", samples.SOURCES["python"][0])], "file string, language string, content string"))
    return rows.where(F.col("type").isin(sorted({t for t, *_ in samples.TREE}))).groupBy("type", "depth").agg(F.count("*").alias("n"))


@query(f"SELECT url, owner, repo FROM {_values(*samples.REMOTES)} AS t(url, owner, repo) UNION ALL SELECT DISTINCT 'git@github.com:acme/' || repo, 'acme', repo FROM commits WHERE repo IS NOT NULL")
def x12_remotes(spark, sf_dir):
    urls = spark.createDataFrame([(u,) for u, *_ in samples.REMOTES], "url string")
    repos = _t(spark, sf_dir, "commits").where("repo IS NOT NULL").select(F.concat(F.lit("git@github.com:acme/"), "repo").alias("url")).distinct()
    return urls.unionByName(repos).select("url", X.remote(F.col("url")).alias("r")).select("url", "r.owner", "r.repo")


@query("SELECT * FROM " + _values(*[(str(i), "filter", k, v) for i, (_, out) in enumerate(samples.FILTERS) for k, v in out], *[(str(i), p, k, v) for i, (_, out) in enumerate(samples.PARAMETERS) for p, k, v in out]) + " AS t(i, kind, k, v)")
def x13_options(spark, sf_dir):
    rows = [(str(i), "filter", k, v) for i, (given, _) in enumerate(samples.FILTERS) for k, v in X.parse_filters(given).items()]
    rows += [(str(i), p, k, v) for i, (given, _) in enumerate(samples.PARAMETERS) for p, of in X.parse_parameters(given).items() for k, v in of.items()]
    return spark.createDataFrame(rows, "i string, kind string, k string, v string")


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.DOMAIN_STOP_WORDS) + "]"
_SINGULAR = "CASE WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '([nrt]ch|each|oach|sh|x|ss|zz)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, 's$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END"
_KEEP = f"length(w) > 2 AND NOT list_contains({_STOPS}, w)"


def _terms(text: str) -> str:
    words = f"list_filter(string_split_regex(regexp_replace(regexp_replace(lower(coalesce({text}, '')), '\\b(?:https?://|www\\.)[^\\s]*', '', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: {_KEEP})"
    return f"list_filter(list_transform({words}, lambda w: {_SINGULAR}), lambda w: {_KEEP})"


@query(f"SELECT doc_id, array_to_string({_terms('text')}, ' ') AS terms FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x00-\\x7F]*$')")
def x14_text_keywords(spark, sf_dir):
    """Keywords of the texts in plain letters, which both engines write alike in lower case."""
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL").where(~F.col("text").rlike("[^\\x00-\\x7F]"))
    return rows.select("doc_id", F.concat_ws(" ", X.keywords(F.col("text"), X.DOMAIN_STOP_WORDS)).alias("terms"))


# ---- graph building ------------------------------------------------------------------------------------

@query("SELECT DISTINCT target_id AS id, list_extract(string_split(target_id, '/'), -1) AS name, regexp_extract(list_extract(string_split(target_id, '/'), -1), '^.+(\\.[^.]+)$', 1) AS extension, count(DISTINCT source_id) OVER (PARTITION BY target_id) AS commits FROM (SELECT DISTINCT source_id, target_id FROM edges WHERE type = 'MODIFIED_FILE' AND source_id IS NOT NULL AND target_id IS NOT NULL)")
def g8_files(spark, sf_dir):
    """File nodes and edges from changes; every second one as a rename, deletions giving nothing."""
    rows = _t(spark, sf_dir, "edges").where("type = 'MODIFIED_FILE' AND source_id IS NOT NULL AND target_id IS NOT NULL")
    live = rows.select(F.col("source_id").alias("commit_id"), F.concat(F.lit("old/"), "target_id").alias("a_path"), F.col("target_id").alias("b_path"), F.lit("R100").alias("change_type"), F.lit(0).cast("bigint").alias("seq"))
    gone = live.select("commit_id", "a_path", F.lit(None).cast("string").alias("b_path"), F.lit("D").alias("change_type"), "seq")
    nodes, edges = B.file_graph(live.unionByName(gone))
    at = F.col("attributes")
    n, e = merge_nodes(nodes), merge_edges(edges).where(at["source_path"] == F.concat(F.lit("old/"), "target_id"))
    return n.join(e.groupBy("target_id").agg(F.count("*").alias("commits")), n["id"] == F.col("target_id")).select("id", at["name"].alias("name"), at["extension"].alias("extension"), "commits")


@query("SELECT DISTINCT 'COMMENT:' || substr(sha256(concat(coalesce(repo || ':', ''), n_chars, ':', text)), 1, 12) AS id, CAST(doc_id AS VARCHAR) AS commit_id FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL")
def g9_comments(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL AND n_chars IS NOT NULL").select(F.col("doc_id").cast("string").alias("commit_id"), F.col("repo").alias("file"), F.col("n_chars").alias("line"), "text", F.lit("inline").alias("kind"), F.lit(0).cast("bigint").alias("seq"))
    return merge_edges(B.comment_graph(rows)[1]).where("type = 'HAS_COMMENT'").select(F.col("source_id").alias("id"), F.col("target_id").alias("commit_id"))


@query("""WITH d AS (SELECT DISTINCT source_id AS file, target_id AS name FROM edges WHERE type = 'HAS_SYMBOL'), t AS (SELECT DISTINCT source_id AS name, target_id AS commit_id FROM edges WHERE type = 'MODIFIED_SYMBOL')
SELECT 'HAS_SYMBOL' AS type, count(*) AS n FROM d WHERE file IS NOT NULL AND name IS NOT NULL UNION ALL SELECT 'MODIFIED_SYMBOL', count(*) FROM t WHERE name IS NOT NULL AND commit_id IS NOT NULL UNION ALL SELECT 'SYMBOL', count(DISTINCT name) FROM (SELECT name FROM d UNION SELECT name FROM t) WHERE name IS NOT NULL""")
def g10_symbols(spark, sf_dir):
    e, zero = _t(spark, sf_dir, "edges"), F.lit(0).cast("bigint").alias("seq")
    defined = e.where("type = 'HAS_SYMBOL'").select(F.col("source_id").alias("file"), F.col("target_id").alias("name"), zero)
    touched = e.where("type = 'MODIFIED_SYMBOL'").select(F.col("target_id").alias("commit_id"), F.lit("x.py").alias("file"), F.col("source_id").alias("name"), zero)
    nodes, edges = B.symbol_graph(defined, touched)
    return merge_nodes(nodes).select("type").unionByName(merge_edges(edges).select("type")).groupBy("type").agg(F.count("*").alias("n"))


_SAID = f"WITH {_G}, src AS (SELECT id, message AS text FROM g WHERE type = 'COMMIT' AND regexp_matches(coalesce(message, ''), '^[\\x00-\\x7F]*$') UNION ALL SELECT id, coalesce(name, id) FROM g WHERE type IN ('FILE', 'SYMBOL')), w AS (SELECT id, unnest({_terms('text')}) AS term FROM src), kept AS (SELECT term, count(*) AS frequency FROM w GROUP BY term HAVING count(*) >= 2 ORDER BY 2 DESC, min(id), term LIMIT 100)"


def _said(spark, sf_dir) -> DataFrame:
    """Messages, file names and symbol names with their keywords."""
    nodes = graph(spark, sf_dir).nodes
    plain = ~F.coalesce(F.col("attributes")["message"], F.lit("")).rlike("[^\\x00-\\x7F]")
    texts = nodes.where(F.col("type") == "COMMIT").where(plain).select("id", F.col("attributes")["message"].alias("text")).unionByName(nodes.where(F.col("type").isin("FILE", "SYMBOL")).select("id", F.coalesce(F.col("attributes")["name"], F.col("id")).alias("text")))
    return texts.select(F.col("id").alias("node_id"), F.col("id").alias("seq"), X.keywords(F.col("text"), X.DOMAIN_STOP_WORDS).alias("terms"))


@query(f"{_SAID} SELECT DISTINCT w.id AS node_id, 'KEYWORD:' || w.term AS keyword, CAST(kept.frequency AS VARCHAR) AS frequency FROM w JOIN kept USING (term)")
def g11_keyword_edges(spark, sf_dir):
    nodes, edges = B.keyword_graph(Scratch(spark, "said").write(_said(spark, sf_dir)))
    of = nodes.select(F.col("id").alias("keyword"), F.col("attributes")["frequency"].alias("frequency"))
    return edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("keyword")).distinct().join(of, "keyword")


@query("SELECT 'ENV:KEY_' || (doc_id % 50) AS id, CAST(doc_id AS VARCHAR) AS commit_id FROM documents WHERE doc_id IS NOT NULL")
def g12_secrets(spark, sf_dir):
    """Environment variables of sources that read one in four ways."""
    name, ways = F.concat(F.lit("KEY_"), F.col("doc_id") % 50), ["x = os.getenv('{}')", 'y = os.environ["{}"]', "process.env.{};", "z = os.environ.get( '{}' )"]
    text = F.lit(None)
    for i, way in enumerate(ways):
        before, after = way.split("{}")
        text = F.when(F.col("doc_id") % 4 == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(text)
    rows = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("commit_id"), text.alias("content"), F.lit(0).cast("bigint").alias("seq"))
    return merge_edges(B.secret_graph(rows)[1]).select(F.col("source_id").alias("id"), F.col("target_id").alias("commit_id"))


# ---- enrichment ----------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT id, arg_max(struct_pack(m := message), scanned_at).m AS message FROM commits WHERE id IS NOT NULL GROUP BY id), r AS (SELECT DISTINCT id, unnest(regexp_extract_all(message, '#(\\d+)', 1)) AS n FROM c WHERE message IS NOT NULL)
SELECT r.id AS source_id, 'PR:acme/demo#' || n AS target_id FROM r JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS n FROM documents) d USING (n)""")
def e1_pull_requests(spark, sf_dir):
    """References in messages to records of a table, through a registry in which another plugin fails as it runs."""
    table = _t(spark, sf_dir, "documents").select(F.lit("acme").alias("owner"), F.lit("demo").alias("repo"), F.col("doc_id").alias("number"), F.col("source").alias("title"), "text", *[F.lit(None).cast("string").alias(c) for c in ("body", "state", "url", "author")], F.col("created_at").cast("string").alias("created_at"))
    commits = B.present_commits(_t(spark, sf_dir, "commits")).select("id", "message", F.lit("git@github.com:acme/demo.git").alias("remote"))
    registry = P.Registry()
    registry.register("Broken", lambda c, _: (c.select(F.raise_error(F.lit("broken")).alias("id")), c), "run")
    registry.register("PullRequests", P.pull_requests(table), "run")
    (rows,) = registry.run("run", commits)
    assert len(registry.errors) == 1
    return merge_edges(rows[1]).select("source_id", "target_id")


@query("""WITH c AS (SELECT id, arg_max(struct_pack(m := message), scanned_at).m AS message FROM commits WHERE id IS NOT NULL GROUP BY id), r AS (SELECT DISTINCT id, unnest(regexp_extract_all(message, 'task-?(\\d+)|#(\\d+)', 0)) AS whole FROM c WHERE message IS NOT NULL),
n AS (SELECT DISTINCT id, regexp_extract(whole, '(\\d+)', 1) AS task FROM r) SELECT n.id AS source_id, 'CLICKUP_TASK:' || task AS target_id FROM n JOIN (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS task FROM documents) d USING (task)""")
def e2_tasks(spark, sf_dir):
    """A user's pattern with two groups, of which the first that matched counts."""
    table = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("title", "status", "url", "description", "team_id")])
    commits = B.present_commits(_t(spark, sf_dir, "commits")).select("id", "message", F.lit(None).cast("string").alias("remote"))
    return merge_edges(P.tasks(table)(commits, {"regex": r"task-?(\d+)|#(\d+)"})[1]).select("source_id", "target_id")


# ---- vectors -------------------------------------------------------------------------------------------

def _letters(text: str) -> list:
    """An embedder that can be told in SQL: how often each letter occurs in a chunk of words, to unit length."""
    import numpy as np

    out = []
    for part in V.chunks((text or "").lower().split()):
        words = "".join(part)
        out.append(V.pool(np.array([[words.count(chr(97 + i)) for i in range(26)]], np.float32), np.ones(1)))
    return out


_COUNTS = ", ".join(f"length(w) - length(replace(w, '{chr(97 + i)}', ''))" for i in range(26))
_ITEMS = f"WITH {_G}, it AS (SELECT id AS node_id, string_split_regex(trim(regexp_replace(lower(message), '\\s+', ' ', 'g')), ' ') AS ws FROM g WHERE type = 'COMMIT' AND trim(message) <> ''), ch AS (SELECT node_id, len(ws) AS n, unnest(generate_series(0, CASE WHEN len(ws) <= 256 THEN 0 ELSE CAST(ceil(len(ws) / 206.0) - 1 AS BIGINT) END)) AS chunk_id, ws FROM it)"


@query(f"{_ITEMS} SELECT node_id, CAST(chunk_id AS INTEGER) AS chunk_id, round(v[5] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 3) AS e FROM (SELECT node_id, chunk_id, [{_COUNTS}]::DOUBLE[] AS v FROM (SELECT node_id, chunk_id, array_to_string(CASE WHEN n <= 256 THEN ws ELSE ws[chunk_id * 206 + 1 : chunk_id * 206 + 256] END, '') AS w FROM ch))")
def v6_embedded_messages(spark, sf_dir):
    """Messages cut into chunks of 256 words at a stride of 206, each embedded."""
    items = graph(spark, sf_dir).nodes.where("type = 'COMMIT'").select(F.col("id").alias("node_id"), F.lit("COMMIT_MESSAGE").alias("node_type"), F.col("attributes")["message"].alias("text"))
    return V.embed_items(items, _letters).select("node_id", "chunk_id", F.round(F.col("embedding")[4].cast("double"), 3).alias("e"))


@query(f"WITH {_G} SELECT id AS node_id FROM g WHERE type = 'COMMIT' AND trim(message) <> '' AND id LIKE '0%'")
def v7_changed_items(spark, sf_dir):
    """What is to be embedded anew when the messages of some commits have changed since."""
    g = graph(spark, sf_dir)
    items = V.items(g.nodes.where("type = 'COMMIT'"), g.edges.where("false"))
    before = items.select("node_id", "node_type", F.sha2(F.when(F.col("node_id").startswith("0"), F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("digest"))
    return V.changed_items(items, before).select("node_id")


# ---- repositories --------------------------------------------------------------------------------------

@query("SELECT CAST(seq AS BIGINT) AS seq, message, parents, files FROM " + _values(*[(i, m, min(i, 1), ",".join(sorted(f for f, t in files.items() if t is not None))) for i, (m, files) in enumerate(samples.COMMITS)]) + " AS t(seq, message, parents, files)")
def i2_git_history(spark, sf_dir):
    rows = history(spark, samples.repository(shared_dir(spark)), batch=2)
    return rows.select("seq", "message", F.size("parents").alias("parents"), F.array_join(F.array_sort(F.filter(F.col("diffs.b_path"), lambda x: x.isNotNull())), ",").alias("files"))


@query("SELECT path, sha256(content) AS digest FROM " + _values(*[(f, t) for _, files in samples.COMMITS for f, t in files.items() if t is not None]) + " AS t(path, content)")
def i3_git_blobs(spark, sf_dir):
    path = samples.repository(shared_dir(spark))
    live = changes(history(spark, path)).where("b_path IS NOT NULL")
    return live.join(blobs(live, path), "b_blob_sha").select(F.col("b_path").alias("path"), F.sha2("content", 256).alias("digest"))


@query("SELECT type, CAST(n AS BIGINT) AS n FROM " + _values(("REPOSITORY", 1), ("COMMIT", 3), ("COMMIT_MESSAGE", 3), ("AUTHOR", 1), ("TIME_BUCKET", 1), ("FILE", 2), ("SYMBOL", 3), ("FUNCTION", 2), ("FUNCTION_HISTORY", 2), ("FUNCTION_VERSION", 3), ("SECRET", 1)) + " AS t(type, n)")
def i4_ingested_nodes(spark, sf_dir):
    """A repository read, parsed and built, without keywords and comments."""
    nodes, _ = graph_of(spark, samples.repository(shared_dir(spark)))
    return nodes.where("type NOT IN ('KEYWORD', 'COMMENT')").groupBy("type").agg(F.count("*").alias("n"))
