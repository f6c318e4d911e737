"""The engine as one class: index, query, history, syntax tree, dependencies, types, amendments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.functions.syntax import tree
from stratagraph.model.store import Catalog
from stratagraph.operators import enrich as P
from stratagraph.operators import expand as E
from stratagraph.operators import lookup as L
from stratagraph.operators import search as S
from stratagraph.operators import vectors as V
from stratagraph.operators.ingest import ingest
from stratagraph.operators.versions import history_text
from stratagraph.sources.gitsource import _git, acquire


CONNECTIONS = "array<struct<type:string,id:string,distance:int,attributes:string>>"


def file_text(root: str, path: str) -> str:
    """A file of a repository: as of HEAD, else in the working tree, else as the last commit that had it left it; empty if none has it."""
    import os

    text = _git(root, "show", f"HEAD:{path}").decode("utf-8", "replace")
    inside = os.path.realpath(os.path.join(root, path))
    if not text and inside.startswith(os.path.realpath(root) + os.sep) and os.path.isfile(inside):
        with open(inside, encoding="utf-8", errors="replace") as f:
            text = f.read()
    if not text and (last := _git(root, "log", "-1", "--format=%H", "--diff-filter=AMR", "HEAD", "--", path).decode().strip()):
        text = _git(root, "show", f"{last}:{path}").decode("utf-8", "replace")
    return text


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder=None, overwrite: bool = False) -> None:
        self.spark, self.catalog = spark, Catalog(spark, root, overwrite)
        self.embedder = embedder or V.hashing_embedder()
        self.plugins = P.Registry()

    def graph(self) -> S.Graph:
        return self.catalog.amended() if self.catalog.state["amendments"] else self.catalog.graph()

    def index(self, repositories: str, skip_bots: bool = True, vectors: bool = True, parameters: Sequence[str] = (), cache: str = "", token: str = "") -> int:
        """Ingest a comma-separated list of local repositories, or of addresses that are cloned or pulled under ``cache``.

        The number of nodes afterwards comes back. Known commits are skipped.
        """
        for source in filter(None, (p.strip() for p in repositories.split(","))):
            path = acquire(source, cache, token) if cache else source
            self.catalog.append(*ingest(self.spark, path, self.catalog.graph(), skip_bots))
        self.catalog.compact()
        for nodes, edges in self.plugins.run("build", P.in_context(self.catalog.graph()), list(parameters)):
            self.catalog.append(nodes, edges)
        if vectors:
            g = self.catalog.graph()
            new = self.catalog_cache(V.changed_items(V.items(g.nodes, g.edges), self.catalog.embedded()))
            if new.head(1):  # what was embedded with the same text stays
                self.catalog.put_embeddings(V.embed_items(new, self.embedder), new)
        return self.catalog.count_nodes()

    def vector(self, text: str) -> list[float] | None:
        """The mean of a query's chunk vectors; None for a blank query."""
        if not (text or "").strip():
            return None
        import numpy as np

        return [float(x) for x in np.mean(self.embedder(text), axis=0)]

    def query(
        self, query: str = "", repo_name: str | None = None, depth: int = 1, traverse_types: Sequence[str] = (), exclude_types: Sequence[str] = (), semantic_only: bool = False, min_score: float = 10.0, top_n: int = 5,
        filters: Sequence[str] = (), all_matches: bool = False, all_files: bool = False, excluded_commits: Sequence[str] = (), offset: int = 0, negative_query: str = "", plugins: bool = False, parameters: Sequence[str] = (), limit: int | None = None,
    ) -> DataFrame:
        """(id, message, author, date, relevance, reasons, connections): the ranked commits with what lies around them.

        Connections carry their attributes. ``limit`` shortens what is shown after ``top_n`` has been ranked and expanded.
        """
        g, vector, away = self.graph(), self.vector(query), self.vector(negative_query)
        run = lambda g: S.search(g, query, vector, repo_name, X.parse_filters(list(filters)), semantic_only, negative_query, away, excluded_commits, min_score, top_n, offset)
        found = self.catalog_cache(run(g))
        if plugins:
            for nodes, edges in self.plugins.run("run", P.in_context(g, found), list(parameters)):
                self.catalog.append(nodes, edges)
            g = self.graph()
            found = self.catalog_cache(run(g))
        if depth < 1:
            return (found if limit is None else found.limit(limit)).withColumn("connections", F.array().cast(CONNECTIONS))
        stops = X.stop_words(self.spark)
        words, avoid = X.query_words(query, stops), X.query_words(negative_query, stops)
        near = V.top_similar(g.embeddings, vector, V.CANDIDATES).where(F.col("similarity") >= V.FLOOR) if vector else None
        far = V.top_similar(g.embeddings, away, V.CANDIDATES).where(F.col("similarity") >= V.FLOOR) if away else None
        hits = S.triggers(S.hits_to_commits(S.keyword_hits(g.nodes, words), g)).join(found.select(F.col("id").alias("start")), "start", "left_semi") if words and not semantic_only else None
        around = E.expand(g, found, E.gates(g, words, avoid, near, far, all_files), depth, traverse_types, exclude_types, all_matches, hits)
        told = around.join(g.nodes.select("id", "type", F.to_json("attributes").alias("attributes")), ["id", "type"], "left")
        grouped = told.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("type", "id", "distance", "attributes"))).alias("connections"))
        page = found.join(grouped, found["id"] == grouped["start"], "left").drop("start").withColumn("connections", F.coalesce("connections", F.array().cast(CONNECTIONS))).orderBy(F.desc("relevance"), "id")
        return page if limit is None else page.limit(limit)

    def catalog_cache(self, df: DataFrame) -> DataFrame:
        from stratagraph.session import Scratch

        return Scratch(self.spark, "query").write(df, "found")

    def connections(self, result: DataFrame, kept: dict[str, int] | None = None) -> DataFrame:
        """(id, type, shown, more): the connected ids per type; of keywords the first five, with the number left out."""
        rows = result.select("id", F.explode("connections").alias("c")).select("id", "c.type", F.col("c.id").alias("other"))
        return L.grouped(rows, kept or {"KEYWORD": 5})

    def text(self, result: DataFrame) -> str:
        """The result as numbered paragraphs; keywords are cut at three. Results are a page, so they fit the driver."""
        shown = {}
        for r in self.connections(result, {"KEYWORD": 3}).collect():
            shown.setdefault(r["id"], []).append(f"   {r['type']}: {', '.join(r['shown'])}" + (f" (+{r['more']} more)" if r["more"] else ""))
        out = []
        for i, r in enumerate(result.orderBy(F.desc("relevance"), "id").collect(), 1):
            out.append("\n".join([f"{i}. {r['id'][:8]} (relevance {r['relevance']:.2f})", f"   {r['message'].splitlines()[0] if r['message'] else ''}", f"   {r['author']}, {r['date']}", *[f"   - {x}" for x in r["reasons"]], *sorted(shown.get(r["id"], []))]))
        return "\n\n".join(out) or "No results."

    def history(self, function: str) -> str:
        """All histories of a function as text; the name may be part of one symbol's or function's id."""
        g = self.graph()
        name = L.resolve(g.nodes, function, ["FUNCTION", "SYMBOL"], 10)
        mine = g.edges.where("type = 'HAS_HISTORY'").where(F.col("source_id") == name).select(F.col("target_id").alias("history_id"))
        versions = g.edges.where("type = 'HAS_VERSION'").join(mine, F.col("source_id") == F.col("history_id"), "left_semi")
        linked = g.edges.where("type = 'PREVIOUS_VERSION'").join(versions.select("target_id"), "target_id", "left_semi")
        rows = history_text(g.nodes, versions.unionByName(linked)).orderBy("history_id", "place").collect()
        out, last = [], None
        for r in rows:
            if r["history_id"] != last:
                out.append(f"History {r['history_id']}")
                last = r["history_id"]
            out.append(r["text"])
        return "\n".join(out) or f"No history of {name}."

    def syntax_tree(self, node: str, max_depth: int = 0, query: str = "") -> list[dict]:
        """The syntax tree of a file (as of HEAD), a function (its latest version) or a version, optionally what resembles a query."""
        import numpy as np

        g = self.graph()
        id_, kind = L.resolve_for_tree(g.nodes, node)
        if kind == "FILE":
            roots = g.nodes.where("type = 'REPOSITORY'").select(F.col("attributes")["root_path"].alias("p")).where("p IS NOT NULL").collect()  # one row per indexed repository
            source = next((s for r in roots if (s := file_text(r["p"], id_))), "")
            name = id_
        else:
            rows = V.latest_versions(g.nodes, g.edges).where(F.col("function_id") == id_) if kind == "FUNCTION" else g.nodes.where((F.col("id") == id_) & (F.col("type") == kind))
            found = rows.select("attributes").head(1)
            source, name = (found[0]["attributes"].get("content", ""), found[0]["attributes"].get("file_path", "")) if found else ("", "")
        language = X.LANGUAGES.get("." + name.rsplit(".", 1)[-1].lower())
        listed = tree(source, language, max_depth if not query else 0)
        if query:
            q = np.asarray(self.vector(query))
            for r in listed:
                r["similarity"] = float(np.dot(q, self.embedder(f"{r['text'] or ''} {r['type']}")[0]) / max(np.linalg.norm(q), 1e-12))
            listed = sorted((r for r in listed if r["similarity"] >= V.FLOOR and (not max_depth or r["depth"] <= max_depth)), key=lambda r: -r["similarity"])
        return listed

    def dependencies(self, node: str) -> DataFrame:
        g = self.graph()
        return L.neighbours(g, self.spark.createDataFrame([(L.resolve(g.nodes, node),)], "id string")).orderBy("direction", "edge_type", "other_id")

    def node_types(self) -> list[str]:
        return [r["type"] for r in L.types(self.graph().nodes).collect()]

    def edge_types(self) -> list[str]:
        return [r["type"] for r in L.types(self.graph().edges).collect()]

    def amend(self, action: str, entity_type: str, payload: dict) -> str:
        return self.catalog.amend(action, entity_type, payload)
