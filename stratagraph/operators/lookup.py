"""Point lookups: dependencies, fuzzy identifiers, type catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.model.schemas import STRUCTURAL
from stratagraph.operators.build import ranked
from stratagraph.operators.search import Graph, contains

FUZZY_TYPES = ["FILE", "FUNCTION", "SYMBOL", "COMMIT"]
AST_TYPES = ["FILE", "FUNCTION", "FUNCTION_VERSION"]


class Ambiguous(LookupError):
    """An identifier that names several nodes, or none; ``options`` holds a few of them."""

    def __init__(self, text: str, options: list[str]) -> None:
        super().__init__(f"{'several nodes match' if options else 'no node matches'} {text!r}" + (": " + ", ".join(options) if options else ""))
        self.options = options


def readable_name(id_: Column, kind: Column, attributes: Column) -> Column:
    """The name attribute; else of a file the last segment, of a commit the first line of its message or eight characters; else the id."""
    line = F.nullif(F.trim(F.substring_index(attributes["message"], "\n", 1)), F.lit(""))
    return F.coalesce(F.nullif(attributes["name"], F.lit("")), F.when(kind == "FILE", F.element_at(F.split(id_, "/"), -1)).when(kind == "COMMIT", F.coalesce(line, F.substring(id_, 1, 8))), id_)


def neighbours(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, direction, edge_type, other_id, other_type, name): what the nodes depend on ('out') and what depends on them ('in').

    Comment and keyword links are no dependencies; an edge whose other end is no node is left out.
    """
    e = graph.edges.where(~F.col("type").isin(STRUCTURAL))
    wanted = ids.select("id").distinct()
    out = e.join(wanted, F.col("source_id") == wanted["id"]).select(wanted["id"].alias("at"), F.lit("out").alias("direction"), F.col("type").alias("edge_type"), F.col("target_id").alias("other_id"))
    into = e.join(wanted, F.col("target_id") == wanted["id"]).select(wanted["id"].alias("at"), F.lit("in").alias("direction"), F.col("type").alias("edge_type"), F.col("source_id").alias("other_id"))
    nodes = graph.nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"), "attributes")
    return out.unionByName(into).distinct().join(nodes, "other_id").select(F.col("at").alias("id"), "direction", "edge_type", "other_id", "other_type", readable_name(F.col("other_id"), F.col("other_type"), F.col("attributes")).alias("name"))


def candidates(nodes: DataFrame, text: str, types: list[str] | None = None) -> DataFrame:
    """(id, type): nodes of the types whose id contains the text."""
    return nodes.where(F.col("type").isin(types or FUZZY_TYPES)).where(contains(F.col("id"), text)).select("id", "type")


def resolve(nodes: DataFrame, text: str, types: list[str] | None = None, options: int = 5) -> str:
    """The node a text means: an exact id; else the only candidate; else the only one that ends with it; else an error with a few options."""
    if nodes.where(F.col("id") == text).head(1):
        return text
    found = candidates(nodes, text, types)
    suffix = F.col("id").endswith(f"/{text}") | F.col("id").endswith(f".{text}")
    some = [r["id"] for r in found.select("id").distinct().orderBy("id").limit(2).collect()]
    if len(some) == 1:
        return some[0]
    ends = [r["id"] for r in found.where(suffix).select("id").distinct().orderBy("id").limit(2).collect()]
    if len(ends) == 1:
        return ends[0]
    raise Ambiguous(text, [r["id"] for r in found.select("id").distinct().orderBy("id").limit(options).collect()])


def resolve_for_tree(nodes: DataFrame, text: str, options: int = 5) -> tuple[str, str]:
    """(id, type) of the file, function or version whose syntax tree is asked for; a single file wins over others."""
    exact = nodes.where(F.col("type").isin(AST_TYPES)).where(F.col("id") == text).orderBy("type").head(1)
    if exact:
        return exact[0]["id"], exact[0]["type"]
    found = candidates(nodes, text, AST_TYPES).distinct()
    files = found.where("type = 'FILE'").orderBy("id").limit(2).collect()
    if len(files) == 1:
        return files[0]["id"], "FILE"
    ends = found.where(F.element_at(F.split("id", "/"), -1) == text).orderBy("id").limit(2).collect()
    if len(ends) == 1:
        return ends[0]["id"], ends[0]["type"]
    one = found.orderBy("id").limit(2).collect()
    if len(one) == 1:
        return one[0]["id"], one[0]["type"]
    raise Ambiguous(text, [r["id"] for r in found.orderBy("id").limit(options).collect()])


def grouped(rows: DataFrame, kept: dict[str, int]) -> DataFrame:
    """(id, type, shown, more) of connections (id, type, other): the connected ids per type, of the types of ``kept`` the first few, with the number left out."""
    caps = F.lit(2**31 - 1)
    for kind, n in kept.items():
        caps = F.when(F.col("type") == kind, n).otherwise(caps)
    numbered = ranked(rows, ["id", "type"], [F.col("other")], "i")
    return numbered.groupBy("id", "type").agg(F.sort_array(F.collect_list(F.when(F.col("i") <= caps, F.col("other")))).alias("shown"), F.count_if(F.col("i") > caps).alias("more"))


def types(rows: DataFrame) -> DataFrame:
    """(type): the distinct types, sorted."""
    return rows.select("type").where("type IS NOT NULL").distinct().orderBy("type")
