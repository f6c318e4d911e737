"""A feed of amendments replayed over a graph: what every counting change since an entity's last deletion says, merged by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.model.sanitize import sanitize_map
from stratagraph.operators.changefeed import WRAPPERS
from stratagraph.session import Scratch

ATTRIBUTES = "map<string,string>"


def _field(name: str) -> Column:
    return F.coalesce(*[F.get_json_object("payload", f"${w}.{name}") for w in ("", *[f".{x}" for x in WRAPPERS])])


def counting(changes: DataFrame) -> DataFrame:
    """The valid changes of ``normalise_changes`` no copy of which is reverted, each once, with what their payload says.

    ``at`` orders them: the latest time last and, of one time, the smallest id last, so that it decides.
    """
    revoked = changes.where("reverted").select("amendment_id").distinct()
    once = changes.where("valid").join(revoked, "amendment_id", "left_anti").dropDuplicates(["amendment_id"])
    said = F.coalesce(F.from_json(_field("attributes"), ATTRIBUTES), F.create_map().cast(ATTRIBUTES))
    return once.select("kind", "entity_type", "entity_key", "source_id", "target_id", "amendment_id", "at_us", "deletes", sanitize_map(said).alias("attributes"), _field("weight").cast("double").alias("weight"))


def replayed(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after all counting changes, in the order of their time and id.

    An addition or update merges its attributes, and an edge's weight by maximum; what was said of an entity before
    its last deletion, by the graph or by the feed, is gone. A deleted node takes along the edges that lead to or
    from its id and were there before; later edges stay. An update of an entity that does not exist adds it.
    A null time is earlier than all others. A null attribute removes its key.
    """
    scratch = Scratch(nodes.sparkSession, "replay")
    ranked = F.struct(F.coalesce("at_us", F.lit(-(2**62))).alias("at"), F.col("amendment_id").alias("id"))
    rows = scratch.write(counting(changes).withColumn("o", ranked), "counting")
    # of one time the smaller id is the later one
    later = lambda a, b: (F.col(f"{a}.at") > F.col(f"{b}.at")) | ((F.col(f"{a}.at") == F.col(f"{b}.at")) & (F.col(f"{a}.id") < F.col(f"{b}.id")))
    last = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("o", F.struct(-F.col("o.at"), F.col("o.id"))).alias("d"))
    gone = rows.where("deletes")

    # the numbers of merge rows: the feed comes after the graph, and of one time the smaller id last
    seq = F.struct(F.lit(1).alias("feed"), F.col("o.at").alias("at"), F.translate("o.id", "0123456789abcdef", "fedcba9876543210").alias("id"))
    base = F.struct(F.lit(0).alias("feed"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("id"))

    dead = last(gone.where("kind = 'node'"), F.col("entity_key").alias("id"), F.col("entity_type").alias("type"))
    said = rows.where("kind = 'node' AND NOT deletes").select(F.col("entity_key").alias("id"), F.col("entity_type").alias("type"), "attributes", "o", seq.alias("seq"))
    said = said.join(dead, ["id", "type"], "left").where(F.col("d").isNull() | later("o", "d")).drop("d", "o")
    old = nodes.select("id", "type", "attributes", base.alias("seq")).join(dead, ["id", "type"], "left_anti")
    new_nodes = merge_nodes(old.unionByName(said), null_deletes=True)

    # an id is dead from the last deletion of a node of that name
    ends = last(gone.where("kind = 'node'"), F.col("entity_key").alias("end"))
    cut = last(gone.where("kind = 'edge'"), "source_id", "target_id", F.col("entity_type").alias("type"))
    fresh = rows.where("kind = 'edge' AND NOT deletes").select("source_id", "target_id", F.col("entity_type").alias("type"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "attributes", "o", seq.alias("seq"))
    fresh = fresh.join(cut, ["source_id", "target_id", "type"], "left").where(F.col("d").isNull() | later("o", "d")).drop("d")
    kept = edges.select("source_id", "target_id", "type", "weight", "attributes", base.alias("seq"))
    kept = kept.join(cut.select("source_id", "target_id", "type"), ["source_id", "target_id", "type"], "left_anti")
    for side in ("source_id", "target_id"):
        kept = kept.join(ends, F.col(side) == F.col("end"), "left_anti")
        fresh = fresh.join(ends, F.col(side) == F.col("end"), "left").where(F.col("d").isNull() | later("o", "d")).drop("d", "end")
    return new_nodes, merge_edges(kept.unionByName(fresh.drop("o")), null_deletes=True)
