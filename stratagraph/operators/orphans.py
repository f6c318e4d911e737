"""References to records that do not exist, per table and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.session import Scratch

#: Keys up to which the bad ones are broadcast (some 100 bytes each) instead of shuffling all references to them.
FEW_KEYS = 200_000
SIDES = {"source": "source_id", "target": "target_id"}


def parent_states(nodes: DataFrame) -> DataFrame:
    """(ref, deleted, arrival): per node id the present state's deletion and the earliest created_at.

    The present state is the row with the latest updated_at; rows without one come before all others.
    Ties go to the row that is deleted. Null ids are no keys.
    """
    order = F.struct(F.col("updated_at"), F.col("deleted_at").isNotNull())
    return (
        nodes.where("id IS NOT NULL").groupBy(F.col("id").alias("ref"))
        .agg(F.max_by(F.col("deleted_at").isNotNull(), order).alias("deleted"), F.min("created_at").alias("arrival"))
    )


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, side, ref, created_at): one row for each non-null side of each edge row."""
    sides = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("ref")) for side, c in SIDES.items()])
    return edges.select(F.col("id").alias("edge_id"), "created_at", F.explode(sides).alias("s")).select("edge_id", "created_at", "s.side", "s.ref").where("ref IS NOT NULL")


def _kind(at: Column) -> Column:
    return F.when(~F.col("present"), F.lit("missing")).when(F.col("deleted"), F.lit("deleted")).when(F.col("arrival") > at, F.lit("late"))


def orphan_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, side, kind, period): edges whose source or target is missing, deleted or arrives later.

    The distinct foreign keys (with their earliest use) are anti-joined against the parent keys that are sound by
    then: present and arrived. The keys left over are a case for some edge; they are told missing, deleted and
    late apart and written out. Only they are joined back: broadcast if they are few, so that the references stay
    where they are, else shuffled, where a hot key is one row on its side and AQE splits its edges. Exact
    repeats of an edge give one row. Null references are no cases; a null edge date gives a null period
    and cannot be late; a null node arrival is never late. Empty tables give empty results.
    """
    refs = references(edges)
    # coalescing keeps a key alive for the 'late' test only where some edge is dated
    used = refs.groupBy("ref").agg(F.min("created_at").alias("first_use"))
    states = parent_states(nodes).select(F.col("ref").alias("key"), "deleted", "arrival")
    sound = ~F.col("deleted") & ~F.coalesce(F.col("arrival") > F.col("first_use"), F.lit(False))
    orphans = used.join(states, (F.col("ref") == F.col("key")) & sound, "left_anti")
    cases = orphans.join(states, F.col("ref") == F.col("key"), "left").select(F.col("ref").alias("bad_ref"), F.col("key").isNotNull().alias("present"), "deleted", "arrival")
    bad = Scratch(edges.sparkSession, "orphans").write(cases, "keys")
    if bad.count() <= FEW_KEYS:
        bad = F.broadcast(bad)
    return (
        refs.join(bad, F.col("ref") == F.col("bad_ref"))
        .select("edge_id", "side", _kind(F.col("created_at")).alias("kind"), F.date_format("created_at", "yyyy-MM").alias("period"))
        .where("kind IS NOT NULL")
        .distinct()
    )


def orphan_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, kind, period, n): the counts per side, kind and month."""
    return orphan_references(edges, nodes).groupBy("side", "kind", "period").agg(F.count("*").alias("n"))
