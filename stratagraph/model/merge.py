"""Keyed merges of node and edge rows: one row per key, whatever the number and order of the rows.

Attributes merge key by key, the write with the largest ``seq`` winning (ties: the largest value); with
``null_deletes`` a null value removes its key, without it a null is stored like any value. The type of a node
is that of its first row; the weight of an edge is its largest, null counting as 1. A node whose id is null is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    """SHA-256 of source|target|type; null ends count as empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", part(source), part(target), part(kind)), 256)


def _attributes(rows: DataFrame, keys: list[str], null_deletes: bool) -> DataFrame:
    """(keys, attributes): last write per attribute; partial aggregation before both shuffles."""
    written = rows.select(*keys, "seq", F.explode("attributes").alias("k", "v")).groupBy(*keys, "k").agg(F.max_by(F.struct("v"), F.struct("seq", "v")).alias("w"))
    if null_deletes:
        written = written.where("w.v IS NOT NULL")
    return written.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", F.col("w.v").alias("v"))))).alias("attributes"))


def _keyed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], "attributes")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, on, "left").drop(*[f"__{k}" for k in keys]).withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def merge_nodes(rows: DataFrame, by_type: bool = True, null_deletes: bool = False) -> DataFrame:
    """(id, type, attributes) of rows (id, type, attributes, seq).

    ``by_type`` keys nodes by (type, id); without it ids share one namespace and the first row's type stays.
    """
    rows = rows.where("id IS NOT NULL")
    keys = ["id", "type"] if by_type else ["id"]
    base = rows.groupBy(*keys).agg(*([] if by_type else [F.min_by("type", F.struct("seq", "type")).alias("type")]), F.count("*").alias("__n")).drop("__n")
    return _keyed(base, _attributes(rows, keys, null_deletes), keys).select("id", "type", "attributes")


def merge_edges(rows: DataFrame, null_deletes: bool = False) -> DataFrame:
    """(id, source_id, target_id, type, weight, attributes) of rows (source_id, target_id, type, weight, attributes, seq)."""
    keys = ["source_id", "target_id", "type"]
    base = rows.groupBy(*keys).agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    merged = _keyed(base, _attributes(rows, keys, null_deletes), keys)
    return merged.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("type")).alias("id"), *keys, "weight", "attributes")
