"""Queries of the training-data operators; their SQL is in ``sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.chunking import present_messages, split_long
from stratagraph.llm.labelled import SPELLINGS
from stratagraph.llm.leakage import leaked_items
from stratagraph.llm.mixing import mixture, shares
from stratagraph.llm.names import identities, same_author_pairs
from stratagraph.llm.neighbours import fit_index, measured_recall, similar_pairs
from stratagraph.llm.repetition import outlying_documents, repeated_documents, statistics
from stratagraph.llm.sql import SQL  # noqa: F401 - read by the driver contract


#: Characters above which a message is cut.
LIMIT = 1_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long(present_messages(_t(spark, sf_dir, "commits"), LIMIT), "commit_id", "message", LIMIT).select(F.col("key").alias("commit_id"), "chunk_id", "start", "stop", "piece", "hard_cut")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_long(present_messages(_t(spark, sf_dir, "commits"), LIMIT), "commit_id", "message", LIMIT)
    return pieces.where("chunk_id = 0").select(F.col("key").alias("commit_id"), F.col("forced").cast("bigint").alias("forced"))


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages put together again from their pieces without the overlaps, and whether all pieces keep the limit."""
    pieces = split_long(present_messages(_t(spark, sf_dir, "commits"), LIMIT), "commit_id", "message", LIMIT)
    rest = F.when(F.col("chunk_id") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 101)"))
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk_id", rest.alias("rest")))).alias("p"), F.max(F.char_length("piece")).alias("longest"))  # the pieces of one message
    return whole.select(F.col("key").alias("commit_id"), F.sha2(F.concat_ws("", "p.rest"), 256).alias("digest"), (F.col("longest") <= LIMIT).alias("within"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(_t(spark, sf_dir, "node_vectors"))


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of a search through small leaves, in several levels, against brute force over all rows."""
    return measured_recall(_t(spark, sf_dir, "node_vectors"))


def p3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of ``p3_found``: its leaves and levels, how many a search visits, and the recall calibrated."""
    i = fit_index(_t(spark, sf_dir, "node_vectors"), 10, 0.6)
    row = (i.tree.leaves, i.tree.levels, i.visits, i.mean_visits, i.recall) if i else (0, 0, 0, 0.0, 1.0)
    return spark.createDataFrame([row], "leaves bigint, levels bigint, visits bigint, mean_visits double, recall double")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_author_pairs(_t(spark, sf_dir, "authors"))


def p4_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities(_t(spark, sf_dir, "authors"))


def p4_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a small table whose owners are known; its SQL pairs the rows of each owner."""
    return same_author_pairs(spark.createDataFrame([(i, n, e) for i, (_, n, e) in enumerate(SPELLINGS)], "author_id bigint, name string, email string"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _t(spark, sf_dir, "mix_targets")
    return shares(mixture(_t(spark, sf_dir, "documents"), targets), targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_documents(_t(spark, sf_dir, "documents")).select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every document."""
    return statistics(_t(spark, sf_dir, "documents")).select("doc_id", "words", F.round("run_share", 6).alias("share"))


def p9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that the robust distance rejects, whatever their repeated share: also those of repeated lines, sentences and words."""
    return outlying_documents(_t(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.round("run_share", 6).alias("share"), F.round("d2", 3).alias("d2"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p2_rebuilt, p3_found, p3_recall, p3_index, p4_found, p4_identities, p4_labelled, p7_found, p8_mixture, p8_shares, p9_found, p9_shares, p9_outliers)}
