"""Streams: commits appended as they arrive (function histories go on where they stopped), windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratagraph.model.store import Catalog
from stratagraph.operators import build as B
from stratagraph.operators.ingest import rows_of
from stratagraph.sources.gitsource import GitLog


def follow_repository(spark: SparkSession, path: str, catalog: Catalog, checkpoint: str, skip_bots: bool = True) -> StreamingQuery:
    """Ingest the commits behind those seen before, then stop; each batch skips commits that are nodes already, so a repeated batch adds nothing."""
    spark.dataSource.register(GitLog)
    stream = spark.readStream.format("gitlog").load(path)

    def merge(batch: DataFrame, _: int) -> None:
        rows = B.unseen(B.without_bots(batch) if skip_bots else batch, catalog.nodes())
        if rows.head(1):
            catalog.append(*rows_of(batch.sparkSession, rows, path, catalog.graph()))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_rows(stream: DataFrame, catalog: Catalog, checkpoint: str) -> StreamingQuery:
    """Append a stream of commit rows (columns of ``build.commit_graph``) to the catalog."""

    def merge(batch: DataFrame, _: int) -> None:
        new = B.unseen(batch, catalog.nodes())
        catalog.append(*B.commit_graph(new))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, value): counts per window, rows later than ``late`` behind the newest left out.

    ``ts`` may be a timestamp without zone, which watermarks reject; it is read in the session's zone. The same
    plan runs over batches and streams.
    """
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user without a pause of ``gap``."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
