"""A change feed applied to a table kept as append-only files with delete vectors (merge on read).

Every applied batch appends its row images to new files; nothing is rewritten. A key index maps each
entity to the (file, position) pairs of its images, in buckets. For the entities a batch touches, the images that
no longer decide are marked in per-file bitmaps, 64 positions to a word, and reads drop marked positions.
Because superseded images stay until ``compact``, a change that arrives late, twice or is reverted
afterwards only moves bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratagraph.session import Scratch, spread

SEP = "\x1f"
WRAPPERS = ("data",)
IMAGE = "entity string, kind string, entity_type string, entity_key string, amendment_id string, at_us bigint, deletes boolean, payload string, reverted boolean"
#: The index names an entity by two 64-bit hashes, which together do not collide, and a file by the hash of its name.
INDEX = "e1 bigint, e2 bigint, amendment_id string, at_us bigint, deletes boolean, reverted boolean, file bigint, pos bigint"
ENTITY = ["e1", "e2"]
MARKS = "file bigint, word bigint, batch int, seen bigint, dead bigint"
#: Words of bitmaps, 24 bytes each, up to which they are broadcast: 128 million images.
FEW_WORDS = 2_000_000


def _hashes() -> list[Column]:
    return [F.xxhash64("entity").alias("e1"), F.xxhash64(F.lit(1), "entity").alias("e2")]


def epoch_micros(ts: Column) -> Column:
    """Epoch in seconds, milliseconds, microseconds or nanoseconds, told apart by magnitude, as whole microseconds."""
    size = F.abs(ts)
    scaled = F.when(size < 1e11, ts * 1e6).when(size < 1e14, ts * 1e3).when(size < 1e17, ts).otherwise(ts / 1e3)
    return F.when(~F.isnan(ts), F.round(scaled)).cast("bigint")


def normalise_changes(feed: DataFrame) -> DataFrame:
    """One row per delivered change with a spelled-out action, entity key, time and validity.

    Actions are read in any case and with any separators. A payload counts if it is one valid JSON value
    (anything behind it makes it invalid, as do repeated keys in one object), possibly a JSON string
    that holds JSON, possibly wrapped in ``data``, and names a node id or both ends of an edge. Rows
    without an id are dropped; a null or NaN timestamp is earlier than all others.
    """
    action = F.regexp_replace(F.lower(F.trim("action")), "[^a-z]+", "_")
    one = lambda s: f"try_parse_json(concat('[', {s}, ']'))"  # noqa: E731 - the brackets reject text behind the value
    rows = (
        feed.where("id IS NOT NULL")
        .select(F.col("id").alias("amendment_id"), epoch_micros(F.col("timestamp").cast("double")).alias("at_us"), action.alias("act"), "entity_type", "payload", (F.coalesce(F.col("reverted"), F.lit(0)) == 1).alias("reverted"), "received_at")
        .withColumn("outer", F.expr(f"{one('payload')}"))
        .withColumn("text", F.expr("CASE WHEN try_variant_get(outer, '$[1]', 'string') IS NULL AND schema_of_variant(outer) = 'ARRAY<STRING>' THEN try_variant_get(outer, '$[0]', 'string') END"))
        .withColumn("doc", F.expr(f"CASE WHEN text IS NOT NULL THEN {one('text')} ELSE outer END"))
    )
    field = lambda name: F.expr("coalesce(" + ", ".join(f"try_variant_get(doc, '$[0]{w}.{name}', 'string')" for w in ("", *[f".{x}" for x in WRAPPERS])) + ")")
    alone = F.expr("doc IS NOT NULL AND try_variant_get(doc, '$[1]', 'variant') IS NULL")
    kind = F.regexp_extract("act", "^(add|update|delete)_(node|edge)$", 2)
    key = F.when(kind == "node", field("id")).when(kind == "edge", F.concat(field("source_id"), F.lit("|"), field("target_id")))
    edge_end = lambda name: F.when(alone & (kind == "edge"), field(name))
    rows = rows.withColumn("kind", kind).withColumn("entity_key", F.when(alone, key)).withColumn("source_id", edge_end("source_id")).withColumn("target_id", edge_end("target_id"))
    return rows.select(
        F.concat_ws(SEP, "kind", F.coalesce("entity_type", F.lit("\x1e")), "entity_key").alias("entity"),
        "kind", "entity_type", "entity_key", "source_id", "target_id", "amendment_id", "at_us", F.col("act").startswith("delete").alias("deletes"),
        F.coalesce("text", "payload").alias("payload"), "reverted", F.col("entity_key").isNotNull().alias("valid"), "received_at",
    )


class DeleteVectorTable:
    """The current state of all entities, rebuilt by ``apply``; every file lies in the shared folder.

    The index is kept in buckets by entity, and a batch reads the buckets it touches. Bitmaps are logged as what each
    batch saw and marked; ``read`` folds the log.
    """

    def __init__(self, spark: SparkSession, buckets: int = 16) -> None:
        self.spark, self.scratch, self.buckets = spark, Scratch(spark, "changefeed"), buckets
        self.files: list[str] = []
        self.indexes: list[str] = []
        self.marks: list[str] = []

    def _all(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucketed(self, paths: list[str], schema: str, touched: list[int]) -> DataFrame:
        """The rows of the touched buckets; only their folders are read."""
        parts = [self.spark.read.schema(f"{schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched)) for path in paths]
        return reduce(DataFrame.unionByName, parts)

    def _keep(self, rows: DataFrame, name: str) -> str:
        path = self.scratch.path(name)
        rows.withColumn("bucket", F.pmod("e1", F.lit(self.buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(path)
        return path

    def _locate(self, path: str) -> DataFrame:
        """The key index of the images in ``path``: only their key columns are read."""
        return self._all([path], IMAGE).select(*_hashes(), "amendment_id", "at_us", "deletes", "reverted", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))

    def apply(self, batch: DataFrame) -> None:
        """Apply a batch of ``normalise_changes`` rows.

        Of the changes that count, the latest time decides, then the smallest id; a change any copy of
        which is reverted, now or in a later batch, does not count. Applying a batch again changes nothing.
        """
        images = batch.where("valid").select(*[c.split()[0] for c in IMAGE.split(", ")])  # a copy is one more image, superseded by the first
        path = self.scratch.path("images")
        images.write.parquet(path)
        self.files.append(path)
        self.indexes.append(self._keep(self._locate(path), "index"))

        new = self.spark.read.schema(f"{INDEX}, bucket int").parquet(self.indexes[-1])
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        located = self._bucketed(self.indexes, INDEX, touched).join(new.select(*ENTITY).distinct(), ENTITY, "left_semi")
        # a reverted copy is an image as well: it touches its entity and revokes the other copies there
        rank = F.struct((-F.coalesce("at_us", F.lit(-(2**63) + 1))).alias("late"), F.col("amendment_id"), F.col("file"), F.col("pos"), F.col("deletes"))
        copies = located.groupBy(*ENTITY, "amendment_id").agg(F.min(rank).alias("d"), F.bool_or("reverted").alias("gone"))
        decides = copies.where("NOT gone").groupBy(*ENTITY).agg(F.min("d").alias("d"))
        stays = (F.col("d.file") == F.col("file")) & (F.col("d.pos") == F.col("pos")) & ~F.col("d.deletes")
        marked = located.join(decides, ENTITY, "left").withColumn("stays", F.coalesce(stays, F.lit(False)))
        bit = F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")
        words = marked.groupBy("file", F.expr("shiftright(pos, 6)").alias("word")).agg(
            F.bit_or(bit).alias("seen"), F.bit_or(F.when(~F.col("stays"), bit).otherwise(F.lit(0).cast("bigint"))).alias("dead")
        )
        where = self.scratch.path("marks")
        words.withColumn("batch", F.lit(len(self.marks))).select("file", "word", "batch", "seen", "dead").write.parquet(where)
        self.marks.append(where)

    @property
    def vectors(self) -> DataFrame:
        """(file, word, bits) of the words with a marked position: later batches overrule earlier ones on what they saw."""
        log = self._all(self.marks, MARKS)
        steps = F.sort_array(F.collect_list(F.struct("batch", "seen", "dead")))
        folded = F.aggregate(steps, F.lit(0).cast("bigint"), lambda bits, m: (bits.bitwiseAND(F.bitwise_not(m["seen"]))).bitwiseOR(m["dead"]))
        return log.groupBy("file", "word").agg(folded.alias("bits")).where("bits != 0")

    def read(self) -> DataFrame:
        """The live rows: every image whose position no bitmap marks.

        Up to ``FEW_WORDS`` words the bitmaps go to the scans of the images; more are joined.
        """
        rows = self._all(self.files, IMAGE)
        if not self.files:
            return rows
        seen = Observation()
        bitmaps = self.scratch.write(self.vectors.observe(seen, F.count("*").alias("n")), "vectors")
        placed = rows.select("*", F.xxhash64("_metadata.file_name").alias("file"), F.expr("shiftright(_metadata.row_index, 6)").alias("word"), F.expr("cast(pmod(_metadata.row_index, 64) as int)").alias("bit"))
        live = F.expr("bits IS NULL OR (shiftright(bits, bit) & 1) = 0")
        return placed.join(F.broadcast(bitmaps) if seen.get["n"] <= FEW_WORDS else bitmaps, ["file", "word"], "left").where(live).select(*rows.columns)

    def compact(self) -> None:
        """Rewrite the live rows into one set of files; later reverts of what was superseded can no longer be undone."""
        live, path = self.read(), self.scratch.path("images")
        live.write.parquet(path)
        self.files, self.indexes, self.marks = [path], [self._keep(self._locate(path), "index")], []


def replay(feed: DataFrame, batches: int = 3) -> DeleteVectorTable:
    """Apply a whole feed in ``batches`` arrival batches (by received_at; rows without it arrive first)."""
    table = DeleteVectorTable(feed.sparkSession)
    at = F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(2**62)))
    cuts = feed.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000).alias("c")).head()["c"] if batches > 1 else []
    number = F.lit(0)
    for cut in sorted(set(cuts or [])):
        number = number + (at > cut).cast("int")
    path = table.scratch.path("feed")
    changes = normalise_changes(spread(feed)).withColumn("batch", number)
    changes.write.partitionBy("batch").parquet(path)
    stored = feed.sparkSession.read.schema(changes.schema).parquet(path)
    for i in range(len(set(cuts or [])) + 1):
        table.apply(stored.where(F.col("batch") == i).drop("batch"))
    return table
