"""The graph as versioned Parquet tables: an append log of rows, compacted into merged tables partitioned by type."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.model.merge import merge_edges, merge_nodes
from stratagraph.model.sanitize import sanitize, sanitize_map
from stratagraph.model.schemas import AMENDMENTS, EDGES, EMBEDDINGS, NODES
from stratagraph.operators.amend import replayed
from stratagraph.operators.changefeed import normalise_changes
from stratagraph.operators.search import Graph
from stratagraph.operators.vectors import upsert_embeddings
from stratagraph.session import Scratch

NODE_ROWS = "id string, type string, attributes map<string,string>, seq bigint"
EDGE_ROWS = "source_id string, target_id string, type string, weight double, attributes map<string,string>, seq bigint"


#: Rows of one type that a file of a compacted table holds.
FILE_ROWS = 1_000_000


class Catalog:
    """Tables under one folder; numbered JSON files name their versions, and the highest number counts.

    A change writes its tables first and then adds the next number by a rename, which fails if another writer
    was faster; readers see the state before or after, never between.
    """

    def __init__(self, spark: SparkSession, root: str, overwrite: bool = False) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if overwrite:
            self._fs.delete(self._path(self.root), True)
        self._fs.mkdirs(self._path(self.root))
        if not self._states():
            self._commit({"seq": 0, "nodes": [], "edges": [], "amendments": [], "embeddings": None, "base_nodes": None, "base_edges": None})

    def _states(self) -> list[str]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(n for n in names if n.startswith("state-"))

    @property
    def state(self) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{self._states()[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        number = state.pop("number", -1) + 1
        temporary = f"{self.root}/.new-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary), True)
        out.write(bytearray(json.dumps(state | {"number": number}).encode()))
        out.close()
        target = self._path(f"{self.root}/state-{number:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(self._path(temporary), target):
            raise RuntimeError("another writer changed the graph; read it again and repeat")

    def _new(self, name: str) -> str:
        return os.path.join(self.root, name, uuid.uuid4().hex)

    def append(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Add rows (with ``seq``, ordered after all rows stored before); attributes are sanitised."""
        state = self.state
        shift = F.lit(state["seq"]).cast("bigint")
        for name, rows, schema in (("nodes", nodes, NODE_ROWS), ("edges", edges, EDGE_ROWS)):
            if rows is not None:
                columns = [c.split()[0] for c in schema.replace("<string,string>", "").split(", ")]
                path = self._new(name)
                rows.withColumn("attributes", sanitize_map(F.col("attributes"))).withColumn("seq", F.col("seq") + shift).select(*columns).write.parquet(path)
                state[name].append(path)
        tops = [self.spark.read.parquet(state[n][-1]).agg(F.max("seq").alias("m")).head()["m"] for n, r in (("nodes", nodes), ("edges", edges)) if r is not None]
        state["seq"] = max([state["seq"], *[t + 1 for t in tops if t is not None]])
        self._commit(state)

    def _rows(self, name: str, schema: str) -> DataFrame:
        paths = self.state[name]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        """(id, type, attributes): merged on read until the next ``compact``."""
        base = self.state["base_nodes"]
        rows = self._rows("nodes", NODE_ROWS)
        if not base:
            return merge_nodes(rows)
        old = self.spark.read.schema(NODES).parquet(base)
        return old.select("id", "type", "attributes") if not self.state["nodes"] else merge_nodes(old.select("id", "type", "attributes", F.lit(-1).cast("bigint").alias("seq")).unionByName(rows))

    def edges(self) -> DataFrame:
        base = self.state["base_edges"]
        rows = self._rows("edges", EDGE_ROWS)
        if not base:
            return merge_edges(rows)
        old = self.spark.read.schema(EDGES).parquet(base).select("id", "source_id", "target_id", "type", "weight", "attributes")
        return old if not self.state["edges"] else merge_edges(old.drop("id").withColumn("seq", F.lit(-1).cast("bigint")).unionByName(rows))

    def compact(self) -> None:
        """Write the merged tables, partitioned by type, and empty the log; readers of the old version are not disturbed."""
        state = self.state
        for name, table in (("nodes", self.nodes()), ("edges", self.edges())):
            path = self._new(f"base_{name}")
            # a type of many rows is written by as many tasks as it fills files
            table = Scratch(self.spark, "compact").write(table, name)
            sizes = table.groupBy("type").count().select("type", F.ceil(F.col("count") / FILE_ROWS).cast("int").alias("files"))
            placed = table.join(sizes, "type").withColumn("part", F.pmod(F.xxhash64("id"), F.col("files")))
            placed.repartition("type", "part").drop("files", "part").write.partitionBy("type").parquet(path)
            state[f"base_{name}"], state[name] = path, []
        self._commit(state)

    def count_nodes(self) -> int:
        return self.nodes().count()

    def get_node(self, id_: str) -> dict | None:
        found = self.nodes().where(F.col("id") == id_).orderBy("type").head(1)
        return found[0].asDict() if found else None

    def of_type(self, kind: str) -> DataFrame:
        """Nodes of one type; after ``compact`` only its partition is read."""
        return self.nodes().where(F.col("type") == kind)

    def embeddings(self) -> DataFrame:
        path = self.state["embeddings"]
        return self.spark.read.schema(EMBEDDINGS).parquet(path) if path else self.spark.createDataFrame([], EMBEDDINGS)

    def put_embeddings(self, new: DataFrame, items: DataFrame | None = None) -> None:
        """Replace the vectors of the nodes that ``new`` names; ``items`` (node_id, node_type, text) are what was embedded, and remembered."""
        path = self._new("embeddings")
        upsert_embeddings(self.embeddings(), new).write.parquet(path)
        state = self.state
        if items is not None:
            told, digests = items.select("node_id", "node_type", F.sha2("text", 256).alias("digest")), self._new("digests")
            self.embedded().join(told.select("node_id", "node_type").distinct(), ["node_id", "node_type"], "left_anti").unionByName(told).write.parquet(digests)
            state["digests"] = digests
        state["embeddings"] = path
        self._commit(state)

    def embedded(self) -> DataFrame:
        """(node_id, node_type, digest): the texts whose vectors are stored."""
        path, schema = self.state.get("digests"), "node_id string, node_type string, digest string"
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def graph(self) -> Graph:
        return Graph(self.nodes(), self.edges(), self.embeddings())

    # ---- amendments ---------------------------------------------------------------------------------

    def log_amendment(self, action: str, entity_type: str, payload: dict) -> str:
        """Append an amendment (payload sanitised) and return its id."""
        row = (uuid.uuid4().hex, time.time(), action, entity_type, json.dumps(payload, sort_keys=True), 0)
        path = self._new("amendments")
        self.spark.createDataFrame([row], AMENDMENTS).withColumn("payload", sanitize(F.col("payload"))).write.parquet(path)
        state = self.state
        state["amendments"].append(path)
        self._commit(state)
        return row[0]

    def amendments(self) -> DataFrame:
        return self.spark.read.schema(AMENDMENTS).parquet(*self.state["amendments"]) if self.state["amendments"] else self.spark.createDataFrame([], AMENDMENTS)

    def amend(self, action: str, entity_type: str, payload: dict) -> str:
        """Log an add, update or delete of a node or edge; ids are required. It takes effect in ``amended``."""
        kind = action.rsplit("_", 1)[-1]
        needed = {"node": ["id"], "edge": ["source_id", "target_id"]}.get(kind)
        if needed is None or action.split("_")[0] not in ("add", "update", "delete"):
            raise ValueError(f"unknown action {action!r}")
        missing = [k for k in needed if not payload.get(k)]
        if missing:
            raise ValueError(f"payload lacks {', '.join(missing)}")
        return self.log_amendment(action, entity_type, payload)

    def revert(self, amendment_id: str) -> None:
        """Log a copy of an amendment marked as reverted; replaying leaves it out."""
        path = self._new("amendments")
        self.amendments().where(F.col("id") == amendment_id).limit(1).withColumn("reverted", F.lit(1)).write.parquet(path)
        state = self.state
        state["amendments"].append(path)
        self._commit(state)

    def amended(self) -> Graph:
        """The graph with the log replayed over it (``operators.amend.replayed``)."""
        log = self.amendments().withColumn("received_at", F.timestamp_seconds("timestamp"))
        return Graph(*replayed(self.nodes(), self.edges(), normalise_changes(log)), self.embeddings())

    def jdbc(self, url: str, table: str, **options: str) -> DataFrame:
        """A table of another database, read in parallel if ``options`` give partitionColumn, bounds and numPartitions."""
        return self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
