"""Vectors: exact cosine search, chunking, embedding, and the items that are embedded."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 384
CHUNK, OVERLAP = 256, 50
CANDIDATES, SCORED, FLOOR = 200, 20, 0.20


def _similarity(query: np.ndarray):
    q = query / np.linalg.norm(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.float64).reshape(-1, len(q)) if batch.num_rows else np.empty((0, len(q)))
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            sim = (x[good] @ q) / size[good]
            keep = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([keep.column("node_id"), keep.column("node_type"), pa.array(sim)], names=["node_id", "node_type", "similarity"])

    return run


def similarities(embeddings: DataFrame, query: Sequence[float], node_types: list[str] | None = None) -> DataFrame:
    """(node_id, node_type, similarity): the best chunk of every node; zero, broken and other-width vectors are skipped."""
    rows = embeddings.where(F.size("embedding") == len(query))
    if node_types:
        rows = rows.where(F.col("node_type").isin(node_types))
    sims = rows.select("node_id", "node_type", "embedding").mapInArrow(_similarity(np.asarray(query, np.float64)), "node_id string, node_type string, similarity double")
    return sims.groupBy("node_id").agg(F.max(F.struct("similarity", "node_type")).alias("b")).select("node_id", "b.node_type", F.round("b.similarity", 6).alias("similarity"))


def top_similar(embeddings: DataFrame, query: Sequence[float], k: int = 5, node_types: list[str] | None = None) -> DataFrame:
    """The ``k`` nodes most similar to ``query``, ties by node id; at most ``k`` rows leave each task."""
    return similarities(embeddings, query, node_types).orderBy(F.desc("similarity"), "node_id").limit(k)


def mean_vector(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(pos, value): the element-wise mean of the vectors, as rows; null elements are ignored."""
    return rows.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def chunks(tokens: Sequence[int], size: int = CHUNK, overlap: int = OVERLAP) -> list[list[int]]:
    """Token windows of ``size`` at a stride of size - overlap; a text that fits stays whole."""
    if len(tokens) <= size:
        return [list(tokens)]
    return [list(tokens[a : a + size]) for a in range(0, len(tokens), size - overlap)]


def pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean of token states, to unit length; an empty mask gives zeros."""
    m = mask[:, None].astype(np.float32)
    mean = (states * m).sum(0) / max(float(m.sum()), 1e-9)
    return mean / max(float(np.linalg.norm(mean)), 1e-12)


def hashing_embedder(width: int = WIDTH) -> Callable[[str], list[np.ndarray]]:
    """A deterministic embedder without a model: words hashed to signed dimensions, pooled per chunk."""

    def embed(text: str) -> list[np.ndarray]:
        words = (text or "").lower().split()
        codes = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") for w in words], np.uint64)
        out = []
        for part in chunks(codes):
            total = np.zeros(width)
            for shift in (0, 16, 32) if len(part) else ():
                hashed = np.asarray(part, np.uint64) >> np.uint64(shift)
                np.add.at(total, (hashed % np.uint64(width)).astype(np.int64), np.where(hashed >> np.uint64(15) & np.uint64(1), 1.0, -1.0))
            mean = (total / max(1, len(part))).astype(np.float32)
            out.append(mean / np.float32(max(float(np.linalg.norm(mean)), 1e-12)))
        return out

    return embed


def onnx_embedder(model: str, tokenizer: str) -> Callable[[str], list[np.ndarray]]:
    """An embedder from ONNX model and tokenizer files, loaded once per worker."""
    state: dict = {}

    def embed(text: str) -> list[np.ndarray]:
        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            state["session"], state["tokenizer"] = onnxruntime.InferenceSession(model), Tokenizer.from_file(tokenizer)
        out = []
        for part in chunks(state["tokenizer"].encode(text or "").ids):
            feeds = {"input_ids": np.array([part], np.int64), "attention_mask": np.ones((1, len(part)), np.int64), "token_type_ids": np.zeros((1, len(part)), np.int64)}
            names = {i.name for i in state["session"].get_inputs()}
            out.append(pool(state["session"].run(None, {k: v for k, v in feeds.items() if k in names})[0][0], np.ones(len(part))))
        return out

    return embed


def embed_items(items: DataFrame, embedder: Callable[[str], list[np.ndarray]] | None = None) -> DataFrame:
    """(node_id, chunk_id, node_type, embedding) of items (node_id, node_type, text).

    Several items of one node and type are numbered on; null and blank texts give nothing.
    """
    make = embedder or hashing_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, i, k, v.astype(np.float32)) for n, k, t in zip(*[c.to_pylist() for c in batch.columns]) for i, v in enumerate(make(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.list_(pa.float32()))], names=["node_id", "chunk_id", "node_type", "embedding"])

    texts = items.select("node_id", "node_type", "text").where("trim(text) != ''")
    return texts.mapInArrow(run, "node_id string, chunk_id int, node_type string, embedding array<float>")


def upsert_embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored rows of nodes that ``new`` doesn't name, and the new rows."""
    return stored.join(new.select("node_id", "node_type").distinct(), ["node_id", "node_type"], "left_anti").unionByName(new)


def changed_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """The items whose text is not the one embedded before; ``stored`` holds (node_id, node_type, digest)."""
    told = items.withColumn("digest", F.sha2("text", 256))
    return told.join(stored.select("node_id", "node_type", "digest").distinct(), ["node_id", "node_type", "digest"], "left_anti").drop("digest")


def latest_versions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(function_id, version_id, attributes): the versions of each function's histories that no other follows."""
    history = edges.where("type = 'HAS_HISTORY'").select(F.col("source_id").alias("function_id"), F.col("target_id").alias("history_id"))
    version = edges.where("type = 'HAS_VERSION'").select(F.col("source_id").alias("history_id"), F.col("target_id").alias("version_id"))
    followed = edges.where("type = 'PREVIOUS_VERSION'").select(F.col("source_id").alias("version_id"))
    last = history.join(version, "history_id").join(followed, "version_id", "left_anti")
    return last.join(nodes.where("type = 'FUNCTION_VERSION'").select(F.col("id").alias("version_id"), "attributes"), "version_id").select("function_id", "version_id", "attributes")


def items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, node_type, text): what is embedded: symbols, functions' latest text, messages, commits' symbols, pull requests, tasks."""
    of = lambda kind, text, label=None: nodes.where(F.col("type") == kind).select(F.col("id").alias("node_id"), F.lit(label or kind).alias("node_type"), text.alias("text"))
    a = lambda k: F.col("attributes")[k]
    symbols = (
        edges.where("type = 'MODIFIED_SYMBOL'").select(F.col("target_id").alias("node_id"), F.col("source_id").alias("s"))
        .join(nodes.where("type = 'COMMIT'").select(F.col("id").alias("node_id")), "node_id", "left_semi")
        .groupBy("node_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("s"))).alias("text")).select("node_id", F.lit("COMMIT_SYMBOLS").alias("node_type"), "text")
    )
    functions = latest_versions(nodes, edges).select(F.col("function_id").alias("node_id"), F.lit("FUNCTION").alias("node_type"), a("content").alias("text"))
    out = of("SYMBOL", F.coalesce(a("name"), F.col("id"))).unionByName(functions).unionByName(of("COMMIT", a("message"), "COMMIT_MESSAGE")).unionByName(symbols)
    return out.unionByName(of("PULL_REQUEST", F.concat_ws(" ", a("title"), a("body")))).unionByName(of("CLICKUP_TASK", F.concat_ws(" ", a("title"), a("description")))).where("trim(text) != ''")
