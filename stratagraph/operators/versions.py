"""Function histories: matching versions to histories, ordering and printing them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAME_FILE, ENOUGH = 1.0, 0.6
VERSIONS = "function string, seq bigint, commit_id string, file_path string, content string, history_id string, version_id string, previous_id string, score double"


def quick_ratio(a: str, b: str) -> float:
    """Twice the shared characters, counted with repeats, over both lengths; 1 for two empty texts."""
    return float(quick_ratios([a], [b])[0])


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (text, character) pairs that occur, as sorted numbers, and how often."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    return np.unique(row << 21 | codes, return_counts=True)


def quick_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``quick_ratio`` of the i-th texts of both lists."""
    (x, n), (y, m) = _counts(a), _counts(b)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.bincount(both >> 21, np.minimum(n[i], m[j]), len(a))
    sizes = np.array([len(s) + len(t) for s, t in zip(a, b)], np.float64)
    return np.where(sizes > 0, 2.0 * shared / np.maximum(sizes, 1.0), 1.0)


def quick_ratio_column(a: Column, b: Column) -> Column:
    """The same for columns, in Arrow batches (counting characters with SQL functions took ten times as long); null if one is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(quick_ratios(x.fillna("").tolist(), y.fillna("").tolist()), index=x.index)
        return out.where(x.notna() & y.notna())

    return ratio(a, b)


def open_histories(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(function, history_id, version_id, file_path, content): the last version of every stored history, to go on from."""
    history = edges.where("type = 'HAS_HISTORY'").select(F.col("source_id").alias("function"), F.col("target_id").alias("history_id"))
    version = edges.where("type = 'HAS_VERSION'").select(F.col("source_id").alias("history_id"), F.col("target_id").alias("version_id"))
    followed = edges.where("type = 'PREVIOUS_VERSION'").select(F.col("source_id").alias("version_id"))
    text = nodes.where("type = 'FUNCTION_VERSION'").select(F.col("id").alias("version_id"), F.col("attributes")["file_path"].alias("file_path"), F.col("attributes")["content"].alias("content"))
    return history.join(version, "history_id").join(followed, "version_id", "left_anti").join(text, "version_id").select("function", "history_id", "version_id", "file_path", "content")


def _digest(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode("utf-8", "surrogatepass")).hexdigest()[:8]


def match_versions(functions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Assign every function version (function, seq, commit_id, file_path, content) to a history.

    In commit order, per function: the open history with the best ratio (plus 1 in the same file; the first
    of equals) takes the version if its last file is the same or the score exceeds 0.6; otherwise a new
    history opens. Ids are hashes of their origin, so a rerun gives the same. Rows are sorted, not gathered: a
    task holds the open histories of one function, not its versions. Null contents count as empty. The
    histories of ``known`` (as ``open_histories`` gives them) are open from the start.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, open_ = None, []  # per open history: its id, last version, last content, last file
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.function != name:
                    name, open_ = row.function, []
                if not row.new:
                    open_.append([row.history_id, row.version_id, row.content, row.file_path])
                    continue
                same = np.array([h[3] == row.file_path for h in open_], np.float64)
                scores = SAME_FILE * same + quick_ratios([h[2] for h in open_], [row.content] * len(open_))
                first = int(scores.argmax()) if len(scores) else None  # of equal scores the first opened
                score = None if first is None else float(scores[first])
                if first is None or not (same[first] or score > ENOUGH):
                    first, score = len(open_), None
                    open_.append([f"HISTORY:{name}:{_digest(name, row.commit_id, row.file_path)}", None, None, None])
                history, previous = open_[first][:2]
                version = f"VERSION:{history}:{row.commit_id}:{_digest(row.content)}"
                out.append((row.function, row.seq, row.commit_id, row.file_path, row.content, history, version, previous, score))
                open_[first][1:] = version, row.content, row.file_path
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERSIONS.split(", ")])

    filled = lambda c: F.coalesce(c, F.lit("")).alias(c)
    none = F.lit(None).cast("string")
    rows = functions.where("function IS NOT NULL").select(F.lit(1).alias("new"), "function", "seq", filled("commit_id"), filled("file_path"), filled("content"), none.alias("history_id"), none.alias("version_id"))
    if known is not None:
        rows = rows.unionByName(known.where("function IS NOT NULL").select(F.lit(0).alias("new"), "function", F.lit(0).cast("bigint").alias("seq"), F.lit("").alias("commit_id"), filled("file_path"), filled("content"), "history_id", "version_id"))
    return rows.repartition("function").sortWithinPartitions("function", "new", "seq", "commit_id", "history_id", "file_path", "content").mapInPandas(run, VERSIONS)


def version_graph(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of matched versions."""
    from stratagraph.operators.build import edge, node, union

    s = F.col("seq")
    nodes = union(
        node(versions, "FUNCTION", F.col("function"), s, name=F.col("function")), node(versions, "FUNCTION_HISTORY", F.col("history_id"), s, function_name=F.col("function")),
        node(versions, "FUNCTION_VERSION", F.col("version_id"), s, content=F.col("content"), commit_id=F.col("commit_id"), file_path=F.col("file_path")),
    )
    edges = union(
        edge(versions, "MODIFIED_FUNCTION", F.col("commit_id"), F.col("function"), s), edge(versions, "HAS_HISTORY", F.col("function"), F.col("history_id"), s), edge(versions, "HAS_VERSION", F.col("history_id"), F.col("version_id"), s),
        edge(versions, "CREATED_VERSION", F.col("commit_id"), F.col("version_id"), s), edge(versions, "PREVIOUS_VERSION", F.col("previous_id"), F.col("version_id"), s),
    )
    return nodes, edges


def ordered_versions(edges: DataFrame) -> DataFrame:
    """(history_id, version_id, place): versions in the order of their PREVIOUS_VERSION edges, from 1.

    The chain is ranked by the hierarchy operator: a version's place is its depth among its predecessors.
    Of several predecessors the smallest counts; versions on a loop come last, by id.
    """
    from pyspark.sql import Window as W

    from stratagraph.operators.hierarchy import build_hierarchy

    version = edges.where("type = 'HAS_VERSION'").select(F.col("source_id").alias("history_id"), F.col("target_id").alias("id")).distinct()
    before = edges.where("type = 'PREVIOUS_VERSION'").select(F.col("target_id").alias("id"), F.col("source_id").alias("parent_id")).join(version.select("id"), "id", "left_semi")
    tree = build_hierarchy(version.select("id", F.lit(None).cast("string").alias("parent_id")).unionByName(before)).nodes
    placed = version.join(tree.select("id", "depth", "on_loop"), "id")
    return placed.select("history_id", F.col("id").alias("version_id"), F.row_number().over(W.partitionBy("history_id").orderBy("on_loop", "depth", "id")).alias("place"))


def history_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(history_id, place, text): one block per version: number, short commit id, message, content; 'Unknown' without a commit."""
    versions = nodes.where("type = 'FUNCTION_VERSION'").select(F.col("id").alias("version_id"), F.col("attributes")["content"].alias("content"), F.col("attributes")["commit_id"].alias("commit_id"))
    messages = nodes.where("type = 'COMMIT'").select(F.col("id").alias("commit_id"), F.col("attributes")["message"].alias("message"))
    rows = ordered_versions(edges).join(versions, "version_id").join(messages, "commit_id", "left")
    return rows.select("history_id", "place", F.format_string("V%d (%s): %s\n%s", "place", F.substring("commit_id", 1, 8), F.coalesce("message", F.lit("Unknown")), F.coalesce("content", F.lit(""))).alias("text"))
