"""The k most similar vectors of every vector: a hierarchical k-means tree searched best bin first.

The tree grows level by level: the top is fitted on a bounded sample (``SAMPLE`` rows) on the driver, then every leaf
that would still hold more than ``leaf_rows`` vectors is split on the executors by k-means over a bounded sample of
its own (``SUB_SAMPLE`` rows), until leaves have their size. Every vector is put into its leaf and sent, packed, to
the few leaves its best-bin-first search visits. How many leaves are visited is widened until the recall against
brute force, measured with ``PROBES`` queries from outside the fitting sample over all rows, reaches the target.
Where these have too few neighbours to measure it, more are drawn; where all drawn ones have, all leaves are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratagraph.session import Scratch

#: Bounds of what is fitted and measured on the driver: vectors of the fitting sample, calibration queries drawn at first.
SAMPLE, PROBES = 16_384, 512
#: Vectors that one leaf is split with, and how many of a sample a leaf stands on at least.
SUB_SAMPLE, LEAST = 8_192, 64
#: Leaves up to which the tree grows (its centroids, 1.5 KB each, go to every executor); beyond 330 million vectors leaves grow instead.
MAX_LEAVES = 65_536
#: Vectors that a leaf should hold, and the most that one task compares at once (larger leaves are split).
LEAF_ROWS, CELL_ROWS = 5_000, 16_384
BRANCHES, ROUNDS = 16, 8
#: Leaves a search reaches at least before it ranks them: a greedy descent alone often misses the best leaf.
LOOK = 12
TARGET_RECALL = 0.998
#: Groups of copies (with their keys about 100 bytes each) up to which they are broadcast.
FEW_COPIES = 200_000
#: Packed bytes that one search task should read.
TASK_BYTES = 24 << 20
PACKED = "cell bigint, kind int, node array<string>, chunk array<bigint>, same binary, vectors binary"
FOUND = "node_a string, chunk_a bigint, node_b string, chunk_b bigint, similarity double"


@dataclass
class Tree:
    """Centroids (unit length) of all nodes but the root; ``first[i]``/``count[i]`` give node i's children, -1 the root's."""

    centroids: np.ndarray
    first: np.ndarray
    count: np.ndarray
    root: tuple[int, int]
    leaf_of: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    reach: int = 0

    @property
    def leaves(self) -> int:
        return int((self.count == 0).sum())

    @property
    def levels(self) -> int:
        depth = np.ones(len(self.count), np.int64)
        for i in range(len(self.count)):  # children come behind their parent
            depth[self.first[i] : self.first[i] + self.count[i]] = depth[i] + 1
        return int(depth.max()) if len(depth) else 0

    def visit(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``wanted`` leaves of each row of ``x`` with the most similar centroids, of the first ``reach`` or more
        that a best-bin-first search comes to, and how much less similar each centroid is than the first.

        Every query holds a priority queue of nodes by cosine; the best is taken out, an inner node puts its
        children in, a leaf is visited. All queries advance together; queues are rows of one matrix that
        widens as nodes are opened.
        """
        given, wanted = min(wanted, self.leaves), min(max(wanted, self.reach or LOOK), self.leaves)
        out, score = np.full((len(x), wanted), -1, np.int64), np.zeros((len(x), wanted), np.float32)
        lo, n = self.root
        for a in range(0, len(x), 1024):
            q = x[a : a + 1024]
            width = n + 8 * BRANCHES
            ids, queue = np.zeros((len(q), width), np.int32), np.full((len(q), width), -np.inf, np.float32)
            ids[:, :n], queue[:, :n] = np.arange(lo, lo + n), q @ self.centroids[lo : lo + n].T
            seen, used, rows = np.zeros(len(q), np.int64), np.full(len(q), n), np.arange(len(q))
            while len(rows):
                slot = queue[rows, : used.max()].argmax(1)
                value, best = queue[rows, slot], ids[rows, slot]
                queue[rows, slot] = -np.inf
                leaf = self.count[best] == 0
                at = rows[leaf]
                out[a + at, seen[at]], score[a + at, seen[at]] = self.leaf_of[best[leaf]], value[leaf]
                seen[at] += 1
                inner, opened = rows[~leaf], best[~leaf]
                if len(inner) and (used[inner] + self.count[opened]).max() > queue.shape[1]:
                    more = queue.shape[1]
                    ids, queue = np.pad(ids, ((0, 0), (0, more))), np.pad(queue, ((0, 0), (0, more)), constant_values=-np.inf)
                by = np.argsort(opened, kind="stable")
                inner, opened = inner[by], opened[by]
                edge = np.append(np.flatnonzero(np.append(True, opened[1:] != opened[:-1])), len(opened)) if len(opened) else ()
                for i, j in zip(edge[:-1], edge[1:]):
                    who, child, m = inner[i:j], self.first[opened[i]], self.count[opened[i]]
                    place = used[who][:, None] + np.arange(m)
                    ids[who[:, None], place], queue[who[:, None], place] = np.arange(child, child + m), q[who] @ self.centroids[child : child + m].T
                    used[who] += m
                rows = rows[seen[rows] < wanted]
        rank = np.argsort(-score, axis=1, kind="stable")[:, :given]
        out, score = np.take_along_axis(out, rank, 1), np.take_along_axis(score, rank, 1)
        return out, score[:, :1] - score

    def graft(self, below: dict[int, Tree]) -> Tree:
        """This tree with its leaves, by number, opened into the trees of ``below``; leaves are numbered anew."""
        centroids, first, count, at = [self.centroids], self.first.copy(), self.count.copy(), len(self.centroids)
        firsts, counts, node_of = [first], [count], np.flatnonzero(self.count == 0)
        for leaf, tree in sorted(below.items()):
            first[node_of[leaf]], count[node_of[leaf]] = at + tree.root[0], tree.root[1]
            centroids.append(tree.centroids)
            firsts.append(np.where(tree.count > 0, tree.first + at, 0))
            counts.append(tree.count)
            at += len(tree.centroids)
        return _numbered(Tree(np.concatenate(centroids), np.concatenate(firsts), np.concatenate(counts), self.root))


def _numbered(tree: Tree) -> Tree:
    tree.leaf_of = np.cumsum(tree.count == 0) - 1
    return tree


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of non-empty clusters and each row's cluster."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    near = (x @ c.T).argmax(1)
    used, near = np.unique(near, return_inverse=True)
    return c[used], near


def fit_tree(sample: np.ndarray, leaf_size: int, seed: int = 7) -> Tree:
    """Split by k-means until a node holds at most ``leaf_size`` sample vectors or can't be split."""
    rng = np.random.default_rng(seed)
    centroids, first, count, todo, root = [], [], [], [(-1, np.arange(len(sample)))], (0, 0)
    while todo:
        node, rows = todo.pop()
        if node >= 0 and len(rows) <= leaf_size:
            continue
        k = min(BRANCHES, max(1 if node < 0 else 2, math.ceil(len(rows) / leaf_size)), len(rows))
        c, near = _means(sample[rows], k, rng)
        if node >= 0 and len(c) < 2:
            continue  # copies of one vector: a leaf, however many there are
        span = (len(centroids), len(c))
        if node < 0:
            root = span
        else:
            first[node], count[node] = span
        for j in range(len(c)):
            centroids.append(c[j])
            first.append(0)
            count.append(0)
            todo.append((span[0] + j, rows[near == j]))
    return _numbered(Tree(np.array(centroids, np.float32), np.array(first), np.array(count), root))


def _own(tree: Tree, limits: np.ndarray, width: int):
    """The vectors that leaves are split with: those of each leaf whose key lies under the leaf's limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, width)
            if not len(x):
                continue
            leaf = tree.visit(_unit(x), 1)[0][:, 0]
            here = _drawn(rows.column("key").to_numpy()) < limits[leaf]
            if here.any():
                yield pa.RecordBatch.from_arrays([pa.array(leaf[here]), pa.array([v.tobytes() for v in _unit(x[here])], pa.binary())], names=["leaf", "x"])

    return run


def _split(sizes: dict[int, int], width: int):
    """Over rows sorted by leaf: a tree for every leaf, as arrays; a leaf that can't be split has none."""

    def fit(leaf: int, held: list[bytes]) -> pa.RecordBatch | None:
        tree = fit_tree(np.frombuffer(b"".join(held), np.float32).reshape(-1, width), max(2, math.ceil(len(held) / sizes[leaf])))
        if len(tree.centroids) < 2:
            return None
        parts = [tree.centroids.tobytes(), tree.first.astype(np.int64).tobytes(), tree.count.astype(np.int64).tobytes(), np.array(tree.root, np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=["leaf", "centroids", "first", "count", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            for leaf, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if leaf != here:
                    if held and (made := fit(here, held)) is not None:
                        yield made
                    here, held = leaf, []
                held.append(x)
        if held and (made := fit(here, held)) is not None:
            yield made

    return run


def _drawn(key: np.ndarray) -> np.ndarray:
    """A number in [0, 1) by key: what decides about being drawn; probes are drawn from its upper end, samples from its lower."""
    return (key.view(np.uint64) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _grow(vectors: DataFrame, tree: Tree, expected: np.ndarray, leaf_rows: int, width: int) -> tuple[Tree, np.ndarray]:
    """Split every leaf expected to hold more than ``leaf_rows``, round by round; the tree and the expected rows of its leaves."""
    spark, whole = vectors.sparkSession, np.zeros(len(expected), bool)  # leaves that can't be split, as they hold copies
    of = lambda b: np.frombuffer(b, np.int64)
    while True:
        wanted = np.where(whole | (expected <= 1.5 * leaf_rows), 1, np.clip(np.ceil(expected / leaf_rows), 1, SUB_SAMPLE // LEAST)).astype(np.int64)
        room = MAX_LEAVES - tree.leaves
        for leaf in np.argsort(-expected):  # the largest first, as far as there is room
            wanted[leaf] = min(wanted[leaf], room + 1)
            room -= wanted[leaf] - 1
        opened = np.flatnonzero(wanted > 1)
        if not len(opened):
            return tree, expected
        limits = np.zeros(tree.leaves)
        limits[opened] = SUB_SAMPLE / expected[opened]
        drawn = vectors.mapInArrow(_own(tree, limits, width), "leaf bigint, x binary")
        tasks = min(len(opened), 4 * spark.sparkContext.defaultParallelism)
        made = drawn.repartition(tasks, "leaf").sortWithinPartitions("leaf").mapInArrow(_split({int(i): int(wanted[i]) for i in opened}, width), "leaf bigint, centroids binary, first binary, count binary, root binary").collect()  # at most MAX_LEAVES centroids
        below = {r["leaf"]: Tree(np.frombuffer(r["centroids"], np.float32).reshape(-1, width), of(r["first"]), of(r["count"]), tuple(of(r["root"]).tolist())) for r in made}
        old, tree = np.flatnonzero(tree.count == 0), tree.graft(below)
        came = np.full(len(tree.count), -1)
        came[old] = np.arange(len(old))
        for i in np.flatnonzero(tree.count):
            if came[i] >= 0:
                came[tree.first[i] : tree.first[i] + tree.count[i]] = came[i]
        leaves = came[tree.count == 0]
        several = np.bincount(leaves, minlength=len(old))
        whole = whole[leaves] | (np.isin(leaves, opened) & (several[leaves] == 1))
        expected = expected[leaves] / several[leaves]  # the parts of a leaf are even by its sample


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _usable(batch: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose vector has ``width`` finite numbers, not all zero, and these vectors."""
    flat = batch.column("embedding").flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return batch.filter(pa.array(good)), x[good]


def _pack(x: np.ndarray) -> bytes:
    """Lossless: the four byte planes of the floats one after the other, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.float32).reshape(-1, width)


def _vectors(df: DataFrame, width: int) -> DataFrame:
    return df.where(F.size("embedding") == width).where("node_id IS NOT NULL AND chunk_id IS NOT NULL").select(
        "node_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding", F.xxhash64("node_id").alias("same"), F.xxhash64("node_id", F.col("chunk_id").cast("bigint")).alias("key"),
        F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"),
    )


def _copies(scratch: Scratch, vectors: DataFrame) -> DataFrame | None:
    """(h1, h2, node_r, chunk_r, mixed): vectors that several keys share, with the key that stands for them; None if there are none.

    ``mixed`` tells whether they belong to more than one node.
    """
    key = F.struct("node_id", "chunk_id")
    groups = vectors.groupBy("h1", "h2").agg(F.min(key).alias("a"), F.max(key).alias("z")).where("a != z")
    table = scratch.write(groups.select("h1", "h2", F.col("a.node_id").alias("node_r"), F.col("a.chunk_id").alias("chunk_r"), (F.col("a.node_id") != F.col("z.node_id")).alias("mixed")), "groups")
    if not table.head(1):
        return None
    usable = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    few = table.count() <= FEW_COPIES
    one = (F.col("node_id") == F.col("node_r")) & (F.col("chunk_id") == F.col("chunk_r"))
    good = vectors.join(F.broadcast(table) if few else table, ["h1", "h2"]).where(one).where(usable).select("h1", "h2", "node_r", "chunk_r", "mixed").distinct()
    copies = scratch.write(good, "copies")
    return copies if copies.head(1) else None


def _standing(vectors: DataFrame, copies: DataFrame) -> DataFrame:
    """The vectors without the copies another key stands for; one that stands for several nodes excludes none of them."""
    few = copies.count() <= FEW_COPIES
    joined = vectors.join(F.broadcast(copies) if few else copies, ["h1", "h2"], "left")
    kept = joined.where(F.col("node_r").isNull() | ((F.col("node_id") == F.col("node_r")) & (F.col("chunk_id") == F.col("chunk_r"))))
    return kept.select("node_id", "chunk_id", "embedding", F.when(F.col("mixed"), F.xxhash64("h1", "h2", F.lit("copies"))).otherwise(F.col("same")).alias("same"), "key", "h1", "h2")


def _spread(found: DataFrame, vectors: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """From neighbours of standing vectors to neighbours of all: copies are neighbours of each other and share the others.

    Of a group at most ``k`` keys of a node and 2 * ``k`` in all can be among anyone's ``k`` nearest, since a
    query leaves out one node only; longer lists are cut there (before the shuffle, by Spark's partial
    ranking), and every key of a group then picks from its group's list.
    """
    first = lambda df, by, order, n: df.withColumn("__i", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__i") <= n).drop("__i")
    members = vectors.select("node_id", "chunk_id", "h1", "h2").distinct().join(copies, ["h1", "h2"]).select("node_r", "chunk_r", F.col("node_id").alias("node_m"), F.col("chunk_id").alias("chunk_m"))
    listed = first(first(members, ["node_r", "chunk_r", "node_m"], ["chunk_m"], k), ["node_r", "chunk_r"], ["node_m", "chunk_m"], 2 * k)
    at = (F.col("node_b") == F.col("node_r")) & (F.col("chunk_b") == F.col("chunk_r"))
    opened = found.join(listed, at, "left").select("node_a", "chunk_a", F.coalesce("node_m", "node_b").alias("node_b"), F.coalesce("chunk_m", "chunk_b").alias("chunk_b"), "similarity")
    own = listed.select(F.col("node_r").alias("node_a"), F.col("chunk_r").alias("chunk_a"), F.col("node_m").alias("node_b"), F.col("chunk_m").alias("chunk_b"), F.lit(1.0).alias("similarity"))
    order = [F.desc("similarity"), "node_b", "chunk_b"]
    both = first(first(opened.unionByName(own), ["node_a", "chunk_a", "node_b"], [F.desc("similarity"), "chunk_b"], k), ["node_a", "chunk_a"], order, 2 * k)
    lists = both.groupBy("node_a", "chunk_a").agg(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "node_b", "chunk_b"))).alias("list"))
    who = lists.join(members, (F.col("node_a") == F.col("node_r")) & (F.col("chunk_a") == F.col("chunk_r")), "left").select(F.coalesce("node_m", "node_a").alias("node_a"), F.coalesce("chunk_m", "chunk_a").alias("chunk_a"), "list")
    picked = F.slice(F.filter("list", lambda x: x["node_b"] != F.col("node_a")), 1, k)
    return who.select("node_a", "chunk_a", F.explode(picked).alias("x")).select("node_a", "chunk_a", "x.node_b", "x.chunk_b", (-F.col("x.minus")).alias("similarity"))


def _probe(tree: Tree, probes: np.ndarray, same: np.ndarray, k: int, floor: float, width: int):
    """Brute force of the probes against every batch: (probe, similarity, leaf and key of the neighbour)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, width)
            if not len(x):
                continue
            once = np.unique(rows.column("key").to_numpy(), return_index=True)[1]  # repeated rows would crowd out others
            rows, x = rows.take(pa.array(once)), _unit(x[once])
            for a in range(0, len(probes), PROBES):
                sims = probes[a : a + PROBES] @ x.T
                sims[same[a : a + PROBES, None] == rows.column("same").to_numpy()[None, :]] = -2
                p, j = np.nonzero(sims >= floor)
                if not len(p):
                    continue
                top = _top(p, sims[p, j], k)
                p, j = p[top], j[top]
                used, inverse = np.unique(j, return_inverse=True)
                leaf = tree.visit(x[used], 1)[0][inverse, 0]
                key = rows.column("key").to_numpy()[j]
                yield pa.RecordBatch.from_arrays([pa.array(a + p), pa.array(sims[p, j].astype(np.float64)), pa.array(leaf), pa.array(key)], names=["probe", "similarity", "leaf", "key"])

    return run


def _top(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest values of each group."""
    order = np.lexsort((-value, group))
    g = group[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[place < k]


def _send(tree: Tree, splits: np.ndarray, visits: int, margin: float, width: int):
    """Each vector once as a row of its leaf's cell, and as a query to every other cell it visits, packed per cell."""
    begin = np.cumsum(splits) - splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _usable(batch, width)
            if not len(x):
                continue
            order, gaps = tree.visit(_unit(x), visits)
            order = np.where(gaps <= margin, order, -1)
            own = begin[order[:, 0]] + rows.column("key").to_numpy().view(np.uint64) % splits[order[:, 0]].astype(np.uint64)
            own = own.astype(np.int64)
            at, leaf = np.nonzero(order >= 0)[0], order[order >= 0]
            reps = splits[leaf]
            cell = np.repeat(begin[leaf], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            at = np.repeat(at, reps)
            other = cell != own[at]
            for kind, who, cells in ((0, np.arange(len(x)), own), (1, at[other], cell[other])):
                if not len(who):
                    continue
                sort = np.argsort(cells, kind="stable")
                who, cells = who[sort], cells[sort]
                edge = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                offsets = pa.array(np.append(edge, len(cells)), pa.int32())
                spans = list(zip(edge, np.append(edge[1:], len(cells))))
                take = pa.array(who)
                same = rows.column("same").to_numpy()[who]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells[edge]), pa.array(np.full(len(edge), kind, np.int32)),
                        pa.ListArray.from_arrays(offsets, rows.column("node_id").take(take)), pa.ListArray.from_arrays(offsets, rows.column("chunk_id").take(take)),
                        pa.array([same[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([_pack(x[who[a:b]]) for a, b in spans], pa.binary()),
                    ],
                    names=["cell", "kind", "node", "chunk", "same", "vectors"],
                )

    return run


class _Block:
    """Unpacked vectors of one cell with their keys."""

    def __init__(self, parts: list[tuple]) -> None:
        self.node = np.concatenate([p[0] for p in parts])
        self.chunk = np.concatenate([p[1] for p in parts])
        self.same = np.concatenate([p[2] for p in parts])
        self.x = _unit(np.concatenate([p[3] for p in parts]))

    def once(self) -> _Block:
        """Repeated (node, chunk) rows once."""
        keep = np.sort(np.unique(np.stack([self.same, self.chunk]), axis=1, return_index=True)[1])
        self.node, self.chunk, self.same, self.x = self.node[keep], self.chunk[keep], self.same[keep], self.x[keep]
        return self


def _compare(q: _Block, base: _Block, k: int, floor: float) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(q.x), 1024):
        sims = q.x[a : a + 1024] @ base.x.T
        i, j = np.nonzero(sims >= floor - 1e-4)
        different = q.same[a + i] != base.same[j]
        i, j = i[different], j[different]
        if not len(i):
            continue
        rough = sims[i, j]
        if len(i) > 2 * k * len(sims):  # dense neighbourhoods: only what can still be among the k, with room for rounding
            near = _top(i, rough, 2 * k)
            i, j = i[near], j[near]
        exact = np.einsum("ij,ij->i", q.x[a + i], base.x[j], dtype=np.float64)
        enough = exact >= floor
        i, j, exact = i[enough], j[enough], exact[enough]
        top = _top(i, exact, k)
        i, j, exact = a + i[top], j[top], exact[top]
        yield pa.RecordBatch.from_arrays([pa.array(q.node[i], pa.string()), pa.array(q.chunk[i], pa.int64()), pa.array(base.node[j], pa.string()), pa.array(base.chunk[j], pa.int64()), pa.array(exact, pa.float64())], names=[c.split()[0] for c in FOUND.split(", ")])


def _search(k: int, floor: float, width: int):
    """Over rows sorted by (cell, kind): gather a cell's own vectors, compare them, then stream its queries past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, base = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                here, kind = batch.column("cell")[r].as_py(), batch.column("kind")[r].as_py()
                if here != cell:
                    if parts:
                        base = _Block(parts).once()
                        yield from _compare(base, base, k, floor)
                    cell, parts, base = here, [], None
                block = (
                    np.array(batch.column("node")[r].as_py(), dtype=object), np.array(batch.column("chunk")[r].as_py(), np.int64),
                    np.frombuffer(batch.column("same")[r].as_py(), np.int64), _unpack(batch.column("vectors")[r].as_py(), width),
                )
                if kind == 0:
                    parts.append(block)
                    continue
                if parts:
                    base, parts = _Block(parts).once(), []
                    yield from _compare(base, base, k, floor)
                if base is not None:
                    yield from _compare(_Block([block]), base, k, floor)
        if parts:
            base = _Block(parts).once()
            yield from _compare(base, base, k, floor)

    return run


@dataclass
class Index:
    """A fitted tree, how far a search goes in it, and the recall measured that way.

    A search visits at most ``visits`` leaves, and of these the ones whose centroid is at most ``margin``
    less similar than the first leaf's; ``mean_visits`` is what that comes to on the probes.
    """

    tree: Tree
    splits: np.ndarray
    rows: int
    visits: int = 1
    margin: float = 0.0
    recall: float = 1.0
    mean_visits: float = 1.0


def _draw(vectors: DataFrame, rows: int, number: int, top: bool, width: int) -> tuple[pa.RecordBatch, np.ndarray] | None:
    """About ``number`` usable rows by hash of their key, from the lower or the upper end of ``_drawn``; None if there are none."""
    share, at = min(1.0, number / max(rows, 1)), F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    table = vectors.where(at >= 1 - share if top else at < share).toArrow().combine_chunks()
    if not table.num_rows:
        return None
    kept, x = _usable(table.to_batches(max_chunksize=table.num_rows)[0], width)
    return (kept, _unit(x)) if len(x) else None


def fit_index(df: DataFrame, k: int = 10, floor: float = -1.0, width: int = 384, target: float = TARGET_RECALL, leaf_rows: int | None = None) -> Index | None:
    """Fit the tree level by level and calibrate the number of visits; None if there is no usable vector."""
    rows, leaf_rows = df.count(), leaf_rows or LEAF_ROWS
    vectors = _vectors(df, width).drop("h1", "h2")
    got = _draw(vectors, rows, SAMPLE, False, width)
    if got is None and not vectors.head(1):
        return None
    kept, sample = got or (None, np.eye(1, width, dtype=np.float32))  # no usable vector in the sample: one leaf for all
    # a leaf of the top stands on LEAST vectors of the sample at least
    tree = fit_tree(sample, max(8 if rows <= SAMPLE else LEAST, round(leaf_rows * len(sample) / max(rows, 1))))
    expected = np.bincount(tree.visit(sample, 1)[0][:, 0], minlength=tree.leaves) / len(sample) * rows
    if kept is not None and rows > SAMPLE:
        tree, expected = _grow(vectors, tree, expected, leaf_rows, width)
    splits = np.maximum(1, np.ceil(expected / CELL_ROWS)).astype(np.int64)
    if kept is None or tree.leaves == 1:
        return Index(tree, splits, rows)
    asked = _draw(vectors, rows, 8 * PROBES, True, width) or got
    # a key is a hash, so the probes come from everywhere in the table; repeated rows are drawn once
    drawn = np.unique(asked[0].column("key").to_numpy(), return_index=True)[1][: max(8 * PROBES, SAMPLE)]
    enough = math.ceil(1 / max(1 - target, 1e-9))  # fewer neighbours can't show a miss of 1 - target
    place = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("similarity"), "key"))
    pairs, a, size = [], 0, PROBES
    while a < len(drawn) and len(pairs) < enough:
        now = drawn[a : a + size]
        hits = vectors.mapInArrow(_probe(tree, asked[1][now], asked[0].column("same").to_numpy()[now], k, floor, width), "probe bigint, similarity double, leaf bigint, key bigint").distinct()
        best = hits.withColumn("place", place).where(F.col("place") <= k).select("probe", "leaf").collect()  # at most k a probe
        pairs += [(now[r["probe"]], r["leaf"]) for r in best]
        a, size = a + len(now), 4 * size
    if len(pairs) < enough:
        return Index(tree, splits, rows, tree.leaves, math.inf, 1.0, float(tree.leaves))  # too little to calibrate on: compare all
    who, at = np.unique([p for p, _ in pairs], return_inverse=True)
    leaf = np.array([x for _, x in pairs])
    # the visits alone reach somewhat more than the target, the margin then takes back what is above it
    more, tree.reach = target + 0.5 * (1 - target), min(LOOK, tree.leaves)
    while True:
        order, gaps = tree.visit(asked[1][who], tree.reach)
        hit = order[at] == leaf[:, None]
        found, rank = hit.any(1), hit.argmax(1)
        if found.mean() >= more or tree.reach >= tree.leaves:
            break
        tree.reach = min(2 * tree.reach, tree.leaves)  # widen: the search goes on through its queue
    visits = next((v for v in range(1, tree.reach + 1) if (found & (rank < v)).mean() >= more), tree.reach)
    gap = gaps[at, rank]
    inside = np.sort(gap[found & (rank < visits)])
    margin = float(inside[min(len(inside), math.ceil(target * len(gap))) - 1]) + 1e-6
    reached = found & (rank < visits) & (gap <= margin)
    gaps = tree.visit(asked[1][drawn[:PROBES]], visits)[1]
    return Index(tree, splits, rows, visits, margin, float(reached.mean()), float((gaps <= margin).sum(1).mean()))


def nearest(df: DataFrame, k: int = 10, floor: float = -1.0, width: int = 384, target: float = TARGET_RECALL, index: Index | None = None, leaf_rows: int | None = None) -> DataFrame:
    """(node_a, chunk_a, node_b, chunk_b, similarity): the k most similar vectors of other nodes, of every vector.

    Only neighbours of a cosine of at least ``floor`` are given, and the recall is calibrated on these.
    Vectors that are null, of another width, all zero or hold a null, NaN or infinity, and rows without
    node or chunk take no part; repeated (node_id, chunk_id) rows count once. Of equal similarities the
    smaller (node_b, chunk_b) comes first, except within rounding. Copies of one vector under several keys go
    through the search once and get their neighbours afterwards. A leaf that holds many rows is split into cells, each compared
    with all queries of the leaf, so no task gathers it. An empty table gives an empty result.
    """
    index = index or fit_index(df, k, floor, width, target, leaf_rows)
    if index is None:
        return df.sparkSession.createDataFrame([], FOUND)
    spark = df.sparkSession
    vectors = _vectors(df, width)
    copies = _copies(Scratch(spark, "neighbours"), vectors)
    standing = vectors if copies is None else _standing(vectors, copies)
    wanted = k if copies is None else 2 * k
    sent = standing.drop("h1", "h2").mapInArrow(_send(index.tree, index.splits, index.visits, index.margin, width), PACKED)
    packed = index.rows * index.mean_visits * width * 2
    tasks = min(int(index.splits.sum()), max(2 * spark.sparkContext.defaultParallelism, math.ceil(packed / TASK_BYTES)))
    found = sent.repartition(max(1, tasks), "cell").sortWithinPartitions("cell", "kind").mapInArrow(_search(wanted, floor, width), FOUND)
    once = found.repartition("node_a", "chunk_a").groupBy("node_a", "chunk_a", "node_b", "chunk_b").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(W.partitionBy("node_a", "chunk_a").orderBy(F.desc("similarity"), "node_b", "chunk_b"))
    best = once.withColumn("place", place).where(F.col("place") <= wanted).drop("place")
    return best if copies is None else _spread(best, vectors, copies, k)


def similar_pairs(df: DataFrame, k: int = 10, floor: float = 0.6, width: int = 384) -> DataFrame:
    """(node_a, chunk_a, node_b, chunk_b): pairs of different nodes, smaller node first, of which one is among the other's ``k``."""
    near = nearest(df, k, floor, width)
    turned = F.col("node_a") > F.col("node_b")
    pick = lambda a, b, c: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(c)
    return near.select(pick("node_a", "node_b", "node_a"), pick("chunk_a", "chunk_b", "chunk_a"), pick("node_b", "node_a", "node_b"), pick("chunk_b", "chunk_a", "chunk_b")).distinct()


def measured_recall(df: DataFrame, queries: int = 512, k: int = 10, floor: float = 0.6, width: int = 384, leaf_rows: int = 256, least: float = 0.95) -> DataFrame:
    """(queries, pairs, reached): the neighbours at ``floor`` or above that brute force over all rows finds for a fixed
    number of queries, and whether a search through leaves of ``leaf_rows`` finds the share ``least`` of them.

    The queries are the keys of the smallest SHA-256; they and their neighbours are bounded by ``queries`` and ``k``.
    """
    key = F.sha2(F.concat_ws(":", "node_id", "chunk_id"), 256)
    vectors = _vectors(df, width)
    usable = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = vectors.where(usable).select("node_id", "chunk_id", "embedding", "same", key.alias("sha")).distinct().orderBy("sha").limit(queries).toArrow().combine_chunks()
    spark = df.sparkSession
    if not asked.num_rows:
        return spark.createDataFrame([(0, 0, True)], "queries bigint, pairs bigint, reached boolean")
    x = _unit(asked.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
    one = _numbered(Tree(np.zeros((1, width), np.float32), np.zeros(1, np.int64), np.zeros(1, np.int64), (0, 1)))
    hits = vectors.drop("h1", "h2").mapInArrow(_probe(one, x, asked.column("same").to_numpy(), k, floor - 1e-6, width), "probe bigint, similarity double, leaf bigint, key bigint")
    place = F.row_number().over(W.partitionBy("probe").orderBy(F.desc("similarity"), "key"))
    true = hits.select("probe", "similarity", "key").distinct().withColumn("place", place).where(F.col("place") <= k).select("probe", "key")
    number = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(zip(asked.column("node_id").to_pylist(), asked.column("chunk_id").to_pylist()))], "node_a string, chunk_a bigint, probe bigint")
    near = nearest(df, k, floor, width, leaf_rows=leaf_rows).join(F.broadcast(number), ["node_a", "chunk_a"]).select("probe", F.xxhash64("node_b", "chunk_b").alias("key"), F.lit(1).alias("found"))
    both = true.join(near, ["probe", "key"], "left").agg(F.count("*").alias("pairs"), F.count("found").alias("found"))
    return both.select(F.lit(asked.num_rows).cast("bigint").alias("queries"), "pairs", (F.col("found") >= least * F.col("pairs")).alias("reached"))
