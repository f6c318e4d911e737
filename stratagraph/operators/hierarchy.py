"""Parent-child links to full hierarchies, as nested sets, in a logarithmic number of rounds.

Each node learns the sizes of all subtrees and its place in a preorder walk without any level-by-level
loop: pointers to the 2^k-th ancestor double each round, subtree sizes are summed upward along them
(the descendants within 2^(k+1) steps are those within 2^k steps of the node and of the nodes exactly
2^k below it), siblings get disjoint preorder ranges by prefix sums, and the offsets are summed downward
along the same pointers. A node that no round resolves is on a loop or leads into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stratagraph.operators.prefix import exclusive_prefix_sum
from stratagraph.session import Scratch

#: Children that one bucket of a parent should hold, and the most buckets of one parent.
SIBLINGS, MAX_BUCKETS = 100_000, 4_096
MAX_DOUBLINGS = 62


def first_parent_links(commits: DataFrame) -> DataFrame:
    """(id, parent_id) of the present commits: per id the row scanned last; the parent is the first entry.

    A null or empty list, a null first entry and a blank first entry mean no parent.
    """
    last = commits.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("parents"), F.struct(F.col("scanned_at"), F.col("parents"))).alias("c"))
    first = F.try_element_at("c.parents", F.lit(1))
    return last.select("id", F.when(F.trim(first) != "", first).alias("parent_id"))


@dataclass
class Hierarchy:
    """``nodes``: id, parent_id (null for roots), root_id, depth, lo, hi, descendants, on_loop.

    Inside a root, ``lo`` is the preorder position and [lo, hi) spans the subtree: u is an ancestor of v
    exactly if they share the root and u.lo < v.lo < u.hi. Nodes on or leading into a loop have
    on_loop true, the smallest id of the loop as root_id, depth -1 and null lo, hi, descendants.
    """

    nodes: DataFrame
    scratch: Scratch

    def ancestors(self, ids: DataFrame) -> DataFrame:
        """(id, ancestor_id, depth) for every id of ``ids``, the node itself included.

        Ranges are cut into dyadic intervals, so the stabbing query is an equi-join on (root, level,
        interval) whose matches are exactly the answers: no root's rows are compared pairwise.
        """
        tree = self.nodes.where(~F.col("on_loop"))
        wanted = tree.join(ids.select("id").distinct(), "id", "left_semi").select("id", "root_id", "lo")
        pieces = tree.select(F.col("id").alias("ancestor_id"), "root_id", "depth", F.explode(dyadic("lo", "hi")).alias("p")).select("ancestor_id", "root_id", "depth", "p.*")
        stabs = self._stabs(wanted)
        return stabs.join(pieces, ["root_id", "level", "cell"]).select("id", "ancestor_id", "depth")

    def _stabs(self, rows: DataFrame) -> DataFrame:
        """A row for the cell that ``lo`` lies in, on each level up to that of its whole tree."""
        sizes = self.nodes.where("parent_id IS NULL AND NOT on_loop").select("root_id", F.ceil(F.log2("hi")).cast("int").alias("top"))
        return rows.join(sizes, "root_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).withColumn("cell", F.expr("shiftright(lo, level)")).drop("top")

    def descendants(self, ids: DataFrame) -> DataFrame:
        """(id, descendant_id, depth) for every id of ``ids``, the node itself excluded; ranges as in ``ancestors``."""
        tree = self.nodes.where(~F.col("on_loop"))
        wanted = tree.join(ids.select("id").distinct(), "id", "left_semi")
        pieces = wanted.select("id", "root_id", F.explode(dyadic("lo", "hi")).alias("p")).select("id", "root_id", "p.*")
        below = self._stabs(tree.join(wanted.select("root_id").distinct(), "root_id", "left_semi").select(F.col("id").alias("descendant_id"), "root_id", "depth", "lo"))
        return below.join(pieces, ["root_id", "level", "cell"]).where("id != descendant_id").select("id", "descendant_id", "depth")

    def paths(self, ids: DataFrame) -> DataFrame:
        """(id, path): the chain from the root down to each id of ``ids``."""
        chain = self.ancestors(ids).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor_id"))).alias("c"))
        return chain.select("id", F.col("c.ancestor_id").alias("path"))


def dyadic(lo: str, hi: str):
    """The canonical dyadic intervals of [lo, hi) as array<struct<level, cell>>; fewer than 2 * log2(hi - lo) + 2."""
    return F.expr(
        f"""flatten(transform(sequence(0, cast(ceil(log2({hi} + 1)) as int)), j -> filter(array(
            named_struct('level', j, 'cell', shiftright({lo} + shiftleft(1L, j) - 1, j)),
            named_struct('level', j, 'cell', shiftright({hi}, j) - 1)),
            (x, i) -> shiftright({lo} + shiftleft(1L, j) - 1, j) < shiftright({hi}, j)
              AND ((i = 0 AND x.cell % 2 = 1) OR (i = 1 AND x.cell % 2 = 0)))))"""
    )


def build_hierarchy(links: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> Hierarchy:
    """Resolve parent links of unknown depth.

    Null ids are dropped; an id given repeatedly counts once, with its smallest non-null parent; a parent
    that is no id makes the node a root; a node that names itself is a loop of one. An empty table gives
    an empty result. Other columns are ignored, so they may clash with the names used here.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    raw = links.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent_id")).where("id IS NOT NULL").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    # the rounds run on numbers, fixed by this one write, instead of ids
    raw = scratch.write(raw.withColumn("num", F.monotonically_increasing_id()), "links")
    known = raw.select(F.col("id").alias("known"), F.col("num").alias("parent_num"))
    base = scratch.write(raw.join(known, raw.parent_id == known.known, "left").select("num", "id", F.col("known").alias("parent_id"), "parent_num"), "base")
    scratch.drop(raw)

    # upward: a round's rows are those not yet resolved. jump = the ancestor 2^k steps up (or the root, once done),
    # size = descendants within 2^k steps, itself included. Resolved rows are written once, in the round that resolves
    # them; what a node gains from below later is summed once from the rounds' rows.
    root = F.col("parent_num").isNull()
    one = F.lit(1).cast("bigint")
    start = base.select("num", F.coalesce("parent_num", "num").alias("jump"), F.when(root, 0).otherwise(1).cast("bigint").alias("dist"), one.alias("size"), root.alias("done"))
    state, left = _write_round(scratch, start, "up")
    rounds = [state]
    for k in range(MAX_DOUBLINGS):
        if left == 0:
            break
        open_ = _part([state], False)
        gains = open_.groupBy(F.col("jump").alias("gain_num")).agg(F.sum("size").alias("gain"))
        moved = open_.join(_far(rounds, "jump", "dist"), F.col("jump") == F.col("far_num")).select("num", F.col("far_jump").alias("jump"), (F.col("dist") + F.col("far_dist")).alias("dist"), "size", F.col("far_done").alias("done"))
        # sizes matter only to the next gains, which resolved rows no longer give
        grown = moved.join(gains, F.col("num") == F.col("gain_num"), "left").select("num", "jump", "dist", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"), "done")
        was = left
        state, left = _write_round(scratch, grown, "up")
        rounds.append(state)
        if left == was and k:
            break  # depths are contiguous: nothing resolved between 2^k and 2^(k+1) means nothing deeper exists

    gained = _part(rounds, False).groupBy(F.col("jump").alias("gain_num")).agg(F.sum("size").alias("gain"))
    trees = _part(rounds, True).select(F.col("num").alias("t_num"), F.col("jump").alias("root_num"), F.col("dist").alias("depth"))
    sized = trees.join(gained, F.col("t_num") == F.col("gain_num"), "left").select("t_num", "root_num", "depth", (F.coalesce("gain", F.lit(0)) + 1).alias("size"))
    resolved = scratch.write(base.join(sized, F.col("num") == F.col("t_num")).drop("t_num"), "resolved")
    placed = _preorder(scratch, resolved)
    roots = resolved.where("parent_num IS NULL").select(F.col("num").alias("r_num"), F.col("id").alias("root_id"))
    nodes = placed.join(roots, F.col("root_num") == F.col("r_num")).select(
        "id", "parent_id", "root_id", "depth", "lo", (F.col("lo") + F.col("size")).alias("hi"), (F.col("size") - 1).alias("descendants"), F.lit(False).alias("on_loop")
    )
    if left:
        loops = _loops(scratch, base.join(_part([state], False).select(F.col("num").alias("s_num")), F.col("num") == F.col("s_num"), "left_semi"))
        nothing = F.lit(None).cast("bigint")
        nodes = nodes.unionByName(
            loops.select("id", "parent_id", "root_id", F.lit(-1).cast("bigint").alias("depth"), nothing.alias("lo"), nothing.alias("hi"), nothing.alias("descendants"), F.lit(True).alias("on_loop"))
        )
    for r in rounds:
        scratch.drop(r)
    return Hierarchy(nodes, scratch)


def _part(rounds: list[DataFrame], done: bool) -> DataFrame:
    """The resolved or the open rows of all rounds, in one scan of their folders; in the last round open ones are on or lead into loops."""
    first = rounds[0]
    schema = first.drop("done").schema
    paths = [f"{r.scratch_path}/done={str(done).lower()}" for r in rounds if (r.resolved if done else r.left)]
    spark = first.sparkSession
    return (spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)).withColumn("done", F.lit(done))


def _far(rounds: list[DataFrame], *carried: str) -> DataFrame:
    """What a jump lands on: the open rows of the last round and the resolved rows of all, as far_num, far_jump, far_done and ``carried``."""
    rows = _part(rounds[-1:], False).unionByName(_part(rounds, True))
    return rows.select(*[F.col(c).alias(f"far_{c}") for c in dict.fromkeys(("num", "jump", "done", *carried))])


def _write_round(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a round's state; the number of unresolved nodes comes with the write, without another job."""
    seen = Observation()
    # resolved and open rows lie in folders of their own, so that either are read without the others
    out = scratch.write(df.observe(seen, F.count_if(~F.col("done")).alias("left"), F.count_if("done").alias("resolved")), name, by="done" if name != "ring" else None)
    out.left, out.resolved = seen.get["left"], seen.get["resolved"]
    return out, seen.get["left"]


def _preorder(scratch: Scratch, resolved: DataFrame) -> DataFrame:
    """Add lo, the preorder position inside the root; siblings are ordered by (hash bucket, id).

    A parent has one bucket for each ``SIBLINGS`` children, as far as their number can be bounded by its size.
    """
    parents = resolved.select(F.col("num").alias("p_num"), F.least(F.lit(MAX_BUCKETS), F.ceil(F.col("size") / SIBLINGS)).cast("bigint").alias("buckets"))
    children = resolved.where("parent_num IS NOT NULL").select("id", "num", "parent_num", "size").join(parents, F.col("parent_num") == F.col("p_num")).drop("p_num")
    bucket = F.pmod(F.xxhash64("id"), F.col("buckets"))
    offsets = exclusive_prefix_sum(children, ["parent_num"], "id", "size", "before", bucket).select("num", F.col("parent_num").alias("jump"), (F.col("before") + 1).alias("acc"), F.lit(False).alias("done"))
    roots = resolved.where("parent_num IS NULL").select("num", F.col("num").alias("jump"), F.lit(0).cast("bigint").alias("acc"), F.lit(True).alias("done"))
    state, left = _write_round(scratch, offsets.unionByName(roots), "down")
    rounds = [state]
    while left:
        moved = _part([state], False).join(_far(rounds, "acc"), F.col("jump") == F.col("far_num")).select("num", F.col("far_jump").alias("jump"), (F.col("acc") + F.col("far_acc")).alias("acc"), F.col("far_done").alias("done"))
        state, left = _write_round(scratch, moved, "down")
        rounds.append(state)
    places = _part(rounds, True).select(F.col("num").alias("s_num"), F.col("acc").alias("lo"))
    return resolved.join(places, F.col("num") == F.col("s_num")).drop("s_num")


def _loops(scratch: Scratch, own: DataFrame) -> DataFrame:
    """(id, parent_id, root_id) of the nodes on or leading into a loop; root_id is the loop's smallest id.

    jump = the node 2^k steps on, low = the smallest id of the 2^k nodes from here on. Once 2^k reaches every loop's
    length and every way into one, the low of the jump is the loop's smallest id. While that does not hold, some
    node's low of the jump changes with the next doubling: the stretch it spans then leaves the node that gave it.
    """
    own = scratch.write(own.select("num", "id", "parent_id", "parent_num"), "stuck")
    state = own.select("num", F.col("parent_num").alias("jump"), F.col("id").alias("low"), F.lit("").alias("found"))
    changed = -1
    while changed:
        far = state.select(F.col("num").alias("far_num"), F.col("jump").alias("far_jump"), F.col("low").alias("far_low"))
        moved = state.join(far, F.col("jump") == F.col("far_num")).select("num", F.col("far_jump").alias("jump"), F.least("low", "far_low").alias("low"), F.col("far_low").alias("found"), (F.col("far_low") == F.col("found")).alias("done"))
        before = state
        state, changed = _write_round(scratch, moved, "ring")
        scratch.drop(before)
    return own.join(state.select(F.col("num").alias("l_num"), F.col("found").alias("root_id")), F.col("num") == F.col("l_num"))
