"""Queries of the general data-processing operators: hierarchies, change feeds, orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators.changefeed import replay
from stratagraph.operators.hierarchy import build_hierarchy, first_parent_links
from stratagraph.operators.orphans import orphan_references, orphan_report


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = build_hierarchy(first_parent_links(_t(spark, sf_dir, "commits"))).nodes
    return nodes.select(F.col("id").alias("commit_id"), "root_id", "depth")


def p1_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested-set ranges of every commit: its place, the number of commits below it, loops marked."""
    nodes = build_hierarchy(first_parent_links(_t(spark, sf_dir, "commits"))).nodes
    return nodes.select(F.col("id").alias("commit_id"), "parent_id", "root_id", "depth", "lo", "hi", "descendants", "on_loop")


def p1_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every commit the number of commits below it, from the width of its range."""
    nodes = build_hierarchy(first_parent_links(_t(spark, sf_dir, "commits"))).nodes
    return nodes.where("NOT on_loop").select(F.col("id").alias("commit_id"), "root_id", "depth", "descendants")


def p1_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of first parents from the root to every commit that is not on a loop or leading into one."""
    tree = build_hierarchy(first_parent_links(_t(spark, sf_dir, "commits")))
    return tree.paths(tree.nodes.where("NOT on_loop").select("id")).select(F.col("id").alias("commit_id"), F.concat_ws("/", "path").alias("path"))


def p1_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every commit all commits below it, one row each, by stabbing the ranges."""
    tree = build_hierarchy(first_parent_links(_t(spark, sf_dir, "commits")))
    return tree.descendants(tree.nodes.where("descendants > 0").select("id")).select(F.col("id").alias("commit_id"), "descendant_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(_t(spark, sf_dir, "amendments")).read().select("entity_type", "entity_key", "amendment_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_t(spark, sf_dir, "edges"), _t(spark, sf_dir, "nodes"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_t(spark, sf_dir, "edges"), _t(spark, sf_dir, "nodes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranges, p1_subtrees, p1_chains, p1_below, p5_found, p6_found, p6_report)}

_LINKS = """
last AS (SELECT id, arg_max(coalesce(parents, []), scanned_at) AS p FROM commits WHERE id IS NOT NULL GROUP BY id),
link AS (SELECT l.id, k.id AS parent_id FROM last l LEFT JOIN last k ON k.id = CASE WHEN trim(l.p[1]) <> '' THEN l.p[1] END),
tree AS (SELECT id, id AS root_id, CAST(0 AS BIGINT) AS depth FROM link WHERE parent_id IS NULL
         UNION ALL SELECT l.id, t.root_id, t.depth + 1 FROM link l JOIN tree t ON l.parent_id = t.id),
stuck AS (SELECT id, parent_id FROM link WHERE id NOT IN (SELECT id FROM tree)),
walk AS (SELECT id AS start, parent_id AS pos FROM stuck UNION SELECT w.start, s.parent_id FROM walk w JOIN stuck s ON s.id = w.pos),
ring AS (SELECT start AS id FROM walk WHERE start = pos),
looped AS (SELECT start AS id, min(pos) AS root_id FROM walk WHERE pos IN (SELECT id FROM ring) GROUP BY start)"""

_STATES = """
state AS (SELECT id, arg_max(deleted_at IS NOT NULL, updated_at) AS deleted, min(created_at) AS arrival FROM nodes GROUP BY id),
refs AS (SELECT id, 'source' AS side, source_id AS ref, created_at FROM edges UNION ALL SELECT id, 'target', target_id, created_at FROM edges),
kinds AS (SELECT DISTINCT r.id AS edge_id, side,
            CASE WHEN s.id IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN arrival > created_at THEN 'late' END AS kind,
            strftime(created_at, '%Y-%m') AS period
          FROM refs r LEFT JOIN state s ON s.id = r.ref WHERE ref IS NOT NULL)"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT id AS commit_id, root_id, depth FROM tree UNION ALL SELECT id, root_id, CAST(-1 AS BIGINT) FROM looped",
    "p1_subtrees": f"""WITH RECURSIVE {_LINKS}, up AS (SELECT id AS commit_id, parent_id AS above FROM link UNION ALL SELECT up.commit_id, l.parent_id FROM up JOIN link l ON l.id = up.above JOIN tree t ON t.id = l.id WHERE l.parent_id IS NOT NULL)
SELECT tree.id AS commit_id, root_id, depth, count(up.commit_id) AS descendants FROM tree LEFT JOIN up ON up.above = tree.id GROUP BY ALL""",
    "p1_ranges": f"""WITH RECURSIVE {_LINKS}, up AS (SELECT id AS commit_id, parent_id AS above FROM link UNION ALL SELECT up.commit_id, l.parent_id FROM up JOIN link l ON l.id = up.above JOIN tree t ON t.id = l.id WHERE l.parent_id IS NOT NULL),
size AS (SELECT tree.id, root_id, depth, count(up.commit_id) AS below FROM tree LEFT JOIN up ON up.above = tree.id GROUP BY ALL),
step AS (SELECT l.id, l.parent_id, 1 + coalesce(sum(s.below + 1) OVER (PARTITION BY l.parent_id ORDER BY l.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step FROM link l JOIN size s ON s.id = l.id WHERE l.parent_id IS NOT NULL),
place AS (SELECT id, CAST(0 AS HUGEINT) AS lo FROM link WHERE parent_id IS NULL UNION ALL SELECT step.id, place.lo + step.step FROM step JOIN place ON step.parent_id = place.id)
SELECT s.id AS commit_id, l.parent_id, root_id, depth, CAST(lo AS BIGINT) AS lo, CAST(lo + below + 1 AS BIGINT) AS hi, below AS descendants, false AS on_loop FROM size s JOIN place p ON p.id = s.id JOIN link l ON l.id = s.id
UNION ALL SELECT k.id, l.parent_id, root_id, CAST(-1 AS BIGINT), NULL, NULL, NULL, true FROM looped k JOIN link l ON l.id = k.id""",
    "p1_chains": f"""WITH RECURSIVE {_LINKS}, paths AS (SELECT id, id AS path FROM link WHERE parent_id IS NULL UNION ALL SELECT l.id, p.path || '/' || l.id FROM link l JOIN paths p ON l.parent_id = p.id)
SELECT id AS commit_id, path FROM paths""",
    "p1_below": f"""WITH RECURSIVE {_LINKS}, below AS (SELECT l.parent_id AS commit_id, l.id AS descendant_id FROM link l JOIN tree t ON t.id = l.id WHERE l.parent_id IS NOT NULL
  UNION ALL SELECT l.parent_id, b.descendant_id FROM below b JOIN link l ON l.id = b.commit_id WHERE l.parent_id IS NOT NULL)
SELECT commit_id, descendant_id FROM below""",
    "p5_found": """
WITH parsed AS (
  SELECT *, lower(regexp_replace(trim(action), '[^A-Za-z]+', '_', 'g')) AS act,
    CASE WHEN json_valid(payload) THEN
      CASE WHEN json_type(payload) = 'VARCHAR' THEN CASE WHEN json_valid(payload ->> '$') THEN payload ->> '$' END ELSE payload END END AS doc,
    round(CASE WHEN abs(timestamp) < 1e11 THEN timestamp * 1e6 WHEN abs(timestamp) < 1e14 THEN timestamp * 1e3 WHEN abs(timestamp) < 1e17 THEN timestamp ELSE timestamp / 1e3 END) AS at_us
  FROM amendments),
keyed AS (
  SELECT *, CASE WHEN act LIKE '%node' THEN coalesce(doc ->> '$.id', doc ->> '$.data.id')
    ELSE coalesce(doc ->> '$.source_id', doc ->> '$.data.source_id') || '|' || coalesce(doc ->> '$.target_id', doc ->> '$.data.target_id') END AS entity_key
  FROM parsed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY split_part(act, '_', 2), entity_type, entity_key ORDER BY at_us DESC, id) AS rn
  FROM keyed WHERE entity_key IS NOT NULL AND id NOT IN (SELECT id FROM amendments WHERE reverted = 1))
SELECT entity_type, entity_key, id AS amendment_id FROM ranked WHERE rn = 1 AND act NOT LIKE 'delete%'""",
    "p6_found": f"WITH {_STATES} SELECT * FROM kinds WHERE kind IS NOT NULL",
    "p6_report": f"WITH {_STATES} SELECT side, kind, period, count(*) AS n FROM kinds WHERE kind IS NOT NULL GROUP BY ALL",
}
