"""p2: hierarchies over clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.hierarchy import hierarchy
from lexloom.session import table


def _tree(spark: SparkSession, sf_dir: str, with_path: bool) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "clauses"), "id", "parent_clause_id", "document_id", with_path=with_path)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir, False)
    return t.filter(F.col("parent").isNotNull()).select(F.col("node").alias("clause_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root, for every clause; null path on or below a cycle."""
    t = _tree(spark, sf_dir, True)
    path = F.concat_ws("/", F.col("path").cast("array<string>"))
    return t.select(F.col("node").alias("clause_id"), F.col("root").alias("root_id"), "depth", F.when(F.col("path").isNotNull(), path).alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause below every clause, with the number of links between them (none on or below a cycle)."""
    t = _tree(spark, sf_dir, True).filter(F.size("path") > 1)
    up = t.select(F.col("node").alias("descendant_id"), F.size("path").alias("n"), F.posexplode("path").alias("at", "clause_id"))
    return up.filter(F.col("at") < F.col("n") - 1).select("clause_id", "descendant_id", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))


def p2_endless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses whose chain of parents never ends, with the smallest id on the cycle."""
    return _tree(spark, sf_dir, False).filter("depth = -1").select(F.col("node").alias("clause_id"), F.col("root").alias("cycle_id"))


_WALK = """
WITH RECURSIVE n AS (SELECT id, min(parent_clause_id) AS p FROM clauses WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT c.id, c.p FROM n c JOIN n q ON q.id = c.p),
walk AS (
  SELECT id AS clause_id, id AS node, [id] AS seen, CAST(NULL AS BIGINT) AS cycle_id FROM n
  UNION ALL
  SELECT w.clause_id, e.p, list_append(w.seen, e.p),
         CASE WHEN list_contains(w.seen, e.p) THEN list_min(w.seen[list_position(w.seen, e.p):]) END
  FROM walk w JOIN e ON e.id = w.node WHERE w.cycle_id IS NULL
),
ended AS (
  SELECT clause_id, node AS root_id, CAST(len(seen) - 1 AS INTEGER) AS depth, list_reverse(seen) AS path
  FROM walk w WHERE cycle_id IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.id = w.node)
  UNION ALL
  SELECT clause_id, cycle_id, -1, NULL FROM walk WHERE cycle_id IS NOT NULL
)
"""

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_endless": p2_endless}
ORACLE = {
    "p2_found": _WALK + "SELECT clause_id, root_id, depth FROM ended WHERE clause_id IN (SELECT id FROM n WHERE p IS NOT NULL)",
    "p2_paths": _WALK + "SELECT clause_id, root_id, depth, array_to_string(path, '/') AS path FROM ended",
    "p2_descendants": _WALK
    + "SELECT unnest(path[:-2]) AS clause_id, clause_id AS descendant_id, CAST(unnest(list_reverse(range(1, len(path)))) AS INTEGER) AS distance FROM ended WHERE len(path) > 1",
    "p2_endless": _WALK + "SELECT clause_id, root_id AS cycle_id FROM ended WHERE depth = -1",
}
