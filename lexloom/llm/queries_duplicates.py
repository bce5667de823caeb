"""p6: near-duplicates within legal_docs and within source_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.near_duplicates import all_pairs, duplicate_groups, near_duplicates
from lexloom.session import table

THRESHOLD, WIDTH = 0.6, 3


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "legal_docs").select(F.lit("legal_docs").alias("table_name"), "id", F.col("full_text").alias("body"))
    return docs.unionByName(table(spark, sf_dir, "source_files").select(F.lit("source_files").alias("table_name"), "id", F.col("extracted_text").alias("body")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(_texts(spark, sf_dir), "id", "body", "table_name", THRESHOLD, WIDTH)
    return all_pairs(members, links).withColumnRenamed("kind", "table_name")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_duplicates(_texts(spark, sf_dir), "id", "body", "table_name", THRESHOLD, WIDTH)
    return duplicate_groups(members, links).withColumnRenamed("kind", "table_name")


def p6_groups_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the general setting: five words, similarity 0.8."""
    members, links = near_duplicates(_texts(spark, sf_dir), "id", "body", "table_name")
    return duplicate_groups(members, links).withColumnRenamed("kind", "table_name")


_SETS = r"""
WITH w AS (
  SELECT 'legal_docs' AS k, id, regexp_extract_all(lower(full_text), '[\p{L}\p{N}]+') AS w FROM legal_docs
  UNION ALL SELECT 'source_files', id, regexp_extract_all(lower(extracted_text), '[\p{L}\p{N}]+') FROM source_files
),
s AS (
  SELECT k, id, list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' '))) AS s FROM w WHERE len(w) > 0
),
t AS (SELECT k, id, len(s) AS n, unnest(s) AS x FROM s)
"""
_PAIRS = """
SELECT a.k AS table_name, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.k = b.k AND a.x = b.x AND a.id < b.id
GROUP BY a.k, a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))
"""



def _groups_sql(width: int, threshold: float) -> str:
    """Classes by equal words, links between classes by brute force, groups by walking the links."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT 'legal_docs' AS k, id, regexp_extract_all(lower(full_text), '[\p{{L}}\p{{N}}]+') AS w FROM legal_docs
  UNION ALL SELECT 'source_files', id, regexp_extract_all(lower(extracted_text), '[\p{{L}}\p{{N}}]+') FROM source_files
),
m AS (SELECT k, id, w, min(id) OVER (PARTITION BY k, w) AS class_id FROM w WHERE len(w) > 0),
s AS (SELECT k, id, list_distinct(list_transform(range(1, greatest(2, len(w) - {width - 2})), lambda i: list_aggregate(w[i:i + {width - 1}], 'string_agg', ' '))) AS s FROM m WHERE id = class_id),
t AS (SELECT k, id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.k, a.id AS a, b.id AS b FROM t a JOIN t b ON a.k = b.k AND a.x = b.x AND a.id <> b.id GROUP BY a.k, a.id, b.id, a.n, b.n HAVING count(*) >= {threshold} * (a.n + b.n - count(*))),
r AS (SELECT k, a AS c, a AS seen FROM l UNION SELECT r.k, r.c, l.b FROM r JOIN l ON l.k = r.k AND l.a = r.seen),
g AS (SELECT k, c, min(seen) AS group_id FROM r GROUP BY k, c),
d AS (SELECT k, a AS c, count(*) AS links FROM l GROUP BY k, a)
SELECT DISTINCT m.k AS table_name, m.id, m.class_id, coalesce(d.links, 0) AS links, coalesce(g.group_id, m.class_id) AS group_id
FROM m LEFT JOIN d ON d.k = m.k AND d.c = m.class_id LEFT JOIN g ON g.k = m.k AND g.c = m.class_id"""


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups, "p6_groups_strict": p6_groups_strict}
ORACLE = {"p6_found": _SETS + _PAIRS, "p6_groups": _groups_sql(WIDTH, THRESHOLD), "p6_groups_strict": _groups_sql(5, 0.8)}
