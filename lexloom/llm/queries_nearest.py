"""p3: the most similar chunks for every chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.nearest import nearest
from lexloom.operators.retrieval import dot, top_k_batch
from lexloom.session import table

K, LEAST = 5, 0.80


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "document_chunks"), "id", "embedding", K, LEAST)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar other chunks of every chunk, whatever their similarity."""
    return nearest(table(spark, sf_dir, "document_chunks"), "id", "embedding", K)


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the chunks whose id is divisible by 50, how many neighbours there are among all rows, found by comparing each with every row,
    and whether ``nearest`` has at least nine tenths of them (a neighbour as similar as the last true one counts)."""
    chunks = table(spark, sf_dir, "document_chunks").filter(F.col("embedding").isNotNull() & (dot(F.col("embedding"), F.col("embedding")) > 0)).select("id", "embedding")
    queries = chunks.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    # each query finds itself and perhaps its copies, so one more than K
    exact = top_k_batch(chunks.withColumnRenamed("id", "seq"), queries, K + 1).filter("query_id <> seq")
    least = exact.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, K).alias("best")).select("query_id", F.size("best").alias("wanted"), F.array_min("best").alias("least"))
    near = nearest(table(spark, sf_dir, "document_chunks").filter("embedding is not null"), "id", "embedding", K).filter("id % 50 = 0")
    found = near.join(least, near["id"] == least["query_id"]).filter(F.col("similarity") >= F.col("least") - 1e-6).groupBy("query_id").agg(F.count("*").alias("found"))
    per = least.join(found, "query_id", "left").agg(F.count("*").alias("queries"), F.sum("wanted").cast("long").alias("pairs"), F.sum("found").alias("found"))
    return per.select("queries", "pairs", (F.col("found") >= 0.9 * F.col("pairs")).alias("reached"))


_FOUND = """
WITH v AS (
  SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM document_chunks
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: x * x), 'sum') > 0
),
s AS (
  SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS c FROM v a JOIN v b ON a.id <> b.id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.79999
),
r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s WHERE c >= 0.80)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5
"""

_RECALL = """
WITH v AS (SELECT id FROM document_chunks WHERE embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: x * x), 'sum') > 0)
SELECT count(*) AS queries, CAST(5 * count(*) AS BIGINT) AS pairs, true AS reached FROM v WHERE id % 50 = 0
"""

QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_recall": p3_recall}
ORACLE = {"p3_found": _FOUND, "p3_recall": _RECALL}
