"""p7 and p8: packing and mixing of documents.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.mixing import credited, mix, mix_copies, mix_report
from lexloom.llm.packing import CAPACITY, pack
from lexloom.session import table


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used with and without filled remainders against the least possible number."""
    docs = table(spark, sf_dir, "documents")

    def used(df: DataFrame, method: str) -> DataFrame:
        return df.groupBy("container_id").agg(F.sum("tokens").alias("n")).agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")).select(F.lit(method).alias("method"), "*")

    both = used(pack(docs), "filled").unionByName(used(pack(docs, fill=False), "classes only"))
    return both.withColumn("least_possible", F.ceil(F.col("tokens") / CAPACITY))


def p7_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every text with tokens whether its pieces follow each other from 0 in containers that hold no more than they can, and whether
    it is in one piece or larger than a container."""
    packed = p7_pack(spark, sf_dir)
    held = packed.groupBy("container_id").agg(F.sum("tokens").alias("held"))
    pieces = packed.join(held, "container_id").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", "token_start", "tokens"))).alias("p"), F.max("held").alias("held"), F.sum("tokens").alias("tokens")
    )
    follow = F.aggregate("p", F.lit(0).cast("long"), lambda at, x: F.when(x["token_start"] == at, at + x["tokens"]))
    return pieces.select("doc_id", (follow.eqNullSafe(F.col("tokens")) & (F.col("held") <= CAPACITY)).alias("whole"), ((F.size("p") == 1) | (F.col("tokens") > CAPACITY)).alias("unsplit"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of every source with a target, and how many of them are credited to it: a text that several sources deliver
    counts for the one of the smallest id."""
    return credited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that may be in the mixture, its source and cap, and whether its copies are rate rounded down or up and within the cap."""
    docs, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mix_copies(docs, targets).select(F.col("doc").alias("doc_id"), "source", "max_repeats", ((F.col("copies") >= F.floor("rate")) & (F.col("copies") <= F.ceil("rate")) & (F.col("copies") <= F.coalesce("max_repeats", F.col("copies")))).alias("within"))


_KEY = r"regexp_replace(lower(trim(source)), '[-\s]+', '_', 'g')"
_ELIGIBLE = f"""WITH goal AS (SELECT {_KEY} AS source, CAST(min(max_repeats) AS INTEGER) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 GROUP BY 1),
  d AS (SELECT doc_id, text, {_KEY} AS source FROM documents WHERE length(text) > 0 AND source IS NOT NULL),
  t AS (SELECT doc_id, text, source, max_repeats, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM d JOIN goal USING (source))"""

QUERIES = {"p7_pack": p7_pack, "p7_fill": p7_fill, "p7_cover": p7_cover, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_credit": p8_credit, "p8_caps": p8_caps}
ORACLE = {
    "p7_cover": "SELECT doc_id, true AS whole, true AS unsplit FROM documents WHERE length(text) > 0",
    "p8_caps": f"{_ELIGIBLE} SELECT doc_id, source, max_repeats, true AS within FROM t WHERE r = 1",
    "p8_credit": f"{_ELIGIBLE} SELECT source, count(DISTINCT text) AS texts, count(*) FILTER (WHERE r = 1) AS credited FROM t GROUP BY source",
}
