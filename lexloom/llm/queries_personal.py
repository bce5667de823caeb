"""p1: personal information in legal_docs.full_text, clauses.clause_text and document_chunks.chunk_text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.personal import find_personal, redact_personal
from lexloom.session import table

TEXTS = {"legal_docs": "full_text", "clauses": "clause_text", "document_chunks": "chunk_text"}


def _all(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    parts = [operator(table(spark, sf_dir, name), "id", column).withColumn("table_name", F.lit(name)) for name, column in TEXTS.items()]
    return reduce(DataFrame.unionByName, parts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows delivered twice give the same occurrences
    return _all(spark, sf_dir, find_personal).select("table_name", "row_id", "pii_type", "char_start").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, redact_personal).select("table_name", "row_id", "redacted")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and texts concerned by table and type."""
    found = p1_found(spark, sf_dir)
    return found.groupBy("table_name", "pii_type").agg(F.count("*").alias("occurrences"), F.count_distinct("row_id").alias("texts"))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every text whether the redacted one is the text with its occurrences, and nothing else, replaced by their types."""
    spans = _all(spark, sf_dir, find_personal).select("table_name", "row_id", F.struct("char_start", "char_end", "pii_type").alias("s")).distinct()
    spans = spans.groupBy("table_name", "row_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    texts = reduce(DataFrame.unionByName, [table(spark, sf_dir, n).select(F.lit(n).alias("table_name"), F.col("id").alias("row_id"), F.col(c).alias("t")) for n, c in TEXTS.items()])
    redacted = p1_redacted(spark, sf_dir).distinct()
    j = texts.filter("t is not null").distinct().join(spans, ["table_name", "row_id"], "left").join(redacted, ["table_name", "row_id"])
    part = lambda a, z: F.substring("t", a + 1, F.greatest(z - a, F.lit(0)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    built = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<char_start:int,char_end:int,pii_type:string>>")), start, lambda b, s: F.struct(F.concat(b["out"], part(b["at"], s["char_start"]), F.lit("["), s["pii_type"], F.lit("]")).alias("out"), s["char_end"].alias("at")))
    return j.withColumn("b", built).select("table_name", "row_id", (F.concat("b.out", part(F.col("b.at"), F.length("t"))) == F.col("redacted")).alias("consistent"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p1_rates": p1_rates, "p1_consistent": p1_consistent}
ORACLE = {"p1_consistent": " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS table_name, id AS row_id, true AS consistent FROM {n} WHERE {c} IS NOT NULL" for n, c in TEXTS.items())}
