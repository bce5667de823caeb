"""p9: abusive, hateful or sexual content of documents.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.mixing import source_key
from lexloom.llm.moderation import fit_labelled, score_documents
from lexloom.session import table


_fitted: dict = {}


def _fit(spark: SparkSession, docs: DataFrame, labels: DataFrame):
    """The model of these files, trained once in an application."""
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()), *sorted(labels.inputFiles()))
    if key not in _fitted:
        _fitted.clear()
        _fitted[key] = fit_labelled(docs, labels)
    return _fitted[key]


def _scored(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels")
    return score_documents(docs, labels, keep=keep, fitted=_fit(spark, docs, labels))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("is_abusive").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and share found per source (irregular spellings of a source together)."""
    scored = _scored(spark, sf_dir, ("source",))
    return (
        scored.groupBy(source_key(F.col("source")).alias("source"))
        .agg(F.count("*").alias("documents"), F.count_if("is_abusive").alias("abusive"), F.avg("score").alias("mean_score"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )


def p9_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether its score is a probability, and whether it is 0 for want of a text."""
    return p9_scores(spark, sf_dir).select("doc_id", F.col("score").between(0, 1).alias("valid"), ((F.col("score") == 0) & F.col("passage").isNull()).alias("empty"))


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall against the labels of documents that each fold's model has not seen, at each tenth of the score."""
    fitted = _fit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))
    rows = []
    for k in range(1, 10) if fitted else ():
        hit = fitted.scores >= k / 10
        both = float(fitted.labels[hit].sum())
        rows.append((k / 10, len(hit), int(fitted.labels.sum()), int(hit.sum()), both / max(1, int(hit.sum())), both / max(1.0, float(fitted.labels.sum()))))
    return spark.createDataFrame(rows, "score double, documents int, positive int, found int, precision double, recall double")


QUERIES = {"p9_scored": p9_scored, "p9_quality": p9_quality, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
# a text without a letter or digit says nothing
ORACLE = {"p9_scored": "SELECT doc_id, true AS valid, text IS NULL OR NOT regexp_matches(lower(text), '[a-z0-9à-ž]') AS empty FROM documents"}
