"""Retrieval over a stored index of chunks: building it, replacing and removing sources, answering questions with filters.

An index has the columns of INDEX. Everything is relational but embedding (Arrow batches) and the exact search of a batch of questions
(``retrieval.top_k_batch``). Filters on metadata apply before the search; privacy, superseded sources and jurisdiction apply to its
3 k candidates, so a filter never makes room for worse ones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.chunking import chunk_semantic
from lexloom.operators.privacy import may_see
from lexloom.operators.retrieval import rescore, top_k_batch

INDEX = "doc_id string, chunk_id string, seq long, text string, embedding array<float>, source_url string, doc_type string, route string, level int, superseded boolean, publication_year int, country string, region string"
#: Candidates of a question for each source it is to get (fixed value).
FAN_OUT = 3


class Embedder(Protocol):
    """What turns texts into vectors; models stay behind it."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without a model: counts of words in hash buckets."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                out[i, zlib.crc32(w.encode()) % self.dim] += 1
        return out


def embed(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    """All rows with their vectors in column embedding; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            x = embedder.encode([t or "" for t in texts])
            vectors = [None if t is None else v.tolist() for t, v in zip(texts, x, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL("embedding array<float>").fields]))


def ingest(index: DataFrame, sources: DataFrame, embedder: Embedder, limit: int = 1000, overlap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(index, report) after taking in sources (doc_id, source_url, text, error, doc_type, route, level, superseded, publication_year,
    country, region).

    A source with an error (or without a text) fails alone: the report (doc_id, status, error) says so and what is stored of it stays.
    A source whose address begins with http replaces what is stored under that address; a document's other chunks are added."""
    good = sources.filter("error is null and text is not null")
    chunks = chunk_semantic(good, "doc_id", "text", limit, overlap).select(F.col("doc").alias("doc_id"), F.concat("doc", F.lit(":chunk:"), "seq").alias("chunk_id"), F.col("seq").cast("long"), F.col("chunk").alias("text"))
    fresh = embed(chunks, "text", embedder).join(good.drop("text", "error"), "doc_id").select(*(f.name for f in T.StructType.fromDDL(INDEX).fields))
    again = good.filter(F.col("source_url").startswith("http")).select("source_url").distinct()
    report = sources.select("doc_id", F.when(F.col("error").isNull() & F.col("text").isNotNull(), "ingested").otherwise("failed").alias("status"), F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no text"))).otherwise(F.col("error")).alias("error"))
    return add(index.join(again, "source_url", "left_anti").select(*fresh.columns), fresh), report


def add(index: DataFrame, rows: DataFrame) -> DataFrame:
    return index.unionByName(rows)


def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the documents in ``gone`` (doc_id)."""
    return index.join(gone.select("doc_id"), "doc_id", "left_anti").select(*index.columns)


def size(index: DataFrame) -> int:
    return index.count()


def fits_jurisdiction(country: Column, region: Column, want_country: Column, want_region: Column) -> Column:
    """Whether a source's place fits a question's: none asked for or none known fits, INT is asked for fits all, and a source for a whole
    country fits its regions."""
    place = (want_country == "INT") | ((country == want_country) & (want_region.isNull() | region.isNull() | (region == want_region)))
    return want_country.isNull() | country.isNull() | F.coalesce(place, F.lit(False))


def candidates(index: DataFrame, questions: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The FAN_OUT x k most similar chunks of each question (query_id, query_embedding, ...) among those that ``where`` allows. Chunks
    are numbered by ``seq``, which is unique in the index searched."""
    found = top_k_batch(index if where is None else index.filter(where), questions, FAN_OUT * k)
    return found.select("query_id", "seq", "score").join(index.drop("embedding"), "seq").join(questions.drop("query_embedding"), "query_id")


def answer_sources(index: DataFrame, questions: DataFrame, k: int, year: int, provider_is_local: bool, where: Column | None = None, weights: tuple[float, float, float] = (0.6, 0.3, 0.1), reranker: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """The k sources of every question (query_id, query_embedding, want_country, want_region): of its candidates those that the provider
    may see, that are not superseded and whose jurisdiction fits, by their combined score; rank is their number in the context. A
    ``reranker`` gets one question's sources (at most k rows) and returns them in another order."""
    c = candidates(index, questions, k, where)
    kept = c.filter(may_see(F.col("route"), provider_is_local) & ~F.coalesce("superseded", F.lit(False)) & fits_jurisdiction(F.col("country"), F.col("region"), F.col("want_country"), F.col("want_region")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), F.desc("score"), "seq"))
    top = rescore(kept, year, *weights).withColumn("rank", rank).filter(F.col("rank") <= k)
    if reranker is None:
        return top

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = reranker(rows.sort_values("rank").reset_index(drop=True))
        # confidence stays that of the places, so the scores keep theirs
        return out.assign(combined=rows.sort_values("rank")["combined"].to_numpy()[: len(out)], rank=np.arange(1, len(out) + 1, dtype=np.int32))

    return top.groupBy("query_id").applyInPandas(run, top.schema)


def prompts(sources: DataFrame, questions: DataFrame, template: str, conflicts: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt, confidence, route): the template with {context} and {question}, then the note on conflicts; confidence is the
    mean combined score, route the strictest of the sources."""
    order = F.array_sort(F.collect_list(F.struct("rank", F.format_string("[%d] %s", "rank", "text").alias("t"))))
    told = sources.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: x["t"]), "\n\n").alias("context"), F.avg("combined").alias("confidence"), F.max(F.when(F.col("route") == "any", 0).when(F.col("route") == "local_only", 1).otherwise(2)).alias("r"))
    j = questions.select("query_id", "question").join(told, "query_id", "left")
    if conflicts is not None:
        j = j.join(conflict_note(conflicts), "query_id", "left")
    before, _, rest = template.partition("{context}")
    middle, _, after = rest.partition("{question}")
    text = F.concat(F.lit(before), F.coalesce("context", F.lit("")), F.lit(middle), "question", F.lit(after), F.coalesce("note", F.lit("")) if conflicts is not None else F.lit(""))
    return j.select("query_id", text.alias("prompt"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.array(*map(F.lit, ("any", "local_only", "blocked")))[F.coalesce("r", F.lit(0))].alias("route"))


def conflict_note(conflicts: DataFrame) -> DataFrame:
    """(query_id, note) for conflicts (query_id, ord, conflict_type, description): how the sources differ, and what a model is to do if
    they disagree."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("  ["), F.upper("conflict_type"), F.lit("] "), F.coalesce(F.nullif("description", F.lit("")), F.lit("See the sources."))).alias("t")))), lambda x: x["t"]), "\n")
    head = "\n\nThe sources differ as follows. Where they take different positions, give each with its source and say which governs; otherwise answer as usual.\n"
    return conflicts.groupBy("query_id").agg(F.concat(F.lit(head), lines, F.lit("\nName each position's source [N] and whether it is binding.")).alias("note"))


def partial_answers(tokens: DataFrame) -> DataFrame:
    """(query_id, ord, text): the answer as far as it has come with every token (query_id, ord, token)."""
    upto = Window.partitionBy("query_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.select("query_id", "ord", F.array_join(F.collect_list("token").over(upto), "").alias("text"))
