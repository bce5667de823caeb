"""Vector retrieval with filters, authority-weighted rescoring, conflicts and citations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import authority_binding, authority_weight, jurisdiction_conflicts, jurisdiction_label
from lexloom.plans.runtime import blocks_for

#: Queries and rows that meet in one task of a batch search.
QUERY_BLOCK, ROW_BLOCK = 4_096, 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length; elements beyond the shorter one count for its length only."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def top_k(index: DataFrame, query: list[float], k: int, vector: str = "embedding", order: str = "seq", where: Column | None = None) -> DataFrame:
    """The k most similar rows of an index to one query vector. A filter on metadata applies before; scores of 0 or less are dropped
    after the cut. The query is a constant, so the scan scores rows where they are and only k rows per task are sorted together."""
    src = index if where is None else index.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return src.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), order).limit(k).filter("score > 0")


def top_k_each(index: DataFrame, queries: DataFrame, k: int, on: list[str], vector: str = "embedding", query_vector: str = "query_embedding", query_id: str = "query_id", order: str = "seq") -> DataFrame:
    """The k best rows for every query of a batch, within the same values of ``on`` (a partition of the index)."""
    j = queries.join(index, on).withColumn("score", cosine(F.col(vector), F.col(query_vector)))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), order))
    return j.withColumn("rank", rank).filter((F.col("rank") <= k) & (F.col("score") > 0))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones, nulls and missing elements are filled with 0, as are vectors that are not finite."""
    lists = pa.chunked_array([c.cast(pa.list_(pa.float64())) for c in column.chunks], pa.list_(pa.float64())).combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = np.zeros((len(lists), dim))
    x[np.arange(dim) < lengths[:, None]] = lists.drop_null().flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    x[~np.isfinite((x * x).sum(1))] = 0
    return x


def _search_blocks(k: int):
    """The k best rows of one block for every query of one block."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_r, out_s = [], [], []
        if queries.num_rows and rows.num_rows:
            lengths = [max(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=0) for c in t["v"].chunks) for t in (queries, rows)]
            q, x = (_matrix(t["v"], int(max(lengths))) for t in (queries, rows))
            query_ids, ids = queries["q"].to_numpy(), rows["r"].to_numpy()
            nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
            u, w = q / np.where(nq > 0, nq, 1)[:, None], x / np.where(nx > 0, nx, 1)[:, None]
            for a in range(0, len(u), 256):
                sims = u[a : a + 256] @ w.T
                least = np.partition(sims, len(w) - k, axis=1)[:, len(w) - k] if len(w) > k else np.full(len(sims), -2.0)
                for i, row in enumerate(sims):
                    # products in blocks differ in the last digits: near ties are scored again, pair by pair, so that equal vectors tie
                    at = np.flatnonzero((row >= least[i] - 1e-9) & (row > -1e-9) & (nx > 0)) if nq[a + i] > 0 else np.zeros(0, np.int64)
                    score = (x[at] * q[a + i]).sum(1) / (nx[at] * nq[a + i])
                    best = np.lexsort((ids[at], -score))[:k]
                    best = best[score[best] > 0]
                    out_q.append(np.full(len(best), query_ids[a + i]))
                    out_r.append(ids[at][best])
                    out_s.append(score[best])
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"q": cat(out_q, pa.int64()), "r": cat(out_r, pa.int64()), "score": cat(out_s, pa.float64())})

    return run


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", query_vector: str = "query_embedding", query_id: str = "query_id", order: str = "seq", query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, order, score, rank): the k best of all rows for every query of a batch, exactly. Every block of queries meets every block
    of rows in one task; the k best of each are merged per query. Scores of 0 or less are dropped (they rank below all others); ties go
    to the smaller ``order``, which is a number like ``query_id``. Null and zero vectors and such that are not finite score 0."""
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).alias("v"))
    r = index.select(F.col(order).cast("long").alias("r"), F.col(vector).alias("v"))
    many_q, many_r = blocks_for(q.count(), query_block), blocks_for(r.count(), row_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(many_q)).cast("int")).withColumn("rb", every(many_r))
    r = r.withColumn("rb", F.pmod(F.xxhash64("r"), F.lit(many_r)).cast("int")).withColumn("qb", every(many_q))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(_search_blocks(k), "q long, r long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "r"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("r").alias(order), "score", "rank")


def rescore(candidates: DataFrame, year: int, alpha: float = 0.6, beta: float = 0.3, gamma: float = 0.1) -> DataFrame:
    """Candidates (score, level, superseded, publication_year) with combined = alpha similarity + beta authority + gamma recency, where
    recency loses 0.02 a year and is 0.5 where the year is unknown."""
    recency = F.when(F.col("publication_year").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.02 * (F.lit(year) - F.col("publication_year"))))
    return candidates.withColumn("combined", alpha * F.col("score") + beta * authority_weight(F.col("level"), F.col("superseded")) + gamma * recency)


def answer_summary(top: DataFrame) -> DataFrame:
    """Confidence (mean combined score) and range of authority; 0 without sources."""
    return top.agg(F.coalesce(F.avg("combined"), F.lit(0.0)).alias("confidence"), F.coalesce(F.min("level"), F.lit(0)).alias("authority_min"), F.coalesce(F.max("level"), F.lit(0)).alias("authority_max"))


def context(top: DataFrame, order: str, text: str) -> DataFrame:
    """The sources as one numbered context: [i] text, blank lines between."""
    n = F.row_number().over(Window.orderBy(order))
    rows = top.withColumn("i", n)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.format_string("[%d] %s", "i", text).alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))


def conflicts(sources: DataFrame, years: int = 5, gap: int = 20) -> DataFrame:
    """Conflicts between the sources of each question (question, ord, id, jur, level, publication_year): another region of one
    country, years apart, or (if neither) authority apart. Pairs are made within a question's few sources only."""
    a = sources.select("question", *(F.col(c).alias(f"{c}_a") for c in ("ord", "id", "jur", "level", "publication_year")))
    b = sources.select("question", *(F.col(c).alias(f"{c}_b") for c in ("ord", "id", "jur", "level", "publication_year")))
    p = a.join(b, "question").filter("ord_a < ord_b")
    apart = F.abs(F.col("level_a") - F.col("level_b"))
    both = authority_binding(F.col("level_a")) & authority_binding(F.col("level_b"))
    jur = F.coalesce(jurisdiction_conflicts(F.col("jur_a"), F.col("jur_b")), F.lit(False))
    old = F.coalesce(F.abs(F.col("publication_year_a") - F.col("publication_year_b")) >= years, F.lit(False))
    made = F.array_compact(
        F.array(
            F.when(jur, F.struct(F.lit("jurisdiction_conflict").alias("conflict_type"), F.when(both, "high").otherwise("medium").alias("severity"))),
            F.when(old, F.struct(F.lit("temporal_conflict").alias("conflict_type"), F.when(apart < gap, "high").otherwise("medium").alias("severity"))),
            F.when(~jur & ~old & (apart >= gap), F.struct(F.lit("authority_conflict").alias("conflict_type"), F.lit("medium").alias("severity"))),
        )
    )
    higher = (F.col("level_a") > F.col("level_b"))
    rows = p.select("question", "id_a", "id_b", "level_a", "level_b", F.explode(made).alias("c"))
    swap = (F.col("c.conflict_type") == "authority_conflict") & ~higher
    return rows.select("question", F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("source_a"), F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("source_b"), "c.conflict_type", "c.severity")


def citation(style: str, title: Column, page: Column, url: Column, index: Column | None = None) -> Column:
    """One source as inline, footnote or bluebook reference."""
    page = F.when(page > 0, page.cast("string"))
    url = F.nullif(url, F.lit(""))
    if style == "footnote":
        return F.concat(F.lit("["), index.cast("string"), F.lit("] "), title, F.coalesce(F.concat(F.lit(" <"), url, F.lit(">")), F.lit("")), F.coalesce(F.concat(F.lit(", p. "), page), F.lit("")), F.lit("."))
    if style == "bluebook":
        return F.concat(title, F.coalesce(F.concat(F.lit(", at "), page), F.lit("")), F.coalesce(F.concat(F.lit(" ("), url, F.lit(")")), F.lit("")), F.lit("."))
    return F.concat(F.lit("("), F.concat_ws(", ", title, F.coalesce(F.concat(F.lit("p. "), page), url)), F.lit(")"))


def sync(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, status) of a new fetch (url, text, failed) against the stored copies (url, text): added, changed, unchanged or kept (the fetch
    failed, or the source was not fetched again)."""
    j = old.select("url", F.sha2("text", 256).alias("h1")).join(new.select("url", F.sha2("text", 256).alias("h2"), "failed"), "url", "full")
    status = F.when(F.col("failed") | F.col("failed").isNull(), "kept").when(F.col("h1").isNull(), "added").when(F.col("h1") == F.col("h2"), "unchanged").otherwise("changed")
    return j.select("url", status.alias("status")).filter(~((F.col("status") == "kept") & F.col("url").isNull()))


__all__ = ["answer_summary", "citation", "conflicts", "context", "cosine", "jurisdiction_label", "rescore", "sync", "top_k", "top_k_batch", "top_k_each"]
