"""Mixing sources to target weights (p8).

Tokens are summed per source over distinct texts, each source gets a repetition rate, and every text is emitted
floor(rate) times plus once more if a hash of (seed, text) falls below the fraction: no shuffle beyond the two
aggregations, no sampling state, the same mixture on every run.

Definitions. Source names are compared in lower case with ``-`` and blanks as ``_``. A text delivered several times
counts once, under the smallest id among its deliveries with a target; so no text exceeds its cap through copies. Where several
sources deliver it, it is credited to that delivery's source and the others have a text less (``credited`` reports how many). Shares
are divided by the sum over sources that have texts. The mixture aims at ``total`` tokens (all available ones by
default); a source's rate is share x total / available, at most max_repeats (null: no cap). Sources whose cap binds
fall short, which the report shows. A targeted source without texts is reported with 0; a text without a target or
source, null texts and texts of 0 tokens are not emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.tokens import VOCABULARY, count_tokens
from lexloom.plans.runtime import materialize

SEED = 42


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def _goal(targets: DataFrame) -> DataFrame:
    return targets.filter("source is not null and target_share > 0").groupBy(source_key(F.col("source")).alias("source_key")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("max_repeats"))


def _wanted(docs: DataFrame, goal: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, body, source_key, text_key) of the texts whose source has a target: ``goal`` has a row per target source."""
    keyed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body"), source_key(F.col("source")).alias("source_key"), F.sha2(F.col(text_col).cast("string"), 256).alias("text_key"))
    return keyed.filter("body <> '' and source_key is not null").join(F.broadcast(goal.select("source_key")), "source_key", "left_semi")


def _plan(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str, total: float | None, path: str) -> tuple[DataFrame, DataFrame]:
    goal = _goal(targets)
    counted = count_tokens(_wanted(docs, goal, id_col, text_col), "doc", "body", ("source_key", "text_key"), path).filter("tokens > 0")
    # copies shrink to one row before the shuffle already
    texts = counted.groupBy("text_key").agg(F.min(F.struct("doc", "source_key", "tokens")).alias("m")).select("text_key", "m.doc", "m.source_key", "m.tokens")
    texts = materialize(texts, "texts")
    have = texts.groupBy("source_key").agg(F.count("*").alias("texts"), F.sum("tokens").alias("available"))
    joined = goal.join(have, "source_key", "left").select("source_key", "share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("available", F.lit(0)).alias("available"))
    # two numbers
    sums = joined.agg(F.sum(F.when(F.col("available") > 0, F.col("share"))).alias("shares"), F.sum("available").alias("everything")).first()
    part = F.col("share") / F.lit(sums["shares"] or 1.0)
    aim = F.lit(float(total if total is not None else sums["everything"] or 0))
    rate = F.when(F.col("available") > 0, F.least(part * aim / F.col("available"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(float("inf"))))).otherwise(0.0)
    return texts, joined.select("source_key", part.alias("target_share"), "max_repeats", "texts", "available", rate.alias("rate"))


def _copies(texts: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Each text with its number of copies. ``rates`` has one row per target source, a table of fixed size."""
    unit = (F.pmod(F.xxhash64("text_key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
    whole = F.floor("rate")
    n = (whole + (unit < F.col("rate") - whole).cast("long")).cast("int")
    return texts.join(F.broadcast(rates.select("source_key", "rate")), "source_key").withColumn("copies", n)


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """(source, doc, copy_no, tokens): the mixture, one row per copy."""
    texts, rates = _plan(docs, targets, id_col, text_col, total, path)
    out = _copies(texts, rates, seed).filter("copies > 0")
    return out.select(F.col("source_key").alias("source"), "doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "tokens")


def mix_report(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """One row per target source with the share reached."""
    texts, rates = _plan(docs, targets, id_col, text_col, total, path)
    got = _copies(texts, rates, seed).groupBy("source_key").agg(F.sum(F.col("copies") * F.col("tokens")).alias("emitted"), F.max("copies").alias("most_copies"))
    joined = rates.join(got, "source_key", "left")
    whole = joined.agg(F.sum("emitted")).first()[0] or 1
    return joined.select(
        F.col("source_key").alias("source"),
        F.round("target_share", 6).alias("target_share"),
        "max_repeats",
        "texts",
        F.col("available").alias("available_tokens"),
        F.round("rate", 6).alias("rate"),
        F.coalesce("emitted", F.lit(0)).alias("emitted_tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.round(F.coalesce(F.col("emitted"), F.lit(0)) / F.lit(float(whole)), 6).alias("reached_share"),
    )


def mix_copies(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, seed: int = SEED, path: str = VOCABULARY) -> DataFrame:
    """(doc, source, max_repeats, tokens, rate, copies): every text that may be in the mixture, those without a copy included."""
    texts, rates = _plan(docs, targets, id_col, text_col, total, path)
    caps = F.broadcast(rates.select("source_key", "max_repeats"))
    return _copies(texts, rates, seed).join(caps, "source_key").select("doc", F.col("source_key").alias("source"), "max_repeats", "tokens", "rate", "copies")


def credited(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(source, texts, credited): the distinct texts of every target source, and those of them that count for it."""
    wanted = _wanted(docs, _goal(targets), id_col, text_col).select("doc", "source_key", "text_key")
    # one row per text and source first, so a text of many deliveries meets itself in one small group
    each = wanted.groupBy("text_key", "source_key").agg(F.min("doc").alias("doc"))
    first = each.groupBy("text_key").agg(F.min("doc").alias("first"))
    return each.join(first, "text_key").groupBy(F.col("source_key").alias("source")).agg(F.count("*").alias("texts"), F.count_if(F.col("doc") == F.col("first")).alias("credited"))
