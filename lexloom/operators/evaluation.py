"""Field scoring, privacy metrics, calibration and redaction coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import strip


def values_match(expected: Column, actual: Column) -> Column:
    """Equal without case and outer white space; an actual null never matches."""
    return F.coalesce(F.lower(strip(expected)) == F.lower(strip(actual)), F.lit(False))


def score_fields(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, field, weight, match) for every expected field (case_id, field, value, weight)."""
    j = expected.join(actual.select("case_id", "field", F.col("value").alias("actual")), ["case_id", "field"], "left")
    return j.select("case_id", "field", F.coalesce("weight", F.lit(1.0)).alias("weight"), values_match(F.col("value"), F.col("actual")).alias("match"))


def field_accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("field").agg(F.count("*").alias("total"), F.count_if("match").alias("correct")).withColumn("accuracy", F.col("correct") / F.col("total"))


def overall_accuracy(scored: DataFrame) -> DataFrame:
    """Weighted field accuracy, and the share of cases all of whose fields match."""
    hit = F.col("match").cast("double")
    cases = scored.groupBy("case_id").agg(F.sum(F.col("weight") * hit).alias("w_hit"), F.sum("weight").alias("w"), F.bool_and("match").alias("all_match"))
    return cases.agg((F.sum("w_hit") / F.sum("w")).alias("field_accuracy"), F.avg(F.col("all_match").cast("double")).alias("case_accuracy"), F.count("*").alias("cases"))


def entity_metrics(expected: Column, found: Column) -> Column:
    """Precision, recall and F1 of two arrays of entity types as sets without case; nothing expected and found is right."""
    e, f = (F.array_distinct(F.transform(F.coalesce(x, F.array()), F.upper)) for x in (expected, found))
    hit = F.size(F.array_intersect(e, f))
    p = F.when(F.size(f) > 0, hit / F.size(f)).when(F.size(e) > 0, 0.0).otherwise(1.0)
    r = F.when(F.size(e) > 0, hit / F.size(e)).otherwise(1.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def macro(df: DataFrame, metrics: str) -> DataFrame:
    """Averages over cases; F1 is that of the averages."""
    a = df.agg(F.avg(f"{metrics}.precision").alias("precision"), F.avg(f"{metrics}.recall").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return a.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, n, correct, accuracy, mean_confidence) for all bins; confidences outside [0, 1] and null are left out."""
    ok = df.filter(F.col(confidence).between(0.0, 1.0) & ~F.isnan(confidence))
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    got = ok.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("correct"), F.avg(confidence).alias("mean_confidence"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    j = every.join(got, "bin", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), n.alias("n"), F.coalesce("correct", F.lit(0)).alias("correct"), F.when(n > 0, F.col("correct") / n).otherwise(0.0).alias("accuracy"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"))


def calibration_error(bins: DataFrame) -> DataFrame:
    total = F.sum("n")
    return bins.agg(F.when(total > 0, F.sum(F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")) / total).otherwise(0.0).alias("ece"), total.alias("n"))


def span_coverage(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, start, end, entity, covered): whether found spans of the document cover a gold span whole (found spans must not overlap)."""
    j = gold.join(found.select("doc", F.col("start").alias("s"), F.col("end").alias("e")), "doc", "left")
    # least and greatest pass over nulls, which would make a document without found spans look covered
    inside = F.when(F.col("s").isNotNull(), F.greatest(F.lit(0), F.least("e", "end") - F.greatest("s", "start")))
    return j.groupBy("doc", "start", "end", "entity").agg((F.coalesce(F.sum(inside), F.lit(0)) >= F.max(F.col("end") - F.col("start"))).alias("covered"))


def require(df: DataFrame, column: str, least: float) -> None:
    """Raise if a one-row metric is below a gate."""
    value = df.select(column).first()[0]
    if value is None or value < least:
        raise AssertionError(f"{column} is {value}, below {least}")


def provenance_coverage(fields: DataFrame, doc: str, found: Column) -> DataFrame:
    """(doc, coverage): share of a document's fields whose origin is known."""
    return fields.groupBy(doc).agg((F.count_if(found) / F.count("*")).alias("coverage"))


def by_tag(cases: DataFrame, tag: str) -> DataFrame:
    return cases.filter(F.array_contains("tags", tag))


def by_doc_type(cases: DataFrame, doc_type: str) -> DataFrame:
    return cases.filter(F.col("doc_type") == doc_type)


def score_run(expected: DataFrame, actual: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored fields of a run and one row of counts (cases, error_cases). A case in ``errors`` (case_id) missed every field."""
    scored = score_fields(expected, actual.join(errors.select("case_id"), "case_id", "left_anti"))
    cases = expected.select("case_id").distinct().join(errors.select("case_id", F.lit(True).alias("e")).distinct(), "case_id", "left")
    return scored, cases.agg(F.count("*").alias("cases"), F.count_if("e").alias("error_cases"))


def privacy_run(cases: DataFrame) -> DataFrame:
    """One row of precision, recall, f1, count_matches, blocking_accuracy and failures for privacy cases (expected, found: arrays of entity
    types; expected_count, found_count; should_block, blocked; crashed). A crash is a miss in everything."""
    crash = F.coalesce("crashed", F.lit(False))
    m = entity_metrics(F.col("expected"), F.col("found"))
    c = cases.select(
        F.when(crash, 0.0).otherwise(m["precision"]).alias("p"),
        F.when(crash, 0.0).otherwise(m["recall"]).alias("r"),
        (~crash & (F.coalesce("found_count", F.lit(0)) >= F.coalesce("expected_count", F.lit(0)))).alias("enough"),
        (~crash & F.col("blocked").eqNullSafe(F.col("should_block"))).alias("right"),
        crash.alias("crash"),
    )
    a = c.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(F.col("enough").cast("double")).alias("count_matches"), F.avg(F.col("right").cast("double")).alias("blocking_accuracy"), F.count_if("crash").alias("failures"))
    p, r = F.col("precision"), F.col("recall")
    return a.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def require_field_accuracy(overall: DataFrame, least: float) -> None:
    require(overall, "field_accuracy", least)


def require_case_accuracy(overall: DataFrame, least: float) -> None:
    require(overall, "case_accuracy", least)


def require_pii_recall(privacy: DataFrame, least: float) -> None:
    require(privacy, "recall", least)


def require_perfect_blocking(privacy: DataFrame) -> None:
    require(privacy, "blocking_accuracy", 1.0)


def leaks(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(label, tokens, left): identifying tokens (doc, label, start, end) of labelled spans, and how many of them found spans (doc, start,
    end, without overlaps) do not cover whole."""
    covered = span_coverage(tokens.withColumnRenamed("label", "entity"), found)
    return covered.groupBy(F.col("entity").alias("label")).agg(F.count("*").alias("tokens"), F.count_if(~F.col("covered")).alias("left"))


def identifying_tokens(spans: DataFrame, titles: list[str] = ()) -> DataFrame:
    """(doc, label, start, end): the words of labelled spans (doc, label, start, end, text: the span's own text) that begin with a capital or
    a digit once punctuation is off their ends; titles are none."""
    word = r"(?U)[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"
    w = spans.select("doc", "label", "start", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.regexp_count("text", F.lit(r"(?U)\S+")), F.lit(1)))).alias("n"))
    # the n-th word's place: the length of what stands before it
    head = F.regexp_extract("text", r"(?sU)^\s*", 0)
    before = F.expr(r"regexp_extract(text, concat('(?sU)^(\\s*(?:\\S+\\s+){', cast(n - 1 as string), '})\\S+'), 1)")
    raw = F.expr(r"regexp_extract(text, concat('(?sU)^\\s*(?:\\S+\\s+){', cast(n - 1 as string), '}(\\S+)'), 1)")
    core = F.regexp_extract(raw, word, 0)
    lead = F.expr("instr(raw, core)") - 1
    placed = w.withColumns({"before": before, "raw": raw}).withColumn("core", core).withColumn("at", F.col("start") + F.length("before") + lead)
    kept = placed.filter(F.col("core").rlike(r"(?U)^[\p{Lu}\p{N}]") & ~F.lower("core").isin(*[t.lower() for t in titles] or [""]) & head.isNotNull())
    return kept.select("doc", "label", F.col("at").cast("long").alias("start"), (F.col("at") + F.length("core")).cast("long").alias("end"))


def false_alarms(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Found spans (doc, start, end, ...) that overlap no labelled one."""
    g = labelled.select("doc", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = found.join(g, "doc").filter((F.col("start") < F.col("_b")) & (F.col("_a") < F.col("end"))).select("doc", "start", "end").distinct()
    return found.join(hit, ["doc", "start", "end"], "left_anti")


def provenance_scores(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(values, resolved, correct, exact) for values (doc, value, gold_start, gold_end) with the place found for them (char_start, char_end,
    null if none): correct overlaps the true place, exact reads like the value."""
    j = found.join(texts.select("doc", "text"), "doc")
    got = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    overlap = got & (F.col("char_start") < F.col("gold_end")) & (F.col("gold_start") < F.col("char_end"))
    same = got & (F.expr("substring(text, int(char_start) + 1, int(char_end - char_start))") == F.col("value"))
    return j.agg(F.count("*").alias("values"), F.count_if(got).alias("resolved"), F.count_if(overlap).alias("correct"), F.count_if(same).alias("exact"))
