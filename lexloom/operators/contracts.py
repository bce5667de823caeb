"""Extraction of contracts from chunks by a model: calls, fallback, failures, and building records from the answers.

Calls are rows (doc, call, seq, prompt) that ``plans.tasks.complete`` sends in Arrow batches; all else is relational. Answers are JSON.
A document of one chunk is asked once for clauses and financial terms together and, only if that fails, twice; longer ones are asked
twice for every chunk, wherever the chunks lie."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import amount, normal_date, strip
from lexloom.operators.extraction import dedupe_clauses, dedupe_parties, dedupe_terms
from lexloom.plans.runtime import materialize
from lexloom.plans.tasks import Provider, complete

#: Characters of a document's first chunks that the information call may hold, and of its text that an estimate counts (fixed values).
INFO_CHARS, ESTIMATE_CHARS = 12_000, 20_000
PROMPTS = {"info": "Name type, title, dates, governing law and parties of this contract as JSON:\n", "clauses": "List the clauses as JSON:\n", "financial": "List the financial terms as JSON:\n", "combined": "List the clauses and the financial terms as JSON:\n"}
INFO = "contract_type string, title string, effective_date string, expiration_date string, governing_law string, parties array<struct<name:string,role:string,confidence:double>>"
CLAUSES = "clauses array<struct<clause_type:string,text:string,section_number:string,confidence:double>>"
TERMS = "financial_terms array<struct<term_type:string,amount:string,currency:string,due_date:string,confidence:double>>"


def plan_calls(chunks: DataFrame, financial: bool = True) -> DataFrame:
    """(doc, call, seq, prompt) for chunks (doc, seq, chunk)."""
    head = chunks.filter("seq < 2").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("t"))
    info = head.select("doc", F.lit("info").alias("call"), F.lit(0).alias("seq"), F.concat(F.lit(PROMPTS["info"]), F.substring("t", 1, INFO_CHARS)).alias("prompt"))
    many = chunks.groupBy("doc").agg(F.count("*").alias("n"))
    both = F.array(F.lit("clauses"), F.lit("financial")) if financial else F.array(F.lit("clauses"))
    kinds = F.when(F.col("n") == 1, F.array(F.lit("combined")) if financial else both).otherwise(both)
    each = chunks.join(many, "doc").select("doc", F.explode(kinds).alias("call"), F.col("seq").cast("int"), "chunk")
    return info.unionByName(each.select("doc", "call", "seq", F.concat(_prompt(F.col("call")), "chunk").alias("prompt")))


def _prompt(call: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv])[call]


def run_calls(calls: DataFrame, provider: Provider) -> DataFrame:
    """The calls with answer and error; a failed combined call is replaced by the two separate ones."""
    first = materialize(complete(calls, provider), "calls")
    # an answer that is no JSON object fails like a call that raises
    first = first.withColumn("error", F.coalesce("error", F.when(F.get_json_object("answer", "$").isNull() | ~F.col("answer").rlike(r"^\s*\{"), "no JSON object")))
    broken = first.filter("call = 'combined' and error is not null")
    chunk = F.substring("prompt", len(PROMPTS["combined"]) + 1, 2**30)
    again = broken.select("doc", F.explode(F.array(F.lit("clauses"), F.lit("financial"))).alias("call"), "seq", chunk.alias("chunk")).select("doc", "call", "seq", F.concat(_prompt(F.col("call")), "chunk").alias("prompt"))
    second = complete(again, provider).withColumn("error", F.coalesce("error", F.when(~F.coalesce(F.col("answer").rlike(r"^\s*\{"), F.lit(False)), "no JSON object")))
    return materialize(first.filter("not (call = 'combined' and error is not null)").unionByName(second), "answers")


def call_status(answers: DataFrame) -> DataFrame:
    """(doc, failed, warnings): a document all of whose calls failed has failed; otherwise failures are warnings, in order of chunks."""
    said = F.concat(F.when(F.col("call") == "info", F.lit("")).otherwise(F.concat(F.lit("Chunk "), "seq", F.lit(": "))), "call", F.lit(": "), F.element_at(F.split("error", "\n"), 1))
    order = F.struct((F.col("call") != "info").alias("later"), "seq", "call", said.alias("w"))
    told = answers.groupBy("doc").agg(F.bool_and(F.col("error").isNotNull()).alias("failed"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), order))).alias("w"))
    return told.select("doc", "failed", F.transform("w", lambda x: x["w"]).alias("warnings"))


def _parsed(answers: DataFrame, calls: tuple[str, ...], schema: str, field: str) -> DataFrame:
    ok = answers.filter(F.col("call").isin(*calls) & F.col("error").isNull()).select("doc", "seq", F.from_json("answer", schema)[field].alias("items"))
    return ok.select("doc", "seq", F.posexplode("items").alias("k", "r")).select("doc", (F.col("seq").cast("long") * 1_000_000 + F.col("k")).alias("ord"), "r.*")


def build_clauses(clauses: DataFrame, threshold: float) -> DataFrame:
    """Clauses with a text and a type whose confidence reaches the threshold, texts stripped."""
    kept = clauses.filter((F.length(F.coalesce("text", F.lit(""))) > 0) & (F.length(F.coalesce("clause_type", F.lit(""))) > 0) & (F.col("confidence") >= threshold))
    return kept.withColumn("text", strip(F.col("text")))


def build_terms(terms: DataFrame) -> DataFrame:
    """Financial terms with a type: the amount as a number (plain, else read as money), the due date as a date, the currency in capitals."""
    said = strip(F.col("amount").cast("string"))
    plain = said.rlike(r"^[+-]?\d+(?:\.\d+)?$")
    return terms.filter(F.length(F.coalesce("term_type", F.lit(""))) > 0).withColumns(
        {"amount": F.when(plain, said.try_cast("decimal(38,8)")).otherwise(amount(said)), "due_date": normal_date(F.coalesce("due_date", F.lit(""))), "currency": F.upper("currency")}
    )


def resolve_type(said: Column, hint: Column, known: list[str]) -> Column:
    """The hint, else the type said if it is a known one."""
    low = F.lower(said)
    return F.coalesce(hint, F.when(low.isin(*known), low))


def low_confidence(parties: DataFrame, threshold: float) -> DataFrame:
    """(doc, warning) naming the parties below the threshold, in order. The wording is a fixed value."""
    item = F.format_string("Party '%s' (conf=%s)", F.col("name"), F.format_number("confidence", 2))
    low = parties.filter(F.col("confidence") < threshold).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("t")))).alias("w"))
    return low.select("doc", F.concat(F.lit(f"Items below confidence threshold ({threshold}): "), F.array_join(F.transform("w", lambda x: x["t"]), "; ")).alias("warning"))


def estimate(chunks: DataFrame, docs: DataFrame, per_million: float) -> DataFrame:
    """(doc, tokens, cost): four characters a token; the information call, every chunk once, and the first ESTIMATE_CHARS characters of
    the text (doc, text), at a price for a million tokens."""
    tokens = lambda c: F.floor(F.length(c) / 4)
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") < 2, F.struct("seq", "chunk")))), lambda x: x["chunk"]), "\n\n")
    per = chunks.groupBy("doc").agg(F.sum(tokens("chunk")).alias("all"), tokens(F.substring(head, 1, INFO_CHARS)).alias("info"))
    total = F.coalesce("all", F.lit(0)) + F.coalesce("info", F.lit(0)) + F.coalesce(tokens(F.substring("text", 1, ESTIMATE_CHARS)), F.lit(0))
    return docs.join(per, "doc", "left").select("doc", total.cast("long").alias("tokens"), (total * per_million / 1_000_000).alias("cost"))


@dataclass
class Extracted:
    """Records of contracts: one row per document, and its parties, clauses and financial terms."""

    documents: DataFrame
    parties: DataFrame
    clauses: DataFrame
    terms: DataFrame


def extract(chunks: DataFrame, provider: Provider, known_types: list[str], threshold: float = 0.5, financial: bool = True, hints: DataFrame | None = None) -> Extracted:
    """All steps for chunks (doc, seq, chunk); ``hints`` (doc, hint) sets types. Documents that failed have no records but their row."""
    answers = run_calls(plan_calls(chunks, financial), provider)
    status = call_status(answers)
    info = answers.filter("call = 'info' and error is null").select("doc", F.from_json("answer", INFO).alias("i")).select("doc", "i.*")
    parties = info.select("doc", F.posexplode("parties").alias("k", "p")).select("doc", F.col("k").cast("long").alias("ord"), "p.*")
    parties = dedupe_parties(parties).drop("first_seen")
    clauses = _parsed(answers, ("clauses", "combined"), CLAUSES, "clauses")
    kept = dedupe_clauses(clauses).join(clauses.select("doc", "ord", "section_number"), ["doc", "ord"])
    terms = build_terms(dedupe_terms(_parsed(answers, ("financial", "combined"), TERMS, "financial_terms")).drop("first_seen"))
    j = status.join(info.drop("parties"), "doc", "left").join(low_confidence(parties, threshold), "doc", "left")
    j = j.join(hints, "doc", "left") if hints is not None else j.withColumn("hint", F.lit(None).cast("string"))
    date = lambda c: normal_date(F.coalesce(c, F.lit(""))).alias(c)
    warnings = F.array_compact(F.concat("warnings", F.array("warning")))
    documents = j.select("doc", F.when(F.col("failed"), "failed").otherwise("extracted").alias("status"), resolve_type(F.col("contract_type"), F.col("hint"), known_types).alias("contract_type"), "title", date("effective_date"), date("expiration_date"), "governing_law", warnings.alias("warnings"))
    return Extracted(documents, parties, build_clauses(kept, threshold), terms)
