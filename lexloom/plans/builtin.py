"""Built-in tasks: personal data, labels, citations, chunk prompts; each a transformation of documents (id, doc_type, route, full_text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import deadline_date
from lexloom.operators.chunking import chunk_clause_aware
from lexloom.operators.contracts import extract
from lexloom.operators.extraction import clause_labels, text_citations
from lexloom.operators.privacy import merged_text
from lexloom.plans.tasks import Provider, Registry, Task, append_columns, complete, prompt

#: Characters of a document that a prompt may hold, by task (fixed values).
PROMPT_CHARS = {"summarization": 12_000, "obligations": 12_000, "comparison": 8_000}


def _kinds(text: str | None) -> tuple:
    """The types of personal data of a text after merging, in alphabetical order."""
    if text is None:
        return (None,)
    return (sorted({kind for _, _, kind in merged_text(text)}),)


def pii_task() -> Task:
    """Adds the types of personal data found, and raises a public sensitivity to confidential where there are any."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        j = append_columns(docs, F.when(mine, F.coalesce("full_text", F.lit(""))), "pii_types array<string>", _kinds)
        if "sensitivity" in docs.columns:
            j = j.withColumn("sensitivity", F.when((F.size("pii_types") > 0) & (F.coalesce("sensitivity", F.lit("public")) == "public"), "confidential").otherwise(F.col("sensitivity")))
        return j

    return Task("pii_detection", run)


def label_task(multi: bool = True) -> Task:
    """Adds the clause labels of a contract's text, or only the first."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        labels = F.coalesce(clause_labels(F.col("full_text")), F.array().cast("array<string>"))
        return docs.withColumn("labels", F.when(mine, labels if multi else F.slice(labels, 1, 1)))

    return Task("classification", run, ("contract",))


def citation_task() -> Task:
    """Adds the citations of a text in order."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        return append_columns(docs, F.when(mine, F.coalesce("full_text", F.lit(""))), "citations array<string>", lambda t: (None if t is None else [c[0] for c in text_citations(t)],))

    return Task("citation", run, ("statute", "regulation", "case_opinion", "secondary", "contract", "pleading"))


def model_task(task_id: str, template: str, provider: Provider, doc_types: tuple[str, ...] = ()) -> Task:
    """Sends the beginning of a text to a model and adds answer, error and whether the text was cut."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        p, cut = prompt(template, F.when(mine, F.col("full_text")), PROMPT_CHARS.get(task_id, 12_000))
        asked = complete(docs.select("*", p, cut), provider)
        return asked.drop("prompt").withColumnsRenamed({c: f"{task_id}_{c}" for c in ("answer", "error", "truncated")})

    return Task(task_id, run, doc_types, True)


def comparison_task(provider: Provider, template: str = "Compare these two versions:\n") -> Task:
    """Sends the beginnings of a text and of its other version (column other_text) to a model."""
    most = PROMPT_CHARS["comparison"]

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        a, b = (F.when(mine, F.substring(c, 1, most)) for c in ("full_text", "other_text"))
        asked = complete(docs.select("*", F.concat(F.lit(template), a, F.lit("\n---\n"), b).alias("prompt"), F.when(mine, (F.length("full_text") > most) | (F.length("other_text") > most)).alias("truncated")), provider)
        return asked.drop("prompt").withColumnsRenamed({c: f"comparison_{c}" for c in ("answer", "error", "truncated")})

    return Task("comparison", run, needs_model=True)


def timeline_task() -> Task:
    """Adds the due date that a text's deadline (column deadline) resolves to from its effective_date, and whether it does."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        due = deadline_date(F.col("deadline"), F.col("effective_date"))
        return docs.withColumns({"due_date": F.when(mine, due), "resolved": F.when(mine, due.isNotNull())})

    return Task("timeline", run)


def risk_task(severities: tuple[str, ...], least: str) -> Task:
    """Keeps of a document's risks (array of struct<severity, ...>) those of at least a severity; ``severities`` go from low to high."""
    keep = severities[severities.index(least) :]

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        return docs.withColumn("risks", F.when(mine, F.filter("risks", lambda r: r["severity"].isin(*keep))).otherwise(F.col("risks")))

    return Task("risk_analysis", run)


def extraction_task(provider: Provider, known_types: list[str], threshold: float = 0.5) -> Task:
    """Adds what a model extracts from a contract: status, type and numbers of parties, clauses and terms. Documents are joined with their
    records, which are written before, so calls are made once."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        chunks = chunk_clause_aware(docs.filter(mine), "id", "full_text").select("doc", "seq", "chunk")
        got = extract(chunks, provider, known_types, threshold)
        told = got.documents.select("doc", "status", "contract_type")
        for name, part in (("parties", got.parties), ("clauses", got.clauses), ("terms", got.terms)):
            told = told.join(part.groupBy("doc").agg(F.count("*").alias(name)), "doc", "left")
        told = told.select(F.col("doc").alias("id"), F.struct("status", "contract_type", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("parties", "clauses", "terms"))).alias("extraction"))
        return docs.join(told, "id", "left")

    return Task("contract_extraction", run, ("contract",), True)


def names_task(recogniser: Callable[[str], list[str]]) -> Task:
    """Adds the entities that a given recogniser names in a text, each once, in order."""

    def run(docs: DataFrame, mine: Column) -> DataFrame:
        return append_columns(docs, F.when(mine, F.col("full_text")), "entities array<string>", lambda t: (None if t is None else list(dict.fromkeys(recogniser(t))),))

    return Task("ner", run)


#: Prompt templates with their versions; ``register_template`` adds newer ones.
TEMPLATES: dict[tuple[str, int], str] = {("summarization", 1): "Summarise this document:\n", ("obligations", 1): "List the obligations in this document:\n"}


def register_template(task_id: str, version: int, text: str) -> None:
    if (task_id, version) in TEMPLATES:
        raise KeyError(f"{task_id} has a template of version {version} already")
    TEMPLATES[(task_id, version)] = text


def template(task_id: str, version: int | None = None) -> str:
    """A task's template of a version, by default its newest."""
    found = {v: t for (name, v), t in TEMPLATES.items() if name == task_id}
    if not found or (version is not None and version not in found):
        raise KeyError(f"no template {version if version is not None else ''} for {task_id}")
    return found[max(found) if version is None else version]


def default_registry(provider: Provider | None = None, recogniser: Callable[[str], list[str]] | None = None, known_types: list[str] | None = None) -> Registry:
    r = Registry()
    for make in (pii_task, label_task, citation_task, timeline_task):
        r.register(make().task_id, make)
    r.register("risk_analysis", lambda: risk_task(("low", "medium", "high", "critical"), "low"))
    if recogniser is not None:
        r.register("ner", lambda: names_task(recogniser))
    if provider is not None:
        for name in ("summarization", "obligations"):
            r.register(name, lambda n=name: model_task(n, template(n), provider))
        r.register("comparison", lambda: comparison_task(provider))
        r.register("contract_extraction", lambda: extraction_task(provider, known_types or []))
    return r


def first_chunks_prompt(chunks: DataFrame, template: str, count: int = 2, limit: int = 12_000) -> DataFrame:
    """(doc, prompt): the first chunks of every document, joined by blank lines and cut to the limit."""
    head = chunks.filter(F.col("seq") < count).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "\n\n").alias("t"))
    return head.select("doc", F.concat(F.lit(template), F.substring("t", 1, limit)).alias("prompt"))


def provider_kind(model: Column) -> Column:
    """Which backend a model name stands for; anything unknown is local."""
    m = F.lower(model)
    return F.when(m.startswith("gpt-oss"), "local").when(m.startswith("gpt-"), "openai").when(m.startswith("claude-"), "anthropic").when(m.startswith("gemini-"), "google").otherwise("local")
