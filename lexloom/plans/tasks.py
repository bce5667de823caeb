"""Tasks as DataFrame transformations, pipelines of them, a registry, and the boundary to models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.operators.privacy import may_see
from lexloom.plans.runtime import materialize


class Provider(Protocol):
    """What a model backend offers; only scripted ones ship here."""

    name: str
    is_local: bool

    def complete(self, prompt: str) -> str: ...


@dataclass
class Scripted:
    """A provider that answers from a function, for tests and offline runs."""

    answer: Callable[[str], str]
    name: str = "scripted"
    is_local: bool = True

    def complete(self, prompt: str) -> str:
        return self.answer(prompt)


@dataclass
class Task:
    """New columns of documents (doc_type, route, ...), for some types of documents, perhaps with a model.

    ``run(docs, mine)`` returns all rows of ``docs`` in one pass over them, with the new columns null where ``mine`` is false."""

    task_id: str
    run: Callable[[DataFrame, Column], DataFrame]
    doc_types: tuple[str, ...] = ()
    needs_model: bool = False

    def supports(self) -> Column:
        return F.coalesce(F.col("doc_type").isin(*self.doc_types), F.lit(False)) if self.doc_types else F.lit(True)


@dataclass
class Pipeline:
    """Tasks in order, each one step of one plan: n tasks scan the documents once. A row that a task doesn't support gets nulls; for a
    task with a model only rows that the provider may see are given to it, the others are noted in ``task_errors``."""

    tasks: list[Task]
    provider_is_local: bool = True
    timings: dict[str, float] = field(default_factory=dict)

    def __call__(self, docs: DataFrame, measure: bool = False) -> DataFrame:
        """With ``measure`` each task's result is written before the next one begins, and ``timings`` has its seconds."""
        docs = docs.withColumn("task_errors", F.array().cast("array<string>"))
        for t in self.tasks:
            began = time.perf_counter()
            mine = t.supports()
            if t.needs_model and "route" in docs.columns:
                allowed = may_see(F.col("route"), self.provider_is_local)
                docs = docs.withColumn("task_errors", F.when(mine & ~allowed, F.array_append("task_errors", F.lit(f"{t.task_id}: routing forbids this provider"))).otherwise(F.col("task_errors")))
                mine = mine & allowed
            docs = t.run(docs, mine)
            if measure:
                docs = materialize(docs, "task")
                self.timings[t.task_id] = time.perf_counter() - began
        return docs


def estimate(docs: DataFrame, tasks: list[Task], limits: dict[str, int], per_million: float, text: str = "full_text") -> DataFrame:
    """(task_id, documents, tokens, cost) of what a model would be sent for each task: four characters a token, at most ``limits`` characters
    of a text (12,000 where not named), at a price for a million tokens. Tasks without a model cost nothing. One pass over the documents."""
    sums = []
    for t in tasks:
        mine = t.supports() & F.col(text).isNotNull() & F.lit(t.needs_model)
        sent = F.floor(F.length(F.substring(text, 1, limits.get(t.task_id, 12_000))) / 4)
        sums.append(F.struct(F.lit(t.task_id).alias("task_id"), F.count_if(mine).alias("documents"), F.coalesce(F.sum(F.when(mine, sent)), F.lit(0)).cast("long").alias("tokens")))
    return docs.agg(F.array(*sums).alias("a")).select(F.inline("a")).withColumn("cost", F.col("tokens") * per_million / 1_000_000)


def append_columns(docs: DataFrame, text: Column, fields: str, make: Callable[[str | None], tuple]) -> DataFrame:
    """All rows of ``docs`` with the columns ``fields`` ("name type, ...") that ``make`` computes from a text, in one pass of Arrow batches."""
    names = [f.name for f in T.StructType.fromDDL(fields).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*b.schema.names[:-1], *names])

    kinds = [f.type for f in to_arrow_schema(T.StructType.fromDDL(fields))]
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(fields).fields])
    return docs.select("*", text.alias("_text_")).mapInArrow(run, schema)


class Registry:
    """Tasks by id."""

    def __init__(self):
        self._tasks: dict[str, Callable[[], Task]] = {}

    def register(self, task_id: str, make: Callable[[], Task]) -> None:
        if task_id in self._tasks:
            raise KeyError(f"{task_id} is registered already")
        self._tasks[task_id] = make

    def unregister(self, task_id: str) -> None:
        self._tasks.pop(task_id, None)

    def get(self, task_id: str) -> Task:
        return self._tasks[task_id]()

    def pipeline(self, *task_ids: str, provider_is_local: bool = True) -> Pipeline:
        return Pipeline([self.get(t) for t in task_ids], provider_is_local)


def complete(prompts: DataFrame, provider: Provider, tries: int = 3) -> DataFrame:
    """Prompts (..., prompt) with answer and error; a failing call leaves the first line of its error, a null prompt is not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for p in b.column(b.schema.get_field_index("prompt")).to_pylist():
                said, err = None, None
                for _ in range(tries if p is not None else 0):
                    try:
                        said, err = provider.complete(p), None
                        break
                    except Exception as e:  # noqa: BLE001
                        err = (str(e).splitlines() or [type(e).__name__])[0]
                answers.append(said)
                errors.append(err)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "answer", "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", answer string, error string"
    return prompts.mapInArrow(run, schema)


def prompt(template: str, text, limit: int):
    """A prompt around at most ``limit`` characters of a text, and whether it was cut."""
    return F.concat(F.lit(template), F.substring(text, 1, limit)).alias("prompt"), (F.length(text) > limit).alias("truncated")


def failed_documents(calls: DataFrame, doc: str) -> DataFrame:
    """Documents all of whose calls failed."""
    return calls.groupBy(doc).agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures")).filter("calls = failures").select(doc)
