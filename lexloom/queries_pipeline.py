"""Queries of the operators that are put together from others: retrieval, extraction, enforcement, repository, evaluation."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import chunking as C
from lexloom.operators import contracts as K
from lexloom.operators import enforcement as N
from lexloom.operators import evaluation as V
from lexloom.operators import extraction as E
from lexloom.operators import privacy as P
from lexloom.operators import rag as G
from lexloom.operators import storage as B
from lexloom.operators import structure as S
from lexloom.queries_constructed import _ORDERS, _contracts
from lexloom.session import table
from lexloom.sources.exports import audit_events, contract_summary
from lexloom.sources.files import bootstrap, from_pages

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).distinct()


def _text(*parts) -> Column:
    """Texts and columns one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- retrieval ------------------------------------------------------------------------------------------------------

_INDEX_SQL = """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CASE vec_id % 4 WHEN 1 THEN 'local_only' WHEN 3 THEN 'blocked' ELSE 'any' END AS route, vec_id % 7 = 0 AS superseded,
  CASE vec_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' END AS country, CASE vec_id % 6 WHEN 0 THEN 'CA' WHEN 3 THEN 'NY' END AS region,
  CASE vec_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 55 WHEN 3 THEN 30 ELSE 5 END AS level, CASE WHEN vec_id % 11 <> 0 THEN 1990 + vec_id % 30 END AS year FROM embeddings"""
_SOURCES_SQL = f"""WITH i AS ({_INDEX_SQL}), q AS (SELECT vec_id AS query_id, e AS qe, CASE WHEN vec_id % 100 = 0 THEN 'US' END AS wc, CASE WHEN vec_id % 200 = 0 THEN 'CA' END AS wr FROM i WHERE vec_id % 50 = 0),
s AS (SELECT query_id, wc, wr, i.*, list_cosine_similarity(e, qe) AS score FROM q CROSS JOIN i),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 15 AND score > 0),
f AS (SELECT *, 0.6 * score + 0.3 * level / 100.0 + 0.1 * CASE WHEN year IS NULL THEN 0.5 ELSE greatest(0.0, 1.0 - 0.02 * (2025 - year)) END AS combined FROM c
  WHERE route IN ('any', 'local_only') AND NOT superseded AND (wc IS NULL OR country IS NULL OR (country = wc AND (wr IS NULL OR region IS NULL OR region = wr)))),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, score DESC, vec_id) AS rank FROM f) WHERE rank <= 5)
"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    none = F.lit(None).cast("string")
    return table(spark, d, "embeddings").select(
        _text("d", v).alias("doc_id"), _text("d", v, ":chunk:0").alias("chunk_id"), v.cast("long").alias("seq"), _text("text ", v).alias("text"), F.col("embedding").cast("array<float>").alias("embedding"),
        none.alias("source_url"), F.lit("statute").alias("doc_type"), F.when(v % 4 == 1, "local_only").when(v % 4 == 3, "blocked").otherwise("any").alias("route"),
        F.when(v % 5 == 0, 100).when(v % 5 == 1, 75).when(v % 5 == 2, 55).when(v % 5 == 3, 30).otherwise(5).alias("level"), (v % 7 == 0).alias("superseded"),
        F.when(v % 11 != 0, (1990 + v % 30).cast("int")).alias("publication_year"), F.when(v % 3 == 0, "US").when(v % 3 == 1, "DE").alias("country"), F.when(v % 6 == 0, "CA").when(v % 6 == 3, "NY").alias("region"),
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(v.cast("long").alias("query_id"), F.col("embedding").alias("query_embedding"), _text("question ", v).alias("question"), F.when(v % 100 == 0, "US").alias("want_country"), F.when(v % 200 == 0, "CA").alias("want_region"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return G.answer_sources(_index(spark, d), _questions(spark, d), 5, 2025, True)


@query(_SOURCES_SQL + "SELECT query_id, vec_id AS seq, round(combined, 6) AS combined, CAST(rank AS INTEGER) AS rank FROM t")
def rag_sources(spark, d):
    """Sources of every question: 15 candidates among all rows, then privacy, superseded ones, jurisdiction, and the best 5."""
    return _sources(spark, d).select("query_id", "seq", F.round("combined", 6).alias("combined"), "rank")


@query(
    _SOURCES_SQL
    + """SELECT q.query_id, 'Context: ' || coalesce(string_agg('[' || rank || '] text ' || vec_id, chr(10) || chr(10) ORDER BY rank), '') || ' Q: question ' || q.query_id AS prompt, round(coalesce(avg(combined), 0), 6) AS confidence,
  CASE coalesce(max(CASE route WHEN 'any' THEN 0 ELSE 1 END), 0) WHEN 0 THEN 'any' ELSE 'local_only' END AS route FROM q LEFT JOIN t ON t.query_id = q.query_id GROUP BY q.query_id"""
)
def rag_prompts(spark, d):
    p = G.prompts(_sources(spark, d), _questions(spark, d), "Context: {context} Q: {question}")
    return p.select("query_id", "prompt", F.round("confidence", 6).alias("confidence"), "route")


@query(_SOURCES_SQL + "SELECT query_id, vec_id AS seq, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS INTEGER) AS rank FROM t")
def rag_reranked(spark, d):
    """A reranker that puts a question's sources in the order of their numbers."""
    r = G.answer_sources(_index(spark, d), _questions(spark, d), 5, 2025, True, reranker=lambda rows: rows.sort_values("seq"))
    return r.select("query_id", "seq", "rank")


_PARTS = "(SELECT DISTINCT p_partkey AS k, p_name AS name FROM part)"


@query(
    f"""SELECT 'new-' || k AS doc_id, 'new-' || k || ':chunk:0' AS chunk_id, CASE WHEN k % 2 = 0 THEN 'http://x/' ELSE '/x/' END || k AS source_url FROM {_PARTS} WHERE k % 3 = 0 AND k % 5 <> 0
UNION ALL SELECT 'old-' || k, 'old-' || k || ':chunk:0', CASE WHEN k % 2 = 0 THEN 'http://x/' ELSE '/x/' END || k FROM {_PARTS} WHERE NOT (k % 3 = 0 AND k % 5 <> 0 AND k % 2 = 0)"""
)
def rag_ingested(spark, d):
    """An index after a second delivery of every third source, of which every fifth fails; sources with an http address are replaced."""
    return _ingest(spark, d)[0].select("doc_id", "chunk_id", "source_url")


@query(f"SELECT 'new-' || k AS doc_id, CASE WHEN k % 5 = 0 THEN 'failed' ELSE 'ingested' END AS status, CASE WHEN k % 5 = 0 THEN 'timeout' END AS error FROM {_PARTS} WHERE k % 3 = 0")
def rag_ingest_report(spark, d):
    return _ingest(spark, d)[1]


def _ingest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")).distinct()
    url = F.when(F.col("k") % 2 == 0, _text("http://x/", F.col("k"))).otherwise(_text("/x/", F.col("k")))

    def sources(which: str, df: DataFrame, error) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        return df.select(_text(f"{which}-", F.col("k")).alias("doc_id"), url.alias("source_url"), F.when(error.isNull(), F.col("name")).alias("text"), error.alias("error"), F.lit("statute").alias("doc_type"), F.lit("any").alias("route"), F.lit(1).alias("level"), F.lit(False).alias("superseded"), none("int").alias("publication_year"), none("string").alias("country"), none("string").alias("region"))

    empty = spark.createDataFrame([], G.INDEX)
    old, _ = G.ingest(empty, sources("old", parts, F.lit(None).cast("string")), G.HashEmbedder(16))
    return G.ingest(old, sources("new", parts.filter("k % 3 = 0"), F.when(F.col("k") % 5 == 0, "timeout")), G.HashEmbedder(16))


@query("SELECT vec_id AS seq FROM embeddings WHERE vec_id % 3 <> 0")
def rag_removed(spark, d):
    """The index after a third of its documents were removed, by a list of theirs."""
    i = _index(spark, d)
    return G.remove(i, i.filter("seq % 3 = 0").select("doc_id")).select("seq")


@query("SELECT c AS query_id, k AS ord, string_agg(k || ' ', '') OVER (PARTITION BY c ORDER BY k ROWS UNBOUNDED PRECEDING) AS text FROM (SELECT DISTINCT o_custkey AS c, o_orderkey AS k FROM orders)")
def partial_answers(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("ord")).distinct()
    return G.partial_answers(o.withColumn("token", _text(F.col("ord"), " ")))


@query(
    """SELECT s_nationkey AS query_id, count(*) AS conflicts, CAST(sum(length('  [TEMPORAL_CONFLICT] ' || CASE WHEN s_suppkey % 2 = 0 THEN 'years of ' || s_suppkey ELSE 'See the sources.' END) + 1) AS BIGINT) AS chars FROM (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier) GROUP BY s_nationkey"""
)
def conflict_notes(spark, d):
    """The listed part of every question's note."""
    c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), F.col("s_suppkey").alias("ord")).distinct()
    c = c.select("*", F.lit("temporal_conflict").alias("conflict_type"), F.when(F.col("ord") % 2 == 0, _text("years of ", F.col("ord"))).alias("description"))
    listed = F.filter(F.split("note", "\n"), lambda x: x.startswith("  ["))
    return G.conflict_note(c).select("query_id", F.size(listed).cast("long").alias("conflicts"), F.aggregate(listed, F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1).alias("chars"))


# ---- extraction -----------------------------------------------------------------------------------------------------


@dataclass
class _Model:
    """A scripted model that answers from the number of the document in the prompt."""

    name: str = "scripted"
    is_local: bool = True

    def complete(self, prompt: str) -> str:
        k, seq = map(int, re.search(r"doc (\d+) part (\d+)", prompt).groups())
        kind = next(c for c, p in K.PROMPTS.items() if prompt.startswith(p))
        if k % 35 == 0 or (kind == "combined" and k % 4 == 0):
            raise ValueError(f"refused {k}\nand more")
        if kind == "info":
            parties = [{"name": f" Acme  {k}", "role": "buyer", "confidence": 0.9}, {"name": f"acme {k}", "role": "buyer", "confidence": 0.95}, {"name": "Low", "role": None, "confidence": 0.2}]
            return json.dumps({"contract_type": "NDA" if k % 3 == 0 else "letter", "title": f"T{k}", "effective_date": "January 2, 2024", "parties": parties})
        clauses = [{"clause_type": "payment", "text": f" Payment for {k} is due at once. " if seq == 0 else "Zinc must be delivered by Tuesday.", "confidence": 0.9}, {"clause_type": "x", "text": "low", "confidence": 0.1}, {"clause_type": "", "text": "untyped", "confidence": 0.9}]
        terms = [{"term_type": "fee", "amount": "USD 1,000.50", "currency": "usd", "due_date": "2024-03-01", "confidence": c} for c in (0.8, 0.9)] + [{"term_type": "cap", "amount": str(k), "currency": "eur", "due_date": None, "confidence": 0.7}]
        return json.dumps({"clauses": clauses, "financial_terms": terms})


def _extracted(spark: SparkSession, d: str) -> K.Extracted:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc")).distinct()
    chunks = c.select("doc", F.explode(F.when(F.col("doc") % 2 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("seq"))
    return K.extract(chunks.select("doc", "seq", _text("doc ", F.col("doc"), " part ", F.col("seq")).alias("chunk")), _Model(), ["nda", "lease"])


_CUST = "(SELECT DISTINCT c_custkey AS k FROM customer)"


@query(
    f"""SELECT k AS doc, CASE WHEN k % 35 = 0 THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN k % 35 <> 0 AND k % 3 = 0 THEN 'nda' END AS contract_type, CASE WHEN k % 35 <> 0 THEN 'T' || k END AS title,
  CASE WHEN k % 35 <> 0 THEN DATE '2024-01-02' END AS effective_date, CASE WHEN k % 35 <> 0 THEN 1 WHEN k % 2 = 0 THEN 3 ELSE 5 END AS warnings FROM {_CUST}"""
)
def extracted_documents(spark, d):
    """One row per contract; where all calls failed the warnings are these calls, otherwise one about a party below the threshold."""
    return _extracted(spark, d).documents.select("doc", "status", "contract_type", "title", "effective_date", F.size("warnings").alias("warnings"))


@query(f"SELECT k AS doc, 'Acme ' || k AS spelt, 0.95 AS confidence FROM {_CUST} WHERE k % 35 <> 0 UNION ALL SELECT k, 'Low', 0.2 FROM {_CUST} WHERE k % 35 <> 0")
def extracted_parties(spark, d):
    return _extracted(spark, d).parties.select("doc", F.initcap("name").alias("spelt"), "confidence")


@query(f"SELECT k AS doc, 'Payment for ' || k || ' is due at once.' AS text FROM {_CUST} WHERE k % 35 <> 0 UNION ALL SELECT k, 'Zinc must be delivered by Tuesday.' FROM {_CUST} WHERE k % 35 <> 0 AND k % 2 = 1")
def extracted_clauses(spark, d):
    return _extracted(spark, d).clauses.select("doc", "text")


@query(
    f"SELECT k AS doc, 'fee' AS term_type, 1000.5 AS amount, 'USD' AS currency, DATE '2024-03-01' AS due_date, 0.9 AS confidence FROM {_CUST} WHERE k % 35 <> 0 UNION ALL SELECT k, 'cap', CAST(k AS DOUBLE), 'EUR', NULL, 0.7 FROM {_CUST} WHERE k % 35 <> 0"
)
def extracted_terms(spark, d):
    return _extracted(spark, d).terms.select("doc", "term_type", F.col("amount").cast("double").alias("amount"), "currency", "due_date", "confidence")


@query(
    """WITH c AS (SELECT doc_id, CAST(sum(length(chunk_text) // 4) AS BIGINT) AS a, length(left(string_agg(CASE WHEN chunk_index < 2 THEN chunk_text END, chr(10) || chr(10) ORDER BY chunk_index, chunk_text), 12000)) // 4 AS i FROM document_chunks WHERE chunk_text IS NOT NULL GROUP BY doc_id)
SELECT doc_id AS doc, CAST(coalesce(a, 0) + coalesce(i, 0) + coalesce(length(left(full_text, 20000)) // 4, 0) AS BIGINT) AS tokens FROM legal_docs LEFT JOIN c USING (doc_id)"""
)
def extraction_estimate(spark, d):
    """Tokens that extracting every document from its stored chunks would take."""
    chunks = table(spark, d, "document_chunks").filter("chunk_text is not null").select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("seq"), F.col("chunk_text").alias("chunk"))
    return K.estimate(chunks, table(spark, d, "legal_docs").select(F.col("doc_id").alias("doc"), F.col("full_text").alias("text")), 2.0).select("doc", "tokens")


@query("SELECT clause_type, count(*) AS clauses FROM (SELECT DISTINCT id, clause_type, clause_text, confidence_score FROM clauses) WHERE length(clause_text) > 0 AND length(clause_type) > 0 AND confidence_score >= 0.7 GROUP BY clause_type")
def clauses_kept(spark, d):
    c = table(spark, d, "clauses").dropDuplicates(["id"]).select("clause_type", F.col("clause_text").alias("text"), F.col("confidence_score").alias("confidence"))
    return K.build_clauses(c, 0.7).groupBy("clause_type").agg(F.count("*").alias("clauses"))


@query("SELECT document_id, count(*) AS clauses FROM (SELECT DISTINCT id, document_id, confidence_score FROM clauses) WHERE confidence_score >= 0.8 GROUP BY document_id")
def sure_clauses(spark, d):
    return E.high_confidence(table(spark, d, "clauses").dropDuplicates(["id"]), "confidence_score").groupBy("document_id").agg(F.count("*").alias("clauses"))


@query(
    f"""SELECT k AS doc, 'Added:    ' || CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END || ' clause type(s)' || chr(10) || 'Removed:  0 clause type(s)' || chr(10) || 'Modified: ' || CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END || ' clause(s)'
  || CASE WHEN k % 4 = 0 THEN chr(10) || '  + audit' ELSE '' END || CASE WHEN k % 3 = 0 THEN chr(10) || '  ~ fee (similarity=' || printf('%.2f', 2.0 * (length(t) - 1) / (2 * length(t))) || ')' ELSE '' END AS summary
FROM (SELECT k, 'fee of ' || k || ' is due on the very first day' AS t FROM {_CUST}) WHERE k % 3 = 0 OR k % 4 = 0"""
)
def built_version_summary(spark, d):
    """Two versions of every customer's clauses: one letter differs for each third, a clause type is new for each fourth."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc")).distinct().select("doc", F.lit(1).cast("long").alias("ord"), F.lit("fee").alias("clause_type"), _text("fee of ", F.col("doc"), " is due on the very first day").alias("text"))
    v2 = c.withColumn("text", F.when(F.col("doc") % 3 == 0, F.regexp_replace("text", "day$", "dax")).otherwise(F.col("text")))
    v2 = v2.unionByName(c.filter("doc % 4 = 0").select("doc", F.lit(2).cast("long").alias("ord"), F.lit("audit").alias("clause_type"), F.lit("Books may be seen.").alias("text")))
    return E.diff_summary(E.compare_versions(c, v2))


@query("SELECT o_custkey, bool_and(o_orderkey % 4 IN (0, 1)) AS all_resolved, count(*) FILTER (WHERE o_orderkey % 4 NOT IN (0, 1)) AS open FROM orders GROUP BY o_custkey")
def timeline_state(spark, d):
    """Orders as obligations, of which half have a date."""
    o = table(spark, d, "orders").select("o_custkey", F.when((F.col("o_orderkey") % 4).isin(0, 1), F.col("o_orderdate").cast("date")).alias("due"))
    return E.all_resolved(o, "due", "o_custkey").join(E.unresolved(o, "due").groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "left").select("o_custkey", "all_resolved", F.coalesce("n", F.lit(0)).alias("open"))


@query("SELECT id, coalesce(role, '') AS role, coalesce(address, '') AS address FROM parties")
def timeline_texts(spark, d):
    return E.timeline_entries(table(spark, d, "parties").select("id", "role", "address"), ["role", "address"])


# ---- enforcement ----------------------------------------------------------------------------------------------------


@dataclass
class _Echo:
    """A provider that says what it was told."""

    is_local: bool
    host: str
    name: str = "echo"
    model: str = "small"

    def complete(self, prompt: str) -> str:
        return f"You said: {prompt}"


LOCAL, CLOUD = _Echo(True, "http://10.1.2.3:11434"), _Echo(False, "https://api.example.org")


@query(
    """SELECT sensitivity, provider, CASE WHEN sensitivity IN ('public', 'confidential') THEN CASE sensitivity WHEN 'public' THEN 'sent_raw' ELSE 'sent_redacted' END WHEN sensitivity = 'restricted' THEN CASE provider WHEN 'local' THEN 'sent_redacted' ELSE 'routing_error' END ELSE 'blocked' END AS decision
FROM (VALUES ('public'), ('confidential'), ('restricted'), ('secret')) s(sensitivity), (VALUES ('local'), ('cloud')) p(provider)"""
)
def routing_matrix(spark, d):
    """What becomes of a document of every sensitivity with every kind of provider."""
    s = spark.createDataFrame([(x,) for x in ("public", "confidential", "restricted", "secret")], "sensitivity string")
    route = P.effective_route(F.col("sensitivity"), F.lit(None).cast("string"))
    cell = lambda name, p: s.select("sensitivity", F.lit(name).alias("provider"), N.decision(route, F.col("sensitivity"), F.lit(False), N.not_local(p)).alias("decision"))
    return cell("local", LOCAL).unionByName(cell("cloud", CLOUD))


@query(
    f"""SELECT k AS id, CASE WHEN k % 5 = 0 THEN 'blocked' WHEN k % 5 = 1 THEN 'routing_error' WHEN k % 2 = 0 THEN 'sent_redacted' ELSE 'sent_raw' END AS decision,
  CASE WHEN k % 5 > 1 THEN CASE WHEN k % 2 = 0 THEN 'Mail <EMAIL_ADDRESS_1> or <EMAIL_ADDRESS_2>' ELSE 'Mail c' || k || '@example.org or d' || k || '@example.org' END END AS sent,
  CASE WHEN k % 5 > 1 THEN 'You said: Mail c' || k || '@example.org or d' || k || '@example.org' END AS answer FROM {_CUST}"""
)
def enforced_answers(spark, d):
    """Prompts of all routes to a provider in a cloud: what it saw, and its answers with the addresses back in place."""
    k = F.col("id")
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).distinct().select("id", _text("Mail c", k, "@example.org or d", k, "@example.org").alias("prompt"), F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "local_only").otherwise("any").alias("route"), F.when(k % 2 == 0, "confidential").otherwise("public").alias("sensitivity"), F.lit(False).alias("redaction_done"))
    return N.enforced(p, CLOUD).select("id", "decision", "sent", "answer")


@query(f"SELECT k AS doc, 5 AS \"start\", CAST(5 + length('c' || k || '@example.org') AS INTEGER) AS \"end\", 'EMAIL_ADDRESS' AS entity FROM {_CUST} UNION ALL SELECT k, CAST(9 + length('c' || k || '@example.org') AS INTEGER), CAST(20 + length('c' || k || '@example.org') AS INTEGER), 'US_SSN' FROM {_CUST}")
def built_pii_spans(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).distinct().select("id", _text("Mail c", F.col("id"), "@example.org or 123-45-6789.").alias("t"))
    return P.merge_spans(P.detect(t, "id", "t")).select("doc", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity")


# ---- structure and provenance ---------------------------------------------------------------------------------------


@query(f"SELECT k AS doc, '1' AS number, 'Section 1' AS reference FROM {_ORDERS} UNION ALL SELECT k, '(a)', 'Section (a)' FROM {_ORDERS}")
def built_leaves(spark, d):
    s = S.leaves(S.sections(_contracts(spark, d), "id", "full_text"))
    return s.select("doc", "number", S.full_reference(F.col("number"), F.col("title")).alias("reference"))


@query(f"SELECT k AS doc, raw, ord FROM {_ORDERS}, (VALUES ('Section 1', 1), ('§ 2', 2), ('clause (a)', 3), ('Article 9', NULL)) v(raw, ord)")
def built_resolved(spark, d):
    docs = _contracts(spark, d)
    refs = docs.select(F.col("id").alias("doc"), F.explode(F.array(*map(F.lit, ("Section 1", "§ 2", "clause (a)", "Article 9")))).alias("raw"))
    return S.resolve(refs, S.sections(docs, "id", "full_text"))


@query(
    f"""SELECT 'sections' AS part, 3 * count(*) AS n FROM {_ORDERS} UNION ALL SELECT 'terms', count(*) FROM {_ORDERS} UNION ALL SELECT 'usages', count(*) FROM {_ORDERS} UNION ALL SELECT 'references', 2 * count(*) + count(*) FILTER (WHERE k % 5 NOT IN (1, 2)) FROM {_ORDERS}
UNION ALL SELECT 'schedules', count(*) FROM {_ORDERS} UNION ALL SELECT 'laws', count(*) FROM {_ORDERS} UNION ALL SELECT 'warnings', 0"""
)
def built_parse(spark, d):
    """The rows of every part of a whole parse."""
    p = S.parse(_contracts(spark, d), "id", "full_text")
    parts = [("sections", p.sections), ("terms", p.terms), ("usages", p.usages), ("references", p.references), ("schedules", p.schedules), ("laws", p.laws), ("warnings", p.warnings)]
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts])


@query(f"SELECT k AS doc, 'goods of ' || k || ' are sold' AS recital FROM {_ORDERS} UNION ALL SELECT k, 'they agree' FROM {_ORDERS} WHERE k % 2 = 0")
def built_recitals(spark, d):
    o = _orders(spark, d)
    t = o.select(F.col("k").alias("id"), F.concat(_text("WHEREAS, goods of ", F.col("k"), " are sold\nx\n"), F.when(F.col("k") % 2 == 0, "  Whereas they agree ").otherwise("none")).alias("t"))
    return S.recitals(t, "id", "t").select("doc", "recital")


@query(f"SELECT k AS doc, code, location FROM {_ORDERS}, (VALUES (0, 'NO_SECTIONS_FOUND', ''), (1, 'DUPLICATE_SECTION_NUMBER', '1'), (2, 'MIXED_NUMBERING_SCHEMES', '')) v(m, code, location) WHERE k % 4 = m")
def built_warnings(spark, d):
    """Texts without sections, with a number used twice, with two schemes, and without a fault."""
    m = F.col("k") % 4
    t = _orders(spark, d).select(F.col("k").alias("id"), F.when(m == 0, "plain words").when(m == 1, "1. One\nx\n1. Two\ny").when(m == 2, "1. One\nx\nA. Two\ny").otherwise("1. One\nx\n2. Two\ny").alias("t"))
    return S.parse_warnings(S.sections(t, "id", "t"), t.select(F.col("id").alias("doc")))


@query(f"SELECT k AS doc, k || ' U.S.C. § 34' AS raw_text, 'statute' AS citation_type, CAST(4 AS BIGINT) AS char_start FROM {_ORDERS} UNION ALL SELECT k, 'GDPR', 'regulation', CAST(length('see ' || k || ' U.S.C. § 34 and ') AS BIGINT) FROM {_ORDERS}")
def built_citations(spark, d):
    t = _orders(spark, d).select(F.col("k").alias("id"), _text("see ", F.col("k"), " U.S.C. § 34 and GDPR and GDPR").alias("t"))
    return E.citations(t, "id", "t").select("doc", "raw_text", "citation_type", "char_start")


@query(f"SELECT k AS doc, CAST(seq AS INTEGER) AS seq, CAST(50 * seq AS BIGINT) AS char_start, CAST(50 * seq + 49 AS BIGINT) AS char_end FROM {_ORDERS}, range(3) r(seq)")
def built_chunks(spark, d):
    """Six sections of 24 characters in each text: two fit a chunk of 12 tokens."""
    k = F.lpad(F.col("k").cast("string"), 8, "0")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(i.cast("string"), F.lit(". Section body "), k)), "\n")
    return C.chunk_clause_aware(_orders(spark, d).select(F.col("k").alias("id"), text.alias("t")), "id", "t", 12, 0).select("doc", "seq", "char_start", "char_end")


@query(f"SELECT k AS doc, seq, CAST(seq * (length('aa-' || k) + 1) AS BIGINT) AS char_start, printf('chunk-%04d-', seq) || left(sha256(CASE seq WHEN 1 THEN 'bb-' ELSE 'aa-' END || k), 8) AS chunk_id, CAST(seq + 1 AS INTEGER) AS page, CAST(NULL AS VARCHAR) AS error FROM {_ORDERS}, (VALUES (0), (1), (2)) v(seq) WHERE k % 2 = 0 UNION ALL SELECT k, 1, NULL, NULL, 2, 'chunk 1 is not in the text' FROM {_ORDERS} WHERE k % 2 = 1")
def built_registered_chunks(spark, d):
    """Chunks looked up in their texts in order; every second text lacks one."""
    o = _orders(spark, d)
    k = F.col("k")
    text = F.when(k % 2 == 0, _text("aa-", k, " bb-", k, " aa-", k)).otherwise(_text("aa-", k, " aa-", k))
    chunks = o.select(k.alias("doc"), F.posexplode(F.array(_text("aa-", k), _text("bb-", k), _text("aa-", k))).alias("seq", "chunk"))
    pages = o.select(k.alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq")).withColumn("page", F.col("seq") + 1)
    return C.register_chunks(chunks, o.select(k.alias("doc"), text.alias("text")), pages).select("doc", "seq", "char_start", "chunk_id", "page", "error")


@query(f"SELECT k AS doc, CAST(5 AS BIGINT) AS \"start\", CAST(5 + length('fee for ' || k) + 1 AS BIGINT) AS \"end\" FROM {_ORDERS}")
def built_located(spark, d):
    """Quotations in other white space than their text's."""
    t = _orders(spark, d).select(F.col("k").alias("doc"), _text("fee for ", F.col("k")).alias("quote"), _text("The \nfee \nfor ", F.col("k"), " is due").alias("text"))
    return C.locate_quotes(t).select("doc", "start", "end")


_VALUES_SQL = "SELECT count(*) AS \"values\", count(*) FILTER (WHERE k % 3 <> 2) AS resolved, count(*) FILTER (WHERE k % 3 = 0) AS correct, count(*) FILTER (WHERE k % 3 <> 2) AS exact"


@query(f"{_VALUES_SQL} FROM {_ORDERS}")
def built_provenance_scores(spark, d):
    """Values found in the right place, in another one that reads alike, or not at all."""
    o = _orders(spark, d)
    k = F.col("k")
    m = k % 3
    at = F.when(m == 0, 0).when(m == 1, 10).cast("long")
    v = o.select(k.alias("doc"), F.lit("abc").alias("value"), F.lit(0).cast("long").alias("gold_start"), F.lit(3).cast("long").alias("gold_end"), at.alias("char_start"), (at + 3).alias("char_end"))
    return V.provenance_scores(v, o.select(k.alias("doc"), F.lit("abc ... . abc").alias("text")))


@query(f"SELECT k AS doc, 'f' AS field, 'value ' || k AS value, CASE WHEN k % 2 = 0 THEN 1 END AS seq, CASE WHEN k % 2 = 0 THEN 1.0 END AS score FROM {_ORDERS}")
def built_provenance(spark, d):
    """Values that the second of a text's chunks has, and such that none has."""
    o = _orders(spark, d)
    k = F.col("k")
    values = o.select(k.alias("doc"), F.lit("f").alias("field"), _text("value ", k).alias("value"))
    chunks = o.select(k.alias("doc"), F.posexplode(F.array(F.lit("first part"), F.when(k % 2 == 0, _text("the value ", k, " stands")).otherwise("nothing"), F.lit("value"))).alias("seq", "chunk"))
    chunks = chunks.select("doc", "seq", F.lit(0).cast("long").alias("char_start"), F.length("chunk").cast("long").alias("char_end"), "chunk")
    return C.find_provenance(values, chunks).select("doc", "field", "value", "seq", "score")


# ---- repository -----------------------------------------------------------------------------------------------------


@query("SELECT id, filename FROM source_files WHERE filename = (SELECT min(filename) FROM source_files)")
def file_lookup(spark, d):
    f = table(spark, d, "source_files")
    return B.by_key(f, "filename", f.agg(F.min("filename")).first()[0]).select("id", "filename")


@query("SELECT document_id, count(*) AS clauses FROM clauses WHERE document_id IS NOT NULL GROUP BY document_id")
def clause_counts(spark, d):
    return B.count_by_document(table(spark, d, "clauses"))


@query("SELECT id FROM (SELECT DISTINCT id, created_at FROM clauses WHERE clause_type = 'payment') ORDER BY created_at DESC NULLS FIRST, id LIMIT 40")
def newest_of_type(spark, d):
    return B.by_type(table(spark, d, "clauses").dropDuplicates(["id"]), "payment", 40).select("id")


@query("SELECT id FROM clauses WHERE document_id IS NULL OR document_id % 4 <> 0")
def clauses_after_delete(spark, d):
    c = table(spark, d, "clauses")
    return B.delete_by_document(c, table(spark, d, "legal_docs").filter("id % 4 = 0").select("id").union(c.filter("document_id % 4 = 0").select("document_id")).distinct()).select("id")


@query("SELECT id, arg_min(document_id, id) AS document_id FROM clauses GROUP BY id")
def clauses_inserted(spark, d):
    """Every clause inserted into a store that has a third of them already: each id once."""
    c = table(spark, d, "clauses").select("id", "document_id")
    return B.insert_rows(c.filter("id % 3 = 0").distinct(), c)


@query("SELECT 'contract' AS doc_type, coalesce(json_extract_string(metadata, '$.contract_type'), filename) AS title, file_hash AS content_hash, filename, uploaded_at AS created_at FROM source_files")
def files_as_contracts(spark, d):
    m = B.documents_to_legal(table(spark, d, "source_files"))
    return m.select("doc_type", "title", "content_hash", F.get_json_object("metadata", "$.filename").alias("filename"), "created_at")


@query("SELECT sha256('key' || id) AS document_id, 'erasure' AS processing_stage, 'completed' AS status FROM legal_docs WHERE id % 10 = 0")
def erasure_events(spark, d):
    """The events that an erasure adds to the log, one for each erased document."""
    gone = table(spark, d, "legal_docs").filter("id % 10 = 0").select("id")
    log = B.erase(table(spark, d, "processing_log"), "document_id", gone, F.sha2(_text("key", F.col("id")), 256), {"processing_stage": F.lit("erasure"), "status": F.lit("completed")})
    return log.filter("processing_stage = 'erasure'").select("document_id", "processing_stage", "status")


@query("SELECT document_id, count(*) FILTER (WHERE bbox_x IS NOT NULL AND bbox_y IS NOT NULL AND bbox_width IS NOT NULL AND bbox_height IS NOT NULL) AS boxes FROM clauses GROUP BY document_id")
def clause_boxes(spark, d):
    box = B.bounding_box(*(F.col(f"bbox_{c}") for c in ("x", "y", "width", "height")))
    return table(spark, d, "clauses").groupBy("document_id").agg(F.count(box).alias("boxes"))


@query("SELECT status, count(*) AS files FROM (SELECT filename, CASE WHEN max(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) = 1 THEN 'skipped' WHEN max(extracted_text) IS NULL THEN 'failed' ELSE 'inserted' END AS status FROM source_files GROUP BY filename) GROUP BY status")
def bootstrap_counts(spark, d):
    """All files taken into a store that has every fourth id's; files without a text could not be read."""
    f = table(spark, d, "source_files")
    files = f.select("filename", F.col("extracted_text").alias("text"), F.when(F.col("extracted_text").isNull(), "unreadable").alias("error"))
    return bootstrap(files, f.filter("id % 4 = 0"))[1]


@query(f"SELECT k AS doc, 'page 1 of ' || k || chr(10) || chr(10) || 'page 3' AS text FROM {_ORDERS}")
def built_pages(spark, d):
    o = _orders(spark, d)
    pages = o.select(F.col("k").alias("source"), F.posexplode(F.array(_text("page 1 of ", F.col("k")), F.lit(None).cast("string"), F.lit("page 3"))).alias("page", "page_content"))
    return from_pages(pages)


@query("SELECT id AS doc, (SELECT count(*) FROM clauses c WHERE c.document_id = l.id) AS clauses, (SELECT count(*) FROM processing_log p WHERE p.document_id = l.id) AS events FROM legal_docs l")
def document_summary(spark, d):
    """The summary sheet of an export."""
    part = lambda n: table(spark, d, n).select(F.col("document_id").alias("doc"))
    return contract_summary(table(spark, d, "legal_docs").select(F.col("id").alias("doc")), clauses=part("clauses"), events=part("processing_log"))


@query("SELECT 'error' AS event_type, CAST(document_id AS VARCHAR) AS document_id, error_message AS metadata, count(DISTINCT created_at) AS events FROM processing_log WHERE status = 'failed' GROUP BY document_id, error_message")
def audit_errors(spark, d):
    """Failures as audit events; the same failure told twice is one event."""
    failed = table(spark, d, "processing_log").filter("status = 'failed'")
    e = audit_events(failed, "error", F.col("document_id"), F.col("created_at"), metadata=F.col("error_message"))
    return e.dropDuplicates(["event_id"]).groupBy("event_type", "document_id", "metadata").agg(F.count("*").alias("events"))


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS cases, count(*) FILTER (WHERE id % 5 = 0) AS error_cases, count(*) FILTER (WHERE id % 5 <> 0) AS correct FROM (SELECT DISTINCT id FROM parties)")
def eval_errors(spark, d):
    """A run in which every fifth case ended in an error and the others are right."""
    ids = table(spark, d, "parties").select(F.col("id").alias("case_id")).distinct()
    value = ids.select("case_id", F.lit("id").alias("field"), F.col("case_id").cast("string").alias("value"), F.lit(1.0).alias("weight"))
    scored, counts = V.score_run(value, value, ids.filter("case_id % 5 = 0"))
    return counts.crossJoin(scored.agg(F.count_if("match").alias("correct")))


@query(
    """SELECT avg(CASE WHEN id % 7 = 0 THEN 0 WHEN id % 2 = 0 THEN 1 ELSE 0.5 END) AS precision, avg(CASE WHEN id % 7 = 0 THEN 0 ELSE 1 END) AS recall, avg(CASE WHEN id % 7 <> 0 AND id % 3 <> 0 THEN 1 ELSE 0 END) AS blocking_accuracy, count(*) FILTER (WHERE id % 7 = 0) AS failures FROM (SELECT DISTINCT id FROM parties)"""
)
def eval_privacy(spark, d):
    """Privacy cases with a false alarm in each second, a wrong blocking in each third and a crash in each seventh."""
    i = F.col("id")
    c = table(spark, d, "parties").select("id").distinct().select(
        F.array(F.lit("EMAIL")).alias("expected"), F.when(i % 2 == 0, F.array(F.lit("email"))).otherwise(F.array(F.lit("EMAIL"), F.lit("PHONE"))).alias("found"), F.lit(1).alias("expected_count"), F.lit(1).alias("found_count"),
        F.lit(True).alias("should_block"), (i % 3 != 0).alias("blocked"), (i % 7 == 0).alias("crashed"),
    )
    return V.privacy_run(c).select("precision", "recall", "blocking_accuracy", "failures")


@query(f"SELECT 'PER' AS label, 2 * count(*) AS tokens, count(*) + count(*) FILTER (WHERE k % 2 = 1) AS \"left\" FROM {_ORDERS}")
def built_leaks(spark, d):
    """'Mr. Ann of Kent' is labelled in every text; a detector finds 'Ann', and that only in every second."""
    o = _orders(spark, d)
    k = F.col("k")
    spans = o.select(k.alias("doc"), F.lit("PER").alias("label"), F.lit(4).cast("long").alias("start"), F.lit(19).cast("long").alias("end"), F.lit("Mr. Ann of Kent").alias("text"))
    found = o.filter("k % 2 = 0").select(k.alias("doc"), F.lit(8).cast("long").alias("start"), F.lit(11).cast("long").alias("end"))
    return V.leaks(V.identifying_tokens(spans, ["Mr"]), found)


@query(f"SELECT k AS doc FROM {_ORDERS} WHERE k % 3 = 0")
def built_false_alarms(spark, d):
    """Found spans behind a labelled one, touching it, and across its end."""
    o = _orders(spark, d)
    k = F.col("k")
    start = F.when(k % 3 == 0, 10).otherwise(9).cast("long")
    found = o.select(k.alias("doc"), start.alias("start"), (start + 4).alias("end"))
    return V.false_alarms(found, o.select(k.alias("doc"), F.lit(5).cast("long").alias("start"), F.lit(10).cast("long").alias("end"))).select("doc")
