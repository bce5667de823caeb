"""Further operators over texts and rows built from table columns, each with its result in closed form as SQL; streams run as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import chunking as C
from lexloom.operators import evaluation as V
from lexloom.operators import extraction as E
from lexloom.operators import privacy as P
from lexloom.operators import retrieval as R
from lexloom.operators import storage as B
from lexloom.operators import structure as S
from lexloom.plans.builtin import default_registry, first_chunks_prompt, provider_kind
from lexloom.plans.runtime import shared_dir
from lexloom.plans.tasks import Scripted, estimate
from lexloom.queries_constructed import _ORDERS
from lexloom.queries_pipeline import _CUST, _orders, _text
from lexloom.session import table
from lexloom.sources.exports import write_csv
from lexloom.sources.files import load_files
from lexloom.sources.web import fetch, fetch_pages
from lexloom.streaming import audit as A

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct()


# ---- texts ----------------------------------------------------------------------------------------------------------


@query(f"SELECT k AS doc, CAST(1 AS INTEGER) AS ord, 'Name ' || k AS party_name, CASE WHEN k % 2 = 0 THEN 'BETA LLC' ELSE '' END AS signature_line_text FROM {_ORDERS} UNION ALL SELECT k, 2, 'BETA LLC', '' FROM {_ORDERS} WHERE k % 2 = 0")
def built_signatures(spark, d):
    """Below the signing phrase a company, a signer who is renamed, and for every second text another company."""
    k = F.col("k")
    t = _orders(spark, d).select(k.alias("id"), F.concat(_text("By: Nobody\nIN WITNESS WHEREOF the parties\nACME LLC\nBy: Jane\nName: Name ", k), F.when(k % 2 == 0, "\nBETA LLC").otherwise("")).alias("t"))
    return S.signature_blocks(t, "id", "t")


@query(f"SELECT k AS doc, CAST(seq AS INTEGER) AS seq, CASE seq WHEN 0 THEN 'alpha ' || lpad(CAST(k AS VARCHAR), 8, '0') || chr(10) || chr(10) || 'beta ' || lpad(CAST(k AS VARCHAR), 8, '0') ELSE 'gamma ' || lpad(CAST(k AS VARCHAR), 8, '0') END AS chunk FROM {_ORDERS}, range(2) r(seq)")
def built_semantic_chunks(spark, d):
    """Three paragraphs of three tokens each: two fit a chunk of seven."""
    k = F.lpad(F.col("k").cast("string"), 8, "0")
    t = _orders(spark, d).select(F.col("k").alias("id"), F.concat(F.lit("alpha "), k, F.lit("\n\nbeta "), k, F.lit("\n \ngamma "), k).alias("t"))
    return C.chunk_semantic(t, "id", "t", 7, 0).select("doc", "seq", "chunk")


@query(f"SELECT k AS doc, CAST(seq AS INTEGER) AS seq, CAST(11 * seq AS BIGINT) AS char_start, CAST(11 * seq + 10 AS BIGINT) AS char_end FROM {_ORDERS}, range(4) r(seq)")
def built_fixed_chunks(spark, d):
    """Words of ten characters under a window of twelve: each window is cut back to its last blank."""
    w = F.lpad(F.col("k").cast("string"), 10, "0")
    t = _orders(spark, d).select(F.col("k").alias("id"), F.concat_ws(" ", w, w, w, w).alias("t"))
    return C.chunk_fixed(t, "id", "t", 3).select("doc", "seq", "char_start", "char_end")


@query(f"SELECT 'clause aware' AS chunker, 6 * count(*) AS scored, 6 * count(*) AS intact FROM {_ORDERS} UNION ALL SELECT 'fixed', 6 * count(*), 4 * count(*) FROM {_ORDERS}")
def built_chunk_integrity(spark, d):
    """Sections of 24 characters as gold spans: packed by sections all stay whole, under a window of 40 characters few do."""
    k = F.lpad(F.col("k").cast("string"), 8, "0")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(i.cast("string"), F.lit(". Section body "), k)), "\n")
    t = _orders(spark, d).select(F.col("k").alias("id"), text.alias("t"))
    gold = t.select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("doc", (F.col("i") * 25).cast("long").alias("start"), (F.col("i") * 25 + 24).cast("long").alias("end"))
    score = lambda c, n: C.span_integrity(c, gold, 12).select(F.lit(n).alias("chunker"), "scored", "intact")
    return score(C.chunk_clause_aware(t, "id", "t", 12, 0), "clause aware").unionByName(score(C.chunk_fixed(t, "id", "t", 10), "fixed"))


@query(
    f"""SELECT k AS doc, 'replace' AS mode, 'Mail <EMAIL_ADDRESS_1> or <EMAIL_ADDRESS_1> or <US_SSN_1>.' AS redacted FROM {_CUST}
UNION ALL SELECT k, 'mask', 'Mail *** or *** or ***.' FROM {_CUST}"""
)
def built_redaction(spark, d):
    """An address told twice has one placeholder; masks tell nothing."""
    t = _customers(spark, d).select(F.col("k").alias("id"), _text("Mail c", F.col("k"), "@example.org or c", F.col("k"), "@example.org or 123-45-6789.").alias("t"))
    spans = P.merge_spans(P.detect(t, "id", "t"))
    out = lambda m: P.redact(t, spans, "id", "t", m).select("doc", F.lit(m).alias("mode"), "redacted")
    return out("replace").unionByName(out("mask"))


@query(f"SELECT k AS doc, 1 AS labels, 16 AS digits FROM {_CUST}")
def built_redaction_hash(spark, d):
    """Equal literals have equal hashes, other documents' literals others."""
    t = _customers(spark, d).select(F.col("k").alias("id"), _text("c", F.col("k"), "@example.org c", F.col("k"), "@example.org").alias("t"))
    r = P.redact(t, P.merge_spans(P.detect(t, "id", "t")), "id", "t", "hash", b"key")
    found = F.array_distinct(F.regexp_extract_all("redacted", F.lit(r"<EMAIL_ADDRESS_HASH:([0-9a-f]+)>"), F.lit(1)))
    return r.select("doc", F.size(found).alias("labels"), F.length(found[0]).alias("digits"))


@query("SELECT id, name AS restored, true AS hidden FROM parties WHERE name IS NOT NULL")
def encryption_roundtrip(spark, d):
    key = F.lit(b"0123456789abcdef")
    p = table(spark, d, "parties").filter("name is not null")
    e = P.encrypt(F.col("name"), key)
    return p.select("id", P.decrypt(e, key).alias("restored"), (~F.contains(e, F.col("name"))).alias("hidden"))


@query(f"SELECT k AS doc, 1 AS ord FROM {_CUST} UNION ALL SELECT k, 4 FROM {_CUST} WHERE k % 2 = 0")
def built_clause_dedupe(spark, d):
    """A clause, a part of it, a near copy and, for every second document, another clause."""
    k = F.col("k")
    long = "The fee shall be paid within thirty days of the invoice's date"
    texts = F.array(F.struct(F.lit(1).alias("ord"), F.lit(long + ".").alias("text")), F.struct(F.lit(2).alias("ord"), F.lit("shall be paid within").alias("text")), F.struct(F.lit(3).alias("ord"), F.lit(long).alias("text")), F.struct(F.lit(4).alias("ord"), F.when(k % 2 == 0, "Books may be seen at any hour").alias("text")))
    c = _customers(spark, d).select(k.alias("doc"), F.explode(texts).alias("t")).select("doc", "t.ord", F.lit("fee").alias("clause_type"), "t.text", F.lit(0.5).alias("confidence"))
    return E.dedupe_clauses(c).select("doc", F.col("ord").cast("int").alias("ord"))


@query(f"SELECT k AS doc, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.5 END AS similarity FROM {_CUST}")
def built_version_similarity(spark, d):
    """Equal clauses of one type; for every second document a type is in one version only."""
    c = _customers(spark, d).select(F.col("k").alias("doc"), F.lit(1).alias("ord"), F.lit("fee").alias("clause_type"), F.lit("It is due.").alias("text"))
    more = c.filter("doc % 2 = 1").select("doc", F.lit(2).alias("ord"), F.lit("audit").alias("clause_type"), F.lit("x").alias("text"))
    return E.version_similarity(c, c.unionByName(more))


@query(f"SELECT k AS doc, round(2.0 * (length(CAST(k AS VARCHAR)) + 4) / (2 * length(CAST(k AS VARCHAR)) + 9), 9) AS ratio FROM {_CUST}")
def built_text_ratio(spark, d):
    """A text and the same with a letter more."""
    c = _customers(spark, d)
    return c.select(F.col("k").alias("doc"), F.round(E.text_ratio(_text("fee ", F.col("k")), _text("fee ", F.col("k"), "x")), 9).alias("ratio"))


@query("SELECT document_id AS doc, 'low confidence: ' || string_agg(DISTINCT clause_type, ', ' ORDER BY clause_type) AS warning FROM clauses WHERE confidence_score < 0.5 AND clause_type IS NOT NULL GROUP BY document_id")
def confidence_warnings(spark, d):
    c = table(spark, d, "clauses").filter("clause_type is not null").groupBy("document_id", "clause_type").agg(F.min("confidence_score").alias("c"))
    return E.low_confidence_warning(c, "document_id", "clause_type", "c", 0.5).withColumnRenamed("document_id", "doc")


#: (variant, text before, value, text behind, whether it is a format that is supported)
_FORMATS = [
    ("phone", "Call (", "212) 555-0100", " now", True),
    ("social security", "No. ", "123-45-6789", ".", True),
    ("social security, other dashes", "No. ", "123\u201345\u20136789", ".", True),
    ("social security, hidden character", "No. ", "123-45\u200b-6789", ".", True),
    ("card", "Paid by ", "4111 1111 1111 1111", ".", True),
    ("account", "To ", "DE89370400440532013000", ".", True),
    ("passport", "Holds ", "XY1234567", ".", True),
    ("birth", "born: ", "01/02/1980", ".", True),
    ("address", "Mail ", "jane.roe+x@example.org", ", please", True),
    ("social security in words", "No. ", "one two three", ".", False),
    ("card, four groups of letters", "Paid by ", "abcd efgh ijkl mnop", ".", False),
    ("section number", "See Section ", "12.3.4", ".", False),
    ("sum", "Owes ", "USD 1,000.00", ".", False),
]


@query("SELECT variant, n AS cases, CASE WHEN ok THEN n ELSE 0 END AS caught FROM (VALUES " + ", ".join(f"('{v}', {str(ok).lower()})" for v, _, _, _, ok in _FORMATS) + f") f(variant, ok), (SELECT count(*) AS n FROM {_CUST})")
def pii_formats(spark, d):
    """Values in every format and in look-alikes, once for each customer: how many are covered whole by what is detected."""
    f = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(v).alias("variant"), F.lit(a).alias("a"), F.lit(x).alias("x"), F.lit(b).alias("b")) for i, (v, a, x, b, _) in enumerate(_FORMATS)))
    t = _customers(spark, d).select("k", F.explode(f).alias("f")).select((F.col("k") * 100 + F.col("f.i")).alias("id"), "f.variant", F.concat("f.a", "f.x", "f.b").alias("t"), F.length("f.a").cast("long").alias("start"), F.length(F.concat("f.a", "f.x")).cast("long").alias("end"))
    gold = t.select(F.col("id").alias("doc"), "start", "end", F.col("variant").alias("entity"))
    covered = V.span_coverage(gold, P.merge_spans(P.detect(t, "id", "t")))
    return covered.groupBy(F.col("entity").alias("variant")).agg(F.count("*").alias("cases"), F.count_if("covered").alias("caught"))


# ---- tasks ----------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT k AS id, CASE WHEN k % 2 = 0 THEN 'EMAIL_ADDRESS' ELSE '' END AS pii_types, CASE WHEN k % 2 = 0 THEN 'confidential' ELSE 'public' END AS sensitivity, CASE WHEN k % 3 = 0 THEN 'payment_terms' END AS labels, CASE WHEN k % 3 = 0 THEN k || ' U.S.C. § 7' END AS citations,
  CASE WHEN k % 5 <> 0 THEN 'SUMMARISE' END AS answer, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS errors, DATE '2024-01-31' AS due_date FROM {_CUST}"""
)
def built_pipeline(spark, d):
    """Five tasks over documents of two types and two routes, as one plan."""
    k = F.col("k")
    docs = _customers(spark, d).select(
        k.alias("id"), F.when(k % 3 == 0, "contract").otherwise("letter").alias("doc_type"), F.when(k % 5 == 0, "blocked").otherwise("any").alias("route"), F.lit("public").alias("sensitivity"),
        F.concat(_text("The invoice cites ", k, " U.S.C. § 7"), F.when(k % 2 == 0, "; mail a@b.org").otherwise("")).alias("full_text"), F.lit("within 30 days").alias("deadline"), F.lit("2024-01-01").cast("date").alias("effective_date"),
    )
    r = default_registry(Scripted(lambda p: p[:9].upper()))
    out = r.pipeline("pii_detection", "classification", "citation", "timeline", "summarization")(docs)
    return out.select("id", F.array_join("pii_types", ",").alias("pii_types"), "sensitivity", F.array_join("labels", ",").alias("labels"), F.array_join("citations", ",").alias("citations"), F.col("summarization_answer").alias("answer"), F.size("task_errors").alias("errors"), "due_date")


@query(
    """SELECT 'summarization' AS task_id, count(full_text) AS documents, CAST(sum(length(left(full_text, 12000)) // 4) AS BIGINT) AS tokens FROM legal_docs
UNION ALL SELECT 'contract_extraction', count(full_text), CAST(coalesce(sum(length(left(full_text, 2000)) // 4), 0) AS BIGINT) FROM legal_docs WHERE doc_type = 'contract' UNION ALL SELECT 'classification', 0, 0"""
)
def task_costs(spark, d):
    """What two tasks with a model and one without would be sent of all legal texts."""
    r = default_registry(Scripted(str))
    tasks = [r.get(t) for t in ("summarization", "contract_extraction", "classification")]
    return estimate(table(spark, d, "legal_docs"), tasks, {"contract_extraction": 2_000}, 1.0).select("task_id", "documents", "tokens")


@query("SELECT doc_id AS doc, left('Ask: ' || string_agg(chunk_text, chr(10) || chr(10) ORDER BY chunk_index, chunk_text), 105) AS prompt FROM (SELECT DISTINCT doc_id, chunk_index, chunk_text FROM document_chunks) WHERE chunk_index < 2 AND chunk_text IS NOT NULL GROUP BY doc_id")
def chunk_prompts(spark, d):
    c = table(spark, d, "document_chunks").filter("chunk_text is not null").select(F.col("doc_id").alias("doc"), F.col("chunk_index").alias("seq"), F.col("chunk_text").alias("chunk")).distinct()
    return first_chunks_prompt(c, "Ask: ", 2, 100)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'local' WHEN 2 THEN 'anthropic' ELSE 'google' END AS kind FROM part")
def provider_kinds(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, _text("gpt-", k)).when(k % 4 == 1, _text("GPT-OSS:", k)).when(k % 4 == 2, _text("claude-", k)).otherwise(_text("Gemini-", k))
    return table(spark, d, "part").select(k, provider_kind(name).alias("kind"))


# ---- retrieval, places, rules ---------------------------------------------------------------------------------------


@query(f"SELECT CASE WHEN k % 4 = 3 THEN 'new-' ELSE 'u' END || k AS url, CASE k % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' WHEN 2 THEN 'kept' ELSE 'added' END AS status FROM {_CUST}")
def source_sync(spark, d):
    """Sources that stayed, changed, failed to load, or are new."""
    k = F.col("k")
    c = _customers(spark, d)
    old = c.filter("k % 4 <> 3").select(_text("u", k).alias("url"), F.lit("text").alias("text"))
    new = c.select(F.when(k % 4 == 3, _text("new-", k)).otherwise(_text("u", k)).alias("url"), F.when(k % 4 == 1, "other").otherwise("text").alias("text"), (k % 4 == 2).alias("failed"))
    return R.sync(old, new)


@query("SELECT s_nationkey AS question, round(avg(s_suppkey % 10), 9) AS confidence, min(s_suppkey % 7) AS authority_min, max(s_suppkey % 7) AS authority_max FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier) GROUP BY 1")
def answer_range(spark, d):
    s = table(spark, d, "supplier")
    n = s.agg(F.min("s_nationkey")).first()[0]
    top = s.filter(F.col("s_nationkey") == n).select((F.col("s_suppkey") % 10).alias("combined"), (F.col("s_suppkey") % 7).alias("level"))
    return R.answer_summary(top).select(F.lit(n).alias("question"), F.round("confidence", 9).alias("confidence"), "authority_min", "authority_max")


_PLACES = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'US-CA' WHEN 2 THEN 'INT' ELSE 'DE' END AS j FROM customer"


@query(f"SELECT k, j IN ('US', 'INT') AS broader, false AS conflicts, j IN ('US', 'US-CA') AS in_us, j IN ('US', 'US-CA') AS in_ca, j = 'US' AS in_ny, true AS anywhere FROM ({_PLACES})")
def jurisdiction_relations(spark, d):
    """Places against California: broader, in conflict, and fitting filters."""
    k = F.col("c_custkey")
    j = X.jurisdiction(F.when(k % 4 == 0, "US").when(k % 4 == 1, "US-CA").when(k % 4 == 2, "INT").otherwise("DE"))
    ca = X.jurisdiction(F.lit("US-CA"))
    bool_ = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, d, "customer").select(
        k.alias("k"), bool_(X.jurisdiction_broader(j, ca)).alias("broader"), X.jurisdiction_conflicts(j, ca).alias("conflicts"), X.jurisdiction_matches(j, "US").alias("in_us"), X.jurisdiction_matches(j, "US", "CA").alias("in_ca"), X.jurisdiction_matches(j, "US", "NY").alias("in_ny"), X.jurisdiction_matches(j, "INT").alias("anywhere")
    )


@query("SELECT 'r' || n_nationkey AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'own' ELSE 'parent' END AS origin FROM nation")
def inherited_rules(spark, d):
    """A parent's rules of which every second one is overridden."""
    n = table(spark, d, "nation").select(_text("r", F.col("n_nationkey")).alias("rule_id"), F.col("n_nationkey").alias("k"))
    own = n.filter("k % 2 = 0").select("rule_id", F.lit("own").alias("origin"))
    return E.inherit_rules(own, n.select("rule_id", F.lit("parent").alias("origin")))


# ---- repository, evaluation -----------------------------------------------------------------------------------------


@query("SELECT id, row_number() OVER (ORDER BY page_number NULLS LAST, id) AS place FROM (SELECT DISTINCT id, page_number FROM clauses WHERE document_id = 1)")
def clauses_by_page(spark, d):
    """The clauses of one document in reading order; the order is told by numbering them."""
    c = B.by_page(table(spark, d, "clauses").filter("document_id = 1").dropDuplicates(["id"]))
    return c.select("id", F.row_number().over(Window.orderBy(F.col("page_number").asc_nulls_last(), "id")).cast("long").alias("place"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || id ELSE title END AS title FROM legal_docs")
def updated_column(spark, d):
    docs = table(spark, d, "legal_docs").select("id", "title")
    new = docs.filter("id % 2 = 0").select("id", _text("new ", F.col("id")).alias("title"))
    return B.update_column(docs, new.unionByName(spark.createDataFrame([(-1, "nobody")], "id long, title string")), "id", "title")


@query("SELECT doc_id, count(*) FILTER (WHERE role IS NOT NULL) / count(*) AS coverage FROM parties GROUP BY doc_id")
def field_coverage(spark, d):
    return V.provenance_coverage(table(spark, d, "parties"), "doc_id", F.col("role").isNotNull())


@query(
    """WITH e AS (SELECT DISTINCT id FROM parties), s AS (SELECT id, f, CASE f WHEN 'a' THEN 3.0 ELSE 1.0 END AS w, f = 'a' OR id % 2 = 0 AS hit FROM e, (VALUES ('a'), ('b')) v(f))
SELECT sum(w * CAST(hit AS INTEGER)) / sum(w) AS field_accuracy, (SELECT avg(CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.0 END) FROM e) AS case_accuracy, (SELECT count(*) FROM e) AS cases FROM s"""
)
def eval_weighted(spark, d):
    """Two fields of different weights; the lighter one is wrong in every second case."""
    i = table(spark, d, "parties").select(F.col("id").alias("case_id")).distinct()
    expected = i.select("case_id", F.explode(F.array(F.struct(F.lit("a").alias("field"), F.lit(3.0).alias("weight")), F.struct(F.lit("b").alias("field"), F.lit(1.0).alias("weight")))).alias("f")).select("case_id", "f.field", F.lit("Yes ").alias("value"), "f.weight")
    actual = expected.select("case_id", "field", F.when((F.col("field") == "a") | (F.col("case_id") % 2 == 0), " yes").alias("value"))
    return V.overall_accuracy(V.score_fields(expected, actual))


@query("SELECT doc_id AS case_id FROM documents WHERE doc_type = 'statute' AND lang IN ('en', 'de')")
def cases_by_tag(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "doc_type", F.when(F.col("lang").isin("en", "de"), F.array(F.lit("main"), F.col("lang"))).otherwise(F.array(F.lit("rest"))).alias("tags"))
    return V.by_doc_type(V.by_tag(c, "main"), "statute").select("case_id")


@query("SELECT doc_type, language, count(*) AS cells FROM (SELECT CASE WHEN left(coalesce(doc_type, ''), 1) IN ('=', '+', '-', '@') THEN '''' || doc_type ELSE coalesce(doc_type, '') END AS doc_type, coalesce(language, '') AS language FROM legal_docs) GROUP BY ALL")
def csv_roundtrip(spark, d):
    """Written with headers and read again."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(table(spark, d, "legal_docs").select("id", "doc_type", "language"), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.coalesce("language", F.lit("")).alias("language")).agg(F.count("*").alias("cells"))


# ---- sources --------------------------------------------------------------------------------------------------------


def _server(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
    """A scripted server: by its number a page is new, unchanged, missing, moved to itself, or moved to a private address."""
    k = int(url.rsplit("/", 1)[-1].split("?")[0])
    if k % 5 == 1 and headers.get("If-None-Match") == f"e{k}":
        return 304, {}, ""
    if k % 5 == 2:
        return 404, {}, "gone"
    if k % 5 == 3 and not url.endswith("?moved"):
        return 302, {"Location": f"/{k}?moved"}, ""
    if k % 5 == 4:
        return 301, {"Location": f"http://10.0.0.1/{k}"}, ""
    return 200, {"ETag": f"e{k}"}, f"page {k}"


@query(
    f"""SELECT 'http://93.184.216.34/' || k AS url, CASE k % 5 WHEN 1 THEN 304 WHEN 2 THEN 404 WHEN 4 THEN 301 ELSE 200 END AS status, CASE WHEN k % 5 IN (0, 3) THEN 'page ' || k WHEN k % 5 = 1 THEN '' END AS body,
  k % 5 IN (0, 3) AND NOT (k % 5 = 0 AND k % 2 = 0) AS changed, CASE k % 5 WHEN 2 THEN 'HTTP 404' WHEN 4 THEN 'not followed: http://10.0.0.1/' || k END AS error FROM {_CUST}"""
)
def fetched_pages(spark, d):
    """Conditional fetches of a page for every customer, some of them known; a public page does not lead to a private address."""
    k = F.col("k")
    known = F.when(k % 5 == 1, F.sha2(F.lit("old"), 256)).when((k % 5 == 0) & (k % 2 == 0), F.sha2(_text("page ", k), 256))
    urls = _customers(spark, d).select(_text("http://93.184.216.34/", k).alias("url"), F.when(k % 5 == 1, _text("e", k)).alias("etag"), F.lit(None).cast("string").alias("last_modified"), known.alias("content_hash"))
    return fetch(urls, _server, backoff=0).select("url", "status", "body", "changed", "error")


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, 'a' || n_nationkey || chr(10) || chr(10) || 'b' || n_nationkey AS texts FROM nation")
def paged_texts(spark, d):
    """Two pages of an API for every nation, the second named by a header, a page without a text between them."""

    def send(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], str]:
        path, _, page = url.partition("?p=")
        k = path.rsplit("/", 1)[-1]
        if not page:
            return 200, {"Link": f'<{path}?p=2>; rel="next"'}, f'{{"data": {{"text": "a{k}"}}}}'
        return (200, {}, f'{{"data": {{}}, "next": "{path}?p=3"}}') if page == "2" else (200, {}, f'{{"data": {{"text": "b{k}"}}, "next": "{url}"}}')

    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").distinct().collect()]
    return spark.createDataFrame([(int(k), fetch_pages(f"http://93.184.216.34/{k}", send, "data.text")) for k in keys], "k int, texts string")


@query("SELECT 'txt' AS suffix, p_name AS line, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name")
def loaded_files(spark, d):
    """Names of parts written as text files and loaded as documents."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    table(spark, d, "part").select("p_name").repartition(4).write.text(path)
    got = load_files(spark, path).filter("error is null and size > 0")
    lines = got.select(F.regexp_replace("suffix", "^[.]", "").alias("suffix"), F.explode(F.split("full_text", "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy("suffix", "line").agg(F.count("*").alias("n"))


# ---- rules and deadlines --------------------------------------------------------------------------------------------


@query(f"SELECT k AS doc, 'must' AS rule_id FROM {_CUST} WHERE k % 2 = 1 UNION ALL SELECT k, 'never' FROM {_CUST} WHERE k % 3 = 0 UNION ALL SELECT k, 'absent' FROM {_CUST}")
def built_rule_patterns(spark, d):
    """A pattern that must be there, one that must not, and a clause type that no document has."""
    k = F.col("k")
    text = F.concat(F.when(k % 2 == 0, "Due in 30 DAYS.").otherwise("Due soon."), F.when(k % 3 == 0, " Late fee: 5 %.").otherwise(""))
    c = _customers(spark, d).select(k.alias("doc"), F.lit(1).alias("ord"), F.lit("pay").alias("clause_type"), text.alias("text"))
    rules = [("must", 1, "pay", [], [], r"\b\d+ days?\b", "", False), ("never", 2, "pay", [], [], "", r"late\s+fee:\s*\d", False), ("absent", 3, "law", [], [], "", "", True)]
    schema = "rule_id string, rule_ord int, clause_type string, required array<string>, forbidden array<string>, required_pattern string, forbidden_pattern string, if_missing boolean"
    return E.apply_rules(c, spark.createDataFrame(rules, schema), c).select("doc", "rule_id")


#: (phrase, the date it gives for an effective date of 31 January 2024)
_PHRASES = [("by 2024-06-30", "2024-06-30"), ("no later than March 5, 2024", "2024-03-05"), ("within 2 weeks", "2024-02-14"), ("1 month after the Effective Date", "2024-02-29"), ("within 1 year", "2025-01-31"), ("thirty (30) days", "2024-03-01"), ("10 business days", None), ("5 days after delivery", None), ("soon", None), ("2024-02-30", None)]


@query("SELECT k AS doc, phrase, due FROM (VALUES " + ", ".join(f"('{p}', {f'DATE {chr(39)}{day}{chr(39)}' if day else 'NULL'})" for p, day in _PHRASES) + f") v(phrase, due), {_CUST}")
def built_deadlines(spark, d):
    c = _customers(spark, d).select(F.col("k").alias("doc"), F.explode(F.array(*(F.lit(p) for p, _ in _PHRASES))).alias("phrase"))
    return c.select("doc", "phrase", X.deadline_date(F.col("phrase"), F.lit("2024-01-31").cast("date")).alias("due"))


# ---- streams --------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """All there is of a stream, through a checkpointed query that ends, as a table."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    A.run_available(stream, f"{base}/out", f"{base}/state", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_windows(spark, d):
    counts = _run(A.windowed_counts(_stream(spark, d)), spark, "complete")
    return counts.withColumn("value", F.round("value", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def stream_distinct(spark, d):
    """Each event of a stream that delivers all of them twice, once."""
    s = _stream(spark, d)
    once = _run(A.distinct_events(s.unionByName(_stream(spark, d)).select("event_id", "ts"), "100000 days"), spark, "append")
    return once.agg(F.count("*").alias("events"))

