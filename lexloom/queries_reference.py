"""Queries of the document operators over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import chunking as C
from lexloom.operators import evaluation as V
from lexloom.operators import extraction as E
from lexloom.operators import privacy as P
from lexloom.operators import retrieval as R
from lexloom.operators import storage as B
from lexloom.operators import structure as S
from lexloom.session import table
from lexloom.streaming import audit as A

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_STRIP = r"regexp_replace({c}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"


def strip_sql(c: str) -> str:
    return _STRIP.format(c=c)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "legal_docs")


# ---- texts, hashes, profiles ----------------------------------------------------------------------------------------


@query("SELECT language, doc_type, count(*) AS docs, CAST(sum(length(full_text) // 4) AS BIGINT) AS tokens, count(DISTINCT CASE WHEN length(full_text) > 0 THEN sha256(full_text) END) AS distinct_texts FROM legal_docs GROUP BY ALL")
def doc_tokens(spark, d):
    return _docs(spark, d).groupBy("language", "doc_type").agg(F.count("*").alias("docs"), F.sum(X.token_estimate(F.col("full_text"))).alias("tokens"), F.count_distinct(X.content_hash(F.col("full_text"))).alias("distinct_texts"))


@query("SELECT id, sha256(full_text) AS computed, coalesce(lower(content_hash) = sha256(full_text), false) AS current FROM legal_docs WHERE length(full_text) > 0")
def doc_hashes(spark, d):
    h = X.content_hash(F.col("full_text"))
    return _docs(spark, d).filter(h.isNotNull()).select("id", h.alias("computed"), F.coalesce(F.lower("content_hash") == h, F.lit(False)).alias("current"))


@query("SELECT sha256(extracted_text) AS hash, count(*) AS files, min(id) AS first_id FROM source_files WHERE length(extracted_text) > 0 GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, d):
    h = X.content_hash(F.col("extracted_text"))
    return table(spark, d, "source_files").filter(h.isNotNull()).groupBy(h.alias("hash")).agg(F.count("*").alias("files"), F.min("id").alias("first_id")).filter("files > 1")


@query(
    """SELECT id, country, region, court_system, CASE WHEN region IS NOT NULL THEN country || '-' || region WHEN court_system IS NOT NULL THEN country || '-Federal' ELSE country END AS label FROM (
  SELECT id, CASE WHEN s IN ('EU', 'INT', 'INTERNATIONAL') THEN 'INT' ELSE split_part(s, '-', 1) END AS country,
    CASE WHEN s NOT IN ('EU', 'INT', 'INTERNATIONAL') AND instr(s, '-') > 0 AND s[instr(s, '-') + 1:] NOT IN ('FEDERAL', 'FED') THEN s[instr(s, '-') + 1:] END AS region,
    CASE WHEN s[instr(s, '-') + 1:] IN ('FEDERAL', 'FED') AND instr(s, '-') > 0 THEN 'federal' END AS court_system
  FROM (SELECT id, upper(trim(jurisdiction)) AS s FROM legal_docs WHERE jurisdiction IS NOT NULL))"""
)
def jurisdictions(spark, d):
    j = X.jurisdiction(F.col("jurisdiction"))
    return _docs(spark, d).filter("jurisdiction is not null").select("id", j["country"].alias("country"), j["region"].alias("region"), j["court_system"].alias("court_system"), X.jurisdiction_label(j).alias("label"))


# ---- privacy --------------------------------------------------------------------------------------------------------


@query(
    "SELECT language, "
    + ", ".join(
        f"CAST(sum(len(regexp_extract_all(full_text, '{p}'))) AS BIGINT) AS {k}"
        for k, p in (("us_ssn", r"\b[0-9]{3}[-‐-―−﹘﹣－][0-9]{2}[-‐-―−﹘﹣－][0-9]{4}\b"), ("iban_code", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}\b"), ("passport_number", r"\b[A-Z]{1,2}[0-9]{6,9}\b"), ("drivers_license", r"\b[A-Z][0-9]{7}\b"))
    )
    + " FROM (SELECT language, translate(full_text, '０１２３４５６７８９', '0123456789') AS full_text FROM legal_docs WHERE full_text IS NOT NULL) GROUP BY language"
)
def pii_counts(spark, d):
    folded = F.translate("full_text", "０１２３４５６７８９", "0123456789")
    kinds = ("US_SSN", "IBAN_CODE", "PASSPORT_NUMBER", "DRIVERS_LICENSE")
    return _docs(spark, d).filter("full_text is not null").select("language", *(X.pii_count(folded, k).alias(k) for k in kinds)).groupBy("language").agg(*(F.sum(k).alias(k.lower()) for k in kinds))


@query()
def pii_spans(spark, d):
    return P.merge_spans(P.detect(_docs(spark, d), "id", "full_text"))


_ROUTE_SQL = """
  CASE greatest(CASE json_extract_string(privacy_profile, '$.sensitivity') WHEN 'public' THEN 0 WHEN 'confidential' THEN 0 WHEN 'restricted' THEN 1 ELSE 2 END,
    CASE WHEN json_extract_string(privacy_profile, '$.llm_routing') IS NULL THEN 0 WHEN json_extract_string(privacy_profile, '$.llm_routing') = 'any' THEN 0 WHEN json_extract_string(privacy_profile, '$.llm_routing') = 'local_only' THEN 1 ELSE 2 END)
  WHEN 0 THEN 'any' WHEN 1 THEN 'local_only' ELSE 'blocked' END"""


def _route():
    return P.effective_route(F.get_json_object("privacy_profile", "$.sensitivity"), F.get_json_object("privacy_profile", "$.llm_routing"))


@query(f"SELECT doc_type, {_ROUTE_SQL} AS route, count(*) AS docs FROM legal_docs GROUP BY ALL")
def privacy_routes(spark, d):
    return _docs(spark, d).groupBy("doc_type", _route().alias("route")).agg(F.count("*").alias("docs"))


@query(f"SELECT jurisdiction, CASE max(CASE r WHEN 'any' THEN 0 WHEN 'local_only' THEN 1 ELSE 2 END) WHEN 0 THEN 'any' WHEN 1 THEN 'local_only' ELSE 'blocked' END AS route FROM (SELECT jurisdiction, {_ROUTE_SQL} AS r FROM legal_docs) GROUP BY jurisdiction")
def strictest_routes(spark, d):
    return P.strictest(_docs(spark, d).select("jurisdiction", _route().alias("r")), "jurisdiction", "r")


_SPANS_SQL = "SELECT l_orderkey AS doc, l_partkey * 100000 + l_suppkey AS ord, CAST(l_linenumber * 7 AS BIGINT) AS s, CAST(l_linenumber * 7 + floor(l_quantity / 3) AS BIGINT) AS e, l_returnflag AS entity, l_discount AS score FROM lineitem"


@query(
    f"""WITH x AS ({_SPANS_SQL}), o AS (SELECT *, row_number() OVER w AS n, max(e) OVER (PARTITION BY doc ORDER BY s, e DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x WINDOW w AS (PARTITION BY doc ORDER BY s, e DESC, ord)),
  i AS (SELECT *, sum(CASE WHEN s >= coalesce(before, s) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS island FROM o)
  SELECT doc, min(s) AS "start", max(e) AS "end", arg_max(entity, [score, -n]) AS entity, max(score) AS score FROM i GROUP BY doc, island"""
)
def spans_merged(spark, d):
    li = table(spark, d, "lineitem")
    start = (F.col("l_linenumber") * 7).cast("long")
    return P.merge_spans(li.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"), start.alias("start"), (start + F.floor(F.col("l_quantity") / 3)).cast("long").alias("end"), F.col("l_returnflag").alias("entity"), F.col("l_discount").alias("score")))


@query()
def redacted_docs(spark, d):
    docs = _docs(spark, d)
    r = P.redact(docs, P.merge_spans(P.detect(docs, "id", "full_text")), "id", "full_text")
    return r.select("doc", "redacted", F.size("mapping").alias("placeholders"), F.array_join("types", ",").alias("types"))


@query("SELECT count(*) AS docs, count(*) AS restored FROM legal_docs WHERE full_text IS NOT NULL")
def restore_roundtrip(spark, d):
    docs = _docs(spark, d).filter("full_text is not null")
    r = P.redact(docs, P.merge_spans(P.detect(docs, "id", "full_text")), "id", "full_text")
    back = r.select("doc", P.restore(F.col("redacted"), F.col("mapping")).alias("back"))
    return docs.join(back, docs["id"] == back["doc"]).agg(F.count("*").alias("docs"), F.count_if(F.col("back") == F.col("full_text")).alias("restored"))


# ---- structure ------------------------------------------------------------------------------------------------------


@query(f"SELECT id AS doc, count(*) AS lines, count(*) FILTER (WHERE {strip_sql('l')} <> '') AS filled, CAST(sum(length(l)) AS BIGINT) AS chars FROM (SELECT id, unnest(string_split(full_text, chr(10))) AS l FROM legal_docs WHERE full_text IS NOT NULL) GROUP BY id")
def section_lines(spark, d):
    return S.lines(_docs(spark, d), "id", "full_text").groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(F.length("s") > 0).alias("filled"), F.sum(F.length("line")).alias("chars"))


_HEAD_SQL = rf"""
WITH l AS (SELECT id AS doc, ln, {strip_sql('line')} AS s, line FROM (SELECT id, unnest(string_split(full_text, chr(10))) AS line, generate_subscripts(string_split(full_text, chr(10)), 1) - 1 AS ln FROM legal_docs WHERE full_text IS NOT NULL)),
k AS (SELECT *, CASE WHEN length(s) < 2 THEN NULL
  WHEN regexp_matches(s, '(?i)^Article\s+(?:[IVX]+|[0-9]+)\.?\s*(.*)?$') THEN 'article'
  WHEN regexp_matches(s, '(?i)^Section\s+[0-9]+(?:\.[0-9]+)*(?:\([a-z0-9]+\))*\s*(.*)?$') THEN 'named_numeric'
  WHEN regexp_matches(s, '(?i)^[0-9]+(?:\.[0-9]+)+(?:\([a-z0-9]+\))*\.?\s+(.*)?$') THEN 'deep_numeric'
  WHEN regexp_matches(s, '^[0-9]+\.\s+(.+)$') THEN 'numeric_top'
  WHEN regexp_matches(s, '(?i)^\([a-z]\)(?:\([ivx]+\))?\s*(.*)?$') THEN 'paren_alpha'
  WHEN regexp_matches(s, '^[A-Z]\.\s+(.+)$') THEN 'alpha_top'
  WHEN regexp_matches(s, '^[A-Z][A-Z\s\-]{{2,60}}$') THEN 'caps_heading' END AS kind FROM l)
"""


@query(_HEAD_SQL + "SELECT doc, kind, count(*) AS headings, min(ln) AS first_line FROM k WHERE kind IS NOT NULL GROUP BY doc, kind")
def section_headings(spark, d):
    h = S.headed_lines(_docs(spark, d), "id", "full_text").filter("kind is not null")
    return h.groupBy("doc", "kind").agg(F.count("*").alias("headings"), F.min("ln").cast("long").alias("first_line"))


_BARE = r"trim(regexp_replace({c}, '(?i)^(section|article|clause|para(?:graph)?|exhibit|schedule|annex|§)\s*', ''))"
#: Headings with number, level and order, and the bodies below them.
_TREE_SQL = (
    _HEAD_SQL.rstrip()
    + r""", v AS (SELECT doc, ln, kind, row_number() OVER (PARTITION BY doc ORDER BY ln) AS ord, regexp_replace(trim(CASE kind
   WHEN 'article' THEN regexp_extract(s, '(?i)^(Article\s+(?:[IVX]+|[0-9]+)\.?)', 1)
   WHEN 'named_numeric' THEN regexp_extract(s, '(?i)^(Section\s+[0-9]+(?:\.[0-9]+)*(?:\([a-z0-9]+\))*)', 1)
   WHEN 'deep_numeric' THEN regexp_extract(s, '(?i)^([0-9]+(?:\.[0-9]+)+(?:\([a-z0-9]+\))*\.?)', 1)
   WHEN 'numeric_top' THEN regexp_extract(s, '^([0-9]+\.)', 1) WHEN 'paren_alpha' THEN regexp_extract(s, '(?i)^(\([a-z]\)(?:\([ivx]+\))?)', 1)
   WHEN 'alpha_top' THEN regexp_extract(s, '^([A-Z]\.)', 1) ELSE s END), '\.+$', '') AS number FROM k WHERE kind IS NOT NULL),
t AS (SELECT doc, ln, ord, number, CAST(CASE kind
   WHEN 'named_numeric' THEN len(regexp_extract_all(regexp_extract(number, '([0-9][0-9.]*)', 1), '\.'))
   WHEN 'deep_numeric' THEN len(regexp_extract_all(number, '\.')) + len(regexp_extract_all(number, '(?i)\([a-z0-9]+\)'))
   WHEN 'paren_alpha' THEN len(regexp_extract_all(number, '(?i)\([a-z0-9]+\)')) ELSE 0 END AS INTEGER) AS level FROM v),
b AS (SELECT t.doc, t.ord, t.number, string_agg(k.line, chr(10) ORDER BY k.ln) AS body FROM t JOIN k ON k.doc = t.doc AND k.kind IS NULL AND k.ln > t.ln
  AND k.ln < coalesce((SELECT min(n.ln) FROM t n WHERE n.doc = t.doc AND n.ln > t.ln), 1000000000) GROUP BY t.doc, t.ord, t.number)
"""
)


@query(_TREE_SQL + "SELECT doc, CAST(ord AS INTEGER) AS ord, number, level, CAST((SELECT max(p.ord) FROM t p WHERE p.doc = t.doc AND p.ord < t.ord AND p.level < t.level) AS INTEGER) AS parent_ord FROM t")
def section_parents(spark, d):
    """Every section with the nearest one above it of a lower level."""
    return S.sections(_docs(spark, d), "id", "full_text").select("doc", "ord", "number", "level", "parent_ord")


@query()
def section_tree(spark, d):
    return S.sections(_docs(spark, d), "id", "full_text")


@query(
    _HEAD_SQL
    + r"""SELECT a.doc, a.level, count(*) AS sections, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM v b WHERE b.doc = a.doc AND b.ln < a.ln AND b.level < a.level)) AS with_parent FROM v a GROUP BY a.doc, a.level""".replace("FROM v a", "FROM v a")
)
def section_levels(spark, d):
    s = S.sections(_docs(spark, d), "id", "full_text")
    return s.groupBy("doc", "level").agg(F.count("*").alias("sections"), F.count("parent_ord").alias("with_parent"))


ORACLE["section_levels"] = (
    _HEAD_SQL.rstrip()
    + r""", v AS (SELECT doc, ln, CAST(CASE kind
   WHEN 'named_numeric' THEN len(regexp_extract_all(regexp_extract(regexp_extract(s, '(?i)^(Section\s+[0-9]+(?:\.[0-9]+)*(?:\([a-z0-9]+\))*)', 1), '([0-9][0-9.]*)', 1), '\.'))
   WHEN 'deep_numeric' THEN len(regexp_extract_all(regexp_replace(regexp_extract(s, '(?i)^([0-9]+(?:\.[0-9]+)+(?:\([a-z0-9]+\))*\.?)', 1), '\.+$', ''), '\.')) + len(regexp_extract_all(regexp_extract(s, '(?i)^([0-9]+(?:\.[0-9]+)+(?:\([a-z0-9]+\))*)', 1), '(?i)\([a-z0-9]+\)'))
   WHEN 'paren_alpha' THEN len(regexp_extract_all(regexp_extract(s, '(?i)^(\([a-z]\)(?:\([ivx]+\))?)', 1), '(?i)\([a-z0-9]+\)'))
   ELSE 0 END AS INTEGER) AS level FROM k WHERE kind IS NOT NULL)
SELECT a.doc, a.level, count(*) AS sections, count(*) FILTER (WHERE m < a.level) AS with_parent
FROM (SELECT *, min(level) OVER (PARTITION BY doc ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v) a GROUP BY a.doc, a.level"""
)


@query(
    _TREE_SQL
    + r"""SELECT id AS doc, 'NO_SECTIONS_FOUND' AS code, '' AS location FROM legal_docs WHERE full_text IS NOT NULL AND id NOT IN (SELECT doc FROM t)
UNION ALL SELECT doc, 'DUPLICATE_SECTION_NUMBER', number FROM t GROUP BY doc, number HAVING count(*) > 1
UNION ALL SELECT doc, 'MIXED_NUMBERING_SCHEMES', '' FROM (SELECT doc, CASE WHEN regexp_matches(number, '^[IVX]+$') THEN 'roman' WHEN regexp_matches(number, '^[0-9]+') THEN 'numeric' WHEN regexp_matches(number, '^[A-Z]$') THEN 'alpha' WHEN lower(number) LIKE 'article%' THEN 'article' END AS scheme FROM t WHERE level = 0) GROUP BY doc HAVING count(DISTINCT scheme) > 1"""
)
def structure_warnings(spark, d):
    docs = _docs(spark, d).filter("full_text is not null")
    return S.parse_warnings(S.sections(docs, "id", "full_text"), docs.select(F.col("id").alias("doc")))


@query()
def defined_terms(spark, d):
    return S.defined_terms(S.sections(_docs(spark, d), "id", "full_text")).drop("ord")


@query()
def term_usages(spark, d):
    s = S.sections(_docs(spark, d), "id", "full_text")
    return S.term_usages(s, S.defined_terms(s))


_REFS_SQL = (
    _TREE_SQL.rstrip()
    + rf""", r AS (SELECT DISTINCT doc, number, trim(unnest(regexp_extract_all(body, '(?i)(?:\b(?:Section|Article|Clause|Para(?:graph)?|Exhibit|Schedule|Annex)\s+|§\s*)(?:(?-i:[IVX]+|[A-Z])\b|[0-9]+(?:\.[0-9]+)*(?:\([a-z0-9]+\))*)'))) AS raw FROM b),
x AS (SELECT doc, unnest([number, ltrim(number, '0'), {_BARE.format(c="number")}]) AS key FROM t), i AS (SELECT DISTINCT doc, key FROM x),
c AS (SELECT DISTINCT r.doc, number AS source_section, raw AS raw_text, {_BARE.format(c="raw")} AS target_number, i.key IS NOT NULL AS resolved FROM r LEFT JOIN i ON i.doc = r.doc AND i.key = {_BARE.format(c="raw")} WHERE {_BARE.format(c="raw")} <> {_BARE.format(c="number")})
"""
)


@query(_REFS_SQL + "SELECT * FROM c")
def cross_references(spark, d):
    docs = _docs(spark, d)
    return S.cross_references(S.sections(docs, "id", "full_text"), S.schedules(docs, "id", "full_text"))


@query(_REFS_SQL + "SELECT * FROM c WHERE NOT resolved")
def unresolved_references(spark, d):
    return cross_references(spark, d).filter(~F.col("resolved"))


@query()
def schedules(spark, d):
    return S.schedules(_docs(spark, d), "id", "full_text")


@query(rf"SELECT id AS doc, count(*) AS recitals FROM (SELECT id, {strip_sql('unnest(string_split(full_text, chr(10)))')} AS s FROM legal_docs) WHERE regexp_matches(s, '(?i)^WHEREAS[,;:]?\s+(.+)$') GROUP BY id")
def recitals(spark, d):
    return S.recitals(_docs(spark, d), "id", "full_text").groupBy("doc").agg(F.count("*").alias("recitals"))


@query()
def signature_blocks(spark, d):
    return S.signature_blocks(_docs(spark, d), "id", "full_text")


@query(
    r"""SELECT law, count(*) AS docs FROM (SELECT CASE WHEN a <> '' THEN a ELSE b END AS law FROM (SELECT
  regexp_extract(full_text, '(?i:laws?\s+of\s+(?:the\s+)?(?:(?:State|Commonwealth)\s+of\s+)?)([A-Z][a-zA-Z]+(?:\s+(?:(?:and|of)\s+)?[A-Z][a-zA-Z]+)*)', 1) AS a,
  regexp_extract(full_text, '(?i:(?:governed|construed)\s+(?:by|under|in\s+accordance\s+with)\s+)([A-Z][a-zA-Z]+(?:\s+(?:(?:and|of)\s+)?[A-Z][a-zA-Z]+)*)\s+(?i:laws?)\b', 1) AS b FROM legal_docs WHERE full_text IS NOT NULL)) GROUP BY law"""
)
def governing_laws(spark, d):
    return _docs(spark, d).filter("full_text is not null").groupBy(S.governing_law(F.col("full_text")).alias("law")).agg(F.count("*").alias("docs"))


# ---- chunks and provenance ------------------------------------------------------------------------------------------


@query()
def chunks_clause_aware(spark, d):
    return C.chunk_ids(C.chunk_clause_aware(_docs(spark, d), "id", "full_text", 512, 50))


@query()
def chunks_semantic(spark, d):
    return C.chunk_semantic(_docs(spark, d), "id", "full_text", 512, 50)


@query("SELECT id AS doc, true AS whole FROM legal_docs WHERE length(full_text) > 0")
def chunks_fixed_cover(spark, d):
    """Fixed windows hold every character but the white space between them."""
    docs = _docs(spark, d).filter("length(full_text) > 0")
    c = C.chunk_fixed(docs, "id", "full_text", 128)
    bare = lambda x: F.regexp_replace(x, "[ \n]", "")
    joined = c.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("all"))
    return docs.join(joined, docs["id"] == joined["doc"]).select("doc", (bare(F.col("all")) == bare(F.col("full_text"))).alias("whole"))


@query(
    """WITH c AS (SELECT doc_id, chunk_index, id, chunk_text, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY id) AS r FROM document_chunks)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (WHERE instr(full_text, chunk_text) > 0) AS verbatim FROM c JOIN legal_docs USING (doc_id) WHERE r = 1 AND full_text IS NOT NULL AND chunk_text IS NOT NULL GROUP BY doc_id"""
)
def chunk_provenance(spark, d):
    """Of the stored chunks (first delivery each), how many occur word for word in their document."""
    c = E.latest_by(table(spark, d, "document_chunks").select("doc_id", "chunk_index", "id", "chunk_text"), ["doc_id", "chunk_index"], F.col("id"))
    j = c.join(_docs(spark, d).select("doc_id", "full_text"), "doc_id").filter("full_text is not null and chunk_text is not null")
    return j.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.expr("instr(full_text, chunk_text) > 0")).alias("verbatim"))


@query(
    r"""WITH v AS (SELECT doc_id AS doc, CAST(id AS VARCHAR) AS field, name AS value FROM parties WHERE name IS NOT NULL), c AS (SELECT doc_id AS doc, id AS seq, chunk_text AS chunk FROM document_chunks WHERE chunk_text IS NOT NULL),
w AS (SELECT doc, seq, chunk, list_distinct(list_filter(regexp_split_to_array(lower(chunk), '[\s\x{a0}]+'), lambda x: x <> '')) AS cw FROM c),
e AS (SELECT doc, field, value, min(seq) AS seq FROM v JOIN c USING (doc) WHERE instr(chunk, value) > 0 GROUP BY doc, field, value),
r AS (SELECT v.*, list_distinct(list_filter(regexp_split_to_array(lower(value), '[\s\x{a0}]+'), lambda x: x <> '')) AS vw FROM v ANTI JOIN e USING (doc, field, value)),
s AS (SELECT doc, field, value, seq, len(list_intersect(vw, cw)) / len(list_distinct(list_concat(vw, cw))) AS score FROM r JOIN w USING (doc)),
b AS (SELECT doc, field, value, arg_min(seq, [-score, seq]) AS seq, max(score) AS score FROM s WHERE score >= 0.85 GROUP BY doc, field, value)
SELECT doc, field, value, coalesce(e.seq, b.seq) AS seq, CAST(instr(chunk, value) - 1 AS BIGINT) AS char_start, CAST(instr(chunk, value) - 1 + length(value) AS BIGINT) AS char_end, CASE WHEN e.seq IS NOT NULL THEN 1.0 ELSE b.score END AS score
FROM v LEFT JOIN e USING (doc, field, value) LEFT JOIN b USING (doc, field, value) LEFT JOIN c ON c.doc = v.doc AND c.seq = e.seq"""
)
def clause_provenance(spark, d):
    """Where each party's name stands in the chunks of its document."""
    values = table(spark, d, "parties").filter("name is not null").select(F.col("doc_id").alias("doc"), F.col("id").cast("string").alias("field"), F.col("name").alias("value"))
    ch = table(spark, d, "document_chunks").filter("chunk_text is not null").select(F.col("doc_id").alias("doc"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("char_start"), F.length("chunk_text").cast("long").alias("char_end"), F.col("chunk_text").alias("chunk"))
    return C.find_provenance(values, ch)


# ---- extraction -----------------------------------------------------------------------------------------------------

_WORDS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w.replace(chr(39), chr(39) * 2)}{chr(39)})' for w in ws)} THEN '{k}' END" for k, ws in E.CLAUSE_WORDS.items()) + "], lambda x: x IS NOT NULL)"


def _clauses(spark, d) -> DataFrame:
    return table(spark, d, "clauses").dropDuplicates(["id"])


@query(f"SELECT id, array_to_string({_WORDS_SQL}, ',') AS labels FROM (SELECT DISTINCT id, lower(clause_text) AS t FROM clauses WHERE clause_text IS NOT NULL)")
def clause_labels(spark, d):
    return _clauses(spark, d).filter("clause_text is not null").select("id", F.array_join(E.clause_labels(F.col("clause_text")), ",").alias("labels"))


_STORE_SQL = " ".join(f"WHEN '{label}' THEN '{kind}'" for label, kind in E.STORAGE_TYPES.items())


@query(f"SELECT storage_type, count(*) AS clauses FROM (SELECT CASE unnest({_WORDS_SQL}) {_STORE_SQL} ELSE 'other' END AS storage_type FROM (SELECT DISTINCT id, lower(clause_text) AS t FROM clauses WHERE clause_text IS NOT NULL)) GROUP BY 1")
def storage_types(spark, d):
    l = _clauses(spark, d).filter("clause_text is not null").select(F.explode(E.clause_labels(F.col("clause_text"))).alias("label"))
    return l.groupBy(E.storage_type(F.col("label")).alias("storage_type")).agg(F.count("*").alias("clauses"))


@query(
    f"""SELECT doc_id, key, arg_max(name, [confidence, -id]) AS name, max(confidence) AS confidence, min(id) AS first_id FROM (
  SELECT doc_id, id, confidence, regexp_replace({strip_sql('name')}, '[\\s\\x{{a0}}]+', ' ', 'g') AS name, lower(regexp_replace({strip_sql('name')}, '[\\s\\x{{a0}}]+', ' ', 'g')) AS key FROM parties) WHERE length(name) > 0 GROUP BY doc_id, key"""
)
def party_dedupe(spark, d):
    p = E.dedupe_parties(table(spark, d, "parties").select("doc_id", "id", "name", "confidence"), "doc_id", "name", "confidence", "id")
    return p.select("doc_id", F.lower("name").alias("key"), "name", "confidence", F.col("first_seen").alias("first_id"))


@query()
def clause_dedupe(spark, d):
    c = _clauses(spark, d).select(F.col("document_id").alias("doc"), F.col("id").alias("ord"), "clause_type", F.col("clause_text").alias("text"), F.col("confidence_score").alias("confidence"))
    return E.dedupe_clauses(c).select("doc", "ord", "clause_type", "place")


_CITE = [("case", r"[A-Z][A-Za-z\s\.,]+v\.\s+[A-Z][A-Za-z\s\.,]+,\s+[0-9]+\s+[A-Z][A-Za-z\.]+\s+[0-9]+"), ("statute", r"[0-9]+\s+U\.S\.C\.?\s+§+\s+[0-9\w\-\.]+"), ("regulation", r"[0-9]+\s+C\.F\.R\.?\s+§+\s+[0-9\w\-\.]+"), ("regulation", r"(?:Regulation|Directive)\s+\([A-Z]+\)\s+[0-9]{4}/[0-9]+"), ("regulation", "GDPR|CCPA|HIPAA|FERPA|COPPA")]


@query(
    "SELECT doc, citation_type, count(*) AS wordings FROM (SELECT doc, w, arg_min(citation_type, n) AS citation_type FROM ("
    + " UNION ALL ".join(f"SELECT id AS doc, {n} AS n, '{k}' AS citation_type, trim(unnest(regexp_extract_all(full_text || ' See 1 U.S.C. § ' || id, '{p}'))) AS w FROM legal_docs WHERE full_text IS NOT NULL" for n, (k, p) in enumerate(_CITE))
    + ") GROUP BY doc, w) GROUP BY doc, citation_type"
)
def citation_counts(spark, d):
    """Citations in all legal texts, to each of which one is added so that there is one."""
    docs = _docs(spark, d).filter("full_text is not null").select("id", F.concat("full_text", F.lit(" See 1 U.S.C. § "), F.col("id").cast("string")).alias("t"))
    return E.citations(docs, "id", "t").groupBy("doc", "citation_type").agg(F.count("*").alias("wordings"))


@query()
def legal_citations(spark, d):
    return E.citations(_docs(spark, d), "id", "full_text")


@query()
def dates_in_clauses(spark, d):
    return _clauses(spark, d).select("id", X.normal_date(F.col("clause_text")).alias("date")).filter("date is not null")


@query()
def amounts_in_clauses(spark, d):
    return _clauses(spark, d).select("id", X.amount(F.col("clause_text")).alias("amount")).filter("amount is not null")


_DUE = "'within ' || (o_orderkey % 90) || CASE o_orderkey % 4 WHEN 0 THEN ' days' WHEN 1 THEN ' months' WHEN 2 THEN ' business days' ELSE ' days after termination' END"


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) WHEN 1 THEN CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 90 AS INTEGER)) END AS DATE) AS due FROM orders"""
)
def deadlines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.col("o_orderkey")
    unit = F.when(k % 4 == 0, " days").when(k % 4 == 1, " months").when(k % 4 == 2, " business days").otherwise(" days after termination")
    said = F.concat(F.lit("within "), (k % 90).cast("string"), unit)
    return o.select("o_orderkey", X.deadline_date(said, F.col("day")).alias("due"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'")
def upcoming(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("due"))
    return E.upcoming(o, "due", datetime.date(1996, 1, 1), 30)


@query(
    """WITH v1 AS (SELECT DISTINCT document_id AS doc, coalesce(clause_type, 'unknown') AS t, clause_text AS x FROM clauses WHERE clause_text IS NOT NULL AND id % 2 = 0), v2 AS (SELECT DISTINCT document_id AS doc, coalesce(clause_type, 'unknown') AS t FROM clauses WHERE clause_text IS NOT NULL AND id % 3 <> 0)
SELECT doc, t AS clause_type, change FROM (
  SELECT doc, t, 'type_added' AS change FROM v2 WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.doc = v2.doc AND v1.t = v2.t)
  UNION SELECT doc, t, 'type_removed' FROM v1 WHERE NOT EXISTS (SELECT 1 FROM v2 WHERE v1.doc = v2.doc AND v1.t = v2.t))"""
)
def version_type_changes(spark, d):
    """Clause types that only one of two versions has; the versions are the even clauses and those not divisible by 3."""
    c = _clauses(spark, d).filter("clause_text is not null").select(F.col("document_id").alias("doc"), F.col("id").alias("ord"), F.coalesce("clause_type", F.lit("unknown")).alias("clause_type"))
    types = lambda x: x.select("doc", "clause_type").distinct()
    v1, v2 = types(c.filter("ord % 2 = 0")), types(c.filter("ord % 3 <> 0"))
    only = lambda a, b, w: a.join(b, ["doc", "clause_type"], "left_anti").withColumn("change", F.lit(w))
    return only(v2, v1, "type_added").unionByName(only(v1, v2, "type_removed"))


@query()
def clause_changes(spark, d):
    """Changes between two versions of all documents' clauses: the first lacks the ids that leave 2 when divided by 3, the second those that
    leave 1, so every clause is in one at least. Tested against comparing all pairs on a small fixture."""
    c = _clauses(spark, d).filter("clause_text is not null").select(F.col("document_id").alias("doc"), F.col("id").alias("ord"), F.coalesce("clause_type", F.lit("unknown")).alias("clause_type"), F.col("clause_text").alias("text"))
    return E.compare_versions(c.filter("ord % 3 <> 2"), c.filter("ord % 3 <> 1"))


@query(
    """SELECT id, field, decision, reason FROM (SELECT id, coalesce(clause_type, 'unknown') AS field, c, a, r, CASE WHEN c >= a THEN 'auto_accept' WHEN c >= r THEN 'human_review' ELSE 'auto_reject' END AS decision,
  CASE WHEN c >= a THEN printf('confidence %.2f ≥ accept threshold %.2f', c, a) WHEN c >= r THEN printf('confidence %.2f in review band [%.2f, %.2f)', c, r, a) ELSE printf('confidence %.2f < reject threshold %.2f', c, r) END AS reason
  FROM (SELECT DISTINCT id, clause_type, coalesce(confidence_score, 0) AS c, CASE WHEN coalesce(clause_type, 'unknown') = 'payment' THEN 0.95 ELSE 0.85 END AS a, CASE WHEN coalesce(clause_type, 'unknown') = 'payment' THEN 0.7 ELSE 0.5 END AS r FROM clauses))"""
)
def confidence_routing(spark, d):
    f = _clauses(spark, d).select("id", F.coalesce("clause_type", F.lit("unknown")).alias("field"), F.col("confidence_score").alias("confidence"))
    over = spark.createDataFrame([("payment", 0.95, 0.7)], "field string, accept double, reject double")
    return E.route_fields(f, overrides=over).select("id", "field", "decision", "reason")


@query(
    """SELECT document_id, count(*) AS fields, count(*) FILTER (WHERE c >= 0.85) AS accepted, count(*) FILTER (WHERE c >= 0.5 AND c < 0.85) AS review, count(*) FILTER (WHERE c < 0.5) AS rejected,
  count(*) FILTER (WHERE c >= 0.85) / count(*) AS acceptance_rate, count(*) FILTER (WHERE c >= 0.85) = count(*) AS fully_accepted FROM (SELECT DISTINCT id, document_id, coalesce(confidence_score, 0) AS c FROM clauses) GROUP BY document_id"""
)
def routing_by_document(spark, d):
    f = _clauses(spark, d).select("id", "document_id", F.lit("clause").alias("field"), F.col("confidence_score").alias("confidence"))
    return E.routing_summary(E.route_fields(f), "document_id")


_RULES = [("gap-1", 1, "payment", ["euro"], [], "", "", True), ("word-1", 2, "liability", [], ["without prior consent"], "", "", False)]
_RULE_SCHEMA = "rule_id string, rule_ord int, clause_type string, required array<string>, forbidden array<string>, required_pattern string, forbidden_pattern string, if_missing boolean"


@query(
    """WITH c AS (SELECT DISTINCT id, document_id AS doc, clause_type, clause_text FROM clauses WHERE clause_text IS NOT NULL)
SELECT doc, 'gap-1' AS rule_id, id AS ord FROM c WHERE clause_type = 'payment' AND NOT contains(lower(clause_text), 'euro')
UNION ALL SELECT doc, 'word-1', id FROM c WHERE clause_type = 'liability' AND contains(lower(clause_text), 'without prior consent')
UNION ALL SELECT DISTINCT doc, 'gap-1', CAST(NULL AS BIGINT) FROM c WHERE doc IS NOT NULL AND doc NOT IN (SELECT doc FROM c WHERE clause_type = 'payment' AND doc IS NOT NULL)"""
)
def rule_flags(spark, d):
    """Two example rules; rule sets are the caller's."""
    c = _clauses(spark, d).filter("clause_text is not null").select(F.col("document_id").alias("doc"), F.col("id").alias("ord"), "clause_type", F.col("clause_text").alias("text"))
    return E.apply_rules(c, spark.createDataFrame(_RULES, _RULE_SCHEMA), c.filter("doc is not null")).select("doc", "rule_id", "ord")


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT id, min(role) AS value FROM parties WHERE role IS NOT NULL GROUP BY id), a AS (SELECT id, min(entity_type) AS actual FROM parties GROUP BY id)
SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(lower(value) = lower(actual), false)) AS correct, count(*) FILTER (WHERE coalesce(lower(value) = lower(actual), false)) / count(*) AS accuracy, 'role' AS field FROM e LEFT JOIN a USING (id)"""
)
def eval_fields(spark, d):
    p = table(spark, d, "parties")
    expected = p.filter("role is not null").groupBy(F.col("id").alias("case_id")).agg(F.min("role").alias("value")).select("case_id", F.lit("role").alias("field"), "value", F.lit(1.0).alias("weight"))
    actual = p.groupBy(F.col("id").alias("case_id")).agg(F.min("entity_type").alias("value")).withColumn("field", F.lit("role"))
    return V.field_accuracy(V.score_fields(expected, actual))


@query(
    """WITH b AS (SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, count(*) FILTER (WHERE entity_type = 'individual') AS correct, avg(confidence) AS m FROM parties WHERE confidence BETWEEN 0 AND 1 GROUP BY 1)
SELECT CAST(r AS INTEGER) AS bin, r / 10 AS lower, (r + 1) / 10 AS upper, coalesce(n, 0) AS n, coalesce(correct, 0) AS correct, coalesce(correct / n, 0.0) AS accuracy, coalesce(m, 0.0) AS mean_confidence FROM range(10) t(r) LEFT JOIN b ON b.bin = r"""
)
def calibration(spark, d):
    p = table(spark, d, "parties").select("confidence", F.coalesce(F.col("entity_type") == "individual", F.lit(False)).alias("ok"))
    return V.calibration_bins(p, "confidence", "ok")


@query(
    """WITH b AS (SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, count(*) FILTER (WHERE entity_type = 'individual') AS correct, avg(confidence) AS m FROM parties WHERE confidence BETWEEN 0 AND 1 GROUP BY 1)
SELECT round(sum(abs(correct / n - m) * n) / sum(n), 9) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b"""
)
def calibration_error(spark, d):
    return V.calibration_error(calibration(spark, d)).select(F.round("ece", 9).alias("ece"), "n")


# ---- retrieval ------------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, label, round(s, 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.e) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20) WHERE s > 0"""
)
def vector_top_k(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select("embedding").first()[0]
    return R.top_k(e, q, 20, order="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, label, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), qe) AS c FROM q JOIN embeddings v USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(c, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND c > 0"""
)
def vector_top_k_filtered(spark, d):
    """Every query vector (ids divisible by 50) within its own label."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_embedding"))
    return R.top_k_each(e, q, 10, ["label"], order="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), qe) AS c FROM q CROSS JOIN embeddings v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(c, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND c > 0"""
)
def vector_top_k_batch(spark, d):
    """Every query vector (ids divisible by 50) against all rows, whatever their label."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    return R.top_k_batch(e, q, 10, order="vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_AUTH = "CASE s_suppkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 55 WHEN 3 THEN 30 ELSE 5 END"


@query(
    f"""SELECT s_suppkey, round(0.6 * (s_suppkey % 100) / 100.0 + 0.3 * {_AUTH} / 100.0 * CASE WHEN s_suppkey % 7 = 0 THEN 0.1 ELSE 1 END + 0.1 * CASE WHEN s_suppkey % 11 = 0 THEN 0.5 ELSE greatest(0.0, 1.0 - 0.02 * (2025 - (1980 + s_suppkey % 40))) END, 9) AS combined FROM supplier"""
)
def rag_rescore(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "CONSTITUTIONAL").when(k % 5 == 1, "APPELLATE_COURT").when(k % 5 == 2, "AGENCY_GUIDANCE").when(k % 5 == 3, "SECONDARY_TREATISE").otherwise("BLOG_NEWS")
    s = table(spark, d, "supplier").select("s_suppkey", ((k % 100) / 100.0).alias("score"), X.authority_level(kind).alias("level"), (k % 7 == 0).alias("superseded"), F.when(k % 11 != 0, (1980 + k % 40).cast("int")).alias("publication_year"))
    return R.rescore(s, 2025).select("s_suppkey", F.round("combined", 9).alias("combined"))


@query(
    f"""WITH s AS (SELECT s_nationkey AS question, s_suppkey AS id, {_AUTH} AS level, 1980 + s_suppkey % 40 AS year, CASE s_suppkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' END AS region FROM supplier),
p AS (SELECT a.question, a.id AS ia, b.id AS ib, a.level AS la, b.level AS lb, coalesce(a.region <> b.region, false) AS j, abs(a.year - b.year) >= 5 AS t FROM s a JOIN s b ON a.question = b.question AND a.id < b.id)
SELECT question, ia AS source_a, ib AS source_b, 'jurisdiction_conflict' AS conflict_type, CASE WHEN la > 55 AND lb > 55 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE j
UNION ALL SELECT question, ia, ib, 'temporal_conflict', CASE WHEN abs(la - lb) < 20 THEN 'high' ELSE 'medium' END FROM p WHERE t
UNION ALL SELECT question, CASE WHEN la > lb THEN ia ELSE ib END, CASE WHEN la > lb THEN ib ELSE ia END, 'authority_conflict', 'medium' FROM p WHERE NOT j AND NOT t AND abs(la - lb) >= 20"""
)
def source_conflicts(spark, d):
    k = F.col("s_suppkey")
    kind = F.when(k % 5 == 0, "CONSTITUTIONAL").when(k % 5 == 1, "APPELLATE_COURT").when(k % 5 == 2, "AGENCY_GUIDANCE").when(k % 5 == 3, "SECONDARY_TREATISE").otherwise("BLOG_NEWS")
    jur = X.jurisdiction(F.when(k % 3 == 0, "US-CA").when(k % 3 == 1, "US-NY").otherwise("US"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("question"), k.alias("ord"), k.alias("id"), jur.alias("jur"), X.authority_level(kind).alias("level"), (1980 + k % 40).cast("int").alias("publication_year"))
    return R.conflicts(s)


@query(
    """SELECT id, CASE WHEN p IS NOT NULL THEN '(' || title || ', p. ' || p || ')' ELSE '(' || title || ', ' || source_url || ')' END AS inline, '[' || id || '] ' || title || ' <' || source_url || '>' || coalesce(', p. ' || p, '') || '.' AS footnote
FROM (SELECT id, title, source_url, nullif(CAST(id % 3 AS VARCHAR), '0') AS p FROM legal_docs WHERE title IS NOT NULL AND length(source_url) > 0)"""
)
def citation_styles(spark, d):
    s = _docs(spark, d).filter("title is not null and length(source_url) > 0")
    page = (F.col("id") % 3).cast("int")
    return s.select("id", R.citation("inline", F.col("title"), page, F.col("source_url")).alias("inline"), R.citation("footnote", F.col("title"), page, F.col("source_url"), F.col("id")).alias("footnote"))


# ---- storage --------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT filename, arg_min(id, id) AS id, arg_min(CAST(row(file_hash) AS STRUCT(h VARCHAR)), id).h AS oh, arg_min(CAST(row(extracted_text) AS STRUCT(t VARCHAR)), id).t AS ot FROM source_files WHERE id % 2 = 0 GROUP BY filename)
SELECT n.filename, s.id, CASE WHEN s.id IS NULL THEN 'inserted' WHEN CASE WHEN n.file_hash IS NOT NULL AND oh IS NOT NULL THEN n.file_hash = oh ELSE n.extracted_text IS NOT DISTINCT FROM ot END THEN 'exists' ELSE 'conflict' END AS status
FROM (SELECT * FROM source_files WHERE id % 2 = 1) n LEFT JOIN s USING (filename)"""
)
def insert_or_get(spark, d):
    """The files of odd ids inserted into a store of the even ones."""
    s = table(spark, d, "source_files")
    return B.insert_status(s.filter("id % 2 = 1"), s.filter("id % 2 = 0"))


@query("SELECT id FROM legal_docs WHERE json_extract_string(privacy_profile, '$.sensitivity') = 'confidential' AND CAST(json_extract(privacy_profile, '$.contains_pii') AS VARCHAR) = 'true'")
def metadata_search(spark, d):
    return _docs(spark, d).filter(B.metadata_is(F.col("privacy_profile"), {"sensitivity": "confidential", "contains_pii": True})).select("id")


@query("SELECT id, filename FROM source_files ORDER BY uploaded_at DESC NULLS FIRST, id LIMIT 50")
def newest_files(spark, d):
    return B.newest(table(spark, d, "source_files"), "uploaded_at", 50).select("id", "filename")


@query("SELECT DISTINCT document_id FROM processing_log WHERE status = 'failed' AND document_id IS NOT NULL")
def failed_documents(spark, d):
    return B.failed_documents(table(spark, d, "processing_log"))


@query("SELECT document_id, processing_stage, id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id, processing_stage ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM processing_log) WHERE r = 1")
def latest_stages(spark, d):
    return B.latest_stage(table(spark, d, "processing_log")).select("document_id", "processing_stage", "id", "status")


@query("SELECT DISTINCT id FROM document_chunks WHERE embedding IS NULL")
def unembedded(spark, d):
    return table(spark, d, "document_chunks").filter("embedding is null").select("id").distinct()


@query(
    """SELECT c.id AS clause_id, l.doc_id, coalesce(clause_type, 'unknown') AS clause_type, clause_text, page_number, confidence_score AS confidence FROM (SELECT DISTINCT id, document_id, clause_type, clause_text, page_number, confidence_score FROM clauses) c JOIN legal_docs l ON l.id = c.document_id WHERE l.doc_type = 'contract'"""
)
def clauses_view(spark, d):
    """Clauses migrated to extracted fields and read back by the view."""
    return B.clause_view(B.clause_fields(_clauses(spark, d), _docs(spark, d)))


@query("SELECT (SELECT count(*) FROM legal_docs WHERE id % 10 <> 0) AS documents, (SELECT count(*) FROM clauses WHERE document_id IS NULL OR document_id NOT IN (SELECT id FROM legal_docs WHERE id % 10 = 0)) AS clauses")
def delete_cascade(spark, d):
    docs = _docs(spark, d)
    left, children = B.delete_documents(docs.select("id"), {"clauses": (table(spark, d, "clauses").select("document_id"), "document_id")}, docs.filter("id % 10 = 0").select("id"))
    return left.agg(F.count("*").alias("documents")).join(children["clauses"].agg(F.count("*").alias("clauses")), F.lit(True))


@query("SELECT CASE WHEN document_id % 10 = 0 AND document_id IN (SELECT id FROM legal_docs) THEN sha256('key' || document_id) ELSE CAST(document_id AS VARCHAR) END AS document_id, count(*) AS events FROM processing_log GROUP BY 1")
def erased_log(spark, d):
    gone = _docs(spark, d).filter("id % 10 = 0").select("id")
    log = B.erase(table(spark, d, "processing_log"), "document_id", gone, F.sha2(F.concat(F.lit("key"), F.col("id").cast("string")), 256))
    return log.groupBy("document_id").agg(F.count("*").alias("events"))


@query(r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM documents) SELECT doc_id AS doc, count(*) AS hits FROM w WHERE t IN ('rent', 'tenant') GROUP BY doc_id HAVING count(DISTINCT t) = 2")
def full_text_search(spark, d):
    return B.search(B.inverted_index(table(spark, d, "documents").filter("text is not null"), "doc_id", "text"), ["tenant", "rent"])


# ---- events ---------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS \"start\", event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def events_per_hour(spark, d):
    return A.windowed_counts(table(spark, d, "events")).withColumn("value", F.round("value", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n"""
)
def event_sessions(spark, d):
    s = A.sessions(table(spark, d, "events"))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(ts) AS latest FROM events GROUP BY event_type")
def audit_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("latest"))


@query("SELECT user_id, arg_max(event_id, [epoch_us(ts), event_id]) AS event_id FROM events GROUP BY user_id")
def audit_latest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT e.event_type, json_extract_string(props, '$.k') AS k, count(*) AS events FROM events e GROUP BY ALL")
def json_paths(spark, d):
    from lexloom.sources.files import json_text

    return table(spark, d, "events").groupBy("event_type", json_text(F.col("props"), "k").alias("k")).agg(F.count("*").alias("events"))


@query("SELECT id, CASE WHEN left(coalesce(name, ''), 1) IN ('=', '+', '-', '@') THEN '''' || name ELSE coalesce(name, '') END AS name FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '=' || name ELSE name END AS name FROM parties)")
def safe_cells(spark, d):
    p = table(spark, d, "parties").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("="), F.col("name"))).otherwise(F.col("name")).alias("name"))
    return p.select("id", X.safe_cell(F.col("name")).alias("name"))


@query("SELECT role, entity_type, count(*) AS n, GROUPING(role) AS by_role FROM parties GROUP BY ROLLUP (role, entity_type)")
def party_rollup(spark, d):
    return table(spark, d, "parties").rollup("role", "entity_type").agg(F.count("*").alias("n"), F.grouping("role").cast("long").alias("by_role"))


