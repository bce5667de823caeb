"""Queries over texts that are built from table columns, so that SQL can state the expected result in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import extraction as E
from lexloom.operators import storage as B
from lexloom.operators import structure as S
from lexloom.session import table
from lexloom.sources.exports import ical_event
from lexloom.sources.files import html_text

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """A small contract for every order: two numbered sections, a sub-section, a defined term, references and a schedule."""
    k = F.col("o_orderkey").cast("string")
    body = F.concat(
        F.lit('1. Definitions\n"Item '), k, F.lit('" means the goods of order '), k, F.lit(" in full.\n2. Payment\nSee Section 1 and Section "), (F.col("o_orderkey") % 5).cast("string"),
        F.lit('.\n(a)\n"Item '), k, F.lit('" is paid.\nSchedule A Prices\nNone.\n'),
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), body.alias("full_text")).distinct()


_ORDERS = "(SELECT DISTINCT o_orderkey AS k FROM orders)"


@query(f"SELECT k AS doc, 'Item ' || k AS term, 'the goods of order ' || k || ' in full.' AS definition_text, '1' AS section FROM {_ORDERS}")
def built_defined_terms(spark, d):
    return S.defined_terms(S.sections(_contracts(spark, d), "id", "full_text")).drop("ord")


@query(f"SELECT k AS doc, 'Item ' || k AS term, '(a)' AS section FROM {_ORDERS}")
def built_term_usages(spark, d):
    s = S.sections(_contracts(spark, d), "id", "full_text")
    return S.term_usages(s, S.defined_terms(s))


@query(
    f"""SELECT k AS doc, '2' AS source_section, 'Section 1' AS raw_text, '1' AS target_number, true AS resolved FROM {_ORDERS}
UNION ALL SELECT k, '2', 'Section ' || k % 5, CAST(k % 5 AS VARCHAR), false FROM {_ORDERS} WHERE k % 5 NOT IN (1, 2)
UNION ALL SELECT k, '(a)', 'Schedule A', 'A', true FROM {_ORDERS}"""
)
def built_cross_references(spark, d):
    docs = _contracts(spark, d)
    return S.cross_references(S.sections(docs, "id", "full_text"), S.schedules(docs, "id", "full_text"))


@query(f"SELECT k AS doc, 1 AS ord, 'Schedule A' AS label, 'Prices' AS title, 'None.' AS body FROM {_ORDERS}")
def built_schedules(spark, d):
    return S.schedules(_contracts(spark, d), "id", "full_text")


@query(
    f"""SELECT k AS doc, o AS ord, n AS number, t AS title, l AS level, p AS parent_ord FROM {_ORDERS}, (VALUES (1, '1', 'Definitions', 0, NULL), (2, '2', 'Payment', 0, NULL), (3, '(a)', '', 1, 2)) v(o, n, t, l, p)"""
)
def built_sections(spark, d):
    return S.sections(_contracts(spark, d), "id", "full_text").select("doc", "ord", "number", "title", "level", "parent_ord")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def built_dates(spark, d):
    """Order dates written in four ways and read again."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "d MMMM yyyy")).when(k % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    return table(spark, d, "orders").select("o_orderkey", X.normal_date(F.concat(F.lit("dated "), said)).alias("day"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS amount FROM orders")
def built_amounts(spark, d):
    """Prices written in two ways and read again."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    said = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("USD "), us)).otherwise(F.concat(F.lit("EUR "), F.translate(us, ",.", ".,")))
    return table(spark, d, "orders").select("o_orderkey", X.amount(said).cast("double").alias("amount"))


@query("SELECT p_partkey, p_name || chr(10) || p_type || ' & more' AS body FROM part")
def built_html(spark, d):
    page = F.concat(F.lit("<html><head><title>x</title><style>p {}</style></head><body><p>"), F.col("p_name"), F.lit("</p><script>no()</script><div>"), F.col("p_type"), F.lit(" &amp; more</div></body></html>"))
    return table(spark, d, "part").select("p_partkey", html_text(page).alias("body"))


@query(
    r"""SELECT o_orderkey, concat('BEGIN:VEVENT', chr(13), chr(10), 'UID:', o_orderkey, chr(13), chr(10), 'DTSTART;VALUE=DATE:', strftime(o_orderdate, '%Y%m%d'), chr(13), chr(10), 'DTEND;VALUE=DATE:', strftime(o_orderdate, '%Y%m%d'), chr(13), chr(10),
  'SUMMARY:Buyer\, Ltd: pay\; now', chr(13), chr(10), 'DESCRIPTION:Section: ', o_orderpriority, '\nDeadline: soon\n', chr(13), chr(10), 'END:VEVENT') AS event FROM orders"""
)
def built_ical(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ical_event(F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.lit("Buyer, Ltd"), F.lit("pay; now"), F.col("o_orderpriority"), F.lit("soon"), F.lit("")).alias("event"))


@query(
    """SELECT l_orderkey AS doc, lower(l_returnflag) AS term_type, max(l_discount) AS confidence, count(*) FILTER (WHERE false) + 1 AS kept FROM lineitem GROUP BY l_orderkey, l_returnflag, CAST(l_quantity AS INTEGER)"""
)
def built_term_dedupe(spark, d):
    li = table(spark, d, "lineitem")
    t = li.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")).alias("term_type"), F.col("l_quantity").cast("int").alias("amount"), F.lit("usd").alias("currency"), F.col("l_discount").alias("confidence"))
    return E.dedupe_terms(t).select("doc", F.lower("term_type").alias("term_type"), "confidence", F.lit(1).cast("long").alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def built_metadata_merge(spark, d):
    e = table(spark, d, "events")
    merged = B.merge_metadata(F.concat(F.lit('{"kind": "old", "k": '), F.get_json_object("props", "$.k"), F.lit("}")), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return e.select("event_id", merged.alias("m")).select("event_id", F.get_json_object("m", "$.k").cast("long").alias("k"), F.get_json_object("m", "$.kind").alias("kind"))


@query(
    """WITH a AS (SELECT c_custkey AS doc, 'n' || n_name AS item FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT doc, 'party' AS kind, lower(item) AS item, 'changed' AS change FROM a WHERE doc % 3 = 0
UNION ALL SELECT doc, 'clause', 'extra', 'added' FROM a WHERE doc % 4 = 0
UNION ALL SELECT doc, 'term', 'fee', 'changed' FROM a WHERE doc % 5 = 0"""
)
def built_contract_comparison(spark, d):
    """Two versions of a contract for every customer: roles, clauses and fees differ for some."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("doc"), F.concat(F.lit("n"), F.col("n_name")).alias("name"))
    k = F.col("doc")
    parties = c.withColumn("role", F.lit("buyer")), c.withColumn("role", F.when(k % 3 == 0, "seller").otherwise("buyer"))
    pay = c.select("doc", F.lit("pay").alias("clause_type"))
    clauses = pay, pay.unionByName(c.filter(k % 4 == 0).select("doc", F.lit("extra").alias("clause_type")))
    fee = lambda v: c.select("doc", F.lit("fee").alias("term_type"), v.alias("amount"))
    terms = fee(F.lit("100")), fee(F.when(k % 5 == 0, "101").otherwise("100.00"))
    return E.compare_contracts(parties, clauses, terms)
