"""Operators put together from others: edge cases that the queries over whole tables do not have."""

import zipfile

import pytest
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
from lexloom.plans.tasks import Scripted
from lexloom.sources import exports as X
from lexloom.sources.files import bootstrap, from_pages


def test_local_providers():
    class At:
        def __init__(self, host, model="small", is_local=True):
            self.host, self.model, self.is_local, self.name = host, model, is_local, "x"

    ok = ["http://127.0.0.1:1", "10.0.0.7", "[::1]:80", "http://192.168.1.1", "100.64.3.4", "[::ffff:10.0.0.1]"]
    assert [N.not_local(At(h)) for h in ok] == [None] * len(ok)
    assert not any(N.not_local(At("10.0.0.1", m)) for m in ("", "cloudy", "a-cloud:small", "reg@x/m:cloudlet", "mcloud"))
    for bad in (At("8.8.8.8"), At("http://[2002::1]"), At(None), At("10.0.0.1", "reg/m:120b-cloud@sha"), At("10.0.0.1", "m:Cloud"), At("10.0.0.1", "cloud"), At("10.0.0.1", "a/x-cloud"), At("10.0.0.1", is_local=False), At("nowhere.example")):
        assert N.not_local(bad)
    assert N.not_local(At("inside.example"), lambda n: ["10.1.1.1"]) is None and N.not_local(At("inside.example"), lambda n: ["10.1.1.1", "9.9.9.9"])


def test_enforced_sends_nothing_it_must_not(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(1, "a@b.org", "blocked", "secret", False), (2, "a@b.org", None, None, None), (3, None, "any", "public", False), (4, "a@b.org", "any", "confidential", True), (5, "x", "local_only", "restricted", False)]
    p = spark.createDataFrame(rows, "id long, prompt string, route string, sensitivity string, redaction_done boolean")

    def answer(t):
        seen.add(1)
        return t

    out = {r.id: r for r in N.enforced(p, Scripted(answer, is_local=False)).collect()}
    assert seen.value == 1 and [out[i].decision for i in (1, 2, 3, 4, 5)] == ["blocked", "blocked", "sent_raw", "sent_raw", "routing_error"]
    assert out[4].answer == "a@b.org" and out[1].sent is None and out[3].answer is None
    assert N.enforced(p.limit(0), Scripted(str)).collect() == []


def test_extraction_of_nothing(spark):
    none = spark.createDataFrame([], "doc long, seq int, chunk string")
    got = K.extract(none, Scripted(lambda p: "{}"), [])
    assert got.documents.collect() == got.clauses.collect() == got.terms.collect() == got.parties.collect() == []
    odd = spark.createDataFrame([(1, 0, "t"), (2, 0, None), (3, 0, "")], "doc long, seq int, chunk string")
    got = {r.doc: r for r in K.extract(odd, Scripted(lambda p: "no json"), []).documents.collect()}
    assert got[1].status == "failed" and len(got[1].warnings) == 3 and got[3].status == "failed"


def test_index_of_nothing_and_ties(spark):
    empty = spark.createDataFrame([], G.INDEX)
    q = spark.createDataFrame([(1, [1.0, 0.0], "q", None, None)], "query_id long, query_embedding array<float>, question string, want_country string, want_region string")
    assert G.answer_sources(empty, q, 3, 2025, True).collect() == []
    p = G.prompts(G.answer_sources(empty, q, 3, 2025, True), q, "{context}|{question}").collect()
    assert [(r.prompt, r.confidence, r.route) for r in p] == [("|q", 0.0, "any")]
    rows = [(f"d{i}", f"d{i}:chunk:0", i, f"t{i}", [1.0, 0.0], None, "x", r, 1, None, None, c, None) for i, (r, c) in enumerate([("any", None), ("any", "US"), (None, None), ("any", "DE"), ("any", None)])]
    index = spark.createDataFrame(rows, G.INDEX)
    us = q.withColumn("want_country", F.lit("US"))
    assert [r.seq for r in G.answer_sources(index, us, 5, 2025, False).orderBy("rank").collect()] == [0, 1, 4]
    assert G.size(G.remove(index, spark.createDataFrame([("d1",), (None,)], "doc_id string"))) == 4


def test_failed_sources_leave_what_is_stored(spark):
    cols = "doc_id string, source_url string, text string, error string, doc_type string, route string, level int, superseded boolean, publication_year int, country string, region string"
    src = lambda doc, url, text, err=None: (doc, url, text, err, "x", "any", 1, False, None, None, None)
    index, _ = G.ingest(spark.createDataFrame([], G.INDEX), spark.createDataFrame([src("a", "http://u", "one"), src("b", "http://v", "two")], cols), G.HashEmbedder(4))
    index, report = G.ingest(index, spark.createDataFrame([src("a2", "http://u", None), src("b2", "http://v", "three")], cols), G.HashEmbedder(4))
    assert {(r.doc_id, r.text) for r in index.collect()} == {("a", "one"), ("b2", "three")}
    assert {(r.doc_id, r.status, r.error) for r in report.collect()} == {("a2", "failed", "no text"), ("b2", "ingested", None)}


def test_registering_is_all_or_nothing(spark):
    chunks = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab"), (2, 0, "x"), (2, 1, "nope"), (3, 0, "y")], "doc long, seq int, chunk string")
    texts = spark.createDataFrame([(1, "abab"), (2, "x y")], "doc long, text string")
    got = {(r.doc, r.seq): (r.char_start, r.char_end, r.error) for r in C.register_chunks(chunks, texts).collect()}
    assert got == {(1, 0): (0, 2, None), (1, 1): (2, 4, None), (2, 1): (None, None, "chunk 1 is not in the text"), (3, 0): (None, None, "chunk 0 is not in the text")}
    tiled = {(r.doc, r.seq): (r.char_start, r.char_end) for r in C.register_chunks(chunks).collect()}
    assert tiled[(1, 1)] == (3, 5) and tiled[(2, 1)] == (2, 6)
    assert C.locate_spaced("a b\nc", "bc") == (2, 5) and C.locate_spaced(None, "a") is None and C.locate_spaced("a", " ") is None


def test_sections_of_one_number(spark):
    t = spark.createDataFrame([(1, "1. One\nx\n1. Again\ny\nArticle II Two\nz\nArticle II More\nw")], "id long, t string")
    sec = S.sections(t, "id", "t")
    refs = spark.createDataFrame([(1, "Section 1"), (1, "Article II"), (1, "7"), (2, "1"), (1, None)], "doc long, raw string")
    assert {(r.doc, r.raw): r.ord for r in S.resolve(refs, sec).collect()} == {(1, "Section 1"): 2, (1, "Article II"): 3, (1, "7"): None, (2, "1"): None, (1, None): None}
    assert S.leaves(sec).count() == 4
    assert S.parse(t.limit(0), "id", "t").warnings.collect() == []


def test_coverage_without_found_spans(spark):
    gold = spark.createDataFrame([(1, 0, 3, "A"), (2, 0, 3, "A")], "doc long, start long, end long, entity string")
    found = spark.createDataFrame([(1, 0, 5)], "doc long, start long, end long")
    assert {(r.doc, r.covered) for r in V.span_coverage(gold, found).collect()} == {(1, True), (2, False)}


def test_gates(spark):
    one = spark.createDataFrame([(0.8, 0.5, 0.9, 1.0)], "field_accuracy double, case_accuracy double, recall double, blocking_accuracy double")
    V.require_field_accuracy(one, 0.8), V.require_pii_recall(one, 0.9), V.require_perfect_blocking(one)
    with pytest.raises(AssertionError):
        V.require_case_accuracy(one, 0.6)


def test_rules(spark):
    c = spark.createDataFrame([(1, 1, "pay", "in euro"), (2, 2, None, "x"), (3, 3, "pay", None)], "doc long, ord long, clause_type string, text string")
    schema = "rule_id string, rule_ord int, clause_type string, required array<string>, forbidden array<string>, required_pattern string, forbidden_pattern string, if_missing boolean"
    rules = spark.createDataFrame([("a", 1, "pay", [], [], "", "", True), ("b", 2, "law", [], [], "", "", True), ("c", 3, "pay", [], ["euro"], "", "", False)], schema)
    got = {(r.doc, r.rule_id, r.ord) for r in E.apply_rules(c, rules, c).collect()}
    assert got == {(1, "b", None), (2, "a", None), (2, "b", None), (3, "b", None), (1, "c", 1)}
    plan = E.apply_rules(c, rules, c)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert E.apply_rules(c, rules.limit(0), c).collect() == []


def test_workbook(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2.5, None), ("a<b&c\x07", None, "x")], "s string, n double, t string")
    path = str(tmp_path / "x.xlsx")
    X.write_excel({"Clauses of the contract: a/b?" * 2: df, "clauses of the contract: a/b?" * 2: df.limit(0)}, path)
    with zipfile.ZipFile(path) as z:
        page = z.read("xl/worksheets/sheet1.xml").decode()
        assert z.testzip() is None and "'=1+1" in page and "a&lt;b&amp;c<" in page and "<v>2.5</v>" in page
    names = X.sheet_names(["A" * 40, "a" * 40, "x[y]", ""])
    assert len(set(map(str.lower, names))) == 4 and max(map(len, names)) <= 31 and names[2] == "x_y_"
    try:
        import openpyxl
    except ImportError:
        return
    assert openpyxl.load_workbook(path).worksheets[0]["A2"].value == "'=1+1"


def test_store(spark):
    f = spark.createDataFrame([(1, "a", "t"), (2, "b", None)], "id long, filename string, extracted_text string")
    assert B.id_of(f, "b") == 2 and B.id_of(f, "zz") is None
    new = spark.createDataFrame([(2, "now")], "id long, extracted_text string")
    assert {(r.id, r.extracted_text) for r in B.update_text(f, new).collect()} == {(1, "t"), (2, "now")}
    with pytest.raises(LookupError):
        B.update_text(f, new.withColumn("id", F.lit(9).cast("long")))
    s = spark.createDataFrame([("failed",), ("completed",), (None,)], "s string").select(B.is_failed(F.col("s")).alias("f"), B.is_completed(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in s] == [(True, False), (False, True), (False, False)]
    new, counts = bootstrap(spark.createDataFrame([("a", "x", None), ("c", "y", None), ("d", None, "bad"), ("c", None, "bad")], "filename string, text string, error string"), f)
    assert [r.filename for r in new.collect()] == ["c"] and {tuple(r) for r in counts.collect()} == {("skipped", 1), ("inserted", 1), ("failed", 1)}
    assert from_pages(spark.createDataFrame([], "source string, page int, page_content string")).collect() == []


def test_detection_skips_plain_texts_only(spark):
    t = spark.createDataFrame([(1, "no mark"), (2, "a@b.org"), (3, "１２３-45-6789"), (4, None), (5, "")], "id long, t string")
    assert {r.doc for r in P.detect(t, "id", "t").collect()} == {2, 3}
    assert {r.doc for r in P.detect(t, "id", "t", [("X", "no", 0.9)]).collect()} == {1, 2, 3}


def test_database_sink(spark, tmp_path):
    """An embedded database: the table is made, retries and repeated keys add nothing."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "event_id string, n int")
    B.append_jdbc(df, url, "audit", "event_id", **driver)
    B.append_jdbc(df.unionByName(spark.createDataFrame([("c", 3)], "event_id string, n int")), url, "audit", "event_id", **driver)
    assert sorted(map(tuple, B.jdbc(spark, url, "audit", **driver).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    from lexloom.streaming.audit import append_to_jdbc

    df.unionByName(spark.createDataFrame([("d", 4)], "event_id string, n int")).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    append_to_jdbc(stream, url, "audit", str(tmp_path / "state"), **driver)
    append_to_jdbc(stream, url, "audit", str(tmp_path / "other"), **driver)
    assert B.jdbc(spark, url, "audit", **driver).count() == 4


def test_headers_and_footers():
    import io

    from lexloom.sources.files import docx_loader, docx_text

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('one')}{p(' ')}{p('two')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('top')}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('end')}</w:ftr>")
    assert docx_text(f.getvalue()) == "one\ntwo" and docx_loader(True, True)(f.getvalue()) == "top\none\ntwo\nend"


def test_extraction_as_a_task(spark):
    from lexloom.plans.builtin import default_registry

    answer = '{"contract_type": "NDA", "parties": [{"name": "A", "role": null, "confidence": 0.9}], "clauses": [{"clause_type": "x", "text": "t", "confidence": 0.9}], "financial_terms": []}'
    docs = spark.createDataFrame([(1, "contract", "any", "1. Text of it"), (2, "letter", "any", "x"), (3, "contract", "blocked", "y"), (4, "contract", "any", None)], "id long, doc_type string, route string, full_text string")
    out = {r.id: r for r in default_registry(Scripted(lambda p: answer), known_types=["nda"]).pipeline("contract_extraction")(docs).collect()}
    assert tuple(out[1].extraction) == ("extracted", "nda", 1, 1, 0) and out[2].extraction is None and out[3].extraction is None and out[4].extraction is None
    assert out[3].task_errors == ["contract_extraction: routing forbids this provider"]
