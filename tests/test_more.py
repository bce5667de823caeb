import json

import pytest
from pyspark.sql import functions as F

from lexloom.exceptions import InvalidFile
from lexloom.operators import evaluation as V
from lexloom.operators import extraction as E
from lexloom.operators import storage as B
from lexloom.plans.builtin import default_registry, first_chunks_prompt, provider_kind
from lexloom.plans.tasks import Scripted
from lexloom.sources import suites


def test_builtin_tasks(spark):
    docs = spark.createDataFrame([(1, "contract", "any", "public", "Mail a@b.org. Governed by French law, 42 U.S.C. § 1983 too."), (2, "memo", "any", "public", None)], "id long, doc_type string, route string, sensitivity string, full_text string")
    out = {r.id: r for r in default_registry(Scripted(lambda p: p[-4:])).pipeline("pii_detection", "classification", "citation", "summarization")(docs).collect()}
    assert out[1].pii_types == ["EMAIL_ADDRESS"] and out[1].sensitivity == "confidential" and out[2].sensitivity == "public"
    assert "governing_law" in out[1].labels and out[1].citations == ["42 U.S.C. § 1983"] and out[1].summarization_answer == "too."
    assert out[2].labels is None


def test_first_chunks(spark):
    ch = spark.createDataFrame([("d", 1, "two"), ("d", 0, "one"), ("d", 2, "three")], "doc string, seq int, chunk string")
    assert first_chunks_prompt(ch, "Q: ").first().prompt == "Q: one\n\ntwo"
    names = spark.createDataFrame([("gpt-oss:20b",), ("gpt-9",), ("claude-x",), ("llama",)], "m string")
    assert [r.k for r in names.select(provider_kind(F.col("m")).alias("k")).collect()] == ["local", "openai", "anthropic", "local"]


def test_compare_contracts(spark):
    p = [spark.createDataFrame(r, "doc string, name string, role string") for r in ([("d", "Acme  Ltd", "buyer"), ("d", "B", "seller")], [("d", "ACME Ltd", "seller"), ("d", "C", None)])]
    c = [spark.createDataFrame(r, "doc string, clause_type string") for r in ([("d", "pay"), ("d", "law")], [("d", "pay"), ("d", "pay"), ("d", "law")])]
    t = [spark.createDataFrame(r, "doc string, term_type string, amount string") for r in ([("d", "fee", "50000")], [("d", "fee", "50000.00")])]
    got = {(r.kind, r.item, r.change) for r in E.compare_contracts(tuple(p), tuple(c), tuple(t)).collect()}
    assert got == {("party", "acme ltd", "changed"), ("party", "b", "removed"), ("party", "c", "added"), ("clause", "pay", "changed")}


def test_suites(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"cases": [{"id": 1, "doc_type": "nda", "expected_fields": {"a": "x", "b": True}, "field_weights": {"a": 2}}]}))
    assert {(r.case_id, r.field, r.value, r.weight) for r in suites.read_cases(spark, str(tmp_path / "s.json")).collect()} == {("1", "a", "x", 2.0), ("1", "b", "true", 1.0)}
    (tmp_path / "r.json").write_text(json.dumps([{"id": "r", "clause_type": "pay", "forbidden_keywords": ["x"], "flag_if_missing": True}]))
    rules = suites.read_rules(spark, str(tmp_path / "r.json"))
    suites.write_rules(rules, str(tmp_path / "again.json"))
    assert suites.read_rules(spark, str(tmp_path / "again.json")).collect() == rules.collect()
    for bad in ("{", "5", '[{"clause_type": "x"}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(InvalidFile):
            suites.read_rules(spark, str(tmp_path / "bad.json"))
    with pytest.raises(InvalidFile):
        suites.read_cases(spark, str(tmp_path / "x.txt"))


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, e string")
    assert {(r.id, r.e) for r in B.update_column(df, spark.createDataFrame([(2, "b"), (9, "c")], "id long, e string"), "id", "e").collect()} == {(1, "a"), (2, "b")}
    f = spark.createDataFrame([("d", 1), ("d", None)], "doc string, seq int")
    assert V.provenance_coverage(f, "doc", F.col("seq").isNotNull()).first().coverage == 0.5
    w = spark.createDataFrame([("d", "B", 0.2), ("d", "A", 0.1), ("d", "C", 0.9)], "doc string, name string, c double")
    assert E.low_confidence_warning(w, "doc", "name", "c", 0.5).first().warning == "low confidence: A, B"
    cases = spark.createDataFrame([(1, ["x"], "nda")], "id long, tags array<string>, doc_type string")
    assert V.by_tag(cases, "x").count() == 1 and V.by_doc_type(cases, "sow").count() == 0
