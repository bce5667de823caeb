"""What the optimiser must make of the queries."""

import re

import pytest

from lexloom import queries as core
from lexloom.operators import retrieval as R
from lexloom.session import table

NATIVE = "doc_tokens doc_hashes jurisdictions privacy_routes strictest_routes spans_merged section_tree section_levels cross_references defined_terms governing_laws clause_labels storage_types party_dedupe deadlines built_dates built_amounts confidence_routing routing_by_document rule_flags calibration rag_rescore source_conflicts insert_or_get latest_stages clauses_view erased_log full_text_search events_per_hour".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_stay_in_the_jvm(spark, sf_dir, name):
    p = plan(core.queries()[name](spark, sf_dir))
    assert not re.search(r"EvalPython|MapInArrow|MapInPandas|FlatMapGroups|CartesianProduct", p)


@pytest.mark.parametrize("name,columns", [("privacy_routes", 2), ("section_tree", 2), ("failed_documents", 2), ("full_text_search", 2)])
def test_scans_read_only_what_is_used(spark, sf_dir, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$|,|\s)", plan(core.queries()[name](spark, sf_dir)))
    assert schemas and all(len(re.findall(r"\w+:", s)) <= columns for s in schemas)


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(status,failed\)", plan(core.queries()["failed_documents"](spark, sf_dir)))


def test_filter_stays_above_the_cut(spark, sf_dir):
    """Scores of 0 or less are dropped after the top k, never before."""
    p = plan(R.top_k(table(spark, sf_dir, "embeddings"), [1.0] * 64, 5, order="vec_id"))
    assert p.index("Filter") < p.index("TakeOrderedAndProject")


def _five(spark):
    from lexloom.plans.builtin import model_task
    from lexloom.plans.tasks import Pipeline, Scripted

    return Pipeline([model_task(f"t{i}", "Say: ", Scripted(lambda p: p[:9]), ("contract",) if i % 2 else ()) for i in range(5)])


def test_a_pipeline_scans_once_and_calls_once(spark, sf_dir):
    docs = table(spark, sf_dir, "legal_docs").select("id", "doc_type", "full_text")
    p = plan(_five(spark)(docs))
    # a plan under AQE is printed once before it runs
    assert p.count("MapInArrow") == 5 and p.count("FileScan") == 1


def test_tasks_leave_other_rows_alone(spark):
    from lexloom.plans.builtin import default_registry
    from lexloom.plans.tasks import Pipeline, Scripted

    rows = [
        (1, "contract", "any", "public", "Mail a@b.org. The invoice cites 12 U.S.C. § 34.", "30 days"),
        (2, "letter", "any", "public", "governed by nothing", None),
        (3, "contract", "blocked", "secret", None, "soon"),
    ]
    docs = spark.createDataFrame(rows, "id long, doc_type string, route string, sensitivity string, full_text string, deadline string").selectExpr("*", "date'2024-01-31' AS effective_date", "array(named_struct('severity', 'low'), named_struct('severity', 'high')) AS risks")
    r = default_registry(Scripted(lambda p: "ok"), lambda t: [w for w in t.split() if w.istitle()])
    assert {"ner", "comparison", "risk_analysis", "timeline", "contract_extraction"} <= set(r._tasks)
    tasks = ["pii_detection", "classification", "citation", "ner", "timeline", "summarization"]
    pipe = r.pipeline(*tasks)
    got = {x.id: x for x in pipe(docs, measure=True).collect()}
    assert set(pipe.timings) == set(tasks) and all(s > 0 for s in pipe.timings.values())
    assert got[1].pii_types == ["EMAIL_ADDRESS"] and got[1].sensitivity == "confidential" and got[1].citations == ["12 U.S.C. § 34."] and "payment_terms" in got[1].labels
    assert got[2].labels is None and got[2].citations is None and got[2].pii_types == [] and got[2].summarization_answer == "ok"
    assert str(got[1].due_date) == "2024-03-01" and got[1].resolved and not got[3].resolved
    assert got[3].summarization_answer is None and got[3].task_errors == ["summarization: routing forbids this provider"] and got[1].task_errors == []
    assert got[1].entities == ["Mail", "The", "U.S.C."]
    from lexloom.plans.builtin import risk_task

    kept = Pipeline([risk_task(("low", "medium", "high"), "medium")])(docs).collect()
    assert [[s.severity for s in x.risks] for x in kept] == [["high"]] * 3


def test_templates_have_versions():
    from lexloom.plans.builtin import TEMPLATES, register_template, template

    register_template("summarization", 2, "Sum up:\n")
    try:
        assert template("summarization") == "Sum up:\n" and template("summarization", 1).startswith("Summarise")
        with pytest.raises(KeyError):
            register_template("summarization", 2, "x")
        with pytest.raises(KeyError):
            template("summarization", 9)
    finally:
        del TEMPLATES[("summarization", 2)]
