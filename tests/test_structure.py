import random
import re

from lexloom.operators import structure as S

TEXT = "\n".join(
    [
        "SERVICES AGREEMENT",
        'This is between A ("Buyer") and B.',
        "WHEREAS, the parties agree.",
        "1. Definitions",
        '"Confidential Information" means all data of a party that is secret.',
        "1.1 Scope",
        "See Section 2 and Exhibit A and Section 9.",
        "(a) first",
        "The “Confidential Information” is kept.",
        "2. Term",
        "This follows the laws of the State of New York without more.",
        "Exhibit A Prices",
        "Ten each.",
        "IN WITNESS WHEREOF",
        "ACME HOLDINGS LLC",
        "By: Jane Roe",
        "OTHER PARTY, PLC",
        "Name: John Doe",
    ]
)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, full_text string")


def test_sections(spark):
    rows = S.sections(frame(spark, [TEXT, None, "", "plain text only"]), "id", "full_text").orderBy("doc", "ord").collect()
    got = [(r.kind, r.number, r.title, r.level, r.parent_ord) for r in rows if r.doc == 0]
    assert got[:5] == [("caps_heading", "SERVICES AGREEMENT", "", 0, None), ("numeric_top", "1", "Definitions", 0, None), ("deep_numeric", "1.1", "Scope", 1, 2), ("paren_alpha", "(a)", "first", 1, 2), ("numeric_top", "2", "Term", 0, None)]
    assert all(TEXT[r.start_char : r.end_char].strip() for r in rows if r.doc == 0)
    assert {r.doc for r in rows} == {0}


def test_terms_references_schedules(spark):
    df = frame(spark, [TEXT])
    sec = S.sections(df, "id", "full_text")
    terms = {r.term: r.section for r in S.defined_terms(sec).collect()}
    assert terms == {"Buyer": "SERVICES AGREEMENT", "Confidential Information": "1"}
    assert {(r.term, r.section) for r in S.term_usages(sec, S.defined_terms(sec)).collect()} == {("Confidential Information", "(a)")}
    refs = {(r.source_section, r.raw_text): r.resolved for r in S.cross_references(sec, S.schedules(df, "id", "full_text")).collect()}
    assert refs[("1.1", "Section 2")] and refs[("1.1", "Exhibit A")] and not refs[("1.1", "Section 9")]
    assert [(r.label, r.title) for r in S.schedules(df, "id", "full_text").collect()] == [("Exhibit A", "Prices")]
    assert [r.recital for r in S.recitals(df, "id", "full_text").collect()] == ["the parties agree."]


def test_law_and_signatures(spark):
    df = frame(spark, [TEXT])
    assert df.select(S.governing_law(df["full_text"])).first()[0] == "New York"
    got = [(r.party_name, r.signature_line_text) for r in S.signature_blocks(df, "id", "full_text").orderBy("ord").collect()]
    assert got == [("Jane Roe", "OTHER PARTY, PLC"), ("John Doe", "")]


def test_warnings(spark):
    df = frame(spark, ["1. A\nx\n1. B\ny", "nothing here", "1. A\nx\nA. B\ny"])
    w = {(r.doc, r.code) for r in S.parse_warnings(S.sections(df, "id", "full_text"), df.selectExpr("id as doc")).collect()}
    assert w == {(0, "DUPLICATE_SECTION_NUMBER"), (1, "NO_SECTIONS_FOUND"), (2, "MIXED_NUMBERING_SCHEMES")}


def test_parents_match_a_stack(spark):
    r = random.Random(5)
    heads = ["1. A", "1.1 B", "1.1.1 C", "(a) D", "(a)(i) E", "Section 2.3 F", "ARTICLE IV", "text line", ""]
    texts = ["\n".join(r.choice(heads) for _ in range(40)) for _ in range(15)]
    rows = S.sections(frame(spark, texts), "id", "full_text").orderBy("doc", "ord").collect()
    for doc in range(15):
        stack = []
        for x in (x for x in rows if x.doc == doc):
            while stack and stack[-1][1] >= x.level:
                stack.pop()
            assert x.parent_ord == (stack[-1][0] if stack else None)
            stack.append((x.ord, x.level))


def test_parents_at_any_depth(spark):
    r = random.Random(6)
    heads = [".".join(["1"] * n) + " X" for n in (2, 3, 12, 13, 14, 15, 16, 18, 24)] + ["ARTICLE IV", "text line"]
    texts = ["1.1 A\n" + ".".join("1" * 14) + " B\n" + ".".join("1" * 15) + " C", *("\n".join(r.choice(heads) for _ in range(60)) for _ in range(10))]
    rows = S.sections(frame(spark, texts), "id", "full_text").orderBy("doc", "ord").collect()
    assert [(x.level, x.parent_ord) for x in rows if x.doc == 0] == [(1, None), (13, 1), (14, 2)]
    for doc in range(11):
        stack = []
        for x in (x for x in rows if x.doc == doc):
            while stack and stack[-1][1] >= x.level:
                stack.pop()
            assert x.parent_ord == (stack[-1][0] if stack else None)
            stack.append((x.ord, x.level))
    assert max(x.level for x in rows) == 23


def test_one_shuffle(spark):
    plan = S.sections(frame(spark, [TEXT]), "id", "full_text")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Python" not in plan
