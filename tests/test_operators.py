import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunking as C
from lexloom.operators import evaluation as V
from lexloom.operators import extraction as E
from lexloom.operators import privacy as P
from lexloom.operators import retrieval as R
from lexloom.operators import storage as B

# ---- chunks ---------------------------------------------------------------------------------------------------------


def random_text(seed):
    r = random.Random(seed)
    out = []
    for i in range(r.randint(1, 12)):
        if r.random() < 0.5:
            out.append(f"{i + 1}. Heading {i}")
        out.append(" ".join(r.choice(["alpha", "beta.", "gamma", "x" * r.randint(1, 40), "delta!"]) for _ in range(r.randint(0, 80))))
    return r.choice(["\n", "\n\n"]).join(out)


@pytest.mark.parametrize("seed", range(40))
def test_clause_aware_invariants(seed):
    t = random_text(seed)
    limit, overlap = random.Random(seed).choice([(20, 0), (30, 5), (64, 10)])
    spans = C.clause_aware(t, limit, overlap, seed % 3 > 0)
    # a piece cut at the last of several blanks keeps those before it
    assert all((b - a) // 4 <= limit and t[a:b].strip() and not t[a].isspace() for a, b in spans)
    covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
    assert all(t[i].isspace() for i in range(len(t)) if i not in covered)
    for a, _ in spans:
        # no chunk begins inside a word that would fit
        assert a == 0 or t[a - 1].isspace() or len(re.search(r"\S*\Z", t[:a]).group()) > 4 * limit - 1


def test_chunk_errors_and_kinds(spark):
    with pytest.raises(ValueError):
        C.clause_aware("a", 0, 0)
    assert C.semantic("one\n\ntwo\n\n" + "z" * 50, 5, 0) == ["one\n\ntwo", "z" * 20, "z" * 20, "z" * 10]
    assert C.semantic("One a. Two b. Three c.", 2, 0, "sentence") == ["One a.\n\nTwo b.", "Three c."]
    df = spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, "", 9)], "id long, t string, seq int")
    assert [(r.doc, r.chunk) for r in C.chunk_fixed(df, "id", "t", 1).collect()] == [(1, "a b"), (1, "c")]


def test_provenance(spark):
    ch = spark.createDataFrame([("d", 0, 0, 30, "The Buyer shall pay the rent ."), ("d", 1, 31, 60, "rent is due on the first day")], "doc string, seq int, char_start long, char_end long, chunk string")
    values = spark.createDataFrame([("d", "a", "rent"), ("d", "b", "due rent is on the first day"), ("d", "c", "nothing like it")], "doc string, field string, value string")
    got = {r.field: (r.seq, r.char_start, r.score) for r in C.find_provenance(values, ch).collect()}
    assert got == {"a": (0, 24, 1.0), "b": (1, 31, 1.0), "c": (None, None, None)}


# ---- privacy --------------------------------------------------------------------------------------------------------

PII = [
    ("SSN 123-45-6789.", "US_SSN", "123-45-6789"),
    ("card 4111 1111 1111 1111 ok", "CREDIT_CARD", "4111 1111 1111 1111"),
    ("mail a.b@x.org now", "EMAIL_ADDRESS", "a.b@x.org"),
    ("IBAN DE89370400440532013000", "IBAN_CODE", "DE89370400440532013000"),
    ("dob: 01/02/1990", "DATE_OF_BIRTH", "01/02/1990"),
    ("jo​hn@x.org", "EMAIL_ADDRESS", "jo​hn@x.org"),
    ("call 415-555-0132", "PHONE_NUMBER", "415-555-0132"),
    ("１２３‐45-6789", "US_SSN", "１２３‐45-6789"),
]


@pytest.mark.parametrize("text,kind,value", PII)
def test_detect(text, kind, value):
    assert (kind, value) in {(k, text[a:b]) for k, a, b, _ in P.detect_text(text)}


def test_merge_redact_restore(spark):
    text = "a@x.org wrote to b@x.org and a@x.org, <EMAIL_ADDRESS_1> 123-45-6789"
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "id long, t string")
    spans = P.merge_spans(P.detect(df, "id", "t"))
    out = {r.doc: r for r in P.redact(df, spans, "id", "t").collect()}
    assert out[1].redacted == "<EMAIL_ADDRESS_2> wrote to <EMAIL_ADDRESS_3> and <EMAIL_ADDRESS_2>, <EMAIL_ADDRESS_1> <US_SSN_1>"
    assert out[2].redacted is None and out[3].redacted == "nothing"
    back = P.redact(df, spans, "id", "t").select("doc", P.restore(F.col("redacted"), F.col("mapping")).alias("x"))
    assert {r.doc: r.x for r in back.collect()} == {1: text, 2: None, 3: "nothing"}
    masked = {r.doc: r.redacted for r in P.redact(df, spans, "id", "t", "mask").collect()}
    assert masked[1].count("***") == 4
    hashed = {r.doc: r.redacted for r in P.redact(df, spans, "id", "t", "hash", b"k").collect()}
    assert len(set(re.findall(r"HASH:([0-9a-f]{16})", hashed[1]))) == 3
    key = F.lit(b"0123456789abcdef")
    assert df.filter("id = 1").select(P.decrypt(P.encrypt(F.col("t"), key), key)).first()[0] == text


def test_merge_matches_a_loop(spark):
    r = random.Random(3)
    rows = [(d, i, (s := r.randint(0, 60)), s + r.randint(1, 12), r.choice("ABC"), r.choice([0.5, 0.8, 0.85])) for d in range(30) for i in range(12)]
    got = {}
    for x in P.merge_spans(spark.createDataFrame(rows, "doc long, ord int, start long, end long, entity string, score double")).collect():
        got.setdefault(x.doc, set()).add((x.start, x.end, x.entity, x.score))
    want = {}
    for d in range(30):
        out = []
        for _, i, s, e, k, c in sorted((x for x in rows if x[0] == d), key=lambda x: (x[2], -x[3], x[1])):
            if out and s < out[-1][1]:
                p = out[-1]
                best = (k, c) if c > p[3] else (p[2], p[3])
                out[-1] = (p[0], max(p[1], e), *best)
            else:
                out.append((s, e, k, c))
        want[d] = set(out)
    assert got == want


def test_routes(spark):
    cases = [("public", None, "any"), ("confidential", "any", "any"), ("restricted", "any", "local_only"), ("public", "blocked", "blocked"), ("secret", "any", "blocked"), ("odd", None, "blocked"), (None, None, "blocked"), ("public", "odd", "blocked")]
    df = spark.createDataFrame(cases, "s string, r string, want string").withColumn("got", P.effective_route(F.col("s"), F.col("r")))
    assert all(r.got == r.want for r in df.collect())
    assert {r.got for r in P.gate(df, "got", False).collect()} == {"any"}
    assert {r.got for r in P.gate(df, "got", True).collect()} == {"any", "local_only"}


# ---- extraction -----------------------------------------------------------------------------------------------------


def greedy(rows, ratio=0.9):
    from difflib import SequenceMatcher

    kept = []
    for o, t, x, c in rows:
        for i, (p, t2, x2, c2, _) in enumerate(kept):
            if t2 != t:
                continue
            a, b = x.strip(), x2.strip()
            if a in b:
                break
            if b in a:
                kept[i] = (p, t, x, c, o)
                break
            if SequenceMatcher(None, a, b).ratio() >= ratio:
                if len(a) > len(b) or (len(a) == len(b) and c > c2):
                    kept[i] = (p, t, x, c, o)
                break
        else:
            kept.append((o, t, x, c, o))
    return sorted((k[4], k[0]) for k in kept)


def test_clause_dedupe_matches_a_loop(spark):
    r = random.Random(8)
    base = ["the buyer shall pay the rent on the first day", "each party keeps the data secret for two years", "rent", "the seller delivers"]
    rows = []
    for o in range(120):
        x = r.choice(base)
        if r.random() < 0.5:
            k = r.randrange(len(x))
            x = x[:k] + r.choice("abc ") + x[k + 1 :]
        if r.random() < 0.2:
            x += " and more words"
        rows.append((o, r.choice(["a", "b"]), x, r.choice([0.5, 0.7])))
    df = spark.createDataFrame([("d", o, t, x, c) for o, t, x, c in rows], "doc string, ord long, clause_type string, text string, confidence double")
    got = sorted((x.ord, x.place) for x in E.dedupe_clauses(df).collect())
    assert got == greedy(rows)


def test_versions(spark):
    schema = "doc string, ord long, clause_type string, text string"
    v1 = spark.createDataFrame([("d", 0, "pay", "The rent is 100 euros a month."), ("d", 1, "pay", "Late fees apply."), ("d", 2, "term", "Two years.")], schema)
    v2 = spark.createDataFrame([("d", 0, "pay", "The rent is 200 euros a month."), ("d", 1, "law", "French law."), ("d", 2, "pay", "Something else entirely, at length.")], schema)
    got = {(r.clause_type, r.change, r.ord_v1, r.ord_v2) for r in E.compare_versions(v1, v2).collect()}
    assert got == {("pay", "modified", 0, 0), ("pay", "removed", 1, None), ("pay", "added", None, 2), ("law", "type_added", None, None), ("term", "type_removed", None, None)}
    assert 0 < E.version_similarity(v1, v2).first().similarity < 1
    assert E.version_similarity(v1, v1).first().similarity == 1.0


def test_terms_and_parties(spark):
    t = spark.createDataFrame([("d", 0, " Fee", "10", "usd", 0.5), ("d", 1, "fee ", "10 ", "USD", 0.9), ("d", 2, "fee", None, "USD", 0.1)], "doc string, ord long, term_type string, amount string, currency string, confidence double")
    assert {(r.ord, r.first_seen) for r in E.dedupe_terms(t).collect()} == {(1, 0), (2, 2)}
    p = spark.createDataFrame([("d", 0, "Acme  Ltd", 0.5), ("d", 1, "ACME Ltd", 0.5), ("d", 2, " ", 0.9), ("d", 3, None, 0.9)], "doc string, ord long, name string, confidence double")
    assert [(r.name, r.ord) for r in E.dedupe_parties(p).collect()] == [("Acme Ltd", 0)]


def test_citations(spark):
    df = spark.createDataFrame([(1, "See 42 U.S.C. § 1983 and GDPR, GDPR, Regulation (EU) 2016/679."), (2, None)], "id long, t string")
    assert [(r.citation_type, r.raw_text) for r in E.citations(df, "id", "t").orderBy("char_start").collect()] == [("statute", "42 U.S.C. § 1983"), ("regulation", "GDPR"), ("regulation", "Regulation (EU) 2016/679")]


def test_rules(spark):
    c = spark.createDataFrame([("d1", 0, "pay", "No limit at all"), ("d1", 1, "law", "French law"), ("d2", 0, "law", "any")], "doc string, ord long, clause_type string, text string")
    rules = spark.createDataFrame([("r1", 0, "pay", [], ["no LIMIT"], "", "", True), ("r2", 1, "law", ["english"], [], "", "", False), ("r3", 2, "law", [], [], r"law\b", "", False), ("r4", 3, "law", [], [], "", "^an", False)], "rule_id string, rule_ord int, clause_type string, required array<string>, forbidden array<string>, required_pattern string, forbidden_pattern string, if_missing boolean")
    got = {(r.doc, r.rule_id, r.ord) for r in E.apply_rules(c, rules, c).collect()}
    assert got == {("d1", "r1", 0), ("d1", "r2", 1), ("d2", "r2", 0), ("d2", "r3", 0), ("d2", "r4", 0), ("d2", "r1", None)}
    child = rules.filter("rule_id = 'r1'")
    assert [r.rule_id for r in E.inherit_rules(child, rules).collect()].count("r1") == 1


# ---- retrieval, evaluation, storage ---------------------------------------------------------------------------------


def test_top_k_cuts_before_dropping(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "seq long, embedding array<float>")
    assert [(r.seq, r.score) for r in R.top_k(df, [1.0, 0.0], 3).collect()] == [(0, 1.0), (4, 1.0)]
    assert [r.seq for r in R.top_k(df, [1.0, 0.0], 3, where=F.col("seq") > 0).collect()] == [4]


@pytest.mark.parametrize("query_block,row_block", [(4096, 16384), (3, 7)])
def test_top_k_batch_equals_brute_force(spark, query_block, row_block):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(60)]
    rows += [(60 + i, rows[i][1], 1) for i in range(10)]  # copies under another label
    rows += [(70, [0.0] * 6, 0), (71, None, 0), (72, [0.5, 0.5], 0), (73, [0.1, None, 0.3, 0.0, 0.0, 0.0], 0), (74, [float("nan")] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = df.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "embedding as query_embedding")

    def cosine(a, b):
        a, b = ([x or 0.0 for x in v or []] for v in (a, b))
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na > 0 and nb > 0 else 0.0

    want = {}
    for i, a, _ in rows:
        if i % 5 == 0:
            best = sorted((-round(c, 9), j) for j, b, _ in rows if (c := cosine(a, b)) > 0)[:4]
            want |= {(i, n): (j, -c) for n, (c, j) in enumerate(best, 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in R.top_k_batch(df, q, 4, order="vec_id", query_block=query_block, row_block=row_block).collect()}
    assert got == want and any(rows[i][2] != rows[j][2] for (i, _), (j, _) in got.items())
    assert R.top_k_batch(df.limit(0), q, 4, order="vec_id").collect() == [] and R.top_k_batch(df, q.limit(0), 4, order="vec_id").collect() == []


def test_sync(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "url string, text string")
    new = spark.createDataFrame([("a", "x", False), ("b", "Y", False), ("c", None, True), ("d", "n", False)], "url string, text string, failed boolean")
    assert {r.url: r.status for r in R.sync(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "kept", "d": "added"}


def test_metrics(spark):
    df = spark.createDataFrame([(["A"], ["a", "B"]), ([], []), (["A"], [])], "e array<string>, f array<string>").withColumn("m", V.entity_metrics(F.col("e"), F.col("f")))
    assert [(r.m.precision, r.m.recall) for r in df.collect()] == [(0.5, 1.0), (1.0, 1.0), (0.0, 0.0)]
    one = V.macro(df, "m").first()
    assert round(one.precision, 6) == 0.5 and round(one.recall, 6) == 0.666667
    pairs = spark.createDataFrame([(0.95, True), (0.9, False), (1.0, True), (None, True), (float("nan"), True)], "c double, ok boolean")
    bins = V.calibration_bins(pairs, "c", "ok")
    assert bins.count() == 10 and bins.filter("n > 0").first().n == 3
    assert abs(V.calibration_error(bins).first().ece - abs(2 / 3 - 0.95)) < 1e-9
    with pytest.raises(AssertionError):
        V.require(spark.createDataFrame([(0.5,)], "x double"), "x", 0.9)


def test_storage(spark):
    stored = spark.createDataFrame([(1, "a", "h1", "x"), (2, "b", None, "y")], "id long, filename string, file_hash string, extracted_text string")
    new = spark.createDataFrame([(9, "a", "h1", "other"), (9, "b", "h", "y"), (9, "c", None, None), (9, "a", "h2", "x")], "id long, filename string, file_hash string, extracted_text string")
    got = {(r.filename, r.id, r.status) for r in B.insert_status(new, stored).collect()}
    assert got == {("a", 1, "exists"), ("b", 2, "exists"), ("c", None, "inserted"), ("a", 1, "conflict")}
    j = spark.createDataFrame([('{"a": 1, "b": "x"}', '{"b": "y", "c": true}')], "o string, n string")
    merged = j.select(B.merge_metadata(F.col("o"), F.col("n"))).first()[0]
    assert json.loads(merged) == {"a": 1, "b": "y", "c": True}
    assert j.filter(B.metadata_is(F.col("o"), {"a": 1, "b": "x"})).count() == 1 and j.filter(B.metadata_is(F.col("o"), {"a": 2})).count() == 0


def test_version_comparison_against_all_pairs(spark):
    """Bands of lengths and bounds by letters leave out nothing."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    words = "the buyer shall pay a fee within thirty days of notice under this lease and not later".split()
    rows = []
    for k in range(120):
        base = " ".join(r.choice(words) for _ in range(r.choice([2, 3, 8, 20, 40])))
        for _ in range(r.randint(1, 3)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 10))):
                t[r.randrange(len(t))] = r.choice("abc ")
            rows.append((k % 3, len(rows), "ab"[k % 2], "".join(t)))
    v1, v2 = ([x for x in rows if x[1] % 3 != n] for n in (2, 1))
    want = {}
    for doc, i, kind, text in v1:
        best = max(((SequenceMatcher(None, text, t).ratio(), -j) for d, j, k, t in v2 if (d, k) == (doc, kind)), default=(0, 0))
        want[i] = (round(best[0], 9), -best[1]) if best[0] >= 0.85 else None
    schema = "doc int, ord long, clause_type string, text string"
    got = E.compare_versions(spark.createDataFrame(v1, schema), spark.createDataFrame(v2, schema)).collect()
    assert {x.ord_v1: (round(x.similarity, 9), x.ord_v2) for x in got if x.change == "modified"} == {i: m for i, m in want.items() if m and m[0] < 1}
    assert {x.ord_v1 for x in got if x.change == "removed"} == {i for i, m in want.items() if m is None}
    assert {x.ord_v2 for x in got if x.change == "added"} == {x[1] for x in v2} - {m[1] for m in want.values() if m}


@pytest.mark.parametrize("group_rows,part_texts", [(5, 3), (20, 7), (10**6, 10)])
def test_large_groups_of_clauses_in_pieces(spark, group_rows, part_texts):
    """Taking large groups apart changes nothing."""
    import random

    import pyarrow as pa

    r = random.Random(11)
    words = "fee lease rent buyer seller court notice audit books tax days month year shall pay keep hold give take".split()
    rows = []
    for k in range(260):
        if rows and r.random() < 0.5:
            t = r.choice(rows)[3]
            t = r.choice([t, t + " " + r.choice(words), t[: max(1, len(t) * 2 // 3)], t.replace("e", "a", 1), " " + t + " "])
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 6, 12, 30])))
        rows.append((r.choice([1, 1, 1, 2, None]), k, r.choice(["pay", "pay", "law", None]), t, r.choice([None, 0.5, 0.9])))
    rows.append((1, 999, "pay", None, 0.5))
    df = spark.createDataFrame(rows, "doc long, ord long, clause_type string, text string, confidence double")
    got = sorted(map(tuple, E.dedupe_clauses(df, group_rows=group_rows, part_texts=part_texts).collect()), key=lambda x: x[1])
    want = []
    for d in (1, 2, None):
        for c in ("pay", "law", None):
            mine = [dict(zip(("doc", "ord", "clause_type", "text", "confidence"), x, strict=True)) for x in rows if x[0] == d and x[2] == c and x[3] is not None]
            if mine:
                t = pa.Table.from_pylist(mine, schema=pa.schema([("doc", pa.int64()), ("ord", pa.int64()), ("clause_type", pa.string()), ("text", pa.string()), ("confidence", pa.float64())]))
                want += [tuple(x.values()) for x in E._dedupe_group(t, 0.9).to_pylist()]
    assert got == sorted(want, key=lambda x: x[1])


def test_most_alike_texts_match_a_loop():
    """No bound leaves out a pair, whatever the ratio, length or alphabet; of equals the first counts."""
    import random
    from difflib import SequenceMatcher

    import numpy as np

    from lexloom.operators.alike import best_alike

    r = random.Random(3)

    def edited(t):
        t = list(t)
        for _ in range(r.randrange(0, 2 + len(t) // 8)):
            p = r.randrange(len(t) + 1)
            t[p : p + r.randrange(2)] = r.choice(["", "a", "xyz", "é", "漢"])
        return "".join(t)

    base = ["".join(r.choice("abcdefgh iou") for _ in range(r.choice([0, 1, 8, 62, 63, 64, 126, 127, 180, 300]))) for _ in range(90)]
    x, y = [edited(t) for t in base], [edited(t) for t in base] + base[:30]
    x_group, y_group = np.array([r.randrange(3) for _ in x]), np.array([r.randrange(3) for _ in y])
    y_ord = [r.randrange(1000) for _ in y]
    y_group[:60] = x_group[:60]
    for least in (0.6, 0.85, 1.0):
        want = {}
        for i, t in enumerate(x):
            best = max(((SequenceMatcher(None, t, u).ratio(), -y_ord[k]) for k, u in enumerate(y) if y_group[k] == x_group[i]), default=(0, 0))
            want |= {i: (best[0], -best[1])} if best[0] >= least else {}
        assert {i: (s, y_ord[k]) for i, k, s in best_alike(x, x_group, y, y_group, y_ord, least)} == want and want
    assert best_alike([], np.zeros(0, int), ["a"], np.zeros(1, int), [0], 0.85) == [] == best_alike(["a"], np.zeros(1, int), [], np.zeros(0, int), [], 0.85)


def test_few_pairs_of_versions_are_aligned(monkeypatch):
    """A large group of clauses written of the same words: its millions of pairs have letters in common, but are not aligned."""
    import random

    import numpy as np

    from lexloom.operators import alike

    r = random.Random(4)
    words = "the buyer seller shall pay a fee within thirty days of notice under this lease and not later than rent audit books court term".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(25, 35))) for _ in range(2000)]
    x = [texts[k].replace("e", "i", 3) for k in range(0, 2000, 100)]
    aligned = []
    real = alike.SequenceMatcher
    monkeypatch.setattr(alike, "SequenceMatcher", lambda *a: aligned.append(1) or real(*a))
    got = alike.best_alike(x + texts[:500], np.zeros(520, int), texts[500:], np.zeros(1500, int), list(range(1500)), 0.85)
    assert {(i, j) for i, j, _ in got} >= {(k, 100 * k - 500) for k in range(5, 20)} and len(aligned) < 200


@pytest.mark.parametrize("part_texts", [3, 40, 10**6])
def test_versions_in_parts(spark, part_texts):
    """Cutting large groups into parts changes nothing."""
    r = __import__("random").Random(9)
    words = "fee lease rent buyer seller court notice audit books tax days month".split()
    rows = []
    for k in range(150):
        t = " ".join(r.choice(words) for _ in range(12)) if not rows or r.random() < 0.5 else r.choice(rows)[3].replace(r.choice(words), "x", 1)
        rows.append(("d" if k % 7 else None, k, r.choice(["a", "a", "a", "b"]), t))
    schema = "doc string, ord long, clause_type string, text string"
    v1, v2 = (spark.createDataFrame([x for x in rows if x[1] % 3 != n], schema) for n in (2, 1))
    key = lambda df: sorted(map(str, df.collect()))
    got = E.compare_versions(v1, v2, part_texts=part_texts)
    assert {x.change for x in got.collect()} >= {"modified", "added", "removed"} and key(got) == key(E.compare_versions(v1, v2))
