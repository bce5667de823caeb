"""Post-processing of extracted records: deduplication, normalisation, keyword labels, citations, version comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import squeeze, strip, two_decimals
from lexloom.operators.alike import best_alike
from lexloom.plans.components import components
from lexloom.plans.runtime import blocks_for, materialize

#: Labels of the clause taxonomy with indicative words, in label order.
CLAUSE_WORDS = {
    "termination_for_cause": ["terminate for cause", "material breach", "default", "cure period"],
    "termination_for_convenience": ["terminate for convenience", "terminate without cause", "at its sole discretion"],
    "notice_period_to_terminate": ["days' notice", "days notice", "written notice of termination"],
    "payment_terms": ["payment", "invoice", "net 30", "net 60", "fee", "remit"],
    "cap_on_liability": ["liability shall not exceed", "aggregate liability", "cap on liability", "maximum liability"],
    "uncapped_liability": ["unlimited liability", "no limit on liability", "no cap"],
    "liquidated_damages": ["liquidated damages", "penalty", "pre-agreed damages"],
    "indemnification": ["indemnif", "hold harmless", "defend", "indemnitor"],
    "confidentiality": ["confidential", "non-disclosure", "proprietary information", "trade secret"],
    "governing_law": ["governed by", "governing law", "laws of the state", "applicable law"],
    "arbitration": ["arbitration", "arbitrator", "aaa rules", "jams", "binding arbitration"],
    "venue": ["venue", "jurisdiction", "courts of", "exclusive jurisdiction"],
    "ip_ownership_assignment": ["assigns all", "intellectual property rights", "work made for hire", "assigns to", "vests in"],
    "license_grant": ["license", "non-exclusive", "royalty-free", "sublicense", "right to use"],
    "non_compete": ["non-compete", "not compete", "refrain from competing", "competing business"],
    "exclusivity": ["exclusive", "exclusivity", "sole and exclusive"],
    "no_solicit_of_employees": ["no solicit", "non-solicitation", "solicit employees"],
    "no_solicit_of_customers": ["solicit customers", "solicit clients", "solicit business"],
    "anti_assignment": ["shall not assign", "may not assign", "without prior written consent", "anti-assignment"],
    "change_of_control": ["change of control", "merger", "acquisition", "change in ownership"],
    "warranty_disclaimer": ["as is", "disclaimer of warranties", "no warranty", "disclaim"],
    "insurance_requirements": ["insurance", "general liability", "workers compensation", "certificate of insurance"],
    "data_security": ["data security", "security measures", "personal data", "gdpr", "data protection"],
    "audit_rights": ["audit", "right to audit", "inspect records", "audit rights"],
    "renewal_term": ["automatically renew", "auto-renew", "renewal term", "evergreen"],
    "effective_date": ["effective date", "effective as of", "commencement date"],
    "expiration_date": ["expiration date", "expires on", "term ends", "end date"],
    "contract_modification": ["amendment", "modify", "modification", "may be amended", "addendum"],
    "revenue_profit_sharing": ["revenue share", "profit sharing", "royalty", "commission"],
    "minimum_commitment": ["minimum purchase", "minimum commitment", "minimum order", "take-or-pay"],
    "most_favored_nation": ["most favored nation", "most-favored-nation", "mfn"],
    "rofr_rofo_rofn": ["right of first refusal", "right of first offer", "rofr", "rofo"],
}
#: Broader storage types of labels; all others are 'other'.
STORAGE_TYPES = {
    "termination_for_cause": "termination",
    "termination_for_convenience": "termination",
    "notice_period_to_terminate": "termination",
    "payment_terms": "payment",
    "liquidated_damages": "payment",
    "price_restrictions": "payment",
    "revenue_profit_sharing": "payment",
    "minimum_commitment": "payment",
    "cap_on_liability": "liability",
    "uncapped_liability": "liability",
    "indemnification": "indemnification",
    "insurance_requirements": "indemnification",
    "confidentiality": "confidentiality",
    "data_security": "confidentiality",
    "governing_law": "governing_law",
    "venue": "dispute_resolution",
    "arbitration": "dispute_resolution",
    "license_grant": "intellectual_property",
    "ip_ownership_assignment": "intellectual_property",
    "joint_ip_ownership": "intellectual_property",
    "warranty_disclaimer": "warranty",
    "anti_assignment": "assignment",
    "change_of_control": "assignment",
    "contract_modification": "amendment",
    "renewal_term": "amendment",
}


def clause_labels(c: Column, words: dict[str, list[str]] = CLAUSE_WORDS) -> Column:
    """All labels one of whose words occurs in the text, in label order; empty for null."""
    low = F.lower(c)
    hits = [F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ws)), F.lit(k)) for k, ws in words.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def storage_type(label: Column) -> Column:
    pairs = [F.lit(x) for pair in STORAGE_TYPES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[label], F.lit("other"))


def keep_best(df: DataFrame, keys: list[Column], confidence: str, order: str) -> DataFrame:
    """The most confident row of each key (the first among equals); rows keep the place of their key's first one in column first_seen."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    ks = [f"_k{i}" for i in range(len(keys))]
    best = named.groupBy(*ks).agg(F.max_by(F.struct(*df.columns), F.struct(confidence, (-F.col(order)).alias("o"))).alias("r"), F.min(order).alias("first_seen"))
    return best.select("r.*", "first_seen")


def dedupe_terms(df: DataFrame) -> DataFrame:
    """Financial terms (doc, ord, term_type, amount, currency, confidence) once per type, amount and currency of a document."""
    return keep_best(df, [F.col("doc"), F.lower(strip(F.col("term_type"))), F.coalesce(strip(F.col("amount").cast("string")), F.lit("")), F.upper(F.col("currency"))], "confidence", "ord")


def dedupe_parties(df: DataFrame, doc: str = "doc", name: str = "name", confidence: str = "confidence", order: str = "ord") -> DataFrame:
    """Parties of a document once per name (case and white space ignored), the most confident mention; nameless ones are dropped."""
    named = df.withColumn(name, squeeze(F.col(name))).filter(F.length(name) > 0)
    return keep_best(named, [F.col(doc), F.lower(name)], confidence, order)


def _letters(text: str) -> np.ndarray:
    """Counts of a text's characters in 64 classes."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, minlength=64).astype(np.int32)


def _dedupe_group(t: pa.Table, ratio: float) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["ord"])
    kept: list[dict] = []
    letters = np.zeros((len(rows), 64), np.int32)
    sizes = np.zeros(len(rows), np.int64)
    sure = lambda x: -1.0 if x["confidence"] is None else x["confidence"]

    def keep(i: int, r: dict, place: int, own: np.ndarray, size: int) -> None:
        row = r | {"place": place}
        kept[i : i + 1] = [row]
        letters[i], sizes[i] = own, size

    for r in rows:
        a = r["text"].strip()
        own, size, n = _letters(a), len(a), len(kept)
        # common letters bound what the texts can have in common: only these may contain each other or reach the ratio
        common = np.minimum(letters[:n], own).sum(1)
        maybe = np.flatnonzero((common >= np.minimum(sizes[:n], size)) | (2 * common >= ratio * (sizes[:n] + size)))
        for i in map(int, maybe):
            b = kept[i]["text"].strip()
            if a in b:
                break
            if b in a:
                keep(i, r, kept[i]["place"], own, size)
                break
            if 2 * common[i] >= ratio * (size + sizes[i]) and SequenceMatcher(None, a, b).ratio() >= ratio:
                if (size, sure(r)) > (int(sizes[i]), sure(kept[i])):
                    keep(i, r, kept[i]["place"], own, size)
                break
        else:
            keep(n, r, r["ord"], own, size)
    return pa.Table.from_pylist(kept, schema=t.schema.append(pa.field("place", pa.int64())))


#: Clauses of one document and type that one task goes through in order; larger groups are taken apart first, by parts of PART_TEXTS texts.
GROUP_ROWS, PART_TEXTS = 3_000, 2_000


def _touching(ratio: float):
    """Pairs of nodes (a, b) of two parts of a group whose texts contain each other or reach the ratio."""

    def run(t: pa.Table) -> pa.Table:
        left, right = t["part_a"][0].as_py(), t["part_b"][0].as_py()
        part, node, texts = t["part"].to_numpy(), t["node"].to_numpy(), t["text"].to_pylist()
        letters = np.stack([_letters(x) for x in texts])
        sizes = np.array([len(x) for x in texts])
        rows, others = np.flatnonzero(part == left), np.flatnonzero(part == right)
        a, b = [], []
        for n, i in enumerate(rows):
            js = others if left != right else rows[n + 1 :]
            common = np.minimum(letters[js], letters[i]).sum(1)
            near = 2 * common >= ratio * (sizes[js] + sizes[i])
            maybe = near | (common >= np.minimum(sizes[js], sizes[i]))
            for j, close in zip(js[maybe], near[maybe], strict=True):
                x, y = texts[i], texts[j]
                if x in y or y in x or (close and SequenceMatcher(None, x, y).ratio() >= ratio) or (close and SequenceMatcher(None, y, x).ratio() >= ratio):
                    a.append(node[i])
                    b.append(node[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _apart(src: DataFrame, large: DataFrame, ratio: float, part_texts: int) -> DataFrame:
    """Rows of large groups with column piece: rows of different pieces have nothing in common, directly or through others. Texts of a
    group meet in parts, two at a time, so no task gets more than two parts; only pairs that touch leave it."""
    keys = ["doc", "clause_type"]
    rows = src.join(F.broadcast(large), keys).withColumn("bare", strip(F.col("text"))).withColumn("node", F.xxhash64(*keys, "bare"))
    rows = materialize(rows.drop("rows"), "large")
    nodes = rows.groupBy("node", *keys).agg(F.min("bare").alias("text"))
    parts = F.ceil(F.col("rows") / part_texts).cast("int")
    cut = nodes.join(F.broadcast(large), keys).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = cut.withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")}).groupBy(*keys, "part_a", "part_b")
    edges = materialize(met.applyInArrow(_touching(ratio), "a long, b long"), "touching")
    return rows.join(components(edges), "node", "left").withColumn("piece", F.coalesce("component", "node")).drop("component", "bare", "node")


def dedupe_clauses(df: DataFrame, ratio: float = 0.90, group_rows: int = GROUP_ROWS, part_texts: int = PART_TEXTS) -> DataFrame:
    """Clauses (doc, ord, clause_type, text, confidence) without near-repeats of their type: contained ones go, a containing one takes
    the place of the contained, of two similar ones the longer (then more confident, null least) stays.

    Greedy in order, so a (document, type) is gone through by one task. A group of more than ``group_rows`` is first taken apart into
    pieces that have nothing to do with each other, which changes nothing but where the work is done."""
    src = df.select("doc", F.col("ord").cast("long"), "clause_type", "text", F.col("confidence").cast("double")).filter("text is not null")
    keys = ["doc", "clause_type"]
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes) + ", place long"
    greedy = lambda t: _dedupe_group(t, ratio)
    # null documents and types are groups of their own, as everywhere
    src = src.withColumns({"_d": F.coalesce(F.col("doc").cast("string"), F.lit("\x00")), "_t": F.coalesce("clause_type", F.lit("\x00"))})
    # at most rows / group_rows groups
    large = materialize(src.groupBy("_d", "_t").agg(F.count("*").alias("rows")).filter(F.col("rows") > group_rows), "groups")
    plain = src.join(F.broadcast(large.drop("rows")), ["_d", "_t"], "left_anti").drop("_d", "_t").groupBy(*keys).applyInArrow(greedy, schema)
    if large.isEmpty():
        return plain
    named = src.select(F.col("_d").alias("doc"), "ord", F.col("_t").alias("clause_type"), "text", "confidence", F.struct("doc", "clause_type").alias("own"))
    apart = materialize(_apart(named, large.select(F.col("_d").alias("doc"), F.col("_t").alias("clause_type"), "rows"), ratio, part_texts), "apart")
    many = apart.groupBy("piece").agg(F.count("*").alias("n"))
    placed = apart.join(many, "piece").select("own.doc", "ord", "own.clause_type", "text", "confidence", "piece", "n")
    alone = placed.filter("n = 1").select("doc", "ord", "clause_type", "text", "confidence", F.col("ord").alias("place"))
    pieces = placed.filter("n > 1").groupBy("piece").applyInArrow(lambda t: greedy(t.drop_columns(["piece", "n"])), schema)
    return plain.unionByName(alone).unionByName(pieces)


#: Formats of legal citations in order of precedence.
CITATIONS = [
    ("case", r"[A-Z][A-Za-z\s\.,]+v\.\s+[A-Z][A-Za-z\s\.,]+,\s+\d+\s+[A-Z][A-Za-z\.]+\s+\d+"),
    ("statute", r"\d+\s+U\.S\.C\.?\s+§+\s+[\d\w\-\.]+"),
    ("regulation", r"\d+\s+C\.F\.R\.?\s+§+\s+[\d\w\-\.]+"),
    ("regulation", r"(?:Regulation|Directive)\s+\([A-Z]+\)\s+\d{4}/\d+"),
    ("regulation", r"GDPR|CCPA|HIPAA|FERPA|COPPA"),
]

#: What a text has if any of the formats matches.
CITATION_MARKS = r"v\.|U\.S\.C|C\.F\.R|Regulation|Directive|GDPR|CCPA|HIPAA|FERPA|COPPA"


_CITATIONS = [(k, re.compile(p)) for k, p in CITATIONS]


def text_citations(text: str) -> list[tuple[str, str, int, int]]:
    """(wording, type, start, end) of one text's citations in order, each wording once."""
    seen: dict[str, tuple[str, str, int, int]] = {}
    for kind, p in _CITATIONS:
        for m in p.finditer(text):
            seen.setdefault(m.group().strip(), (m.group().strip(), kind, m.start(), m.end()))
    return sorted(seen.values(), key=lambda c: c[2])


def citations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, raw_text, citation_type, char_start, char_end): each wording once, by the first format that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows += [(i, *c) for c in text_citations(t.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc", "raw_text", "citation_type", "char_start", "char_end"])

    # only texts with a mark of some format leave the JVM
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("t")).filter(F.col("t").rlike(CITATION_MARKS))
    return src.mapInArrow(run, f"doc {dict(df.dtypes)[id_col]}, raw_text string, citation_type string, char_start long, char_end long")


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts (order matters, popular characters of long texts are skipped)."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


#: Clauses of one document, type and version that one task compares; more are cut into parts that meet two at a time.
VERSION_TEXTS = 5_000


def _most_alike(least: float):
    """For clauses of version 1 the most alike ones of version 2 in a cell (of whole documents and types, or of two parts of a large one)."""

    def run(t1: pa.Table, t2: pa.Table) -> pa.Table:
        ids: dict[tuple, int] = {}
        group = lambda t: np.array([ids.setdefault(k, len(ids)) for k in zip(t["doc"].to_pylist(), t["clause_type"].to_pylist(), strict=True)], np.int64)
        found = best_alike(t1["t1"].to_pylist(), group(t1), t2["t2"].to_pylist(), group(t2), t2["ord_v2"].to_pylist(), least)
        rows, others, ratios = zip(*found, strict=True) if found else ((), (), ())
        own = t1.select(["doc", "clause_type", "ord_v1"]).take(pa.array(rows, pa.int64()))
        return own.append_column("ord_v2", t2["ord_v2"].take(pa.array(others, pa.int64()))).append_column("similarity", pa.array(ratios, pa.float64()))

    return run


def _alike(a: DataFrame, b: DataFrame, least: float, part_texts: int) -> DataFrame:
    """(doc, clause_type, ord_v1, ord_v2, similarity) of the most alike clauses of ``a`` (ord_v1, t1) and ``b`` (ord_v2, t2). Small groups
    share a cell; the parts of large ones meet two at a time, so a clause may come out once for each part it met."""
    keys = ["doc", "clause_type"]
    sides = a.select(*keys, F.lit(1).alias("n1"), F.lit(0).alias("n2")).unionByName(b.select(*keys, F.lit(0).alias("n1"), F.lit(1).alias("n2")))
    sizes = materialize(sides.groupBy(*keys).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")), "sizes")
    parts = [F.ceil(F.col(n) / part_texts).cast("int").alias(p) for n, p in (("n1", "p1"), ("n2", "p2"))]
    small = F.greatest("n1", "n2") <= part_texts
    totals = sizes.agg(F.sum(F.when(small, F.col("n1") + F.col("n2"))), F.sum(F.when(~small, F.ceil(F.col("n1") / part_texts) * F.ceil(F.col("n2") / part_texts)))).first()
    shared = blocks_for(totals[0] or 0, part_texts)
    # at most rows / part_texts groups
    large = F.broadcast(materialize(sizes.filter(~small).select(*keys, *parts), "large"))
    tasks = min(10_000, shared + (totals[1] or 0))

    def cells(side: DataFrame, order: str, own: str, other: str) -> DataFrame:
        cut = side.dropna(subset=keys).join(large, keys, "left")
        cut = cut.withColumn(f"_{own}", F.pmod(F.xxhash64(order), F.coalesce(own, F.lit(1))).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        cell = F.when(F.col("p1").isNull(), F.pmod(F.xxhash64(*keys), F.lit(shared))).otherwise(F.xxhash64(*keys, "_p1", "_p2"))
        return cut.withColumn("cell", cell).drop("p1", "p2", "_p1", "_p2").repartition(tasks, "cell")

    types = dict(a.dtypes) | dict(b.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, "ord_v1", "ord_v2")) + ", similarity double"
    met = cells(a, "ord_v1", "p1", "p2").groupBy("cell").cogroup(cells(b, "ord_v2", "p2", "p1").groupBy("cell"))
    return met.applyInArrow(_most_alike(least), schema)


def compare_versions(v1: DataFrame, v2: DataFrame, threshold: float = 0.85, part_texts: int = VERSION_TEXTS) -> DataFrame:
    """Changes between two versions' clauses (doc, ord, clause_type, text): (doc, clause_type, change, ord_v1, ord_v2, similarity).

    Each clause of version 1 finds its most alike clause of its type in version 2 (the first among equals). From the threshold on
    they are one clause, modified if not equal; below, the clause was removed. Clauses of version 2 that nothing found were added.
    Equal texts are matched by a join on the text's hash. Of the others those of a document and type are compared within a task, or part
    by part in several where they are more than ``part_texts``, and only pairs whose common subsequence is long enough are aligned (see
    ``alike``). None of this leaves out a pair that reaches the threshold."""
    a = materialize(v1.select("doc", "clause_type", F.col("ord").alias("ord_v1"), F.col("text").alias("t1")), "v1")
    b = materialize(v2.select("doc", "clause_type", F.col("ord").alias("ord_v2"), F.col("text").alias("t2")), "v2")
    keys = ["doc", "clause_type"]
    # of equal texts in version 2 the first is enough
    h = lambda c: F.unhex(F.sha2(c, 256)).alias("h")
    first = b.groupBy(*keys, h("t2")).agg(F.min("ord_v2").alias("ord_v2"))
    same = a.select(*keys, "ord_v1", h("t1")).join(first, [*keys, "h"]).select(*keys, "ord_v1", "ord_v2", F.lit(1.0).alias("similarity"))
    rest = a.join(same.select(*keys, "ord_v1"), [*keys, "ord_v1"], "left_anti").filter("t1 is not null")
    others = b.filter("t2 is not null")
    pairs = _alike(rest, others, threshold, part_texts)
    best = pairs.groupBy(*keys, "ord_v1").agg(F.max_by(F.struct("ord_v2", "similarity"), F.struct("similarity", (-F.col("ord_v2")).alias("o"))).alias("m")).select(*keys, "ord_v1", "m.*")
    matched = materialize(same.unionByName(best), "matched")
    types2 = b.select(*keys).distinct()
    types1 = a.select(*keys).distinct()
    none = F.lit(None).cast("double")
    modified = matched.filter("similarity < 1").select(*keys, F.lit("modified").alias("change"), "ord_v1", "ord_v2", "similarity")
    gone = a.join(matched.select(*keys, "ord_v1"), [*keys, "ord_v1"], "left_anti")
    removed = gone.join(types2, keys, "left_semi").select(*keys, F.lit("removed").alias("change"), "ord_v1", F.lit(None).cast("long").alias("ord_v2"), none.alias("similarity"))
    new = b.join(matched.select(*keys, "ord_v2").distinct(), [*keys, "ord_v2"], "left_anti")
    added = new.join(types1, keys, "left_semi").select(*keys, F.lit("added").alias("change"), F.lit(None).cast("long").alias("ord_v1"), "ord_v2", none.alias("similarity"))
    only = lambda x, y, word: x.join(y, keys, "left_anti").select(*keys, F.lit(word).alias("change"), F.lit(None).cast("long").alias("ord_v1"), F.lit(None).cast("long").alias("ord_v2"), none.alias("similarity"))
    parts = [modified, removed, added, only(types2, types1, "type_added"), only(types1, types2, "type_removed")]
    return reduce(DataFrame.unionByName, [p.select(*keys, "change", F.col("ord_v1").cast("long").alias("ord_v1"), F.col("ord_v2").cast("long").alias("ord_v2"), "similarity") for p in parts])


def version_similarity(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """(doc, similarity): types in both versions weighted by the ratio of their joined texts, over all types."""
    joined = lambda d, n: d.groupBy("doc", "clause_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias(n))
    j = joined(v1, "t1").join(joined(v2, "t2"), ["doc", "clause_type"], "full")
    return j.withColumn("r", F.when(F.col("t1").isNull() | F.col("t2").isNull(), 0.0).otherwise(text_ratio("t1", "t2"))).groupBy("doc").agg((F.sum("r") / F.count("*")).alias("similarity"))


def overall_similarity(differences: Column, clause_similarity: Column) -> Column:
    score = 1.0 / (1 + differences)
    return F.bround(F.when(clause_similarity > 0, (score + clause_similarity) / 2).otherwise(score), 3)


# ---- rules, obligations, routing ------------------------------------------------------------------------------------


def rule_hit(text: Column, required: Column, forbidden: Column, required_pattern: Column, forbidden_pattern: Column) -> Column:
    """A forbidden word occurs, all required words are absent, a required pattern is absent or a forbidden one present."""
    low = F.lower(text)
    has = lambda words: F.exists(words, lambda w: F.contains(low, F.lower(w)))
    flag = lambda p: F.concat(F.lit("(?iU)"), p)
    return (
        F.coalesce(has(forbidden), F.lit(False))
        | F.coalesce((F.size(required) > 0) & ~has(required), F.lit(False))
        | F.coalesce((F.length(required_pattern) > 0) & ~F.regexp_like(text, flag(required_pattern)), F.lit(False))
        | F.coalesce((F.length(forbidden_pattern) > 0) & F.regexp_like(text, flag(forbidden_pattern)), F.lit(False))
    )


#: Most rules of one call: they are held by every task as one literal.
MOST_RULES = 10_000


def apply_rules(clauses: DataFrame, rules: DataFrame, docs: DataFrame) -> DataFrame:
    """Flags of given rules (rule_id, rule_ord, clause_type, required, forbidden, required_pattern, forbidden_pattern, if_missing) over
    clauses (doc, ord, clause_type, text): one per clause a rule hits, one per document that lacks the clause type of a rule with
    if_missing. Rules are a parameter of at most MOST_RULES rows (more raise ValueError), so they are broadcast. Types present are gathered
    per document before the shuffle, and each document lists for itself what it lacks: no document meets another's rows."""
    wanted = rules.filter("if_missing").select("clause_type", "rule_id", "rule_ord")
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hits = clauses.join(F.broadcast(rules), "clause_type").filter(rule_hit(F.col("text"), F.col("required"), F.col("forbidden"), F.col("required_pattern"), F.col("forbidden_pattern")))
    flagged = hits.select("doc", "rule_id", "rule_ord", F.col("ord").cast("long").alias("ord"), F.substring("text", 1, 500).alias("clause_text"))
    asked = wanted.collect()
    if not asked:
        return flagged
    types = sorted({r["clause_type"] for r in asked if r["clause_type"] is not None})
    # sets of at most as many types as the rules name
    kinds = dict(wanted.dtypes)
    present = clauses.filter(F.col("clause_type").isin(types)).groupBy("doc").agg(F.collect_set("clause_type").alias("present"))
    listed = F.array(*(F.struct(F.lit(r["rule_id"]).cast(kinds["rule_id"]).alias("rule_id"), F.lit(r["rule_ord"]).cast(kinds["rule_ord"]).alias("rule_ord"), F.lit(r["clause_type"]).alias("clause_type")) for r in asked))
    lacking = F.filter(listed, lambda r: F.coalesce(~F.array_contains(F.coalesce("present", F.array().cast("array<string>")), r["clause_type"]), F.lit(True)))
    absent = docs.select("doc").distinct().join(present, "doc", "left").select("doc", F.explode(lacking).alias("r"))
    return flagged.unionByName(absent.select("doc", "r.rule_id", "r.rule_ord", F.lit(None).cast("long").alias("ord"), F.lit("").alias("clause_text")))


def inherit_rules(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Own rules, then the parent's whose id is not overridden."""
    return own.unionByName(parent.join(own.select("rule_id"), "rule_id", "left_anti").select(*own.columns))


def route_fields(fields: DataFrame, accept: float = 0.85, reject: float = 0.5, overrides: DataFrame | None = None) -> DataFrame:
    """Fields (field, confidence, ...) with decision and reason; overrides (field, accept, reject) set thresholds per field. A missing
    confidence counts as 0."""
    if not 0 <= reject < accept <= 1:
        raise ValueError("0 <= reject < accept <= 1")
    f = fields.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    if overrides is not None:
        f = f.join(overrides.select("field", F.col("accept").alias("_a"), F.col("reject").alias("_r")), "field", "left")
    a, r = (F.coalesce(F.col("_a"), F.lit(accept)), F.coalesce(F.col("_r"), F.lit(reject))) if overrides is not None else (F.lit(accept), F.lit(reject))
    c = F.col("confidence")
    decision = F.when(c >= a, "auto_accept").when(c >= r, "human_review").otherwise("auto_reject")
    reason = (
        F.when(c >= a, F.format_string("confidence %s ≥ accept threshold %s", two_decimals(c), two_decimals(a)))
        .when(c >= r, F.format_string("confidence %s in review band [%s, %s)", two_decimals(c), two_decimals(r), two_decimals(a)))
        .otherwise(F.format_string("confidence %s < reject threshold %s", two_decimals(c), two_decimals(r)))
    )
    return f.withColumns({"decision": decision, "reason": reason}).drop("_a", "_r")


def routing_summary(routed: DataFrame, by: str) -> DataFrame:
    n = F.count("*")
    return routed.groupBy(by).agg(n.alias("fields"), F.count_if(F.col("decision") == "auto_accept").alias("accepted"), F.count_if(F.col("decision") == "human_review").alias("review"), F.count_if(F.col("decision") == "auto_reject").alias("rejected")).withColumns(
        {"acceptance_rate": F.col("accepted") / F.col("fields"), "fully_accepted": F.col("accepted") == F.col("fields")}
    )


def upcoming(obligations: DataFrame, date_col: str, reference, days: int) -> DataFrame:
    """Obligations due within the days after the reference, both ends included."""
    ref = F.lit(reference).cast("date")
    return obligations.filter(F.col(date_col).between(ref, F.date_add(ref, days)))


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


# ---- contracts ------------------------------------------------------------------------------------------------------


def compare_contracts(parties: tuple[DataFrame, DataFrame], clauses: tuple[DataFrame, DataFrame], terms: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(doc, kind, item, change) between two versions: parties (doc, name, role) only in one or with another role, clause types (doc,
    clause_type) only in one or in other numbers, financial terms (doc, term_type, amount) whose amounts differ as numbers."""
    one = lambda d, *c: d.select("doc", *c).filter(F.col(c[0]).isNotNull())
    p1, p2 = (one(p, "name", "role").groupBy("doc", F.lower(squeeze(F.col("name"))).alias("item")).agg(F.min("role").alias("v")) for p in parties)
    c1, c2 = (one(c, "clause_type").groupBy("doc", F.col("clause_type").alias("item")).agg(F.count("*").cast("string").alias("v")) for c in clauses)
    amounts = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("amount").cast("decimal(38,8)"))), lambda x: x.cast("string")), ",")
    t1, t2 = (one(t, "term_type", "amount").groupBy("doc", F.col("term_type").alias("item")).agg(amounts.alias("v")) for t in terms)

    def differ(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
        j = a.withColumn("l", F.lit(True)).withColumnRenamed("v", "v1").join(b.withColumn("r", F.lit(True)).withColumnRenamed("v", "v2"), ["doc", "item"], "full")
        change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("v1").eqNullSafe(F.col("v2")), "changed")
        return j.select("doc", F.lit(kind).alias("kind"), "item", change.alias("change")).filter("change is not null")

    return differ(p1, p2, "party").unionByName(differ(c1, c2, "clause")).unionByName(differ(t1, t2, "term"))


def duration_days(effective: Column, expiration: Column) -> Column:
    return F.date_diff(expiration, effective)


def low_confidence_warning(df: DataFrame, doc: str, name: str, confidence: str, least: float) -> DataFrame:
    """(doc, warning): names of the items of a document below a confidence, in order."""
    low = df.filter(F.col(confidence) < least).groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    return low.select(doc, F.concat(F.lit("low confidence: "), "names").alias("warning"))


# ---- summaries ------------------------------------------------------------------------------------------------------


def diff_summary(changes: DataFrame) -> DataFrame:
    """(doc, summary) of ``compare_versions``: how many clause types were added and removed and clauses changed, then each by name. The wording is a
    fixed value."""
    order = F.array_sort(F.collect_list(F.when(F.col("change").isin("modified", "removed", "added"), F.struct("clause_type", F.coalesce("ord_v1", F.lit(2**62)).alias("a"), F.coalesce("ord_v2", F.lit(2**62)).alias("b"), "change", "similarity"))))
    types = lambda w: F.array_sort(F.collect_set(F.when(F.col("change") == w, F.col("clause_type"))))
    g = changes.groupBy("doc").agg(types("type_added").alias("more"), types("type_removed").alias("less"), order.alias("each"))
    item = lambda c: F.concat(F.lit("  ~ "), c["clause_type"], F.lit(" ("), F.when(c["change"] == "modified", F.concat(F.lit("similarity="), two_decimals(c["similarity"]))).otherwise(c["change"]), F.lit(")"))
    listed = lambda c, mark: F.when(F.size(c) > 0, F.concat(F.lit(f"  {mark} "), F.array_join(c, ", ")))
    lines = F.array(
        F.concat(F.lit("Added:    "), F.size("more"), F.lit(" clause type(s)")),
        F.concat(F.lit("Removed:  "), F.size("less"), F.lit(" clause type(s)")),
        F.concat(F.lit("Modified: "), F.size("each"), F.lit(" clause(s)")),
        listed("more", "+"),
        listed("less", "-"),
    )
    return g.select("doc", F.array_join(F.array_compact(F.concat(lines, F.transform("each", item))), "\n").alias("summary"))


def timeline_entries(obligations: DataFrame, columns: list[str]) -> DataFrame:
    """Obligations with empty texts for missing ones."""
    return obligations.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def unresolved(obligations: DataFrame, date_col: str) -> DataFrame:
    return obligations.filter(F.col(date_col).isNull())


def all_resolved(obligations: DataFrame, date_col: str, by: str) -> DataFrame:
    """(by, all_resolved): whether all deadlines of a document have a date."""
    return obligations.groupBy(by).agg(F.bool_and(F.col(date_col).isNotNull()).alias("all_resolved"))


def high_confidence(clauses: DataFrame, confidence: str = "confidence", least: float = 0.8) -> DataFrame:
    return clauses.filter(F.col(confidence) >= least)


def of_severity(risks: DataFrame, severity: str = "critical") -> DataFrame:
    return risks.filter(F.lower("severity") == severity)
