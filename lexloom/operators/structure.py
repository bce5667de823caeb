"""Structural parse of texts: lines, headings, section tree, terms, references, schedules, recitals, signatures.

All of it is relational: a text becomes its lines once, headings are ordered conditions on a line, a section's body is a running
count of headings, and its parent is the last heading of a lower level (one window per level). Every window is partitioned
by the document, so the whole parse shuffles the lines once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import strip
from lexloom.plans.runtime import materialize

#: Heading formats in order of precedence, as (kind, pattern); the first that matches a line wins.
HEADINGS = [
    ("article", r"(?iU)^(Article\s+(?:[IVX]+|\d+)\.?)\s*(.*)?$"),
    ("named_numeric", r"(?iU)^(Section\s+\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)\s*(.*)?$"),
    ("deep_numeric", r"(?iU)^(\d+(?:\.\d+)+(?:\([a-z0-9]+\))*\.?)\s+(.*)?$"),
    ("numeric_top", r"(?U)^(\d+\.)\s+(.+)$"),
    ("paren_alpha", r"(?iU)^(\([a-z]\)(?:\([ivx]+\))?)\s*(.*)?$"),
    ("alpha_top", r"(?U)^([A-Z]\.)\s+(.+)$"),
    ("caps_heading", r"(?U)^([A-Z][A-Z\s\-]{2,60})()$"),
]
MAX_LEVEL = 12
#: Beginnings of schedules and recitals, phrases of governing law, references, definitions and signatures.
_SCHEDULE = r"(?iU)^(Schedule|Exhibit|Annex|Attachment)\s+([A-Z0-9]+\.?)\s*(.*)?$"
_RECITAL = r"(?iU)^WHEREAS[,;:]?\s+(.+)$"
_PLACE = r"([A-Z][a-zA-Z]+(?:\s+(?:(?:and|of)\s+)?[A-Z][a-zA-Z]+)*)"
_LAW = (
    r"(?U)(?i:laws?\s+of\s+(?:the\s+)?(?:(?:State|Commonwealth)\s+of\s+)?)" + _PLACE,
    r"(?U)(?i:(?:governed|construed)\s+(?:by|under|in\s+accordance\s+with)\s+)" + _PLACE + r"\s+(?i:laws?)\b",
)
_REFERENCE = r"(?iU)(?:\b(?:Section|Article|Clause|Para(?:graph)?|Exhibit|Schedule|Annex)\s+|§\s*)(?:(?-i:[IVX]+|[A-Z])\b|\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"
_INLINE_TERM = r'(?iU)["“]([^"“”]{2,80})["”]\s+(?:means?|shall\s+means?|refers?\s+to|is\s+defined\s+as)\s+(.{10,})'
_SIGNED = r"(?iU)IN\s+WITNESS\s+WHEREOF|AGREED\s+AND\s+ACCEPTED|EXECUTED\s+(?:as\s+of|on|by)|SIGNED\s+(?:by|on\s+behalf\s+of)"
_COMPANY_LINE = r"(?U)^([A-Z][A-Z\s,\.]+(?:LLC|Inc|Corp|Ltd|LP|LLP|PLC)\.?)$"
_SIGNER_LINE = r"(?iU)^(?:By|Name|Title|Signature):\s*(.+)$"


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ln, line, s, at): every line with its text, its stripped text and its offset; null texts have none."""
    src = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body")).filter("body is not null")
    split = src.select("doc", F.posexplode(F.split("body", "\n", -1)).alias("ln", "line"))
    before = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("s", strip(F.col("line"))).withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def reference_key(c: Column) -> Column:
    """'Section 4.2(b)' as '4.2(b)'."""
    return strip(F.regexp_replace(strip(c), r"(?iU)^(section|article|clause|para(?:graph)?|exhibit|schedule|annex|§)\s*", ""))


def headed_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with kind, number, title and level where they are headings, and the running number of the heading above."""
    l = lines(df, id_col, text_col)
    s = F.col("s")
    ok = F.length(s) >= 2
    kind, number, title = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in reversed(HEADINGS):
        hit = s.rlike(p)
        kind, number, title = F.when(hit, name).otherwise(kind), F.when(hit, F.regexp_extract(s, p, 1)).otherwise(number), F.when(hit, F.regexp_extract(s, p, 2)).otherwise(title)
    l = l.withColumn("kind", F.when(ok, kind)).withColumn("number", F.when(ok, F.regexp_replace(strip(number), r"\.+$", ""))).withColumn("title", F.when(ok, strip(title)))
    dots = lambda c: F.regexp_count(c, F.lit(r"\."))
    parens = F.regexp_count("number", F.lit(r"(?i)\([a-z0-9]+\)"))
    level = (
        F.when(F.col("kind").isin("article", "caps_heading", "alpha_top", "numeric_top"), 0)
        .when(F.col("kind") == "named_numeric", dots(F.regexp_extract("number", r"(\d[\d.]*)", 1)))
        .when(F.col("kind") == "deep_numeric", dots(F.col("number")) + parens)
        .when(F.col("kind") == "paren_alpha", parens)
    )
    running = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return l.withColumn("level", level.cast("int")).withColumn("ord", F.sum(F.col("kind").isNotNull().cast("int")).over(running).cast("int"))


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ord, kind, number, title, level, parent_ord, body, start_char, end_char), one row per heading in order."""
    h = headed_lines(df, id_col, text_col).filter("ord > 0")
    head = F.col("kind").isNotNull()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("ln", "line")))), lambda x: x["line"]), "\n")
    trimmed = F.length(F.regexp_replace("line", r"(?U)[\s\x1c-\x1f]+\z", ""))
    flat = h.groupBy("doc", "ord").agg(
        *(F.max(F.when(head, F.col(c))).alias(c) for c in ("kind", "number", "title", "level")),
        strip(body).alias("body"),
        F.max(F.when(head, F.col("at"))).alias("start_char"),
        F.max(F.when(F.length("s") > 0, F.col("at") + trimmed)).alias("end_char"),
    )
    above = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # the parent is the nearest heading above with a lower level
    nearest = F.lit(None).cast("int")
    for k in range(MAX_LEVEL, 0, -1):
        last = F.last(F.when(F.col("level") < k, F.col("ord")), ignorenulls=True).over(above)
        nearest = F.when(F.col("level") == k, last).otherwise(nearest)
    # deeper headings: the last shallow one, unless a deep one of a lower level stands in the run since then
    deep = F.col("level") > MAX_LEVEL
    shallow = F.last(F.when(~deep, F.col("ord")), ignorenulls=True)
    flat = flat.withColumn("parent_ord", F.when(deep, shallow.over(above)).otherwise(nearest)).withColumn("run", shallow.over(above.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = F.collect_list(F.when(deep, F.struct("ord", "level"))).over(Window.partitionBy("doc", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    lower = F.array_max(F.transform(F.filter("run_above", lambda x: x["level"] < F.col("level")), lambda x: x["ord"]))
    flat = flat.withColumn("run_above", run).withColumn("parent_ord", F.when(deep, F.coalesce(lower, "parent_ord")).otherwise(F.col("parent_ord")))
    return flat.select("doc", "ord", "kind", "number", "title", "level", "parent_ord", "body", "start_char", "end_char")


def parse_warnings(sec: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, code, location): no sections, numbers used twice, mixed numbering at the top level."""
    none = docs.join(sec.select("doc").distinct(), "doc", "left_anti").select("doc", F.lit("NO_SECTIONS_FOUND").alias("code"), F.lit("").alias("location"))
    twice = sec.groupBy("doc", "number").count().filter("count > 1").select("doc", F.lit("DUPLICATE_SECTION_NUMBER").alias("code"), F.col("number").alias("location"))
    scheme = (
        F.when(F.col("number").rlike(r"^[IVX]+$"), "roman")
        .when(F.col("number").rlike(r"^\d+"), "numeric")
        .when(F.col("number").rlike(r"^[A-Z]$"), "alpha")
        .when(F.lower("number").startswith("article"), "article")
    )
    mixed = sec.filter("level = 0").select("doc", scheme.alias("scheme")).filter("scheme is not null").groupBy("doc").agg(F.count_distinct("scheme").alias("n")).filter("n > 1")
    return none.unionByName(twice).unionByName(mixed.select("doc", F.lit("MIXED_NUMBERING_SCHEMES").alias("code"), F.lit("").alias("location")))


def recitals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return lines(df, id_col, text_col).filter(F.col("s").rlike(_RECITAL)).select("doc", "ln", strip(F.regexp_extract("s", _RECITAL, 1)).alias("recital"))


def schedules(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ord, label, title, body): a schedule runs to the next one or the end."""
    l = lines(df, id_col, text_col).withColumn("starts", F.col("s").rlike(_SCHEDULE))
    running = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = l.withColumn("ord", F.sum(F.col("starts").cast("int")).over(running).cast("int")).filter("ord > 0")
    label = F.concat_ws(" ", F.regexp_extract("s", _SCHEDULE, 1), F.regexp_replace(F.regexp_extract("s", _SCHEDULE, 2), r"\.+$", ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("starts"), F.struct("ln", "line")))), lambda x: x["line"]), "\n")
    return l.groupBy("doc", "ord").agg(F.max(F.when(F.col("starts"), label)).alias("label"), F.max(F.when(F.col("starts"), strip(F.regexp_extract("s", _SCHEDULE, 3)))).alias("title"), strip(body).alias("body"))


def governing_law(c: Column) -> Column:
    """The place whose law governs, by the first pattern that matches anywhere; empty without one."""
    hit = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in _LAW]
    return F.coalesce(*(F.regexp_replace(strip(x), r"[.,;]+$", "") for x in hit), F.lit(""))


def defined_terms(sec: DataFrame) -> DataFrame:
    """(doc, term, definition_text, section): the first definition of each term, inline before parenthetical in one section."""
    text = F.concat_ws(" ", "title", "body")
    inline = sec.select("doc", "ord", "number", F.posexplode(F.regexp_extract_all(text, F.lit(_INLINE_TERM), F.lit(0))).alias("k", "hit")).select(
        "doc", "ord", "number", F.lit(0).alias("way"), "k", strip(F.regexp_extract("hit", _INLINE_TERM, 1)).alias("term"), strip(F.regexp_extract("hit", _INLINE_TERM, 2)).alias("definition_text")
    )
    paren = r'(?iU)\((?:the\s+)?["“]([^"“”]{2,80})["”]\)'
    # with its neighbourhood: up to 200 characters before and 50 after
    around = r'(?isU).{0,200}?\((?:the\s+)?["“]([^"“”]{2,80})["”]\)'
    early = sec.filter(F.lower("title").contains("definition") | (F.col("start_char") < 3000))
    by_paren = early.select("doc", "ord", "number", "body", F.posexplode(F.regexp_extract_all("body", F.lit(paren), F.lit(0))).alias("k", "hit"))
    at = F.expr("instr(body, hit)")
    by_paren = by_paren.select(
        "doc", "ord", "number", F.lit(1).alias("way"), "k", strip(F.regexp_extract("hit", paren, 1)).alias("term"),
        strip(F.substring(F.col("body"), F.greatest(F.lit(1), at - 200), F.length("hit") + 50 + F.least(F.lit(200), at - 1))).alias("definition_text"),
    )
    every = inline.unionByName(by_paren).filter(F.length("term") >= 3)
    first = F.row_number().over(Window.partitionBy("doc", "term").orderBy("ord", "way", "k"))
    return every.withColumn("r", first).filter("r = 1").select("doc", "term", "definition_text", F.col("number").alias("section"), "ord")


def term_usages(sec: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, term, section): other sections whose text has the term in quotes, in any case."""
    t = terms.select("doc", "term", F.col("section").alias("home"))
    hits = [F.contains(F.lower("body"), F.concat(F.lit(a), F.lower("term"), F.lit(b))) for a in '"“”' for b in '"“”']
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return sec.join(t, "doc").filter(found & (F.col("number") != F.col("home"))).select("doc", "term", F.col("number").alias("section")).distinct()


def section_index(sec: DataFrame, kept_roots: DataFrame | None = None) -> DataFrame:
    """(doc, key): what a reference may call a section: its number, without leading zeros, and without its keyword."""
    keys = F.array("number", F.regexp_replace("number", r"^0+", ""), reference_key(F.col("number")))
    return sec.select("doc", F.explode(keys).alias("key")).distinct()


def cross_references(sec: DataFrame, sched: DataFrame) -> DataFrame:
    """(doc, source_section, raw_text, target_number, resolved), once for each wording in a section."""
    raw = sec.select("doc", "number", F.explode(F.regexp_extract_all("body", F.lit(_REFERENCE), F.lit(0))).alias("raw_text")).withColumn("raw_text", strip(F.col("raw_text")))
    raw = raw.withColumn("target_number", reference_key(F.col("raw_text"))).filter(F.col("target_number") != reference_key(F.col("number"))).distinct()
    index = section_index(sec).withColumnRenamed("key", "target_number").withColumn("in_sections", F.lit(True))
    labels = sched.select("doc", F.lower("label").alias("label_key"), F.lit(True).alias("in_schedules")).distinct()
    raw = raw.withColumn("label_key", F.lower(F.regexp_replace("raw_text", r"(?U)\s+", " ")))
    j = raw.join(index, ["doc", "target_number"], "left").join(labels, ["doc", "label_key"], "left")
    return j.select("doc", F.col("number").alias("source_section"), "raw_text", "target_number", (F.coalesce("in_sections", F.lit(False)) | F.coalesce("in_schedules", F.lit(False))).alias("resolved"))


def signature_blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ord, party_name, signature_line_text). Below a signing phrase a company line closes the block before it; a later
    'Name:' line renames the current one. So a block's name is the last such line before the next company line."""
    l = lines(df, id_col, text_col)
    signed = F.col("s").rlike(_SIGNED)
    running = Window.partitionBy("doc").orderBy("ln").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l = l.withColumn("inside", F.max(signed.cast("int")).over(running) == 1).filter(F.col("inside") & ~signed)
    l = l.withColumn("company", F.col("s").rlike(_COMPANY_LINE)).withColumn("signer", F.when(~F.col("company"), F.nullif(strip(F.regexp_extract("s", _SIGNER_LINE, 1)), F.lit(""))))
    l = l.withColumn("block", F.sum(F.col("company").cast("int")).over(running))
    name = F.max_by(F.when(F.col("company"), F.col("s")).otherwise(F.col("signer")), F.when(F.col("company") | F.col("signer").isNotNull(), F.col("ln")))
    blocks = l.groupBy("doc", "block").agg(name.alias("party_name"), F.max(F.when(F.col("company"), F.col("s"))).alias("line"))
    after = F.lead("line").over(Window.partitionBy("doc").orderBy("block"))
    return blocks.withColumn("next", after).filter("party_name is not null").select("doc", F.col("block").cast("int").alias("ord"), "party_name", F.coalesce("next", F.lit("")).alias("signature_line_text"))


# ---- the whole parse ------------------------------------------------------------------------------------------------


@dataclass
class Structure:
    """All parts of parsed texts, each a table by doc."""

    sections: DataFrame
    terms: DataFrame
    usages: DataFrame
    references: DataFrame
    schedules: DataFrame
    recitals: DataFrame
    signatures: DataFrame
    laws: DataFrame
    warnings: DataFrame


def parse(df: DataFrame, id_col: str, text_col: str) -> Structure:
    """Sections first (written once, as everything else needs them), then terms and their usages, references, and the rest."""
    docs = df.filter(F.col(text_col).isNotNull())
    sec = materialize(sections(docs, id_col, text_col), "sections")
    terms, sched = defined_terms(sec), schedules(docs, id_col, text_col)
    laws = docs.select(F.col(id_col).alias("doc"), governing_law(F.col(text_col)).alias("law"))
    warnings = parse_warnings(sec, docs.select(F.col(id_col).alias("doc")))
    return Structure(sec, terms, term_usages(sec, terms), cross_references(sec, sched), sched, recitals(docs, id_col, text_col), signature_blocks(docs, id_col, text_col), laws, warnings)


def full_reference(number: Column, title: Column) -> Column:
    """What a section is called in full."""
    return F.when(F.length(F.coalesce(number, F.lit(""))) > 0, F.concat(F.lit("Section "), number)).otherwise(title)


def leaves(sec: DataFrame) -> DataFrame:
    """Sections without sections below them; ``ord`` is the order of the text."""
    parents = sec.filter("parent_ord is not null").select("doc", F.col("parent_ord").alias("ord")).distinct()
    return sec.join(parents, ["doc", "ord"], "left_anti")


def section_targets(sec: DataFrame) -> DataFrame:
    """(doc, key, ord): the section that a number leads to. Where several have it, the last one whose number it is (as it stands or without
    leading zeros); else the first one whose number without its keyword it is."""
    own = sec.select("doc", "ord", F.explode(F.array_distinct(F.array("number", F.regexp_replace("number", r"^0+", "")))).alias("key")).groupBy("doc", "key").agg(F.max("ord").alias("own"))
    bare = sec.select("doc", "ord", reference_key(F.col("number")).alias("key")).groupBy("doc", "key").agg(F.min("ord").alias("bare"))
    return own.join(bare, ["doc", "key"], "full").select("doc", "key", F.coalesce("own", "bare").alias("ord"))


def resolve(refs: DataFrame, sec: DataFrame, by_number: bool = False) -> DataFrame:
    """(doc, raw, ord) for references (doc, raw): the section each leads to, null without one; ``by_number`` takes them as bare numbers."""
    key = strip(F.col("raw")) if by_number else reference_key(F.col("raw"))
    return refs.select("doc", "raw", key.alias("key")).join(section_targets(sec), ["doc", "key"], "left").select("doc", "raw", "ord")
