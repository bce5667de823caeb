"""Column functions over texts; all of them stay inside whole-stage code generation.

Regular expressions carry (?U) so that digits, blanks and word characters are Unicode's, and (?d) where only a line feed
ends a line, as the compared semantics require."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() removes; Java's \s in (?U) lacks U+001C to U+001F.
WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def token_estimate(c: Column) -> Column:
    """Length in tokens by the rule of four characters a token."""
    return F.floor(F.length(c) / 4).cast("long")


def content_hash(c: Column) -> Column:
    """SHA-256 of a text; null for null and empty texts."""
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def safe_cell(c: Column) -> Column:
    """A value that no spreadsheet takes for a formula; null becomes empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)


def two_decimals(c: Column) -> Column:
    """A number from 0 to 1 with two decimals, rounded from its exact binary value (0.585 is a little less and gives 0.58)."""
    exact = (c * float(1 << 60)).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    unit = F.lit(1 << 60).cast("decimal(20,0)")
    whole = F.floor(exact / unit)
    rest = exact - whole * unit
    half = F.lit(1 << 59).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    h = (whole + up.cast("int")).cast("int")
    return F.format_string("%d.%02d", F.floor(h / 100).cast("int"), h % 100)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without a match."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


# ---- personal data presence (the exact spans are found by lexloom.operators.privacy) --------------------------------

#: Dashes that count as a separator in numbers.
DASH = r"[-‐-―−﹘﹣－]"
SEP = rf"(?:{DASH}|[.\s])"
#: Formats of the built-in recognisers, as (entity type, pattern).
PII_FORMATS = [
    ("PHONE_NUMBER", rf"\b(?:\+?1{SEP}?)?\(?\d{{3}}\)?{SEP}?\d{{3}}{SEP}?\d{{4}}\b"),
    ("US_SSN", rf"\b\d{{3}}{DASH}\d{{2}}{DASH}\d{{4}}\b"),
    ("CREDIT_CARD", rf"\b(?:\d{{4}}(?:{DASH}|\s)?){{3}}\d{{4}}\b"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b"),
    ("PASSPORT_NUMBER", r"\b[A-Z]{1,2}[0-9]{6,9}\b"),
    ("DATE_OF_BIRTH", r"(?i)(?:born|dob|date of birth)[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    ("DRIVERS_LICENSE", r"\b[A-Z]\d{7}\b"),
]


def pii_count(c: Column, entity: str) -> Column:
    pattern = dict(PII_FORMATS)[entity]
    return F.coalesce(F.regexp_count(c, F.lit("(?U)" + pattern)), F.lit(0)).cast("long")


# ---- jurisdictions --------------------------------------------------------------------------------------------------


def jurisdiction(c: Column) -> Column:
    """'US-CA' and the like as struct(country, region, court_system); EU and INT are international, FEDERAL a court system."""
    s = F.upper(strip(c))
    parts = F.split(s, "-", 2)
    international = s.isin("EU", "INT", "INTERNATIONAL")
    suffix = F.get(parts, F.lit(1))
    federal = suffix.isin("FEDERAL", "FED")
    return F.when(
        c.isNotNull(),
        F.struct(
            F.when(international, "INT").otherwise(F.get(parts, F.lit(0))).alias("country"),
            F.when(~international & suffix.isNotNull() & ~federal, suffix).alias("region"),
            F.when(~international & federal, "federal").alias("court_system"),
        ),
    )


def jurisdiction_label(j: Column) -> Column:
    return F.when(j["region"].isNotNull(), F.concat_ws("-", j["country"], j["region"])).when(j["court_system"].isNotNull(), F.concat_ws("-", j["country"], F.initcap(j["court_system"]))).otherwise(j["country"])


def jurisdiction_broader(a: Column, b: Column) -> Column:
    return F.when((a["country"] == "INT") & (b["country"] != "INT"), True).otherwise((a["country"] == b["country"]) & a["region"].isNull() & b["region"].isNotNull())


def jurisdiction_conflicts(a: Column, b: Column) -> Column:
    return F.coalesce((a["country"] == b["country"]) & (a["region"] != b["region"]), F.lit(False))


def jurisdiction_matches(j: Column, country: str, region: str | None = None) -> Column:
    """Fits a filter: the country (INT fits all) and, if a region is asked for, that region or none."""
    ok = F.lit(True) if country == "INT" else j["country"] == country
    return ok if region is None else ok & (j["region"].isNull() | (j["region"] == region))


# ---- authority ------------------------------------------------------------------------------------------------------

#: Authority of kinds of sources.
AUTHORITY = {
    "CONSTITUTIONAL": 100,
    "BINDING_STATUTE": 95,
    "SUPREME_COURT": 90,
    "BINDING_TREATY": 88,
    "REGULATION": 85,
    "APPELLATE_COURT": 75,
    "TRIAL_COURT": 60,
    "AGENCY_GUIDANCE": 55,
    "SECONDARY_TREATISE": 30,
    "LAW_REVIEW": 25,
    "BAR_ASSOCIATION": 20,
    "BLOG_NEWS": 5,
    "UNKNOWN": 1,
}


def authority_level(kind: Column) -> Column:
    pairs = [x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.upper(kind)], F.lit(1))


def authority_weight(level: Column, superseded: Column) -> Column:
    w = level / 100.0
    return F.when(superseded, w * 0.1).otherwise(w)


def authority_binding(level: Column) -> Column:
    return level > AUTHORITY["AGENCY_GUIDANCE"]


# ---- dates ----------------------------------------------------------------------------------------------------------

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def _month_number(c: Column) -> Column:
    pairs = [x for i, m in enumerate(_MONTHS) for x in (F.lit(m), F.lit(i + 1))]
    return F.create_map(*pairs)[F.lower(F.substring(c, 1, 3))]


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.format_string("%s-%s-%s", y.cast("int").cast("string"), m.cast("int").cast("string"), d.cast("int").cast("string")), F.lit("y-M-d")).cast("date")


def normal_date(c: Column) -> Column:
    """The first date in a text. Numeric dates that may be read two ways, two-digit years and impossible days give null."""
    iso = r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)"
    num = r"(?<!\d)(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)"
    mdy = rf"(?i)\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
    dmy = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+day)?(?:\s+of)?\s+({_MONTH})\.?,?\s+(\d{{4}})\b"
    at = {k: F.regexp_instr(c, F.lit(p)) for k, p in (("iso", iso), ("num", num), ("mdy", mdy), ("dmy", dmy))}
    first = F.array_min(F.filter(F.array(*at.values()), lambda x: x > 0))
    g = lambda p, k: F.regexp_extract(c, p, k)
    a, sep, b, y = (F.try_to_number(g(num, 1), F.lit("99")).cast("int"), g(num, 2), F.try_to_number(g(num, 3), F.lit("99")).cast("int"), g(num, 4))
    day_first = (sep == ".") | ((a > 12) & (b <= 12))
    month_first = ((b > 12) & (a <= 12)) | (a == b)
    return (
        F.when(first == at["iso"], _day(g(iso, 1), g(iso, 2), g(iso, 3)))
        .when((first == at["num"]) & (F.length(y) == 4) & day_first, _day(y, b, a))
        .when((first == at["num"]) & (F.length(y) == 4) & month_first, _day(y, a, b))
        .when((first == at["num"]) & (at["num"] > 0), F.lit(None).cast("date"))
        .when(first == at["mdy"], _day(g(mdy, 3), _month_number(g(mdy, 1)), g(mdy, 2)))
        .when(first == at["dmy"], _day(g(dmy, 3), _month_number(g(dmy, 2)), g(dmy, 1)))
    )


def deadline_date(text: Column, effective: Column) -> Column:
    """A deadline as a date: absolute, or relative to the effective date unless it names another start or business days.

    The patterns are fixed values: ISO and month-name dates, business days, other starts, and numbers of days, weeks, months and years."""
    iso = r"(\d{4})-(\d{2})-(\d{2})"
    us = r"(\w+)\s+(\d{1,2}),?\s+(\d{4})"
    month = F.create_map(*[x for i, m in enumerate(_MONTHS) for x in (F.lit(m), F.lit(i + 1))], *[x for i, m in enumerate("january february march april june july august september october november december".split()) for x in (F.lit(m), F.lit(i + 1 if i < 4 else i + 2))])
    g = lambda p, k: F.regexp_extract(text, "(?U)" + p, k)
    n = lambda p: F.try_to_number(F.regexp_extract(text, "(?iU)" + p, 1), F.lit("999999999")).cast("int")
    has = lambda p: text.rlike("(?iU)" + p)
    spelled = F.when(has(r"thirty\s*\(30\)\s*day"), 30).when(has(r"sixty\s*\(60\)\s*day"), 60).when(has(r"ninety\s*\(90\)\s*day"), 90)
    blocked = has(r"(?:business|working|banking)\s+day") | (has(r"\b(?:after|of|following|from|upon|before|prior\s+to)\b") & ~has(r"effective\s+date|date\s+of\s+this\s+agreement|date\s+hereof"))
    absolute = F.coalesce(
        F.when(g(iso, 1) != "", _day(g(iso, 1), g(iso, 2), g(iso, 3))),
        F.when(month[F.lower(g(us, 1))].isNotNull(), _day(g(us, 3), month[F.lower(g(us, 1))], g(us, 2))),
    )
    relative = (
        F.when(blocked, F.lit(None).cast("date"))
        .when(has(r"(\d+)\s+(?:calendar\s+)?day"), F.date_add(effective, n(r"(\d+)\s+(?:calendar\s+)?day")))
        .when(has(r"(\d+)\s+(?:week|wk)"), F.date_add(effective, n(r"(\d+)\s+(?:week|wk)") * 7))
        .when(has(r"(\d+)\s+month"), F.add_months(effective, n(r"(\d+)\s+month")))
        .when(has(r"(\d+)\s+year"), F.add_months(effective, n(r"(\d+)\s+year") * 12))
        .when(spelled.isNotNull(), F.date_add(effective, spelled))
    )
    return F.when(F.length(strip(text)) > 0, F.coalesce(absolute, relative))


def ical_text(c: Column) -> Column:
    """A value escaped for a TEXT property of RFC 5545."""
    s = F.regexp_replace(c, r"([\\;,])", r"\\$1")
    return F.regexp_replace(s, r"\r\n|\n|\r", r"\\n")


# ---- amounts --------------------------------------------------------------------------------------------------------


def amount(c: Column) -> Column:
    """The one amount of money in a text as DECIMAL(38,10); null where it is not exactly one or can be read two ways."""
    whole = r"(?U)(?<![\w.,'])([-−])?([A-Z]{0,3}[$€£¥₹]\s*|[A-Z]{3}\s+)?([-−])?(\d[\d.,']*\d|\d|\.\d+)(?!\w)(?:\s*((?i:thousand|million|billion|trillion))\b)?(?:\s*([A-Z]{3})\b)?"
    found = F.regexp_extract_all(c, F.lit(whole), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, whole, k)
    marked = F.filter(found, lambda x: (part(x, 2) != "") | (part(x, 6) != ""))
    pick = F.when(F.size(found) == 1, found[0]).when((F.size(found) > 1) & (F.size(marked) == 1), F.get(marked, F.lit(0)))
    number = F.regexp_replace(part(pick, 4), "'", "")
    us = number.rlike(r"^(?:(?:[1-9]\d{0,2}(?:,\d{3})+|\d*)(?:\.\d+)?)$")
    eu = number.rlike(r"^(?:(?:[1-9]\d{0,2}(?:\.\d{3})+|\d+),\d{1,2}|[1-9]\d{0,2}(?:\.\d{3}){2,})$")
    plain = F.when(us, F.regexp_replace(number, ",", "")).when(eu, F.regexp_replace(F.regexp_replace(number, r"\.", ""), ",", "."))
    scale = F.lower(part(pick, 5))
    factor = F.when(scale == "thousand", 1_000).when(scale == "million", 1_000_000).when(scale == "billion", 1_000_000_000).when(scale == "trillion", 1_000_000_000_000).otherwise(1)
    sign = F.when((part(pick, 1) != "") | (part(pick, 3) != ""), -1).otherwise(1)
    value = plain.try_cast("decimal(25,8)")
    return (value * factor.cast("decimal(13,0)") * sign.cast("decimal(1,0)")).try_cast("decimal(38,8)")
