"""Variant spellings of names of persons and organisations (p4).

1. Each distinct spelling is parsed once: accents, case, digits for letters, titles, articles and punctuation are folded; legal forms
   are dropped, lines of business and given names are brought to one form by tables of abbreviations and short forms.
2. Blocks: every significant token gives a phonetic code (consonants, doubled and confusable letters merged), each code is joined with
   the line of business or the initial of the given name; the codes of all tokens in sorted order, and both ends of the
   code of the name run together, give further blocks.
3. Within a block spellings are compared by Jaro-Winkler on the remaining tokens, in either order and run together. Given
   names must agree by table, initial or spelling, lines of business by table. Where neither side has a given name of the table,
   all tokens are compared, in any rotation and reversed, each within an edit or so; an initial stands for either end's token.
4. Accepted pairs are clustered by connected components. A spelling that leaves something open (an initial, a missing token) joins only
   if all it agrees with is one cluster; otherwise it joins nothing but its equals.

Only spanning edges leave a block, so a block of many spellings of one entity costs no more edges than spellings; spellings that
parse alike are one from the start.

Defined results: null, empty and unparsable names are nobody's variants; equal strings under several ids are the same
spelling; extra columns are ignored. Organisations without a legal form or a known line of business are compared like persons whose
given name is in no table; they are not linked to the same name with a legal form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.names import FULL_OF, SHORT_FORMS
from lexloom.plans.components import components
from lexloom.plans.runtime import materialize

#: Lines of business and their usual abbreviations.
BUSINESS = {
    "associates": "associate assoc assocs",
    "bank": "banking bk",
    "brothers": "brother bros bro",
    "chemicals": "chemical chem chems",
    "communications": "communication comms comm commun",
    "construction": "constructions constr",
    "consulting": "consultants consult",
    "energy": "nrg",
    "engineering": "engrg engr eng engineers",
    "foods": "food fds",
    "group": "grp",
    "holdings": "holding hldg hldgs",
    "industries": "industry inds ind industrial",
    "insurance": "insur ins assurance",
    "international": "intl intnl internat",
    "investments": "investment inv invest",
    "laboratories": "laboratory labs lab",
    "logistics": "logistic logist logis",
    "manufacturing": "manufacturers manuf mfg mfrs",
    "media": "",
    "partners": "partner ptnrs ptnr prtnrs",
    "pharmaceuticals": "pharmaceutical pharma pharm",
    "properties": "property props prop propertys",
    "services": "service serv servs svcs svc",
    "shipping": "shpg shipg shiping ship",
    "solutions": "solution soln solns",
    "systems": "system sys",
    "technologies": "technology technolgies tech techs technol",
    "textiles": "textile txtls txtl tex",
    "trading": "traders trdg",
    "transport": "transports transp",
    "ventures": "venture",
}
#: Legal forms.
LEGAL = frozenset("limited ltd limted ltda llc llp lp plc inc incorp incorporated corp corpn corporation corporaton co company cie compagnie gmbh mbh ag kg ohg sa sas sarl sl srl spa bv nv sdad sociedad pty".split())
TITLES = frozenset("mr mrs ms miss mx dr prof sir dame herr herrn frau mme mlle monsieur madame don dona senor senora sr sra me hon rev".split())
_LINE = {v: k for k, vs in BUSINESS.items() for v in (k, *vs.split())}
#: Spellings of one block that are compared in one task.
BLOCK_FORMS = 4000
_DOTTED = re.compile(r"\b(?:[a-z]\. ?){1,}[a-z]\b\.?")
_SPLIT = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])")


@lru_cache(maxsize=200_000)
def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    t = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@lru_cache(maxsize=200_000)
def phonetic(token: str) -> str:
    """Consonants of a token with confusable ones merged; its first vowel if it has none."""
    t = token.replace("ph", "f").replace("ck", "k").replace("rn", "m").replace("cl", "d")
    t = t.translate(str.maketrans("cqzxjwy", "kksskvi"))
    out = []
    for c in t:
        if c not in "aeiouhv" and (not out or out[-1] != c):
            out.append(c)
    return "".join(out) or token[:1]


@lru_cache(maxsize=100_000)
def one_edit(a: str, b: str) -> bool:
    """At most one letter inserted, left out, replaced, or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


@lru_cache(maxsize=50_000)
def _given(token: str) -> frozenset[str]:
    """Full given names a token may stand for; misspelt full names included."""
    if token in FULL_OF:
        return FULL_OF[token]
    if len(token) < 4:
        return frozenset()
    near = frozenset(f for f in SHORT_FORMS if len(f) > 3 and one_edit(token, f))
    return near or frozenset(f for f in SHORT_FORMS if len(f) > 5 and abs(len(f) - len(token)) < 3 and jaro_winkler(token, f) >= 0.93)


@lru_cache(maxsize=50_000)
def _line(token: str) -> str | None:
    if token in _LINE:
        return _LINE[token]
    if len(token) >= 6:
        return next((k for k in BUSINESS if len(k) >= 6 and k[0] == token[0] and abs(len(k) - len(token)) < 3 and jaro_winkler(token, k) >= 0.95), None)
    return None


def parse(name: str | None) -> tuple[str, str, str, str, str] | None:
    """(kind, line of business or given names, initial, other tokens in order, single letters among them) or None."""
    if not name or not name.strip():
        return None
    s = _SPLIT.sub(" ", re.sub(r"GmbH|mbH", "gmbh", name))
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    s = s.replace("'", "").replace("’", "").replace("ß", "ss")
    s = _DOTTED.sub(lambda m: (x if (x := re.sub(r"[. ]", "", m.group())) in LEGAL else m.group()), s)
    s = re.sub(r"\b[sa]\.? ?[al]\.?(?=$|,)", lambda m: re.sub(r"[. ]", "", m.group()) if len(re.sub(r"[. ]", "", m.group())) == 2 else m.group(), s)
    raw = re.findall(r"[a-z0-9]+", s)
    tokens = [t.translate(str.maketrans("0158", "olsb")) if not t.isdigit() else t for t in raw]
    while tokens and tokens[0] in ("the", "der", "die", "das", "la", "le", "el") and len(tokens) > 2:
        tokens = tokens[1:]
    tokens = [t for t in tokens if t not in TITLES or len(tokens) == 1]
    legal = [t for t in tokens if t in LEGAL]
    lines = [(i, line) for i, t in enumerate(tokens) if t not in LEGAL and (line := _line(t))]
    if legal or lines:
        # the line of business is the last such token: earlier ones may be part of the name
        at, line = lines[-1] if lines else (-1, "")
        rest = [t for i, t in enumerate(tokens) if i != at and t not in LEGAL]
        letters = [t for t in rest if len(t) == 1]
        words = [t for t in rest if len(t) > 1]
        return ("org", line, "", " ".join(words), " ".join(letters)) if words else None
    letters = [t for t in tokens if len(t) == 1]
    words = [t for t in tokens if len(t) > 1]
    if len(words) < 1 or len(words) + len(letters) < 2:
        return None
    exact = [i for i in range(len(words)) if words[i] in FULL_OF]
    # a misspelt given name is only looked for at either end
    spots = exact or [i for i in (0, len(words) - 1) if (len(words) > 2 or (not letters and len(words[i]) > 4)) and len(words) > 1 and _given(words[i])]
    given: frozenset[str] = frozenset()
    if spots and len(words) > 1:
        i = spots[0] if 0 in spots or len(words) - 1 not in spots else len(words) - 1
        given = _given(words[i])
        words = words[:i] + words[i + 1 :]
    if given:
        return ("person", " ".join(sorted(given)), "", " ".join(words), "")
    ordered = _forward(s, tokens)
    # a letter between words is a middle initial, left out as beside known given names
    initials = [t for k, t in enumerate(ordered) if len(t) == 1 and (not any(len(x) > 1 for x in ordered[:k]) or not any(len(x) > 1 for x in ordered[k + 1 :]))]
    return ("person", "", initials[0] if initials else "", " ".join(t for t in ordered if len(t) > 1), "")


def _forward(s: str, tokens: list[str]) -> list[str]:
    """The tokens with what stands behind a comma first: 'bianchi, laura k.' as 'laura k. bianchi'."""
    behind = len([t for t in re.findall(r"[a-z0-9]+", s.partition(",")[2]) if t not in TITLES])
    return tokens[-behind:] + tokens[:-behind] if 0 < behind < len(tokens) else tokens


def _codes(words: list[str]) -> set[str]:
    codes = {phonetic(w) for w in words}
    codes.add("+" + "".join(sorted(phonetic(w) for w in words)))
    return codes


def block_keys(form: tuple[str, str, str, str, str]) -> list[str]:
    kind, head, initial, rest, _ = form
    words = rest.split()
    # names run together meet by the codes at either end
    whole = phonetic("".join(words))
    codes = _codes(words) | {"+" + whole, "<" + whole[:3], ">" + whole[-3:]}
    if kind == "org":
        return [f"o|{head}|{c}" for c in codes]
    # without a given name of the table either end may be one
    firsts = {g[0] for g in head.split()} or ({initial} if initial else {"?", words[0][0], words[-1][0]})
    return [f"p|{f}|{c}" for f in firsts for c in codes]


def agree(a: tuple, b: tuple) -> str:
    """'same', 'open' (nothing speaks against it, but something is left out) or ''."""
    if a[0] != b[0]:
        return ""
    u, v = a[3].split(), b[3].split()
    if a[0] == "person" and not a[1] and not b[1] and not (a[2] and b[2]):
        if a[2] or b[2]:
            return _initial(a[2], u, v) if a[2] else _initial(b[2], v, u)
        return _tokens(u, v)
    if a[0] == "person" and bool(a[1]) != bool(b[1]) and not a[2] and not b[2]:
        return _near_given(a[1].split(), u, v) if a[1] else _near_given(b[1].split(), v, u)
    verdict = _rest(u, v, a[4].split(), b[4].split())
    if not verdict:
        return ""
    if a[0] == "org":
        return verdict if a[1] == b[1] else ""
    x, y = set(a[1].split()), set(b[1].split())
    if x and y:
        return "" if not x & y else verdict if x == y else "open"
    if x or y:
        names, initial = (x, b[2]) if x else (y, a[2])
        return "open" if any(n[0] == initial for n in names) else ""
    return verdict if a[2] == b[2] else ""


def _alike(p: str, q: str) -> bool:
    return p == q or (min(len(p), len(q)) > 3 and (one_edit(p, q) or jaro_winkler(p, q) >= 0.9))


def _tokens(u: list[str], v: list[str]) -> str:
    """How two names agree of which no token is a known given name: any of them may be."""
    orders = [v[k:] + v[:k] for k in range(len(v))] + [v[::-1]]
    if len(u) == len(v):
        if any(all(map(_alike, u, w)) for w in orders):
            return "same"
        # a short form of a given name, which is at either end, in no table
        short = lambda w: any(_short_for(u[k], w[k]) and all(map(_alike, u[:k] + u[k + 1 :], w[:k] + w[k + 1 :])) for k in {0, len(w) - 1})
        return "open" if len(u) > 1 and any(map(short, orders)) else ""
    if any(one_edit("".join(u), "".join(w)) for w in orders):
        return "same"
    short, long = (u, v) if len(u) < len(v) else (v, u)
    if len(short) > 1 and len(long) == len(short) + 1 and all(map(_alike, short, long)):
        return "open"  # the last token is left out
    return ""


def _short_for(p: str, q: str) -> bool:
    """Whether one token may be a short form of the other: its beginning by letters or, from two equal letters on, by sound."""
    p, q = sorted((p, q), key=len)
    return 3 <= len(p) <= 5 and len(q) >= len(p) + 2 and (q.startswith(p) or (p[:2] == q[:2] and len(phonetic(p)) > 1 and phonetic(q).startswith(phonetic(p))))


def _near_given(names: list[str], u: list[str], v: list[str]) -> str:
    """Known given names and tokens u against all tokens v, an end of which may be the given name in a spelling of no table."""
    for k in {0, len(v) - 1} if len(v) > 1 else ():
        if any(one_edit(v[k], n) or (phonetic(v[k]) == phonetic(n) and jaro_winkler(v[k], n) >= 0.8) for n in names):
            if verdict := _rest(u, v[:k] + v[k + 1 :], [], []):
                return verdict if len(names) == 1 else "open"
    return ""


def _initial(letter: str, u: list[str], v: list[str]) -> str:
    """An initial with tokens u against all tokens v."""
    ends = {0, len(v) - 1} if len(v) > 1 else set()
    return "open" if any(v[k][0] == letter and _rest(u, v[:k] + v[k + 1 :], [], []) for k in ends) else ""


def _rest(u: list[str], v: list[str], lu: list[str], lv: list[str]) -> str:
    """How two token lists agree; lu and lv are the single letters beside them."""
    if len(u) == len(v):
        if len(u) == 1:
            same = jaro_winkler(u[0], v[0]) >= 0.9
            if same and (lu or lv):
                return "same" if lu == lv else ("open" if not lu or not lv else "")
            return "same" if same else ""
        scores = [jaro_winkler(p, q) for p, q in zip(u, v, strict=True)]
        swapped = [jaro_winkler(p, q) for p, q in zip(u, reversed(v), strict=True)]
        best = max(scores, swapped, key=sum)
        if min(best) >= 0.78 and sum(best) / len(best) >= 0.89 and max(best) >= 0.9:
            return "same"
        return "same" if jaro_winkler("".join(u), "".join(v)) >= 0.95 and min(best) >= 0.7 else ""
    short, long = (u, v) if len(u) < len(v) else (v, u)
    letters = lu if len(u) < len(v) else lv
    if jaro_winkler("".join(short), "".join(long)) >= 0.92 and len("".join(short)) >= 0.8 * len("".join(long)):
        return "same"
    if len(short) == 1 and len(long) == 2:
        for k in (0, 1):
            if jaro_winkler(short[0], long[k]) >= 0.92:
                if letters:
                    return "open" if letters[0] == long[1 - k][0] else ""
                return "open" if k == 0 else ""
    return ""


_FORM = "kind string, head string, initial string, rest string, letters string"
_KEYED = pa.schema([("block", pa.int64()), ("part_a", pa.int32()), ("part_b", pa.int32()), ("part", pa.int32()), ("form_id", pa.int64()), ("blocks", pa.list_(pa.int64())), *((c.split()[0], pa.string()) for c in _FORM.split(", "))])


def _first_common(a: frozenset[int], b: frozenset[int]) -> int:
    """Two spellings that share several blocks are compared in the one of the smallest number."""
    return min(a & b)


def match_block(rows: list[tuple]) -> list[tuple[int, int, bool]]:
    """Edges of one block: a spanning forest of 'same', and every 'open' pair once for each tree. ``rows`` are in the order of form_id."""
    block, left, right = rows[0][:3]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges, loose = [], []
    keys = [frozenset(r[5]) for r in rows]
    for j in range(len(rows)):
        for i in range(j):
            # two parts of a large block only meet each other here
            if (left != right and rows[i][3] == rows[j][3]) or _first_common(keys[i], keys[j]) != block or root(i) == root(j):
                continue
            v = agree(rows[i][6:], rows[j][6:])
            if v == "same":
                parent[root(j)] = root(i)
                edges.append((rows[i][4], rows[j][4], True))
            elif v == "open":
                loose.append((i, j))
    seen = set()
    for i, j in loose:
        key = (root(i), root(j))
        if key[0] != key[1] and key not in seen:
            seen.add(key)
            edges.append((rows[i][4], rows[j][4], False))
    return edges


def _match_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks lie one after the other; one may go on in the next batch."""
    held: list[tuple] = []
    out: list[tuple[int, int, bool]] = []

    def made() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "same"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                if len(held) > 1:
                    out += match_block(held)
                held = []
            held.append(row)
        if len(out) > 10_000:
            yield made()
    if len(held) > 1:
        out += match_block(held)
    yield made()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, forms = [], []
        for n in b.column(0).to_pylist():
            f = parse(n)
            if f:
                names.append(n)
                forms.append(f)
        cols = list(zip(*forms, strict=True)) if forms else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.string()) for c in cols)], names=["name", "kind", "head", "initial", "rest", "letters"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [tuple(r.values()) for r in b.to_pylist()]
        keys = [sorted({xxhash.xxh64_intdigest(k) - (1 << 63) for k in block_keys(r[:5])}) for r in rows]
        at = [i for i, ks in enumerate(keys) for _ in ks]
        yield pa.RecordBatch.from_arrays(
            [*b.take(pa.array(at, pa.int64())).columns, pa.array([keys[i] for i in at], pa.list_(pa.int64())), pa.array([k for ks in keys for k in ks], pa.int64())], names=[*b.schema.names, "blocks", "block"]
        )


def _parts(keyed: DataFrame, block_forms: int) -> DataFrame:
    """Blocks of one spelling are left out; those of more than ``block_forms`` are cut into parts that meet pairwise, so no task gets more
    than two parts. Large blocks are at most rows / block_forms many."""
    keyed = materialize(keyed, "keys")
    sizes = materialize(keyed.groupBy("block").count().filter("count > 1"), "blocks")
    large = sizes.filter(F.col("count") > block_forms).select("block", F.ceil(F.col("count") / block_forms).cast("int").alias("parts"))
    k = keyed.join(sizes.select("block"), "block", "left_semi").join(F.broadcast(large), "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    k = k.withColumn("part", F.pmod(F.xxhash64("form_id"), F.col("parts")).cast("int"))
    k = k.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    k = k.withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")})
    return k.select(*_KEYED.names).repartition("block", "part_a", "part_b").sortWithinPartitions("block", "part_a", "part_b", "form_id")


def link_variants(names: DataFrame, name_col: str = "name", block_forms: int = BLOCK_FORMS) -> DataFrame:
    """(name, entity): one row for every distinct parsable spelling; equal entities are the same person or organisation."""
    spellings = names.select(F.col(name_col).cast("string").alias("name")).filter("name is not null").distinct()
    parsed = materialize(spellings.mapInArrow(_parse_batches, f"name string, {_FORM}"), "parsed")
    parts = ["kind", "head", "initial", "rest", "letters"]
    form_id = F.xxhash64(*parts)
    forms = parsed.select(*parts).distinct().withColumn("form_id", form_id)
    keyed = forms.mapInArrow(_key_batches, f"{_FORM}, form_id long, blocks array<long>, block long")
    edges = materialize(_parts(keyed, block_forms).mapInArrow(_match_batches, "a long, b long, same boolean").distinct(), "edges")
    strong = components(edges.filter("same").select("a", "b"))
    nodes = parsed.select(form_id.alias("node")).distinct()
    labelled = materialize(nodes.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "strong")
    of = lambda c, out: labelled.select(F.col("node").alias(c), F.col("component").alias(out))
    # the clusters of open spellings, and what each of them agrees with
    open_pairs = edges.filter(~F.col("same")).select("a", "b").join(of("a", "ca"), "a").join(of("b", "cb"), "b").filter("ca <> cb").select("ca", "cb")
    complete = parsed.groupBy(form_id.alias("node")).agg(F.max(_completeness()).alias("full"))
    cluster_full = labelled.join(complete, "node").groupBy("component").agg(F.max("full").alias("full"))
    full = lambda c, out: cluster_full.select(F.col("component").alias(c), F.col("full").alias(out))
    ranked = open_pairs.join(full("ca", "fa"), "ca").join(full("cb", "fb"), "cb").filter("fa <> fb")
    low = F.col("fa") < F.col("fb")
    attach = ranked.select(F.when(low, F.col("ca")).otherwise(F.col("cb")).alias("lo"), F.when(low, F.col("cb")).otherwise(F.col("ca")).alias("hi"), F.floor(F.greatest("fa", "fb")).alias("f")).distinct()
    # it agrees with one complete cluster only (where it agrees with complete ones, the others do not count)
    top = attach.groupBy("lo").agg(F.max("f").alias("f"))
    unique = attach.join(top, ["lo", "f"]).groupBy("lo").agg(F.count("*").alias("n"), F.min("hi").alias("hi")).filter("n = 1")
    joined = components(unique.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    final = labelled.join(joined.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "left").select("node", F.coalesce("merged", "component").alias("entity"))
    return parsed.select("name", form_id.alias("node")).join(final, "node").select("name", "entity")


def _completeness():
    """2: given name or line of business and two tokens, 1: one of these is missing, 0: both."""
    two = (F.size(F.split("rest", " ")) > 1) | (F.length("rest") >= 10)
    # a short form of several given names is no complete head
    head = (F.col("head") != "") & ~F.col("head").contains(" ")
    # without a given name of the table one of the tokens is it
    all_tokens = (F.col("kind") == "person") & (F.col("head") == "") & (F.col("initial") == "") & F.col("rest").contains(" ")
    long = (F.size(F.split("rest", " ")) > 2) | F.col("rest").rlike(r"\S{10}")
    # of two such names the longer is the fuller one
    return F.when(all_tokens, 1 + long.cast("int") + F.least(F.length("rest"), F.lit(99)) / 1000).otherwise((head.cast("int") + two.cast("int")).cast("double"))
