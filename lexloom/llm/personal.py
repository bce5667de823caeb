"""Personal information inside free text (p1): proposing patterns, validators, context words, typed placeholders.

Every text is scanned whole. Before scanning it is folded character by character (full-width forms, dashes, spaces), and
invisible format characters are left out with a map back, so offsets are those of the given text. Patterns propose spans;
number plans raise or lower a proposal's score, words nearby do so too, and spans of a score of 0.5 or more are accepted. Checksums
decide where context does not: the key of a French number (mod 97), the letter of a Spanish one (mod 23) and Luhn digits where words
nearby speak both for and against a person; a valid IBAN (mod 97) or card number (Luhn) is no telephone or identity number. Where accepted spans overlap, e-mail addresses come before street addresses, identity numbers,
phone numbers and names.

Defined results: null and empty texts have no spans and stay as they are; repeated rows are scanned alike; extra
columns are passed over. Names are found by known given names, by titles, by initials and, whatever the given name, behind words
that announce one, before words that say what only persons do, and joined by 'and' to a name so found; a lone surname is not.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.names import COMMON, FULL_OF, SHORT_FORMS

THRESHOLD = 0.5
ORDER = {"EMAIL": 0, "ADDRESS": 1, "ID_NUMBER": 2, "PHONE": 3, "PERSON": 4}


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


# ---- folding ------------------------------------------------------------------------------------------------------

_FOLD = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFE58, 0xFE63], "-")
_FOLD |= dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x0D, 0x09], " ")
_FOLD[0x2019] = "'"
_PLAIN = {c: unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c))}
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


#: Characters that folding changes beyond tabs and carriage returns; letters that only the slow way makes plain.
_FOLDED = re.compile("[" + "".join(f"\\u{c:04x}" for c in _FOLD if c > 0x20) + "]")
_FAR_LETTER = re.compile("[\u0100-\u1fff\u2c00-\uffef\U00010000-\U0010ffff]")
_PLAIN_BYTES = bytes(ord(_PLAIN.get(c, chr(c)).lower()) if len(_PLAIN.get(c, chr(c)).lower()) == 1 and ord(_PLAIN.get(c, chr(c)).lower()) < 256 else c for c in range(256))


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text to scan and, if characters were left out, the offset of each remaining one."""
    where = None
    if not text.isascii():
        if _INVISIBLE.search(text):
            where = [i for i, c in enumerate(text) if not _INVISIBLE.match(c)]
            text = "".join([text[i] for i in where])
        if _FOLDED.search(text):
            return text.translate(_FOLD), where
    return text.replace("\r", " ").replace("\t", " "), where


def plain_lower(t: str) -> str:
    """A folded text in lower case without accents, character by character."""
    if t.isascii():
        return t.lower()
    if not _FAR_LETTER.search(t):
        # other signs than letters become a question mark, which is no letter either
        return t.encode("latin-1", "replace").translate(_PLAIN_BYTES).decode("latin-1")
    plain = t.translate(_PLAIN)
    low = plain.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)


# ---- e-mail -------------------------------------------------------------------------------------------------------

_AT = re.compile(r"@|[\[(]\s?at\s?[\])]\s?", re.I)
_LOCAL = re.compile(r"[\w.+%'-]*\w")
_DOMAIN = re.compile(r"[\w-]+(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[\w-]+)*(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[^\W\d_]{2,}", re.I)


def emails(t: str) -> Iterator[Span]:
    for m in _AT.finditer(t):
        stop = m.start()
        if t[stop] != "@" and stop and t[stop - 1].isspace():
            stop -= 1
        at = stop
        while at and (t[at - 1].isalnum() or t[at - 1] in "_.+%'-"):
            at -= 1
        left = _LOCAL.fullmatch(t, at, stop)
        right = _DOMAIN.match(t, m.end())
        if left and right:
            start = left.start()
            while start < left.end() and t[start] in ".'-+%":
                start += 1
            yield Span(start, right.end(), "EMAIL", 0.95)


# ---- numbers ------------------------------------------------------------------------------------------------------

_S = r"(?:[ ]?[-./][ ]?|[ ]{1,2}|[ ]?\n[ ]?)"
_PHONE = re.compile(
    rf"""(?<![\w+/-])(?<!\d[.,])(?:
      \+\d{{1,3}}(?:{_S}?\(\d{{1,4}}\))?(?:{_S}?\d{{1,9}}){{1,6}}
    | 00\d{{2}}(?:{_S}?\d{{1,9}}){{2,6}}
    | (?:1{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}
    | 0\d(?:{_S}\d{{2}}){{4}}
    | 0\d{{2,4}}{_S}\d{{3,4}}{_S}\d{{3,4}}
    | 0\d{{2,4}}[ /]\d{{4,8}}(?:-\d{{1,5}})?
    | [6-9]\d{{2}}(?:{_S}\d{{2}}){{3}}
    )(?![\w/]|[.,-]\d)""",
    re.X,
)
_ID = re.compile(
    rf"""(?<![\w+/-])(?<!\d[.,])(?:
      \d{{3}}(?P<s>{_S})\d{{2}}{_S}\d{{4}}
    | \d{{8}}[- ]{{0,2}}[A-Z]
    | [A-Z]{{1,2}}\d{{7,8}}
    | [A-Z]\d{{3}}{_S}\d{{4}}{_S}\d{{4}}
    | [XYZ]-?\d{{7}}-?[A-Z]
    | \d{{13}}(?:[ ]?\d{{2}})?
    | \d{{9}} | \d{{11}}
    )(?![\w/]|[.,-]\d)""",
    re.X,
)
_CALL = re.compile(r"tel|phone|call|fax|ring|reach|number is|mobile|dial|erreichbar|ist unter|rückfrage|telefon|joignable|appel|portable|llam|atiende|teléfono|móvil|contact", re.I)
_FILE = re.compile(r"\b(?:file|build|version|lot|docket|invoice|policy|bundle|pages?|case|item|factura|facture|rechnung|rôle|rollo|expediente|aktenzeichen|compan(?:y|ies)|register(?:ed)?|numéro|société|sociedad|gesellschaft|hrb|ref|reference|order|account|iban|usd|eur|gbp)\b\.?(?: (?:no|number|nr|n°)\b\.?)?[ :#]*$", re.I)
_COMPANY = re.compile(r"\b(?:compan(?:y|ies)|société|sociedad|gesellschaft|rcs|hrb|siren|invoice|policy)\b[^.;\n]{0,60}$", re.I)
_PERSONAL = re.compile(
    r"passport|passeport|pasaporte|\bdocumento\b|reisepass|licen[cs]e|führerschein|permis|tax file|steuer|social security|ssn|national id|\bid\b|\bdni\b|\bnie\b|\bnif\b|ausweis|identi|holder number|personennummer|personal|personnel|number is|contact data|\bnino\b|sozialversicherung|sécurité sociale|titulaire|inhaber|taxpayer",
    re.I,
)


_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_RUN_LEFT = re.compile(r"[\d -]*$")
_RUN_RIGHT = re.compile(r"[\d -]*")
_NIE = str.maketrans("XYZ", "012")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(body: str, key: str) -> bool:
    return 97 - int(body) % 97 == int(key)


def iban(s: str) -> bool:
    """Whether the check digits of an account number hold."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spanish_letter(s: str) -> bool:
    """Whether the last letter of a national or foreigner's number follows from its digits."""
    digits = re.sub(r"\D", "", s[0].translate(_NIE) + s[1:])
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(digits) % 23] == s[-1]


def _card(t: str, start: int, end: int) -> bool:
    """Whether a span lies in a row of 13 to 19 digits in groups that is a valid card number."""
    left, right = _RUN_LEFT.search(t, max(0, start - 24), start), _RUN_RIGHT.match(t, end, end + 24)
    if not t[start].isdigit() or t[max(0, left.start() - 1) : left.start()] in ("+", "("):
        return False
    digits = re.sub(r"\D", "", t[left.start() : right.end()])
    return 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits)


def _phone_score(s: str, left: str) -> float:
    digits = re.sub(r"\D", "", s)
    if not 8 <= len(digits) <= 15:
        return 0.0
    score = 0.75 if s.startswith(("+", "00", "(")) else 0.55
    if not s.startswith(("+", "0")) and len(digits) in (10, 11):  # North American plan: area and exchange begin with 2 to 9
        ten = digits[-10:]
        score += 0.1 if ten[0] in "23456789" and ten[3] in "23456789" and (len(digits) == 10 or digits[0] == "1") else -0.3
    if _CALL.search(left):
        score += 0.3
    if _FILE.search(left):
        score -= 0.6
    return score


def _id_score(s: str, left: str) -> float:
    digits = re.sub(r"\D", "", s)
    lettered = s[0].isalpha() or s[-1].isalpha()
    score = 0.35
    if lettered or len(digits) == 13:
        score += 0.2
    elif re.fullmatch(r"\d{3}\D+\d{2}\D+\d{4}", s):
        score += 0.25
    if len(digits) == 15:
        score += 0.3 if mod97(digits[:13], digits[13:]) else -0.2
    if re.fullmatch(r"\d{8}\W{0,2}[A-Z]|[XYZ]\W?\d{7}\W?[A-Z]", s):
        score += 0.2 if spanish_letter(s) else -0.2
    personal = bool(_PERSONAL.search(left))
    against = 0.5 * (bool(_FILE.search(left)) and not re.search(r"tax file[ :]*$|order n", left, re.I)) + 0.4 * bool(_COMPANY.search(left))
    if personal:
        score += 0.4
        if against and len(digits) in (9, 11) and not lettered and luhn(digits):
            score += against - 0.2  # both kinds of words are near: the check digit decides
    return score - against


#: What every number of interest has: digits and signs between digits, seven at least.
_DIGITS = re.compile(r"\d[\d ()./+\n-]{5,}\d")


def numbers(t: str) -> Iterator[Span]:
    if not _DIGITS.search(t):
        return
    accounts = [m.span() for m in _IBAN.finditer(t) if iban(m.group())]
    free = lambda a, b: not any(x < b and a < y for x, y in accounts) and not _card(t, a, b)
    for m in _PHONE.finditer(t):
        score = _phone_score(m.group(), t[max(0, m.start() - 40) : m.start()])
        if score >= THRESHOLD and free(m.start(), m.end()):
            yield Span(m.start(), m.end(), "PHONE", min(1.0, score))
    for m in _ID.finditer(t):
        score = _id_score(m.group(), t[max(0, m.start() - 110) : m.start()])
        if score >= THRESHOLD and free(m.start(), m.end()):
            yield Span(m.start(), m.end(), "ID_NUMBER", min(1.0, score))


# ---- street addresses ---------------------------------------------------------------------------------------------

_W = r"(?: {1,2}| ?\n ?)"
_NO = r"\d{1,4}(?: ?[A-Ha-h]\b)?"
_ENGLISH = re.compile(
    rf"(?<![\w.,/-])(?<!§ ){_NO}{_W}(?:[A-ZÀ-Ý][\w'-]*{_W}){{1,3}}?(?:Street|Str?|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Terrace|Ter|Way|Boulevard|Blvd|Drive|Dr|Close|Crescent|Place|Pl|Square|Sq|Row|Mews|Gardens|STREET|ST|ROAD|RD|AVENUE|AVE|LANE|COURT|TERRACE|WAY|BOULEVARD|BLVD|DRIVE|CLOSE|PLACE|SQUARE)\b\.?"
)
_FRENCH = re.compile(rf"(?<![\w./-])\d{{1,4}}(?:{_W}?(?:bis|ter|quater))?,?{_W}(?:rue|avenue|av\.|boulevard|bd|chemin|place|quai|allée|impasse|cours|route|square|passage){_W}(?:(?:de|du|des|la|le|les|d'|l'){_W}?){{0,2}}[A-ZÀ-Ý][\w'-]*", re.I)
_SPANISH = re.compile(rf"\b(?:C/|Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrer|Ronda|Travesía){_W}?(?:(?:de|del|la|las|los){_W}){{0,2}}[A-ZÀ-Ý][\w'-]*(?:{_W}[A-ZÀ-Ý][\w'-]*){{0,2}},?{_W}?(?:n\.? ?[º°o]\.?{_W}?|núm\.?{_W}?)?\d{{1,4}}\b", re.I)
_GERMAN = re.compile(rf"\b[A-ZÄÖÜ][\w-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|STRASSE|STRAßE|STR\.|WEG|PLATZ|ALLEE|GASSE|Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse){_W}\d{{1,4}}(?: ?[a-h]\b)?")
#: Street types as they are looked for in lower case without accents, by language; the words around decide.
_TYPES = {
    6: "st str street road rd avenue ave lane ln court ct terrace way boulevard blvd drive dr close crescent place square row mews gardens".split(),
    7: "rue avenue boulevard chemin place quai allee impasse cours route".split(),
    8: "c/ calle avenida avda plaza paseo camino carrer ronda travesia".split(),
    9: ["straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring ", "damm", "ufer"],
}
_NO_STREET = frozenset("the of by each in on at any all if save from within and or no this that court way place for to under upon when where article section clause annex item page".split())


def addresses(t: str, low: str, hits: list) -> Iterator[Span]:
    languages = set()
    for last, cases in hits:
        for kind, word in cases:
            if kind < 6:
                continue
            languages.add(kind)
            start, end = last - len(word) + 1, last + 1
            if kind > 6 or (start and low[start - 1].isalpha()) or (end < len(low) and (low[end].isalnum() or low[end] == "_")):
                continue
            # the house number stands at most three words before the street type
            for x in _ENGLISH.finditer(t, max(0, start - 60), min(len(t), end + 1)):
                if x.start() <= start < x.end():
                    words = re.findall(r"[^\W\d_][\w'-]*", x.group())[:-1]
                    words = [w for w in words if len(w) > 1 or len(words) == 1]
                    if words and not any(w.lower() in _NO_STREET for w in words) and "\n\n" not in x.group():
                        yield Span(x.start(), x.end(), "ADDRESS", 0.8)
    if 7 in languages:
        for m in _FRENCH.finditer(t):
            if re.search(r"[A-ZÀ-Ý]", re.split(r"rue|avenue|av\.|boulevard|bd|chemin|place|quai|allée|impasse|cours|route|square|passage", m.group(), maxsplit=1, flags=re.I)[-1]):
                yield Span(m.start(), m.end(), "ADDRESS", 0.8)
    if 8 in languages:
        for m in _SPANISH.finditer(t):
            if re.search(r"(?:/|\s)(?:(?:de|del|la|las|los)\s+)*[A-ZÀ-Ý]", m.group()[1:], 0):
                yield Span(m.start(), m.end(), "ADDRESS", 0.8)
    if 9 in languages:
        for m in _GERMAN.finditer(t):
            yield Span(m.start(), m.end(), "ADDRESS", 0.8)


# ---- names of persons ---------------------------------------------------------------------------------------------

_PARTICLE = r"(?:[Vv]an|[Vv]on|[Dd]e|[Dd]el|[Dd]i|[Aa]l|[Ee]l|[Ll]a|[Dd]er|[Dd]en|VAN|VON|DE|DEL|DI|AL|EL|LA)"
_SURNAME = r"[A-ZÀ-Ý][\w']*(?:-[A-ZÀ-Ý][\w']+)*"
_AFTER = re.compile(rf"(?P<mid>(?:{_W}[A-Z]\.){{0,2}}){_W}(?P<part>(?:(?:{_PARTICLE}){_W}){{0,2}})(?P<sur>{_SURNAME})")
_AFTER_LOW = re.compile(rf"(?:{_W}[a-z]\.){{0,2}}{_W}(?:(?:van|von|de|del|di|al|el|la|der|den){_W}){{0,2}}(?P<sur>[a-zà-ÿ']{{3,}}(?:-[a-zà-ÿ']+)*)")
_BEFORE = re.compile(rf"(?:(?:{_PARTICLE}){_W}){{0,2}}(?P<sur>{_SURNAME}),{_W}$")
_TITLE = re.compile(rf"\b(?P<title>Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|M|Sr|Sra|D|Dña|Don|Doña|Señora?|Judge|Justice|Sir|Madame|Monsieur|MR|MRS|MS|DR|PROF|HERRN?|FRAU|MME|JUDGE)\b\.?{_W}(?:(?:Dr|Prof)\.?{_W})?(?=[A-ZÀ-Ý])")
_INITIALS = re.compile(rf"(?<![\w.&-])(?:[A-ZÀ-Ý]\.(?:{_W}|-)?){{1,3}}(?:(?:{_PARTICLE}){_W}){{0,2}}(?P<sur>[A-ZÀ-Ý][\w']{{2,}}(?:-[A-ZÀ-Ý][\w']+)*)")
_INVERSE_INITIAL = re.compile(rf"(?<![\w-])(?P<sur>{_SURNAME}),{_W}[A-Z]\.(?=$|[\W])")
_SHIP = re.compile(r"\b(?:vessel|ship|steamer|tanker|ferry|navire|bateau|paquebot|buque|barco|schiff|dampfer|m/?[vs]|ss)\W+$", re.I)
_PLACE_LEFT = re.compile(r"\b(?:quai|pont|place|port|muelle|puente|plaza|kai|brücke|rue|avenue|calle|avenida|chemin)\W+(?:de\W+|del\W+)?$", re.I)
_NOT_SURNAME = frozenset(
    """protocol act convention treaty accord quay bridge pier dock harbour harbor port street road lane court avenue square house tower programme program asset works facility
    partners associates company corporation incorporated limited industries holdings insurance logistics foods shipping brothers services technologies properties textiles pharma pharmaceuticals engineering communications
    period mark holder agent provider committee agreement schedule annex clause section article code fund trust bank island bay river valley foundation institute university hospital school
    and or of the for to in on at by as was is has had shall may must will kai brücke straße gesetz abkommen ley loi decreto convenio tratado llc llp gmbh ag ltd inc s sa sl july june may april march january february august september october november december""".split()
)
_BUSINESS = frozenset("partners associates company corporation industries holdings insurance logistics foods shipping brothers services technologies properties textiles pharma pharmaceuticals engineering communications".split())
_LOW_STOP = _NOT_SURNAME | frozenset(
    "und oder y et e ou o der die das den dem ist hat war est a le la les du des un une ne doit peut el los las un una no que se con por para told testified holds countersigned agrees undertakes dismissed contends am are be been may not any each this with from der when where who which that whose".split()
)
_AMBIGUOUS = frozenset("will rich bill sue pat rob jo ed ben sandy mark nat mina rick dick jack frank art isa dora tori meg peg hank len leo sam dan ted tad ned kate belle eliza pete matt mick jim joe tony tina chris terry tom harry annie john james george henry peter david maria pierre karl".split())
#: Short forms that are ordinary words in lower case.
_WORDS = frozenset("will rich bill sue pat rob jo ed ben mark nat mina dick jack frank art tori meg peg hank len leo belle chris terry sandy chuck don al".split())
_ARTICLE = re.compile(r"\b(?:the|le|la|el|der|die|das)\s+$", re.I)
_CUE_LEFT = re.compile(r"(?:name:|whereof|signed by|attention:|sent to|witness|employee,|names|c/o|issued to|wife of|délivré à|nombre de|inhaber|write to|judge)\s*$", re.I)
_CUE_PERSON = re.compile(r"(?:name:|whereof|signed by|attention:|c/o|issued to|wife of|délivré à|a nombre de|inhaber)\s*$", re.I)
_ORG_RIGHT = re.compile(r"(?:\W{1,2}(?:[A-ZÀ-Ý&][\w'&-]*)){0,3}\W{1,2}(?:LLC|LLP|GmbH|Ltd|Inc|AG\b|S\.A\.|S\.L\.|Corporation|Company|Limited|Incorporated|Partners|Associates|Industries|Holdings|Group)\b")

#: Words (lower case, without accents) behind which a name stands; behind those of the second kind also as 'surname, given name'.
_CUES = tuple("signed by;attention;attn;attn.;c/o;witness;witnessed by;whereof;wife of;husband of;employee,;signe par;signee par;a l'attention de;aux soins de;temoin;epouse de;unterzeichnet von;unterschrieben von;zu handen;zu handen von;z. hd.;z.hd.;z. hd. von;z.hd. von;zeuge;zeugin;firmado por;firmada por;a la atencion de;testigo;esposa de".split(";"))
_NAME_CUES = tuple("name:;name :;nom:;nom :;nombre:;issued to;delivre a;delivree a;au nom de;inhaber;inhaberin;ausgestellt auf;ausgestellt fur;expedido a;expedida a;a nombre de".split(";"))
_NAMED = r"[A-ZÀ-Ý][\w']+(?:-[A-ZÀ-Ý][\w']+)*"
_CUED = re.compile(rf" ?:?{_W}(?P<first>{_NAMED})(?:{_W}[A-ZÀ-Ý]\.){{0,2}}{_W}(?:{_PARTICLE}{_W}){{0,2}}(?P<second>{_NAMED})(?P<more> {{1,2}}(?:{_PARTICLE} {{1,2}}){{0,2}}(?P<third>{_NAMED}))?")
_CUED_INVERSE = re.compile(rf" ?:?{_W}(?P<first>(?:{_PARTICLE}{_W}){{0,2}}{_NAMED}),{_W}(?P<second>{_NAMED})(?:{_W}[A-Z]\.(?!\w))?(?! ?[,&])")
_NO_PERSON_NAME = re.compile(r"(?:compan\w*|business|trade|corporate|legal|file|project|product|vessel|brand|domain|firm\w*|entity|place|event|bank|court|ship|property|societe|empresa|unternehmen\w*)\W+$")
#: Capitalised words behind such words that begin or continue no name of a person.
_NO_NAME = _NOT_SURNAME | frozenset(
    """a all an any both each either every no one our several some such that these this those two whereof which who whom your
    general counsel legal department chief financial executive operating officer director directors manager managing president secretary treasurer vice head office board chairman chair
    captain judge justice court minister ministry state government city county republic kingdom united north south east west new saint san santa port authority
    seller buyer purchaser landlord tenant lessor lessee lender borrower licensee licensor contractor customer client supplier vendor party parties group council commission
    mr mrs ms miss dr prof sir madam messrs herr herrn frau mme mlle monsieur madame me don dona senor senora sr sra
    der die das den dem des ein eine einer le la les un une des el los las una
    parteien beide beiden partei parties vertrag gericht bundesrepublik stadt land ambas partes deux direction direktor geschaftsfuhrer vorstand abteilung directeur directrice gerente""".split()
)

#: Words (lower case, without accents) that say of the name before them what only persons do or are, and such as weakly do.
_DOES = tuple(
    """testified;was born;born on;born in;resides;residing;who resides;lives at;lives in;lived at;swore;deposed;died on;died in;is married;aged;widow of;widower of;
    a declare;ne le;nee le;nee a;demeurant;domicilie;domiciliee;demeure;a temoigne;epoux de;
    geboren;wohnhaft;wohnt;sagte aus;verheiratet;
    nacido en;nacida en;nacido el;nacida el;domiciliado;domiciliada;residente en;reside en;declaro""".replace("\n", "").split(";")
)
_MAY_DO = tuple("signed;agreed;told;wrote;said;countersigned;a signe;unterschrieb;unterzeichnete;firmo".split(";"))
#: Words before a name that make one of a person likely.
_CALLED = tuple("please contact;contact;call;ask for;speak to;speak with;write to;care of;son of;daughter of;mother of;father of;brother of;sister of;husband of".split(";"))
#: Endings of given names in several languages, which make a capitalised word likelier to be one.
_ENDINGS = ("ina", "ella", "elle", "ette", "etta", "ine", "anna", "bert", "fried", "helm", "slav", "mir", "ito", "ita", "isa", "ia", "iel", "ael", "eth", "ias", "ius", "ette", "endra", "esh", "ana", "ara")
_SHAPE = rf"(?P<first>{_NAMED})(?:{_W}[A-ZÀ-Ý]\.)?{_W}(?:{_PARTICLE}{_W}){{0,2}}(?P<second>{_NAMED})"
_NAME_BEFORE = re.compile(rf"(?<![\w'-]){_SHAPE},?{_W}?$")
_NAME_BEHIND = re.compile(rf"{_W}{_SHAPE}(?![\w'-]| ?&)")
_JOINED_LEFT = re.compile(rf"(?<![\w'-]){_SHAPE}{_W}(?:and|und|et|y|e|or|oder|ou|o){_W}$")
_JOINED_RIGHT = re.compile(rf"{_W}(?:and|und|et|y|e|or|oder|ou|o){_W}{_SHAPE}(?![\w'-]| ?&)")
#: Capitalised words of offices and things that are contacted, sign or agree, beside those that are no name anywhere.
_NO_ACTOR = frozenset("support team desk service services help sales technical human resources account data privacy compliance effective date purchase price agreement governing law third confidential information business day working notice payment intellectual property force majeure security center centre central bank federal national public international european american british french german spanish".split())


def _actor(m: re.Match, low: str) -> bool:
    """Whether two words name an office or a thing; some such words are surnames, too."""
    return low[slice(*m.span("first"))] in _NO_ACTOR or low[slice(*m.span("second"))] in _NO_ACTOR - {"price", "law", "french", "german", "english"}


def _shape_score(m: re.Match, t: str, low: str) -> float:
    """How much two capitalised words look like a name by themselves; 0 where one of them is no name."""
    first, second = m["first"], m["second"]
    if _no_name(first) or _no_name(second) or _actor(m, low) or {low[slice(*m.span("first"))], low[slice(*m.span("second"))]} & _LOW_STOP or first.isupper() != second.isupper():
        return 0.0
    if _ORG_RIGHT.match(t, m.end("second"), m.end("second") + 60) or _SHIP.search(t[max(0, m.start("first") - 20) : m.start("first")]) or _PLACE_LEFT.search(t[max(0, m.start("first") - 30) : m.start("first")]):
        return 0.0
    score = 0.3
    given = low[m.start("first") : m.end("first")]
    if given in COMMON or given in FULL_OF:
        score += 0.35
    elif given.endswith(_ENDINGS):
        score += 0.1
    return score


def _by_context(t: str, low: str, start: int, end: int, kind: int) -> Span | None:
    """A name in no table before (kinds 3 and 4) or behind (5) a word of context."""
    if (start and low[start - 1].isalnum()) or (end < len(low) and low[end].isalnum()):
        return None
    if kind == 5:
        m = _NAME_BEHIND.match(t, end, end + 90)
    else:
        m = _NAME_BEFORE.search(t, max(0, start - 90), start)
    score = _shape_score(m, t, low) if m else 0.0
    score += {3: 0.3, 4: 0.15, 5: 0.3}[kind] if score else 0.0
    return Span(m.start("first"), m.end("second"), "PERSON", min(0.7, score)) if score >= THRESHOLD else None


def _joined(t: str, low: str, span: Span) -> Iterator[Span]:
    """Names joined by 'and' to one that was found."""
    for m in (_JOINED_LEFT.search(t, max(0, span.start - 90), span.start), _JOINED_RIGHT.match(t, span.end, span.end + 90)):
        if m and _shape_score(m, t, low):
            yield Span(m.start("first"), m.end("second"), "PERSON", 0.5)


@lru_cache(maxsize=1)
def _words():
    """Given names (kind 0), words of context and street types in one automaton: a word may be of several kinds."""
    import ahocorasick

    cases: dict[str, list[tuple[int, str]]] = {}
    for name in {*FULL_OF, *COMMON}:
        if len(name) > 1:
            cases.setdefault(name, []).append((0, name))
    for kind, cues in ((1, _CUES), (2, _NAME_CUES), (3, _DOES), (4, _MAY_DO), (5, _CALLED)):
        for cue in cues:
            words = cue.strip().split(" ")
            for gaps in product((" ", "\n", "  "), repeat=len(words) - 1):
                spelt = "".join(w + g for w, g in zip(words, (*gaps, ""), strict=True))
                cases.setdefault(spelt, []).append((kind, spelt))
    for kind, types in _TYPES.items():
        for word in types:
            cases.setdefault(word, []).append((kind, word))
    a = ahocorasick.Automaton()
    for word, found in cases.items():
        a.add_word(word, tuple(found))
    a.make_automaton()
    return a


def _no_name(word: str) -> bool:
    return any(w in _NO_NAME for w in word.lower().translate(_PLAIN).strip("'").split("-"))


def _cued(t: str, low: str, start: int, end: int, inverse: bool) -> Span | None:
    """The name behind a cue, of two or three words with capitals that are not known given names (those are found by themselves)."""
    if (start and low[start - 1].isalnum()) or (inverse and low.startswith("name", start) and _NO_PERSON_NAME.search(low, max(0, start - 20), start)):
        return None
    m = (_CUED_INVERSE.match(t, end, end + 120) if inverse else None) or _CUED.match(t, end, end + 120)
    if not m or _actor(m, low) or _no_name(m["first"].split()[-1]) or _no_name(m["second"]) or low[m.start("first") : m.end("first")] in FULL_OF:
        return None
    stop = m.end()
    if m.re is _CUED and m["third"] and (_no_name(m["third"]) or re.match(r"\w", t[stop : stop + 1])):
        stop = m.end("second")
    if re.match(r"[\w@]", t[stop : stop + 1]) or _ORG_RIGHT.match(t, m.end("second"), stop + 60) or re.match(r"\s?&", t[stop : stop + 2]):
        return None
    return Span(m.start("first"), stop, "PERSON", 0.86)


def _bad_surname(s: str) -> bool:
    return s.lower().strip("'-") in _NOT_SURNAME or s.lower().split("-")[0] in _NOT_SURNAME


def persons(t: str, low: str, hits: list) -> Iterator[Span]:
    for last, cue, name in ((last, *case) for last, cases in hits for case in cases if case[0] < 6):
        start, end = last - len(name) + 1, last + 1
        if cue:
            if span := _by_context(t, low, start, end, cue) if cue > 2 else _cued(t, low, start, end, cue == 2):
                yield span
            continue
        if (start and (low[start - 1].isalnum() or low[start - 1] in "_@+")) or (end < len(low) and (low[end].isalnum() or low[end] in "_@")):
            continue
        if start > 1 and low[start - 1] in ".-" and low[start - 2].isalnum() and not low[start - 2].isupper() and not t[start - 2].isupper():
            continue  # inside an address or a compound
        word, left = t[start:end], t[max(0, start - 30) : start]
        if _SHIP.search(left) or _PLACE_LEFT.search(left):
            continue
        if word[0].isupper():
            m = _AFTER.match(t, end, end + 80)
            if m and not _bad_surname(m["sur"]) and (len(m["sur"]) > 1 or m["part"]):
                if name in _AMBIGUOUS and _ARTICLE.search(left):
                    continue
                if name in _AMBIGUOUS and not _CUE_LEFT.search(left) and (m["sur"].isupper() != word.isupper() and len(m["sur"]) > 1 or "\n" in m.group()):
                    continue
                if not word.isupper() and m["sur"].isupper() and len(m["sur"]) < 3:
                    continue
                if _ORG_RIGHT.match(t, m.end(), m.end() + 60) or re.match(r"\s?&", t[m.end() : m.end() + 2]):
                    continue
                yield Span(start, m.end(), "PERSON", 0.85)
                continue
            b = _BEFORE.search(t, max(0, start - 45), start)
            if b and not _bad_surname(b["sur"]) and b["sur"].lower() not in FULL_OF and not re.match(r"\s?[&-]", t[end : end + 2]):
                from_ = b.start("sur") if re.search(r"[a-zà-ÿ]\s{1,2}$", t[max(0, b.start() - 3) : b.start()]) else b.start()
                stop = re.compile(rf"{_W}[A-Z]\.").match(t, end, end + 6)
                yield Span(from_, stop.end() if stop else end, "PERSON", 0.75)
        elif name not in _WORDS or _CUE_PERSON.search(left):
            m = _AFTER_LOW.match(t, end, end + 60)
            if m and m["sur"] not in _LOW_STOP:
                yield Span(start, m.end(), "PERSON", 0.6)
            else:
                b = re.compile(rf"(?P<sur>[a-zà-ÿ'-]{{3,}}),{_W}$").search(t, max(0, start - 40), start)
                if b and b["sur"] not in _LOW_STOP:
                    yield Span(b.start(), end, "PERSON", 0.55)
    for m in _TITLE.finditer(t):
        at = m.end()
        x = re.compile(rf"(?:[A-ZÀ-Ý]\.{_W}){{0,2}}(?:(?:{_PARTICLE}){_W}){{0,2}}{_SURNAME}(?:{_W}[A-Z]\.)?(?:{_W}(?:(?:{_PARTICLE}){_W}){{0,2}}{_SURNAME})?").match(t, at, at + 90)
        if not x:
            continue
        words = re.findall(r"[^\W\d_][\w'-]*", x.group())
        if not words or _bad_surname(words[0]) or (m["title"] in ("M", "D") and m.group()[len(m["title"])] != "."):
            continue
        first = words[0].lower().translate(_PLAIN)
        if m["title"] in ("M", "D") and len(words[0]) > 1 and first not in FULL_OF and not re.search(r"(?:[Ss]elon|[Ss]egún|que)\s{1,2}$", t[max(0, m.start() - 8) : m.start()]):
            continue  # an initial
        if m["title"] in ("M", "D", "Sr") and re.search(rf"(?:[A-ZÀ-Ý][\w']+|[A-Z]\.){_W}$", t[max(0, m.start() - 25) : m.start()]) and not re.search(r"(?:Selon|Según|Por|Para|Par|De|Que|Don)\s$", t[max(0, m.start() - 8) : m.start()]):
            continue  # a middle initial
        if not _SHIP.search(t[max(0, m.start() - 20) : m.start()]):
            yield Span(x.start(), x.end(), "PERSON", 0.7)
    for m in _INITIALS.finditer(t):
        if _bad_surname(m["sur"]) or _ORG_RIGHT.match(t, m.end(), m.end() + 60) or _SHIP.search(t[max(0, m.start() - 20) : m.start()]):
            continue
        before = t[max(0, m.start() - 14) : m.start()]
        word = re.search(r"([A-ZÀ-Ý][\w']+) {1,2}$", before)
        if word and word[1].lower() in _BUSINESS:
            continue  # the end of a company's legal form
        yield Span(m.start(), m.end(), "PERSON", 0.6)
    for m in _INVERSE_INITIAL.finditer(t):
        if not _bad_surname(m["sur"]) and m["sur"].lower() not in FULL_OF and not re.search(r"\d\W*$|[A-Z]\w+ $", t[max(0, m.start() - 12) : m.start()]):
            yield Span(m.start(), m.end(), "PERSON", 0.55)


# ---- one text -----------------------------------------------------------------------------------------------------


def find_spans(text: str | None) -> list[Span]:
    """Accepted spans of a text in order, without overlaps, in its own offsets."""
    if not text:
        return []
    t, where = fold(text)
    low = plain_lower(t)
    hits = list(_words().iter(low))
    named = list(persons(t, low, hits))
    found = [*emails(t), *addresses(t, low, hits), *numbers(t), *named, *(j for s in named for j in _joined(t, low, s))]
    found.sort(key=lambda s: (ORDER[s.kind], -s.score, s.start, -s.end))
    taken: list[Span] = []  # in order of position
    for s in found:
        i = bisect_left(taken, s)
        if (i == 0 or taken[i - 1].end <= s.start) and (i == len(taken) or taken[i].start >= s.end):
            taken.insert(i, s)
    if where is not None:
        taken = [Span(where[s.start], where[s.end - 1] + 1, s.kind, s.score) for s in taken]
    return taken


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its type in square brackets."""
    if not text:
        return text
    out, at = [], 0
    for s in find_spans(text):
        out += [text[at : s.start], f"[{s.kind}]"]
        at = s.end
    return "".join([*out, text[at:]])


# ---- frames -------------------------------------------------------------------------------------------------------


def find_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, pii_type, char_start, char_end, score), one row per occurrence. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, s.kind, s.start, s.end, s.score) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for s in find_spans(t.as_py())]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row_id", "pii_type", "char_start", "char_end", "score"])

    src = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null and t <> ''")
    return src.mapInArrow(run, "row_id long, pii_type string, char_start int, char_end int, score double")


def redact_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_id, redacted): every text, null for null. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t.as_py()) for t in b.column(1)], pa.string())], names=["row_id", "redacted"])

    return df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "row_id long, redacted string")
