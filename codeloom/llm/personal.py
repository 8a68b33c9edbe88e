"""Personal information in free text: find it, and replace it by placeholders or surrogates.

Detection goes by form and context: e-mail addresses in any spelling, phone numbers of known
plans after a cue or with an international prefix, identity numbers after their label, street
addresses by street words, names after or before a cue or as known given and family names.
Replacement is keyed: equal values get equal replacements wherever they stand in the corpus, as
nothing depends on the other values of a text. Different values get different ones: numbers go
through a keyed permutation, words are invented from so many syllables that two never agree in
practice. A surrogate keeps type, format, script, letter case and, for names, the gender of the
pool it comes from; e-mail addresses keep their domain.

Defined cases: null and empty texts have no cases and stay as they are; a value that occurs more
than once in a text is one row; overlapping finds keep the earlier, then longer one, names inside
e-mail addresses are no case of their own; texts are read whole, however long.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# ------------------------------------------------------------------ detection

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?(?:\[\s?at\s?\]|\(\s?at\s?\)|\{\s?at\s?\}|<at>)\s?|\s?\[@\]\s?|\s?\(@\)\s?)"
_DOT = r"(?:\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{\s?dot\s?\}|\[\.\]|\(\.\))\s?|\.|\sdot\s)"
EMAIL = re.compile(
    rf"(?<![\w.+/-]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![\w@]|:[\w~/]|-\w)", re.I
)
SPELT_EMAIL = re.compile(
    rf"(?<![\w.+/-])(?:{_LOCAL}(?:\sdot\s{_LOCAL})*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?!\w)"
    rf"|{_LOCAL}(?:\sdot\s{_LOCAL})*\sat\s{_LABEL}(?:\sdot\s{_LABEL})*\sdot\s[A-Za-z]{{2,}}(?!\w))",
    re.I,
)
_AT_SIGNS = ("at]", "at )", "at ]", "at)", "at}", "<at>", "[@]", "(@)")
_REMOTE = re.compile(r"^(?:git|svn|hg|ssh|root)@", re.I)

# Number plans, the more specific first.
_PHONE_FORMS = (
    r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    r"(?:\+33|0033) ?(?:\(0\) ?)?[1-9](?:[ .-]?\d{2}){4}",
    r"0[1-9](?:([ .-]?)\d{2})(?:\1\d{2}){3}",
    r"(?:\+44|0044) ?(?:\(0\) ?)?\d{2,4}[ -]?\d{3,4}[ -]?\d{3,4}",
    r"0\d{2,4} \d{4} \d{4}",
    r"(?:\+49|0049) ?(?:\(0\) ?)?\d{2,5}[ /-]?\d{3,8}(?:[ -]\d{1,4})?",
    r"0\d{2,5}[ /-]\d{4,8}(?:[ -]\d{1,4})?",
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){1,4}[ .-]?\d{2,5}",
    r"0\d{8,11}",
)
PHONE_CUE = re.compile(
    r"(?:\b(?:tele)?phone|\btelefon|\btéléphone|\btel|\btél|\bfon|\bmobile|\bmobil|\bportable|\bcell|\bfax|\bwhatsapp|\bhandy|\bcall|\bring|\brückruf unter"
    r"|\berreichbar unter|\banrufen|\bappelez|\bon-call at|\breach (?:me|us|him|her|them) (?:at|on)|\bnumber|📞|☎|📱)[\s.:#=]*$",
    re.I,
)
_NOT_PHONE = re.compile(r"(?:\b(?:part no|ticket|build|version|sha|id|offset|lines?|port|rev|issue|order|invoice|isbn|serial)[\s.:#]*|[\w.#/-])$", re.I)
PHONES = [re.compile(rf"(?<![\w+])(?:{form})(?![\w]|[-./]\d)") for form in _PHONE_FORMS]

ID_LABEL = re.compile(
    r"(?:\b(?:ssn|social security (?:no\.?|number|#)|social insurance number|national id(?:entity)?(?: (?:no\.?|number|card))?|id card(?: (?:no\.?|number))?"
    r"|(?:personal )?identity (?:no\.?|number|card)|personal (?:id|number)|passport(?: (?:no\.?|number|#))?|passeport(?: n°| numéro)?|reisepass(?:nummer)?"
    r"|(?:driver'?s?|driving) licen[cs]e(?: (?:no\.?|number))?|führerschein(?:nummer)?|tax (?:id|number|no\.?)|tin|steuer-?id|steuer(?:liche )?\s?identifikationsnummer"
    r"|steuernummer|personalausweis(?:nummer)?|sozialversicherungsnummer|nir|numéro (?:de sécurité sociale|fiscal|d'identité)|n° (?:de )?sécurité sociale|dni|nie|nif"
    r"|(?:his|her|their|my) number is))\s?[:=#]?\s?",
    re.I,
)
ID_FORM = re.compile(
    r"(?:\d \d\d \d\d \d\d \d{3} \d{3} \d\d|\d{13} ?\d\d|\d\d \d{3} \d{3} \d{3}|\d{3}[- ]\d\d[- ]\d{4}|\d{6,8}[-+]\d{3,4}|[A-Z]{1,2}\d[A-Z0-9]{5,9}"
    r"|\d{8,12}[A-Z]?|[A-Z]{1,2}\d{6,9}|\d{2,4}(?:[ -]\d{2,4}){2,4})(?![\w]|-\d)"
)

_UP = r"A-ZÀ-ÖØ-ÞŁŚŽŠ"
_LOW = r"a-zß-öø-ÿłśžš"
_PLACE = rf"(?:\d{{4,5}} [{_UP}][{_UP}{_LOW}'’-]+|[{_UP}][{_UP}{_LOW}'’-]+ \d{{4,5}})"
_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Close|Way|Court|Ct|Terrace|Place|Pl|Hill|Gardens|Row|Crescent|Square|Sq|Boulevard|Blvd|Parkway|Walk|Mews)"
_EN = rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) ?#?\w{{1,4}}, )?\d{{1,4}}[a-zA-Z]? (?:[{_UP}{_LOW}][{_UP}{_LOW}'’-]+ ){{1,3}}?{_EN_STREET}\b(?:\.(?=[.,;]| [{_LOW}-]))?"
_FR = rf"\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|avenue|chemin|boulevard|place|impasse|allée|quai|route|cours|square|passage) (?:(?:de la|de l['’]|du|des|de|d['’]|aux?|à la|la|le|les) ?)?(?:[{_UP}][{_UP}{_LOW}'’-]+ ?){{1,4}}(?<! )"
_DE = rf"(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Alte|Neue|Obere|Untere) )?[{_UP}][{_LOW}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ring|ufer|steig|pfad|markt|hof|graben|chaussee) \d{{1,4}}[a-zA-Z]?"
_ES = rf"(?:Calle|Avenida|Plaza|Paseo|Camino) (?:(?:de la|del|de los|de) )?(?:[{_UP}][{_UP}{_LOW}]+ ?){{1,3}},? \d{{1,4}}"
ADDRESS_PLACE = re.compile(rf", {_PLACE}(?:-[{_LOW}{_UP}]+)*(?!\w)")
ADDRESS_HEAD = re.compile(rf"(?<![\w.,/-])(?:{_FR}|(?i:{_EN})|{_DE}|{_ES})(?!\w)")

#: A number that counts something is no house number.
_COUNTED = re.compile(r"\b(?:step|stage|phase|item|section|chapter|version|line|task|build|release|page|figure|table|schritt|punkt|étape|point|paso|no\.|nr\.)\s$", re.I)

_CAP = rf"[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)*"
_ALL = rf"[{_UP}]{{2,}}(?:[-'’][{_UP}]{{2,}})*"
_WEE = rf"[{_LOW}]{{2,}}(?:[-'’][{_LOW}]+)*"
_INITIAL = rf"[{_UP}]\.(?: ?[{_UP}]\.)?"
NAME = rf"(?:{_CAP}, {_CAP}(?: {_INITIAL})?|{_INITIAL} {_CAP}|{_CAP}(?: {_INITIAL})? {_CAP}|{_ALL}, {_ALL}|{_ALL} {_ALL})"
_TITLE = r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Herr|Frau|Mme|M|Sr|Sra)\.? )*"
NAME_AFTER = re.compile(
    r"(?:\b(?:(?:Reviewed|Signed-off|Acked|Tested|Reported|Suggested|Co-authored|Approved|Written|Fixed|Found)-?[ -]?by|Owner|Author(?:in|s)?|Autorin|Autor|Auteur|Reviewer|Maintainer|Contact|Kontakt|Assignee|Cc|From|Name)\s?: ?"
    r"|\b(?:AUTHOR|REVIEWER|OWNER|MAINTAINER):? |@author |\bTODO\(|\bFIXME\(|(?i:\b(?:thanks to|thank you,?|danke an|dank an|merci à|gracias a|paired with|worked with|talk(?:ed)? to|as|ask|ping|cc|by|with|from)) )"
    + _TITLE + rf"(?P<name>{NAME})"
)
_LABELS = re.compile(r"(?:by|owner|author(?:in|s)?|autorin|autor|auteur|reviewer|maintainer|contact|kontakt|assignee)\s?:? ?(?:dr\.? )?$|@author $|(?:todo|fixme)\($|(?:thanks to|thank you,?|danke an|merci à|gracias a|paired with|worked with) (?:dr\.? )?$", re.I)
NAME_BEFORE = re.compile(
    rf"(?P<name>{NAME})(?=,? (?:asked for|asked me|pointed out|wrote (?:this|most)|said|noted|suggested|reported|reviewed|mentioned|told|fixed|proposed|confirmed|complained|hat (?:das|darauf)|a (?:demandé|signalé))\b)"
)
NAME_SMALL = re.compile(
    rf"\b(?:thanks to|ping|ask|cc|danke an|merci à|paired with) (?P<name>{_WEE} {_WEE})(?=,? (?:for|about|wrote|on|pour|knows|did|who|to|has|please)\b|[,;.!?]|\s-|$)", re.M
)
# Words that begin no name.
_NO_NAME = frozenset(
    "the a an our my your his her their its this that these those all any some each every no not everyone anyone someone nobody somebody us me him them it"
    " for about with from to of on in at by and or but if when while who which what how why der die das ein eine le la les un une el los step note table"
    " please order router hash ring blue harbor release lane index cache tool team bot service build test tests code review".split()
)
_WORDS = re.compile(rf"[{_UP}{_LOW}]+(?:[-'’][{_UP}{_LOW}]+)*")


class Detector:
    """known: token (any case) -> role (given, family) of known names."""

    def __init__(self, known: dict[str, str]):
        self.known = {token.lower(): role for token, role in known.items()}
        given = "|".join(sorted((re.escape(t) for t, r in self.known.items() if r == "given"), key=len, reverse=True)) or r"(?!)"
        family = "|".join(sorted((re.escape(t) for t, r in self.known.items() if r == "family"), key=len, reverse=True)) or r"(?!)"
        self.pair = re.compile(
            rf"(?i)(?<![\w@.+-])(?:(?P<a>{given}) (?P<b>{family})|(?P<c>{family}), (?P<d>{given})|(?-i:[{_UP}]\.) (?:{family}))(?![\w@+]|\.\w| \[at| \(at|\(at| at \w+ dot)"
        )
        self.half = re.compile(
            rf"(?<![\w@.+-])(?:(?i:{given}) (?P<x>{_CAP}|{_ALL})|(?P<y>{_CAP}|{_ALL}) (?i:{family})|(?i:{family}), (?P<v>{_CAP})|(?P<w>{_CAP}), (?i:{given}))(?![\w@+]|\.\w| \[at| \(at|\(at| at \w+ dot)"
        )

    def _is_name(self, value: str, sure: bool) -> bool:
        words = [w.lower() for w in _WORDS.findall(value) if len(w) > 1]
        if any(w in self.known for w in words):
            return not any(w in _NO_NAME for w in words)
        return sure and not any(w in _NO_NAME for w in words)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of every case, in order, without overlaps."""
        found: list[tuple[int, int, str]] = []
        low = text.lower()
        forms = [EMAIL] if "@" in low else []
        if (" dot " in low and " at " in low) or any(sign in low for sign in _AT_SIGNS):
            forms.append(SPELT_EMAIL)
        for form in forms:
            for m in form.finditer(text):
                if not _REMOTE.match(m.group()) and text[max(0, m.start() - 3) : m.start()] != "://":
                    found.append((m.start(), m.end(), "email"))
        for m in ADDRESS_HEAD.finditer(text):
            if _COUNTED.search(text[max(0, m.start() - 12) : m.start()]):
                continue
            end = m.end()
            place = ADDRESS_PLACE.match(text, end)
            found.append((m.start(), place.end() if place else end, "address"))
        labelled = []
        for m in ID_LABEL.finditer(text):
            number = ID_FORM.match(text, m.end())
            if number:
                labelled.append((number.start(), number.end(), "id_number"))
        found += labelled
        for form in PHONES:
            for m in form.finditer(text):
                before = text[max(0, m.start() - 28) : m.start()]
                sure = m.group()[0] == "+" or m.group().startswith("00") and len(re.sub(r"\D", "", m.group())) in range(10, 16)
                if PHONE_CUE.search(before) or sure and m.group()[0] == "+" and not _NOT_PHONE.search(before):
                    found.append((m.start(), m.end(), "phone"))
        for m in NAME_AFTER.finditer(text):
            cue = text[max(0, m.start("name") - 20) : m.start("name")]
            if self._is_name(m.group("name"), bool(_LABELS.search(cue)) or cue.lower().rstrip().endswith("dr.")):
                found.append((*m.span("name"), "name"))
        for m in NAME_BEFORE.finditer(text):
            if self._is_name(m.group("name"), True):
                found.append((*m.span("name"), "name"))
        for m in NAME_SMALL.finditer(text):
            if self._is_name(m.group("name"), True):
                found.append((*m.span("name"), "name"))
        if not any(token in low for token in self.known):
            return _apart(found)
        for m in self.pair.finditer(text):
            found.append((m.start(), m.end(), "name"))
        for m in self.half.finditer(text):
            other = next(g for g in m.groups() if g)
            if self._is_name(m.group(), False) and other.lower() not in _NO_NAME:
                found.append((m.start(), m.end(), "name"))
        return _apart(found)


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Keep the first found kind where finds overlap: e-mail, address, identity number, phone, name; then the longer."""
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}
    taken: list[tuple[int, int, str]] = []
    for start, end, kind in sorted(set(found), key=lambda f: (rank[f[2]], f[0] - f[1], f[0])):
        if all(end <= s or start >= e for s, e, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


# ------------------------------------------------------------------ replacement

# Pools of invented names for surrogates.
POOL = {
    "female": "Alba Brisa Celine Delia Edda Fenja Greta Hanne Ilka Jorun Kaja Livia Mirja Nelda Oda Pernille Runa Svea Thora Viola".split(),
    "male": "Arvid Bror Cedric Duncan Edvin Folke Gustav Hakon Ivar Joris Kasper Ludo Mats Nils Olav Pelle Ragnar Sixten Torben Viggo".split(),
    "family": "Almgren Berkhout Calder Dahlberg Ekholm Fairley Granlund Haverkamp Isaksen Jansma Kjellin Lofgren Mortlake Nordahl Osterby Penhallow Quist Ravnsborg Stenmark Thornby".split(),
}
_FEMALE_ENDS = ("a", "e", "ie", "ine", "y")


def _digest(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(parts).encode("utf-8", "replace"), hashlib.sha256).digest()[:8], "big")


def normal_form(kind: str, value: str) -> str:
    """What makes two spellings the same value: digits of numbers, words of names in order given-family, lower case."""
    if kind in ("phone", "id_number"):
        return re.sub(r"\W", "", value).upper()
    if kind == "email":
        plain = re.sub(_AT, "@", value, flags=re.I)
        plain = re.sub(r"\sat\s", "@", plain, flags=re.I)
        return re.sub(r"\s?[\[({]?\bdot\b[\])}]?\s?|\s?[\[(]\.[\])]\s?", ".", plain, flags=re.I).lower().replace(" ", "")
    if kind == "name" and ", " in value:
        family, given = value.split(", ", 1)
        value = f"{given} {family}"
    return re.sub(r"\s+", " ", value).lower()


def placeholder(kind: str, value: str, key: bytes) -> str:
    """Typed placeholder with a keyed tag, equal for equal values."""
    return f"[{kind.upper()}_{_tag(key, 'tag', kind, normal_form(kind, value))}]"


def _tag(key: bytes, *parts: str) -> str:
    """Twelve letters and digits, 62 bits."""
    tag, letters = _digest(key, *parts), ""
    for _ in range(12):
        tag, rest = divmod(tag, 36)
        letters += "0123456789abcdefghijklmnopqrstuvwxyz"[rest]
    return letters


def _invent(key: bytes, label: str, word: str, syllables: int) -> str:
    """An invented word, equal for equal words; each syllable has 864 forms (9.7 bits)."""
    rest, out = _digest(key, label, word), ""
    for _ in range(syllables):
        rest, a = divmod(rest, 18)
        rest, b = divmod(rest, 6)
        rest, c = divmod(rest, 8)
        out += "bdfghjklmnprstvwzc"[a] + "aeiouy"[b] + "lmnrstkx"[c]
    return out.capitalize()


def _like(word: str, pattern: str) -> str:
    return word.upper() if pattern.isupper() and len(pattern) > 1 else word.lower() if pattern.islower() else word


def _permute(value: str, key: bytes, label: str) -> str:
    """Digits and ASCII letters through a keyed permutation of all values of this form; a first digit stays zero or not.

    Other characters stay. Separators do not count: equal digits give equal digits.
    """
    digits, bases, lows = [], [], []
    for c in value:
        if c.isdecimal():
            first = not digits
            digits.append(int(c))
            lows.append(int(first and c != "0"))
            bases.append(1 if first and int(c) == 0 else 9 if first else 10)
        elif c.isascii() and c.isalpha():
            digits.append(ord(c.upper()) - 65)
            lows.append(0)
            bases.append(26)
    number, size = 0, 1
    for d, low, base in zip(digits, lows, bases):
        number, size = number * base + d - low, size * base
    half = max(1, -(-(size - 1).bit_length() // 2))
    form, mask = f"{label}:{bases}", (1 << half) - 1
    while size > 1:
        left, right = number >> half, number & mask
        for turn in range(8):
            left, right = right, left ^ (_wide(key, half, form, str(turn), str(right)) & mask)
        number = left << half | right
        if number < size:  # else walk on: the cycle returns to the wanted range
            break
    for at in reversed(range(len(digits))):
        number, rest = divmod(number, bases[at])
        digits[at] = rest + lows[at]
    out, at = [], 0
    for c in value:
        if c.isdecimal():
            out.append(str(digits[at]))
        elif c.isascii() and c.isalpha():
            out.append(chr(digits[at] + (65 if c.isupper() else 97)))
        else:
            out.append(c)
            continue
        at += 1
    return "".join(out)


def _wide(key: bytes, bits: int, *parts: str) -> int:
    out = _digest(key, *parts)
    for more in range(1, -(-bits // 64)):
        out = out << 64 | _digest(key, *parts, str(more))
    return out


_ACCENTED = "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))) + "ŁŚŽŠ"


def _initials(text: str, key: bytes) -> str:
    """Initials through a keyed permutation of the letters."""
    out = []
    for c in text.upper():
        letters = next((x for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _ACCENTED) if c in x), "")
        out.append(sorted(letters, key=lambda x: _digest(key, "initial", x))[letters.index(c)] if letters else c)
    return "".join(out)


def _name(value: str, key: bytes) -> str:
    parts = normal_form("name", value).split(" ")
    given, middle = parts[0], [p for p in parts[1:-1] if p.endswith(".")]
    family = " ".join([p for p in parts[1:-1] if not p.endswith(".")] + parts[-1:])
    words = _WORDS.findall(value)
    swapped = ", " in value
    new_family = _like(_invent(key, "family", family, 5), words[0 if swapped else -1])
    if given.endswith("."):
        new_given = _initials(given, key)
    else:
        pool = POOL["female" if given.endswith(_FEMALE_ENDS) else "male"]
        new_given = f"{pool[_digest(key, 'given', given) % len(pool)]}-{_invent(key, 'second', given, 4)}"
        long = [w for w in words if len(w) > 1]
        new_given = _like(new_given, long[-1] if swapped else long[0])
    new_given = " ".join([new_given, *(_initials(m, key) for m in middle)])
    return f"{new_family}, {new_given}" if swapped else f"{new_given} {new_family}"


# Words of an address that tell its form and not its place.
_ADDRESS_FORM = frozenset(
    "flat apt apartment unit suite room bis ter de la l du des d aux au à le les del los der den am an auf im in zum zur alte neue obere untere".split()
)
_STREET_FIRST = frozenset("rue avenue chemin boulevard place impasse allée quai route cours square passage calle avenida plaza paseo camino".split())
_STREET_LAST = re.compile(rf"{_EN_STREET}$", re.I)
_STREET_END = re.compile(r"^(.*?)(straße|strasse|str|weg|gasse|platz|allee|damm|ring|ufer|steig|pfad|markt|hof|graben|chaussee)$", re.I)
_ADDRESS_WORD = re.compile(rf"(?<![\w])[{_UP}{_LOW}]+(?:-[{_UP}{_LOW}]+)*|\d+")


def _address(value: str, key: bytes) -> str:
    """Street and town invented word by word, numbers permuted; words of form (street, flat, de la) stay."""
    place = ADDRESS_PLACE.search(value)
    cut = place.start() if place and place.end() == len(value) else len(value)
    found = list(_ADDRESS_WORD.finditer(value))
    names = [m for m in found if not m.group()[0].isdigit() and m.start() < cut and m.group().lower() not in _ADDRESS_FORM and len(m.group()) > 1]
    street_first = bool(names) and names[0].group().lower() in _STREET_FIRST and len(names) > 1
    out, at = [], 0
    for m in found:
        word, low = m.group(), m.group().lower()
        if word[0].isdigit():
            new = _permute(word, key, "number")
        elif len(word) == 1 or m.start() < cut and low in _ADDRESS_FORM:
            new = word
        elif names and m.start() == names[0].start() and street_first:
            new = word
        elif names and m.start() == names[-1].start() and not street_first and len(names) > 1 and _STREET_LAST.match(word):
            new = word
        else:
            end = _STREET_END.match(word) if m.start() < cut and not street_first else None
            stem, tail = (end.group(1), end.group(2)) if end else (word, "")
            new = _like(_invent(key, "place", stem.lower(), 4), stem or word) + (tail if stem else tail.lower())
        out += [value[at : m.start()], new]
        at = m.end()
    return "".join(out) + value[at:]


# Domains reserved for examples and tests, which belong to nobody.
_RESERVED = re.compile(r"(?i)(?:^|\W)(?:(?:example|test|invalid|localhost)|example\W*(?:\bdot\b\W*)?(?:com|net|org))\W*$")
_LABEL = re.compile(r"[^\W_](?:[\w-]*\w)?")


def _domain(tail: str, key: bytes) -> str:
    """What follows the local part, with invented labels; the last one and reserved domains stay."""
    labels = [m for m in _LABEL.finditer(tail) if m.group().lower() not in ("at", "dot")]
    if _RESERVED.search(tail) or len(labels) < 2:
        return tail
    out, at = [], 0
    for m in labels[:-1]:
        out += [tail[at : m.start()], _like(_invent(key, "domain", m.group().lower(), 4), m.group()) if m.group()[:1].isupper() else _invent(key, "domain", m.group().lower(), 4).lower()]
        at = m.end()
    return "".join(out) + tail[at:]


#: Country codes, so that every way to write a number keeps the same digits.
_LEAD = re.compile(r"(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|0")


def surrogate(kind: str, value: str, key: bytes) -> str:
    """An invented value of the same type, format, script and case; equal for equal values."""
    if kind == "name":
        return _name(value, key)
    if kind == "address":
        return _address(value, key)
    if kind == "email":
        head = re.match(rf"(?:{_LOCAL})(?:\sdot\s{_LOCAL})*(?=@|\s|\(|\[|\{{|<)", value, re.I)
        cut = head.end() if head else value.find("@")
        tag = _tag(key, "email", normal_form(kind, value))
        return (tag.upper() if value[:cut].isupper() and cut > 1 else tag) + _domain(value[cut:], key)
    lead = _LEAD.match(value) if kind == "phone" else None
    cut = lead.end() if lead else 0
    return value[:cut] + _permute(value[cut:], key, f"{kind}:{value[:cut]}")


def replace_cases(text: str, cases: list[tuple[int, int, str]], key: bytes, mode: str = "placeholder") -> str:
    """The text with its cases replaced; a replacement depends on nothing but value and key."""
    make = placeholder if mode == "placeholder" else surrogate
    out, at = [], 0
    for start, end, kind in cases:
        out += [text[at:start], make(kind, text[start:end], key)]
        at = end
    return "".join(out) + text[at:]


# ------------------------------------------------------------------ operators


def _known(names: DataFrame, bound: int = 100_000) -> dict[str, str]:
    """The table of known names: small, does not grow, size checked."""
    rows = names.where("token is not null and role is not null").select(F.trim("token").alias("t"), "role").where("t != ''").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} known names")
    return {r.t: r.role for r in sorted(rows)}


def personal_cases(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, kind, value: each distinct case of each document."""
    known = _known(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Detector(known).find
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text):
                rows += dict.fromkeys((doc_id, kind, text[s:e]) for s, e, kind in find(text))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value"])

    texts = documents.where("text is not null and text != ''").select("doc_id", "text")
    return spread(texts).mapInPandas(run, "doc_id long, kind string, value string")


def redact_documents(documents: DataFrame, names: DataFrame, key: str | None = None, mode: str = "placeholder") -> DataFrame:
    """doc_id, text with every case replaced (mode placeholder or surrogate), cases: how many.

    key: the secret that replacements depend on; without one a secret is drawn for this call, so
    that nobody can compute replacements again.
    """
    known, secret = _known(names), (key or secrets.token_hex(32)).encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Detector(known).find
        for b in batches:
            texts, counts = [], []
            for text in b.text:
                cases = find(text) if text else []
                texts.append(replace_cases(text, cases, secret, mode) if cases else text)
                counts.append(len(cases))
            yield pd.DataFrame({"doc_id": b.doc_id, "text": texts, "cases": counts})

    return spread(documents.select("doc_id", "text")).mapInPandas(run, "doc_id long, text string, cases int")
