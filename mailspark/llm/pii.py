"""Personal data in texts, also where it is disguised, as spans of the source text.

Base: the four patterns ``email, ip, card, phone``, leftmost and non-overlapping per kind, with their
checks; a match that fails its check is dropped and not tried again.

Disguises: a chain of transducers rewrites a text and keeps, for each character it writes, the source
characters that it stands for:

1. look-alike letters and digits of other scripts, full-width forms and dash and dot variants become
   ASCII, invisible characters vanish;
2. number words next to each other become digits, ``plus`` before a digit becomes ``+``;
3. ``at`` and ``dot`` in brackets, or as words in the shape of an address, become ``@`` and ``.``.

The base patterns run over the rewritten text. A match that covers rewritten characters is mapped
back to its source span and added, unless it lies inside a base span of its kind. Base spans stay.

A text costs time in proportion to its length. NULL text is empty; a NULL id, repeated rows and other
columns change nothing; an empty table gives an empty result. Spans are in code points, end exclusive.
"""

import hashlib
import re
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits whose first digit could not begin it.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like ASCII ones, and what they look like.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТХаеорсухіјѕԁԛԝһοΑΒΕΖΗΙΚΜΝΟΡΤΥΧνı․。·‐‑‒–—−",
    "ABEKMHOPCTXaeopcyxijsdqwhoABEZHIKMNOPTYXvi...------",
))
INVISIBLE = "​‌‍⁠﻿­"
#: Number words of the four languages, by digit.
NUMBER_WORDS = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
DIGIT_OF = {w: str(d) for d, words in enumerate(NUMBER_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(DIGIT_OF, key=len, reverse=True)) + ")"
_PLUS = r"(?:\bplus[\s-]+)"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_UNIT = rf"(?:{_WORD}|[0-9])"
#: A run of number words (and digits), with dots said between them.
NUMBERS = re.compile(rf"(?i){_PLUS}?\b{_UNIT}\b(?:(?:[\s,-]{{1,3}}(?:{_DOT_WORD}[\s,-]{{1,3}})?){_UNIT}\b){{3,}}")
NUMBER_PART = re.compile(rf"(?i)\bplus\b|\b{_DOT_WORD}\b|{_WORD}|[0-9]|.", re.S)
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
BRACKETED_AT = re.compile(rf"(?i)(?<=[a-z0-9_%+-]){_OPEN}(?:at|@|arroba|ät){_CLOSE}(?=[a-z0-9])")
BRACKETED_DOT = re.compile(rf"(?i)(?<=[a-z0-9-]){_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}(?=[a-z0-9])")
_SAID_DOT = rf"[ \t]+{_DOT_WORD}[ \t]+"
SAID_ADDRESS = re.compile(rf"(?i)(?<=[a-z0-9_%+-])(?:[ \t]+at[ \t]+|@)(?=[a-z0-9-]+(?:(?:{_SAID_DOT}|\.)[a-z0-9-]+)*{_SAID_DOT}[a-z]{{2,}}\b)|(?<=[a-z0-9])[ \t]+AT[ \t]+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{{2,}}\b)")
SAID_DOT = re.compile(rf"(?i)(?<=[a-z0-9-]){_SAID_DOT}(?=[a-z0-9])")
#: Every bracketed sign begins with one.
MARKS = re.compile(r"[\[({<]")
NUMBER_DOT = re.compile(rf"(?i)(?<=[0-9])\s+{_DOT_WORD}\s+(?=[0-9])")

STRANGE = re.compile(r"[^\x00-\x7f¡-¬®-¶¸-ɏ]|[·ı]")


#: Characters that (?i) takes for ASCII letters and ``lower`` does not.
ODD_CASE = re.compile("[ſİ]")
APART = str.maketrans("-,", "  ")
DOT_WORDS = frozenset(("dot", "punkt", "punto", "point"))
UNITS = DIGIT_OF.keys() | frozenset("0123456789")
#: What SAID_ADDRESS asks for around ``at``, in lower case.
NEAR_AT = re.compile(rf"[ \t]at[ \t]+[a-z0-9-]+(?:\.|[ \t]+{_DOT_WORD})")


def suspect(text: str) -> bool:
    """Whether a transducer would find something to rewrite, by the transducers' own patterns: the first
    that finds something finds it in the text as it is. A pattern is tried where the words that any
    match of it has are there: between two units of a run of numbers, as well as around ``dot`` and
    ``at``, stand only blanks, commas and hyphens."""
    odd = False
    if not text.isascii():
        if STRANGE.search(text):
            return True
        odd = ODD_CASE.search(text) is not None
    low = text.lower()
    words = low.translate(APART).split()
    dots = not DOT_WORDS.isdisjoint(words)
    if MARKS.search(text) and (BRACKETED_AT.search(text) or BRACKETED_DOT.search(text)):
        return True
    if (odd or (dots and "@" in text) or NEAR_AT.search(low)) and SAID_ADDRESS.search(text):
        return True
    if (odd or dots) and NUMBER_DOT.search(text):
        return True
    # Of four units in a row the two in the middle are words of their own.
    units = bytes(map(UNITS.__contains__, (w for w in words if w not in DOT_WORDS) if dots else words))
    return (odd or b"\1\1" in units) and NUMBERS.search(text) is not None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match is the run of local characters before an ``@`` and the domain after it; looking from
    each ``@`` outward finds what the pattern finds from the left, in time linear in the text."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out = {"email": emails(text), "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) < 4 and int(p) < 256 for p in parts):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


class Tape:
    """A rewritten text; ``first`` and ``end`` hold each character's source span, ``new`` what was rewritten."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.first, self.end, self.new = list(range(n)), list(range(1, n + 1)), bytearray(n)

    def rewrite(self, pattern: re.Pattern, write) -> None:
        """Replace each match by ``write(match)``: pieces (start, end, characters) of what it matched."""
        if not pattern.search(self.text):
            return
        text, first, end, new, at = [], [], [], bytearray(), 0
        for m in pattern.finditer(self.text):
            for start, stop, chars in write(m):
                text.append(self.text[at:start])
                first += self.first[at:start]
                end += self.end[at:start]
                new += self.new[at:start]
                at = stop
                text.append(chars)
                if stop > start:
                    first += [self.first[start]] * len(chars)
                    end += [self.end[stop - 1]] * len(chars)
                    new += b"\1" * len(chars)
        text.append(self.text[at:])
        first += self.first[at:]
        end += self.end[at:]
        new += self.new[at:]
        self.text, self.first, self.end, self.new = "".join(text), first, end, new


def _ascii_form(m: re.Match):
    c = m[0]
    if c in INVISIBLE:
        return [(m.start(), m.end(), "")]
    shown = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    return [(m.start(), m.end(), shown)] if shown.isascii() else []


def _digits(m: re.Match):
    """Number words to digits, said dots to dots; what parts them goes."""
    if not any(p.lower() in DIGIT_OF for p in NUMBER_PART.findall(m[0])):
        return []
    out = []
    for p in NUMBER_PART.finditer(m[0]):
        word = p[0].lower()
        if word.isdigit() and word.isascii():
            continue
        shown = "+" if word == "plus" else DIGIT_OF.get(word, "." if p[0].isalpha() and len(word) > 1 else "")
        out.append((m.start() + p.start(), m.start() + p.end(), shown))
    return out


def _as(char: str):
    return lambda m: [(m.start(), m.end(), char)]


TRANSDUCERS = (
    (STRANGE, _ascii_form), (NUMBERS, _digits), (NUMBER_DOT, _as(".")), (BRACKETED_AT, _as("@")), (BRACKETED_DOT, _as(".")),
)


def _said_address(m: re.Match):
    """The word ``at`` of an address, and the said dots of its domain."""
    out = [(m.start(), m.end(), "@")]
    at = m.end()
    label = re.compile(r"[A-Za-z0-9-]+")
    while (x := label.match(m.string, at)) and (d := re.compile(_SAID_DOT + r"|\.", re.I).match(m.string, x.end())):
        if not label.match(m.string, d.end()):
            break
        if d[0] != ".":
            out.append((d.start(), d.end(), "."))
        at = d.end()
    return out


def disguised_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    found = {k: [] for k in KINDS}
    if not suspect(text):
        return found
    tape = Tape(text)
    for pattern, write in TRANSDUCERS:
        tape.rewrite(pattern, write)
    tape.rewrite(SAID_ADDRESS, _said_address)
    if 1 not in tape.new and len(tape.text) == len(text):
        return found
    for kind, spans in base_spans(tape.text).items():
        for start, end in spans:
            source = (tape.first[start], tape.end[end - 1])
            rewritten = 1 in tape.new[start:end] or source[1] - source[0] != end - start
            if rewritten and not any(a <= source[0] and source[1] <= b for a, b in base[kind]):
                found[kind].append(source)
    return found


def spans_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(text: str | None) -> tuple[dict, dict]:
    """Base spans and all spans of a text, by kind."""
    base = base_spans(text or "")
    more = disguised_spans(text or "", base)
    return base, {k: sorted(base[k] + more[k]) for k in KINDS}


def _scan(batches):
    for batch in batches:
        rows = [find(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array([len(base[k]) for base, _ in rows], pa.int64()) for k in KINDS],
                pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([spans_text(every) for _, every in rows], pa.string()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )


def op6_spans(spark, documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    return documents.select("doc_id", "text").mapInArrow(
        _scan, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    )
