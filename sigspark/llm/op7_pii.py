"""Personal data with offset-preserving deobfuscation.

The base rules find e-mail addresses, IPv4 addresses, card and phone numbers as written. The method then runs small
transducers over the text (homoglyphs to ASCII, zero-width characters to nothing, spelled digits to digits, at/dot
disguises to @ and .), each writing its output together with the source offset of every character. The same rules run
on the normalised text and their spans are mapped back to source characters. A span that overlaps a base span of its
kind is not added.

Defined results: null or empty text has no spans; repeated rows are each answered; of two added spans that overlap, the
first stays; an empty table gives no rows; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never starts inside a run of digits: the run's first digit would have matched.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in LOCAL:
            at -= 1
        if at < m.start():
            out.append(("email", at, m.end()))
            last = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = _emails(text) if "@" in text else []
    if _ANY_DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# Letters that look like Latin ones, pairwise.
_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеіјорсѕухԁѡһꞵΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιανɡıⅼ", "ABESIJKMHOPCTXYaeijopcsyxdwhbABEZHIKMNOPTYXoiavgil", strict=True))
_SIGNS = {"․": ".", "。": ".", "｡": ".", "‧": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "＠": "@", "﹫": "@"}
_NOTHING = dict.fromkeys("​‌‍⁠﻿­᠎", "")
#: Latin-1 letters are ordinary text; a transducer runs where other characters stand.
_ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]")

_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_DIGITS, key=len, reverse=True))
_UNIT = rf"(?:(?<![^\W\d_])(?:{_WORD})(?![^\W\d_])|[0-9])"
_DOT_WORD = "dot|punkt|punto|point"
_AT_WORD = "at|ät|arroba|arobase"
_GAP = r"[\s,/_-]{1,3}"
#: Digits, some or all spelled, with a spelled plus before and spelled dots between.
_SPELLED = re.compile(rf"(?:(?<![^\W\d_])plus{_GAP}|\+\s?)?{_UNIT}(?:(?:{_GAP}|\s?\.\s?|\s?[()]\s?|\s(?:{_DOT_WORD})\s)?{_UNIT}){{3,}}", re.I)
_ONE = re.compile(rf"({_WORD})|([0-9])|(plus)|({_DOT_WORD})|(\+)|(\.)|(.)", re.I | re.S)
_SOME_WORD = re.compile(rf"(?<![^\W\d_])(?:{_WORD})(?:{_GAP}|[0-9])(?:{_GAP})?(?:{_UNIT})", re.I)
#: A mark in brackets of any kind stands for itself. Patterns begin with a rare character and never look back over white
#: space, so that a text is read a bounded number of times whatever it holds.
_MARK = re.compile(rf"[\[({{<|]\s*+(?:(?P<at>{_AT_WORD}|@)|(?P<dot>{_DOT_WORD}|\.))\s*+[\])}}>|]", re.I)
_AT = re.compile(rf"(?<=\s)(?:{_AT_WORD})(?=\s)|@", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_STOP = re.compile(rf"(?P<word>\s++(?:{_DOT_WORD})\s++)|\s*+\.\s*+", re.I)
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}+(?:\s*+(?:{_DOT_WORD}|\.)\s*+[0-9]{{1,3}}+){{3}}", re.I)
_BARE_DOT = re.compile(rf"\s++(?:{_DOT_WORD})\s++", re.I)
_HAS_DOT = re.compile(rf"(?<![^\W\d_])(?:{_DOT_WORD})(?![^\W\d_])", re.I)

#: Ascending, disjoint (start, end, new text) in the text that they change.
Change = tuple[int, int, str]


class Draft:
    """A text made from the source by layers of changes; a layer keeps its changes only, not an offset for each character."""

    def __init__(self, text: str, layers: tuple = ()):
        self.text, self.layers = text, layers

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source characters that characters a to b stand for. What replaces a stretch stands for all of it."""
        for at, ends, old_start, old_end in reversed(self.layers):
            i, j = bisect_right(at, a) - 1, bisect_right(at, b - 1) - 1
            a, b = (
                a if i < 0 else old_start[i] if a < ends[i] else a - ends[i] + old_end[i],
                b if j < 0 else old_end[j] if b - 1 < ends[j] else b - ends[j] + old_end[j],
            )
        return a, b

    def replaced(self, changes: list[Change]) -> Draft:
        if not changes:
            return self
        out, at, ends, shift, last = [], [], [], 0, 0
        for a, b, new in changes:
            out += [self.text[last:a], new]
            at.append(a + shift)
            ends.append(a + shift + len(new))
            shift += len(new) - (b - a)
            last = b
        out.append(self.text[last:])
        return Draft("".join(out), (*self.layers, (at, ends, [c[0] for c in changes], [c[1] for c in changes])))


def _left_of(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1].isspace():
        at -= 1
    return at


def _right_of(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _homoglyphs(d: Draft) -> Draft:
    changes = []
    for m in _ODD.finditer(d.text):
        c = m[0]
        new = _ALIKE.get(c, _SIGNS.get(c, _NOTHING.get(c)))
        if new is None:
            digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
            new = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
            if new == c or not new.isascii():
                continue
        changes.append((m.start(), m.end(), new))
    return d.replaced(changes)


def _marks(text: str) -> list[Change]:
    """Bracketed marks with the white space around them."""
    out, last = [], 0
    for m in _MARK.finditer(text):
        if m.start() >= last:
            end = _right_of(text, m.end())
            out.append((_left_of(text, m.start(), last), end, "@" if m["at"] else "."))
            last = end
    return out


def _bare(text: str) -> list[Change]:
    """at and dot as bare words where an address would have its signs: a local part before, a chain of labels after, in
    which at least one stop is a word. The chain ends with the label after its last such stop."""
    out, last = [], 0
    for m in _AT.finditer(text):
        if m.start() < last:
            continue
        left, right = _left_of(text, m.start(), last), _right_of(text, m.end())
        label = _LABEL.match(text, right)
        if left == last or text[left - 1] not in LOCAL or not label:
            continue
        stops, kept, end = [], 0, label.end()
        while (stop := _STOP.match(text, end)) and (label := _LABEL.match(text, stop.end())):
            if stop["word"]:
                stops.append((stop.start(), stop.end(), "."))
                kept = label.end()
            end = label.end()
        if stops:
            out += [(left, right, "@"), *stops]
        last = kept if stops else end  # a chain without a stop word has none from any later place in it either
    return out


def _disguises(d: Draft) -> Draft:
    d = d.replaced(_marks(d.text))
    if not _HAS_DOT.search(d.text):
        return d
    d = d.replaced(_bare(d.text))
    return d.replaced([(m.start() + x.start(), m.start() + x.end(), ".") for m in _DOTTED.finditer(d.text) for x in _BARE_DOT.finditer(m[0])])


def _spelled(d: Draft) -> tuple[Draft, list[tuple[int, int]]]:
    """Also the stretches, in the new text, of digit runs without a plus that were mostly spelled."""
    changes, runs, shift = [], [], 0
    for m in _SPELLED.finditer(d.text):
        new, words, digits = [], 0, 0
        for x in _ONE.finditer(m[0]):
            if x[1] or x[2]:
                new.append(_DIGITS[x[1].lower()] if x[1] else x[2])
                words, digits = words + bool(x[1]), digits + 1
            elif x[3] or x[5]:
                new.append("+")
            elif x[4] or x[6]:
                new.append(".")
        if 2 * words < digits or words < 4:
            continue
        out = "".join(new)
        changes.append((m.start(), m.end(), out))
        at = m.start() + shift
        if out.isdigit() and 9 <= digits <= 15:
            runs.append((at, at + len(out)))
        shift += len(out) - (m.end() - m.start())
    return d.replaced(changes), runs


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans and those the deobfuscated text adds, in source offsets, by kind, then start."""
    base = base_spans(text) if base is None else base
    d = _homoglyphs(Draft(text)) if not text.isascii() else Draft(text)
    d = _disguises(d)
    runs: list[tuple[int, int]] = []
    if _SOME_WORD.search(d.text):
        d, runs = _spelled(d)
    if not d.layers:
        return base
    found = base_spans(d.text)
    taken = _Taken([s for s in found if s[0] == "card"])
    found += [("phone", a, b) for a, b in runs if taken.free("card", a, b)]
    out = _Taken(base)
    for kind, a, b in sorted(found, key=lambda s: (KINDS.index(s[0]), s[1])):
        out.add(kind, *d.source(a, b))
    return out.spans()


class _Taken:
    """Disjoint spans by kind, in order."""

    def __init__(self, spans: list[Span]):
        self.by = {k: sorted((a, b) for kind, a, b in spans if kind == k) for k in KINDS}

    def free(self, kind: str, a: int, b: int) -> bool:
        own = self.by[kind]
        i = bisect_right(own, (a, b))
        return (i == len(own) or own[i][0] >= b) and (i == 0 or own[i - 1][1] <= a)

    def add(self, kind: str, a: int, b: int) -> None:
        if self.free(kind, a, b):
            insort(self.by[kind], (a, b))

    def spans(self) -> list[Span]:
        return [(k, a, b) for k in KINDS for a, b in self.by[k]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, for every row of docs (doc_id, text)."""

    def kernel(batches):
        for batch in small_batches(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                spans = all_spans(text, base)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(kernel, OUT)
