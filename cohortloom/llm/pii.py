"""Personal data in texts: plain identifiers, and disguised ones found after normalising with offsets kept."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cohortloom.llm.batches import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that is not followed by a point fails from each of its digits, so only its first is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, @ and domain. The local part reaches back to the last match or @ sign."""
    found, end, floor = [], 0, 0
    at = text.find("@")
    while at >= 0:
        before = text[max(end, floor) : at]
        local = len(before) - len(before.rstrip(LOCAL))
        if local and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            found.append((at - local, end))
        floor = at + 1
        at = text.find("@", max(floor, end))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind that stand in the text as they are; matches that fail their test are dropped."""
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    found["email"] = emails(text)
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# Look-alike characters, words for digits in the languages of the documents, and words for signs.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ",
}
HIDDEN = "​‌‍⁠﻿­"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase", "ät"), ("dot", "punkt", "point", "punto")

_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# Single digits among the words, or digit groups too.
SPELLED = re.compile(rf"(?<!\w)(?:plus\W{{1,3}})?(?:(?:{_DIGIT}|[0-9])(?:[ ,-]{{1,2}}(?=\w)|(?!\w))){{4,}}", re.IGNORECASE)
GROUPED = re.compile(rf"(?<!\w)(?:plus\W{{1,3}})?(?:(?:{_DIGIT}|[0-9]++)(?:[\s,-]{{1,2}}(?=\w)|(?!\w))){{3,}}", re.IGNORECASE)
SPELLED_PART = re.compile(rf"plus|{_DIGIT}|[0-9]+|[\s,-]+|\W", re.IGNORECASE)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
BRACKETED = re.compile(rf"(?<!\s)\s*+[\[({{<]\s*+(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\s*+[\])}}>]\s*+", re.IGNORECASE)
PART = re.compile(r"[A-Za-z0-9_%+-]+")
PART_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"
SIGN = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:\s++(?:(?P<at>{_AT})|(?:{_DOT}))\s++|(?P<sign>@)|\.)(?=[A-Za-z0-9_%+-])", re.IGNORECASE)
_OCTET = rf"(?:[0-9]{{1,3}}|(?:{_DIGIT}|[0-9])(?:[ -](?:{_DIGIT}|[0-9])){{0,2}})"
SPOKEN_NUMBERS = re.compile(rf"(?<![\w.]){_OCTET}(?:\s++(?:{_DOT})\s++{_OCTET}){{3}}(?!\w)", re.IGNORECASE)
SPOKEN_PART = re.compile(rf"(?P<dot>\s+(?:{_DOT})\s+)|{_DIGIT}|[0-9]+|[ -]", re.IGNORECASE)
SPOKEN_DOT = re.compile(rf"\s(?:{_DOT})\s", re.IGNORECASE)
BRACKET = re.compile(rf"[\[({{<]\s*+(?:{_AT}|{_DOT}|@|\.)\s*+[\])}}>]", re.IGNORECASE)
SUSPECT = re.compile(f"[{''.join(LOOKALIKES)}{HIDDEN}⁰-₟①-⓿！-～\U0001d400-\U0001d7ff]")


class Tape:
    """A text that is rewritten step by step; each character knows the part of the source that it stands for."""

    def __init__(self, text: str):
        self.text, self.first, self.last, self.edited = text, range(len(text)), range(1, len(text) + 1), bytearray(len(text))

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Put a new text in place of each [start, end); all its characters stand for the whole part."""
        text, first, last, edited, done = [], [], [], bytearray(), 0
        for start, end, new in edits:
            text += [self.text[done:start], new]
            first += [*self.first[done:start], *[self.first[start]] * len(new)]
            last += [*self.last[done:start], *[self.last[end - 1]] * len(new)]
            edited += self.edited[done:start] + b"\1" * len(new)
            done = end
        if done:
            self.text = "".join(text) + self.text[done:]
            self.first, self.last = [*first, *self.first[done:]], [*last, *self.last[done:]]
            self.edited = edited + self.edited[done:]

    def source(self, start: int, end: int) -> Span:
        return self.first[start], self.last[end - 1]


def _characters(text: str, edited: bytearray) -> Iterable[tuple[int, int, str]]:
    """Look-alikes, full-width and styled characters become ASCII; hidden characters go."""
    for m in SUSPECT.finditer(text):
        c = m[0]
        new = "" if c in HIDDEN else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if new.isascii():
            yield m.start(), m.end(), new


def _spelled_by(pattern: re.Pattern, least: int):
    """Step that writes ``least`` or more spelled digits in a row, as the pattern reads them, in digits; a leading "plus" becomes a sign."""

    def step(text: str, edited: bytearray) -> Iterable[tuple[int, int, str]]:
        for m in pattern.finditer(text):
            parts = [p.lower() for p in SPELLED_PART.findall(m[0])]
            if sum(p in DIGIT_WORDS for p in parts) >= least:
                digits = "".join("+" if p == "plus" else DIGIT_WORDS.get(p, p if p.isdecimal() else "") for p in parts)
                yield m.start(), m.start() + len(m[0].rstrip(" ,-\t\r\n")), digits

    return step


def _bracketed(text: str, edited: bytearray) -> Iterable[tuple[int, int, str]]:
    for m in BRACKETED.finditer(text):
        yield m.start(), m.end(), "@" if m["at"] else "."


def _chains(text: str) -> Iterable[list[re.Match]]:
    """Signs, spoken or written, with nothing but one part of an address between a sign and the next."""
    chain: list[re.Match] = []
    for sign in SIGN.finditer(text):
        if chain and PART.match(text, chain[-1].end()).end() != sign.start():
            yield chain
            chain = []
        chain.append(sign)
    if chain:
        yield chain


def _spoken(text: str, edited: bytearray) -> Iterable[tuple[int, int, str]]:
    """Addresses with signs in words, of any number of parts. Other signs may stand as such, but a domain after a spoken "at" needs a
    sign that was disguised.

    An address that stands whole in the source does not go on in words.
    """
    done = 0
    for chain in _chains(text):
        before = text[done:chain[0].start()]
        start = chain[0].start() - (len(before) - len(before.rstrip(PART_CHARACTERS)))
        done = chain[-1].end()
        # Parts that go on to the left or right in other letters are no address.
        floor = 1 if start and (text[start - 1].isalnum() or text[start - 1] in "_.") else 0
        last = PART.match(text, chain[-1].end()).end()
        top = len(chain) - (last < len(text) and (text[last].isalnum() or text[last] == "@"))
        ats = [k for k, s in enumerate(chain) if s["at"] or s["sign"]]
        for at, following in zip(ats, [*ats[1:], len(chain)], strict=False):
            signs = chain[floor:min(following, top)]
            domain = chain[at + 1:min(following, top)]
            if at < floor or not domain:
                floor = max(floor, at + 1)
                continue
            floor = following
            written = chain[at]["sign"] is not None
            whole = written and domain[0][0] == "." and not edited[chain[at].start()] and not edited[domain[0].start()]
            disguised = written or any(s[0] != "." or edited[s.start()] for s in domain)
            if disguised and not whole:
                yield from ((s.start(), s.end(), "@" if s["at"] else ".") for s in signs if s[0] not in "@.")


def _spoken_numbers(text: str, edited: bytearray) -> Iterable[tuple[int, int, str]]:
    """Four numbers with spoken points between them, in digits or in words for digits."""
    for m in SPOKEN_NUMBERS.finditer(text):
        for p in SPOKEN_PART.finditer(m[0]):
            new = "." if p["dot"] else DIGIT_WORDS.get(p[0].lower(), p[0].strip(" -"))
            if new != p[0]:
                yield m.start() + p.start(), m.start() + p.end(), new


def _shown(text: str, steps: list, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of identifiers on the tape that the steps leave, without those inside a plain span of their kind."""
    tape = Tape(text)
    for step in steps:
        edits = sorted(step(tape.text, tape.edited))
        tape.rewrite(e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1])
    shown = plain_spans(tape.text)
    spelled = [m.span() for m in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", tape.text) if sum(tape.edited[m.start() : m.end()]) >= 7]
    # digits of a card are no phone number
    spelled = [(a, b) for a, b in spelled if not any(start < b and a < end for start, end in shown["card"])]
    found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    for kind in KINDS:
        for start, end in sorted({*shown[kind], *(spelled if kind == "phone" else [])}):
            first, last = tape.source(start, end)
            if text[first:last] == tape.text[start:end]:
                continue
            if kind == "email" and not tape.text[start:end].rpartition(".")[2].isalpha():
                continue
            if not any(a <= first and last <= b for a, b in plain[kind]):
                found[kind].append((first, last))
    return found


def disguised_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of identifiers that only normalising shows, without those inside a plain span of their kind.

    A span counts if the source reads differently there; an email's top domain must be letters. Ten to fifteen digits
    of which at least seven are spelled also count as a phone number without a plus sign. Spelled digits are read twice, first with
    single digits among them and then with digit groups; the second reading adds what overlaps nothing of its kind.
    """
    characters = [_characters] if not text.isascii() and SUSPECT.search(text) else []
    low = text.lower()
    words = sum(map(DIGIT_WORDS.__contains__, low.replace("-", " ").replace(",", " ").split()))
    dots = any(x in low for x in DOT_WORDS) and SPOKEN_DOT.search(text) is not None
    signs = [_bracketed, _spoken]
    steps = characters + ([_spoken_numbers] if dots else []) + ([_spelled_by(SPELLED, 4)] if words >= 4 else [])
    if steps or BRACKET.search(text):
        found = _shown(text, steps + signs, plain)
    else:
        found = {kind: [] for kind in KINDS}
    if words >= 3 and DIGIT.search(text):
        more = _shown(text, [*characters, _spelled_by(GROUPED, 3), *signs], plain)
        for kind in KINDS:
            taken = sorted(plain[kind] + found[kind])
            found[kind] += [(a, b) for a, b in more[kind] if not any(x < b and a < y for x, y in taken)]
    return found


def listed(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` of all spans by start, then kind as listed, joined by commas."""
    rows = sorted({(start, k, end) for k, kind in enumerate(KINDS) for start, end in spans[kind]})
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in rows)


def personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the number of plain spans of each kind, a digest of these and the list of all spans.

    Spans are code points, end exclusive; ``n_disguised`` of them come from normalising. Null and empty texts have
    none; equal rows get equal results; very long texts are read whole, each pattern once; other columns are ignored; an empty table
    stays empty. Rows stay where they are.
    """
    out = StructType([
        *[StructField(f"n_{kind}", LongType()) for kind in KINDS], StructField("base_sha256", StringType()),
        StructField("spans", StringType()), StructField("n_disguised", LongType()),
    ])

    def make():
        def work(texts: list[str]) -> dict:
            found: dict[str, list] = {f.name: [] for f in out.fields}
            for x in texts:
                plain = plain_spans(x)
                added = disguised_spans(x, plain)
                for kind in KINDS:
                    found[f"n_{kind}"].append(len(plain[kind]))
                found["base_sha256"].append(hashlib.sha256(listed(plain).encode()).hexdigest())
                found["spans"].append(listed({k: plain[k] + added[k] for k in KINDS}))
                found["n_disguised"].append(sum(map(len, added.values())))
            return found

        return work

    return map_texts(docs, make, out, text, list(keep))
