"""Personal data, also in disguise, with offsets into the original text.

Plain identifiers are found first. Then transducers rewrite the text, each a list of replaced pieces:
homoglyphs (compatibility forms, look-alike letters, zero-width marks), "at" and "dot" spelled out or
bracketed, and digits spelled as words. The same detectors run on what they make, and a span found
there goes back through the transducers, last one first, to the characters that it came from.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits matches from its first digit or not at all
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all plain identifiers, kind by kind leftmost and without overlap."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, last := m.end()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return out


class Rewritten:
    """A text in which pieces of another were replaced, and the way back."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]):
        """pieces: (start, end, replacement) in order, without overlap."""
        parts, self.at, self.back, here, pos = [], [], [], 0, 0
        for start, end, new in pieces:
            if start > here:
                self._add(pos, here, None)
                parts.append(text[here:start])
                pos += start - here
            self._add(pos, start, end)
            parts.append(new)
            pos += len(new)
            here = end
        self._add(pos, here, None)
        parts.append(text[here:])
        self.text = "".join(parts)

    def _add(self, pos: int, start: int, end: int | None) -> None:
        if self.at and self.at[-1] == pos:  # the piece before has become nothing
            self.at.pop()
            self.back.pop()
        self.at.append(pos)
        self.back.append((start, end))

    def source(self, start: int, end: int) -> tuple[int, int]:
        """What [start, end) of the new text was made of."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (a, whole), (b, until) = self.back[i], self.back[j]
        return (a if whole is not None else a + start - self.at[i]), (until if until is not None else b + end - self.at[j])


#: Letters of other scripts by the Latin letters they look like.
_LOOKS = dict(zip("аеорсухіјѕԁһкмнтвАВЕКМНОРСТУХІЈЅαοτνικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmhtbABEKMHOPCTYXIJSaotvikpuABEZHIKMNOPTYX"))
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_STRANGE = re.compile("[­Ͱ-׿٠-٩۰-۹०-९ -⯿豈-﫿︀-﻿＀-￯\U0001d400-\U0001d7ff\U0001f100-\U0001f1ff]")


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if c in "‐‑‒–—−":
        return "-"
    new = unicodedata.normalize("NFKC", c)
    return new if new.isascii() else c


def plain_letters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _STRANGE.finditer(text) if (new := _plain(m[0])) != m[0]]


_OPEN, _CLOSE = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_AT = rf"(?:\s{{0,3}}{_OPEN}(?:at|@){_CLOSE}\s{{0,3}}|\s{{1,3}}at\s{{1,3}}|@)"
_DOT = rf"(?:\s{{0,3}}{_OPEN}(?:dot|\.){_CLOSE}\s{{0,3}}|\s{{1,3}}dot\s{{1,3}}|\.)"
#: An address in disguise: names between dots, a sign, and a domain. Runs of names are disjoint, so the search is linear.
_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9]))*+"
_NAMES = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-]){_NAME}(?:{_DOT}{_NAME})*+")
_AT_DOMAIN = re.compile(rf"(?i)({_AT})[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++")
_ATS, _DOTS = re.compile(rf"(?i){_AT}"), re.compile(rf"(?i){_DOT}")
_MAY_AT = re.compile(r"(?i)[\s\[({<]at[\s\])}>]|[\[({<]\s{0,3}@|@")
_MAY_DOT = re.compile(r"(?i)[\s\[({<]dot[\s\])}>]|[\[({<]\s{0,3}\.\s{0,3}[\])}>]")


_MAY_BARE = re.compile(r"(?i)\sat\s{1,3}[a-z0-9-]++\.[a-z]")
#: Words that stand before "at" in prose, as in "look at example.com".
_PROSE = frozenset(
    "a all am and anyone are arrive arrived available be been begin bought buy call come contact directly email everyone file files find found free go going had has have he help her here him home host hosted i in info is it join "
    "learn live located login look looked looking looks mail me meet message more not now of off on online or order out page people pointed posted read register released see seen she shop sign site so sold someone start store that the them then there they this up us visit was we website were work working write you".split()
)
_PLAIN_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+(?:[a-z]{2,}|[A-Z]{2,})\Z")


def _address(name: str, domain: str) -> bool:
    """Whether a bare "at" between these makes an address: "dot" is spelled or bracketed in the domain, or it is a plain one after a word that is none of prose."""
    return bool(_MAY_DOT.search(domain)) or (bool(_PLAIN_DOMAIN.match(domain)) and name.lower() not in _PROSE)


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """Spelled or bracketed marks of addresses, and of four groups of digits."""
    found = sorted([*_in_addresses(text), *_in_digits(text)])
    return [x for k, x in enumerate(found) if not k or x[0] >= found[k - 1][1]]


def _in_addresses(text: str) -> list[tuple[int, int, str]]:
    if not (_MAY_BARE.search(text) or _MAY_DOT.search(text) or re.search(r"(?i)[\[({<]\s{0,3}(?:at|@)\s{0,3}[\])}>]", text)) or not _MAY_AT.search(text):
        return []
    out = []
    here = 0
    while names := _NAMES.search(text, here):
        here = names.end()
        m = _AT_DOMAIN.match(text, here)
        if not m:
            continue
        here = m.end()
        if m[1].strip().lower() == "at" and not _address(names[0], text[m.end(1) : here]):
            continue
        marks = [(x.start(), x.end(), ".") for a, b in ((names.start(), m.start()), (m.end(1), here)) for x in _DOTS.finditer(text, a, b)]
        out += sorted((a, b, new) for a, b, new in [*marks, (m.start(1), m.end(1), "@")] if text[a:b] != new)
    return out


#: Digits as words.
_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(_WORDS) + ")"
_ONE = re.compile(rf"(?i)plus|{_WORD}")
_ANY_WORD = re.compile(rf"(?i)\b{_WORD}\b")
_TOKEN = rf"(?:[0-9]++|{_WORD}(?![A-Za-z0-9]))"
_BETWEEN = r"[\s,.()-]{1,3}"
_RUN = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:plus{_BETWEEN})?{_TOKEN}(?:{_BETWEEN}{_TOKEN})*+")
_PART = re.compile(rf"(?i)plus|{_WORD}|[0-9]++")
_GROUP = rf"(?:[0-9]++|{_WORD}(?![A-Za-z0-9])(?:[\s-]{{1,3}}{_WORD}(?![A-Za-z0-9]))*+)"
_GROUPS = re.compile(rf"(?i)(?<![A-Za-z0-9]){_GROUP}(?:{_DOT}{_GROUP})*+")


def _in_digits(text: str) -> list[tuple[int, int, str]]:
    """Dots in disguise between four groups of digits or more, and spelled digits of these groups."""
    if not (_MAY_DOT.search(text) or _ANY_WORD.search(text)):
        return []
    out = []
    for m in _GROUPS.finditer(text):
        if len(_DOTS.findall(m[0])) < 3:
            continue
        here = m.start()
        for dot in [*_DOTS.finditer(text, m.start(), m.end()), None]:
            words = list(_ONE.finditer(text, here, dot.start() if dot else m.end()))
            for x, y in zip(words, [*words[1:], None]):
                out.append((x.start(), x.end(), _WORDS[x[0].lower()]))
                if y:
                    out.append((x.end(), y.start(), ""))
            if dot:
                if dot[0] != ".":
                    out.append((dot.start(), dot.end(), "."))
                here = dot.end()
    return out


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Digit words in runs of seven or more (fewer alone make no card or phone number), after "plus" or not, and in shorter runs that adjoin digits, each as one piece a word; what stands beside a word in a run goes, but for a dot."""
    if not _ANY_WORD.search(text):
        return []
    out = []
    for m in _RUN.finditer(text):
        parts = list(_PART.finditer(text, m.start(), m.end()))
        spelled = [not x[0][0].isdigit() for x in parts]
        if not any(spelled) or all(spelled) and sum(x[0].lower() != "plus" for x in parts) < 7:
            continue
        for k, x in enumerate(parts):
            if spelled[k]:
                out.append((x.start(), x.end(), "+" if x[0].lower() == "plus" else _WORDS[x[0].lower()]))
            if k + 1 < len(parts) and (spelled[k] or spelled[k + 1]):
                y = parts[k + 1]
                dot = text[x.end() : y.start()].strip()
                out.append((x.end(), y.start(), "." if dot == "." else ""))
    return out


TRANSDUCERS = (plain_letters, at_and_dot, spelled_digits)


def disguised(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that only the rewritten text shows, in offsets of ``text``; those that touch a plain span of their kind are left out."""
    steps: list[Rewritten] = []
    here = text
    for step in TRANSDUCERS:
        if pieces := step(here):
            steps.append(Rewritten(here, pieces))
            here = steps[-1].text
    if not steps:
        return []
    out = []
    # plain spans of a kind are in order and apart, so the last that begins before an end is the one to look at
    known = [[(a, b) for a, k, b in plain if k == kind] for kind in range(len(KINDS))]
    begins = [[a for a, _ in spans] for spans in known]
    for start, kind, end in find(here):
        for step in reversed(steps):
            start, end = step.source(start, end)
        k = bisect_left(begins[kind], end) - 1
        if k < 0 or known[kind][k][1] <= start:
            out.append((start, kind, end))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised and n_found of every row.

    Counts and the hash are of plain identifiers; spans has the disguised ones too, kind:start:end in code points, end exclusive, by start and then kind; n_found counts all of them. Null texts are empty. Rows are looked at one by one, so repeated rows and ids are no matter. The work is linear in a text's length; a text with disguises is held a few times over.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in K.slices(batch, 1, 4 * K.BLOCK):
                counts, shas, spans, more, every = ([], [], [], []), [], [], [], []
                for t in part.column(1).to_pylist():
                    plain = find(t) if t else []
                    added = disguised(t, plain) if t else []
                    for k in range(4):
                        counts[k].append(sum(x[1] == k for x in plain))
                    shas.append(hashlib.sha256(_joined(plain).encode()).hexdigest() if plain else nothing)
                    spans.append(_joined(plain + added))
                    more.append(len(added))
                    every.append(len(plain) + len(added))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64()), pa.array(every, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised", "n_found"])

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string, n_disguised bigint, n_found bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
