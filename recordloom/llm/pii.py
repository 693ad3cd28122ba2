"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it is. The text is then rewritten by
small transducers that keep, for every rewritten stretch, where it came from:
homoglyphs and full-width forms become ASCII, invisible characters go, spelled
digits become digits, "(at)", "[dot]" and the like become "@" and ".". The
same detectors run on the rewritten text, and each new find is mapped back to
the characters of the source it was made from. Base spans always stay; a find
that lies within base spans of its kind is dropped, one that reaches further
is added beside them.

Each document is handled on its own, in one pass over Arrow batches; all
scanners are linear in the text.

Defined cases: a null text is an empty one without spans; null and repeated
ids give one row each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

# Fixed tables of the transducers.
_HOMOGLYPHS = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S",
    # Greek
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    # Signs
    "․": ".", "。": ".", "．": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
_HOMOGLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width ASCII
for _zero in (0x0660, 0x06F0, 0x0966):  # Arabic and Devanagari digits
    _HOMOGLYPHS |= {chr(_zero + i): str(i) for i in range(10)}
_GLYPH_TABLE = {ord(k): v for k, v in _HOMOGLYPHS.items()}
_INVISIBLE = "­​‌‍⁠﻿"
_ODD = re.compile("[" + re.escape("".join(_HOMOGLYPHS)) + _INVISIBLE + "]")
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_DIGIT_WORD = "(?:" + "|".join(_SPELLED) + ")"
_DIGIT_RUN = re.compile(rf"(?<![A-Za-z0-9]){_DIGIT_WORD}(?:[ \-,]{{1,2}}{_DIGIT_WORD})*(?![A-Za-z0-9])", re.I)
_ONE_DIGIT = re.compile(_DIGIT_WORD, re.I)
_PLUS = re.compile(r"(?<![A-Za-z])plus[ \-]{1,2}(?=[0-9(])", re.I)
_AT = r"(?:[ ]?[(\[{<][ ]?(?:at|@)[ ]?[)\]}>][ ]?|&#64;|&commat;|[ ]at[ ]|[ ]?@[ ]?)"
_DOT = r"(?:[ ]?[(\[{<][ ]?(?:dot|punkt|point|punto|\.)[ ]?[)\]}>][ ]?|&#46;|&period;|[ ]dot[ ]|\.)"
_LABEL = r"[A-Za-z0-9-]{1,63}"  # the lengths that mail and domain names may have, 64 and 63; up to nine dotted parts
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,8}}(?P<at>{_AT}){_LABEL}(?:{_DOT}{_LABEL}){{0,8}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])",
    re.I,
)
_SPACED_DOT = rf"(?:{_DOT}|[ ]\.[ ]?|\.[ ])"
_DOTTED = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_SPACED_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_ANY_DOT = re.compile(_DOT, re.I)
_ANY_SPACED_DOT = re.compile(_SPACED_DOT, re.I)
_ANY_AT = re.compile(_AT, re.I)
# Only texts with one of these can hold a disguise.
_HINT = re.compile(
    r"[(\[{<] ?(?:at|@|dot|punkt|point|punto|\.) ?[)\]}>]|&#64;|&commat;|&#46;|&period;| dot | @|@ |[0-9] \.|\. [0-9]|"
    rf"(?<![a-z]){_DIGIT_WORD}[ \-,]{{1,2}}{_DIGIT_WORD}[ \-,]",
    re.I,
)


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = ord(ch) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base identifiers by kind, as (start, end exclusive) in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = _emails(text) if "@" in text else []
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


class Rewritten:
    """A text under rewriting, with the source place of each of its stretches.

    ``starts`` are places in the text, ``source`` the source places there;
    between two starts the text is a copy (``copied``) or the rewriting of the
    source stretch.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts, self.source, self.copied = [0], [0], [True]
        self.end = len(text)

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ordered, disjoint stretches (start, end, new text) and compose the maps."""
        if not edits:
            return
        starts, source, copied, parts = [], [], [], []
        at = size = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            if a >= b:
                return
            i = bisect_right(self.starts, a) - 1
            pos = a
            while pos < b:
                upto = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else b)
                starts.append(size + pos - a)
                source.append(self.source[i] + (pos - self.starts[i] if self.copied[i] else 0))
                copied.append(self.copied[i])
                pos, i = upto, i + 1
            parts.append(self.text[a:b])
            size += b - a

        for a, b, new in edits:
            keep(at, a)
            if new:
                starts.append(size)
                source.append(self.place(a))
                copied.append(False)
                parts.append(new)
                size += len(new)
            at = b
        keep(at, len(self.text))
        self.text = "".join(parts)
        self.starts, self.source, self.copied = starts or [0], source or [0], copied or [True]

    def place(self, i: int) -> int:
        """Source place of the character at i."""
        k = bisect_right(self.starts, i) - 1
        return self.source[k] + (i - self.starts[k] if self.copied[k] else 0)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source stretch that the characters a to b (exclusive) were made from."""
        k = bisect_right(self.starts, b - 1) - 1
        if self.copied[k]:
            return self.place(a), self.source[k] + (b - 1 - self.starts[k]) + 1
        return self.place(a), self.source[k + 1] if k + 1 < len(self.source) else self.end


def deobfuscate(text: str) -> Rewritten | None:
    """The rewritten text, or None if there is nothing to rewrite."""
    odd = None if text.isascii() else _ODD.search(text)
    if not odd and not _HINT.search(text):
        return None
    out = Rewritten(text)
    if odd:
        plain = text.translate(_GLYPH_TABLE)  # one to one: places stay
        out.text = plain
        out.edit([(m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", plain)])
    out.edit([
        (m.start(), m.end(), "".join(_SPELLED[w.lower()] for w in _ONE_DIGIT.findall(m[0])))
        for m in _DIGIT_RUN.finditer(out.text)
        if len(_ONE_DIGIT.findall(m[0])) > 1 or " dot " in out.text or "dot" in out.text.lower()
    ])
    out.edit([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    edits = []
    for pattern in (_DISGUISED, _DOTTED):
        for m in pattern.finditer(out.text):
            base = m.start()
            if pattern is _DISGUISED:
                a, b = m.span("at")
                if m["at"].strip().isalpha() and all(d[0] == "." for d in _ANY_DOT.finditer(m[0][b - base:])):
                    continue  # a bare "at" before a plain host name is prose: the dot must be disguised too
                edits += [(base + d.start(), base + d.end(), ".") for d in _ANY_DOT.finditer(m[0][: a - base]) if d[0] != "."]
                if m["at"] != "@":
                    edits.append((a, b, "@"))
                edits += [(b + d.start(), b + d.end(), ".") for d in _ANY_DOT.finditer(m[0][b - base:]) if d[0] != "."]
            else:
                edits += [(base + d.start(), base + d.end(), ".") for d in _ANY_SPACED_DOT.finditer(m[0]) if d[0] != "."]
    edits.sort()
    clean, upto = [], 0
    for e in edits:
        if e[0] >= upto:
            clean.append(e)
            upto = e[1]
    out.edit(clean)
    return out


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, in places of the source."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    rewritten = deobfuscate(text)
    if rewritten is None or rewritten.text == text:
        return out
    for kind, spans in detect(rewritten.text).items():
        taken = sorted(base[kind])
        firsts = [s for s, _ in taken]
        for a, b in spans:
            s, e = rewritten.span(a, b)
            i, upto = max(0, bisect_right(firsts, s) - 1), s
            while i < len(taken) and taken[i][0] <= upto < e:
                upto, i = max(upto, taken[i][1]), i + 1
            if upto < e:
                out[kind].append((s, e))
    return out


def _joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


SCHEMA_TAIL = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifiers of every document.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base finds), base_sha256
    (of the base spans' list), spans (base and added: kind:start:end, code
    points, end exclusive) and n_added.
    """
    common.small_batches(docs.sparkSession)
    # Ids travel as strings, so null ids don't make floats of the others.
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), common.text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.StringType(), True), *SCHEMA_TAIL])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                base = detect(text)
                more = added_spans(text, base)
                both = {k: base[k] + more[k] for k in KINDS}
                found.append((
                    *[len(base[k]) for k in KINDS],
                    hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), sum(map(len, more.values())),
                ))
            out = pd.DataFrame(found, columns=[f.name for f in SCHEMA_TAIL])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.select(id_col).schema[0].dataType))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, disguised forms included."""
    return find_personal_data(common.read_table(spark, sf_dir, "documents"))
