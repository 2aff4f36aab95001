"""Personal data: patterns propose, checksums confirm, context adjusts.

Regular expressions propose spans in every whole text, validators (Luhn, the mod-97
check of IBANs, octet ranges) drop what cannot be right, and words near a span raise
or lower its score. One pass of Arrow batches without a shuffle; rows are independent.

Every pattern is written so that its work is linear in the text: e-mail addresses
are looked for around each ``@`` only, and runs of digits are entered at their first
digit only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "mac", "birthdate")

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,46}(?![A-Za-z0-9])")
WORD = re.compile(r"[^\W_]+")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
BIRTHDATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])")
DIGITS = re.compile(r"[0-9]")
NO_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks leaves 1, with letters as 10 to 35."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (100 if c > "9" else 10) + int(c, 36)) % 97
    return rest == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of what the pattern allows the longest part that ends at a group's border and leaves 1.

    The pattern may run on into words and numbers that follow, so ends before each blank,
    and the end of a run of 15 to 34 characters, are tried from the last on.
    """
    for m in IBAN.finditer(text):
        body = m.group()
        ends = [len(body), *[i for i in range(len(body) - 1, 0, -1) if body[i] == " "]]
        for end in ends:
            if 15 <= len(t := body[:end].replace(" ", "")) <= 34 and mod97(t):
                yield m.start(), m.start() + end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their ``@`` outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and (text[begin - 1] in _LOCAL):
            begin -= 1
        if begin < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(s: str) -> str:
    return s.translate(NO_DIGITS)


@dataclass(frozen=True)
class Detector:
    """A kind of span; ``needs_context``: reported only with a word of ``near`` close by."""

    kind: str
    find: Callable[[str], Iterable[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    near: tuple[str, ...]
    needs_context: bool = False


def _all(pattern: re.Pattern) -> Callable[[str], Iterable[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


DETECTORS = (
    Detector("email", emails, lambda s: True, 0.9, ("mail", "contact", "write")),
    Detector("ip", _all(IP), lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split(".")), 0.6, ("ip", "address", "server", "host")),
    Detector("card", _all(CARD), lambda s: 14 <= len(d := _digits(s)) <= 19 and luhn(d), 0.8, ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta")),
    Detector("phone", _all(PHONE), lambda s: 10 <= len(_digits(s)) <= 15, 0.7, ("phone", "call", "tel", "mobile", "fax")),
    Detector("iban", ibans, lambda s: True, 0.9, ("iban", "account", "bank", "konto", "cuenta", "compte")),
    Detector("ssn", _all(SSN), lambda s: True, 0.3, ("ssn", "social", "security"), True),
    Detector("mac", _all(MAC), lambda s: True, 0.3, ("mac", "hardware", "device"), True),
    Detector("birthdate", _all(BIRTHDATE), lambda s: True, 0.3, ("born", "birth", "dob", "geboren", "né", "nacido"), True),
)
AGAINST = ("example", "test", "sample", "dummy", "version")
REACH = 40


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def find(text: str, threshold: float = 0.5) -> list[Span]:
    """All spans of a text by start, then kind; base kinds whatever their score.

    A word of the kind that begins or ends within 40 characters adds 0.3 to the score, a
    word such as "example" takes 0.2 away; whole words count, with an ending of up to three
    letters. Spans of added kinds need ``threshold``, and those that overlap an earlier
    span are left out.
    """
    out: list[Span] = []
    starts: list[int] = []  # of the spans that block others, disjoint and in order
    ends: list[int] = []
    digits = DIGITS.search(text) is not None
    for d in DETECTORS:
        if not digits and d.kind != "email" and d.kind != "mac":
            continue
        if d.kind == "phone" and "+" not in text or d.kind == "mac" and ":" not in text or d.kind in ("ssn", "birthdate") and "-" not in text:
            continue
        found = []
        for a, b in d.find(text):
            if not d.valid(text[a:b]):
                continue
            if d.kind not in BASE_KINDS and (at := bisect_left(ends, a + 1)) < len(starts) and starts[at] < b:
                continue
            words = _around(text, a, b)
            score = d.score + 0.3 * _any_of(words, d.near) - 0.2 * _any_of(words, AGAINST)
            if d.kind not in BASE_KINDS and score < threshold:
                continue
            found.append(Span(d.kind, a, b, round(min(1.0, max(0.0, score)), 2)))
        out += found
        if found:
            starts, ends = _merged(starts, ends, found)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _merged(starts: list[int], ends: list[int], found: list[Span]) -> tuple[list[int], list[int]]:
    """All spans as disjoint ones in order."""
    a: list[int] = []
    b: list[int] = []
    for x, y in sorted([*zip(starts, ends, strict=True), *[(s.start, s.end) for s in found]]):
        if a and x < b[-1]:
            b[-1] = max(b[-1], y)
        else:
            a.append(x)
            b.append(y)
    return a, b


def _around(text: str, a: int, b: int) -> set[str]:
    """Lower-case words beside a span, cut ones left out."""
    low, high = max(0, a - REACH), min(len(text), b + REACH)
    out = {m.group().lower() for m in WORD.finditer(text, low, a) if m.start() > low or low == 0 or not text[low - 1].isalnum()}
    return out | {m.group().lower() for m in WORD.finditer(text, b, high) if m.end() < high or high == len(text) or not text[high].isalnum()}


def _any_of(words: set[str], known: tuple[str, ...]) -> bool:
    return any(w.startswith(k) and len(w) <= len(k) + 3 for k in known for w in words)


def redact(text: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


ADDED = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in ADDED]
        for text in batch.column(0):
            spans = find(text.as_py() or "")
            base = [s for s in spans if s.kind in BASE_KINDS]
            for k, kind in enumerate(BASE_KINDS):
                columns[k].append(sum(s.kind == kind for s in base))
            write = lambda x: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in x)
            columns[4].append(hashlib.sha256(write(base).encode()).hexdigest())
            columns[5].append(write(spans))
            columns[6].append([s.score for s in spans])
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[*batch.schema.names[1:], *[f.name for f in ADDED]])


def scan(df: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``df`` with counts of base kinds, their digest, all spans and scores.

    Null counts as empty; very long texts are scanned whole, in time that grows with them.
    Equal rows and ties agree, an empty table gives no rows, and columns not in ``keep``
    are not read, so their names cannot clash.
    """
    keep = list(keep)
    rows = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema][1:], *ADDED])
    return rows.mapInArrow(_run, schema).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
