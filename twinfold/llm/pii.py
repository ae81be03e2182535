"""Personal data in whole texts: patterns propose spans, checksums confirm them, nearby words move their scores.

All patterns are scanned in one pass each without re-reading: a text of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_slices, map_texts, pick, quoted, slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "routing")
CONTEXT_CHARS = 40
KEEP_SCORE = 0.5
CONTEXT_STEP = 0.3
SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)
SPAN_SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>, redacted string"

# score of a span that its pattern and checksum propose, before the words around it are read
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "routing": 0.3}
CONTEXT_WORDS = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "credit", "visa", "mastercard", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "account", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "routing": {"routing", "aba", "bank", "transit"},
}
DOUBT_WORDS = {"example", "version", "isbn", "serial", "invoice", "order"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+")
_ANY_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number with country code and check digits is consistent."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def routing_check(digits: str) -> bool:
    return sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0 and digits != "000000000"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Non-overlapping addresses: around every @, the run of name characters before and the domain behind it."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        taken = domain.end() if domain else at + 1
        if domain:
            yield start, taken
        at = text.find("@", taken)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers up to 255. Of longer dotted runs each next four numbers are one proposal."""
    for run in _DOTTED.finditer(text):
        parts, start = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGIT_RUN.finditer(text):
        if 14 <= len(run[0]) and 14 <= len(digits := _digits(run[0])) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 10 <= len(_digits(run[0])) <= 15:
            yield run.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers confirmed by mod 97; of a run with trailing words the longest valid part."""
    for run in _IBAN.finditer(text):
        end = run.end()
        while end - run.start() >= 15:
            if mod97(text[run.start() : end].replace(" ", "")):
                yield run.start(), end
                break
            end = text.rfind(" ", run.start(), end)


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for run in _SSN.finditer(text):
        area, group, serial = run[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield run.span()


def routings(text: str) -> Iterator[tuple[int, int]]:
    return (run.span() for run in _ROUTING.finditer(text) if routing_check(run[0]))


FINDERS = {"ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns, "routing": routings}


def span_score(text: str, kind: str, start: int, end: int) -> float:
    """Start score of the kind, moved up by words of its own near the span and down by words that speak against it."""
    around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    near = {w.lower() for w in _WORD.findall(around)}
    step = CONTEXT_STEP * (bool(near & CONTEXT_WORDS[kind]) - bool(near & DOUBT_WORDS))
    return round(min(1.0, max(0.0, START_SCORE[kind] + step)), 3)


class Taken:
    """Spans that are taken: the first ones may overlap each other, those added later overlap none."""

    def __init__(self, first: Iterable[tuple[int, int]]):
        spans = sorted(first)
        self._starts = [s for s, _ in spans]
        self._reach = list(accumulate((e for _, e in spans), max))  # the furthest end of the spans so far
        self._later: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        if before and self._reach[before - 1] > start:
            return False
        at = bisect_left(self._later, (end,))
        return not at or self._later[at - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        insort(self._later, (start, end))


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Spans as (start, end, kind, score) by start, then kind.

    Spans of the base kinds always stay, with their score. Spans of other kinds stay if their score reaches
    ``KEEP_SCORE`` and they overlap no span before them.
    """
    found = [(s, e, "email") for s, e in emails(text)]
    if _ANY_DIGIT.search(text):
        for kind in BASE_KINDS[1:]:
            found += [(s, e, kind) for s, e in FINDERS[kind](text)]
        taken = Taken((s, e) for s, e, _ in found)
        for kind in KINDS[len(BASE_KINDS) :]:
            for s, e in FINDERS[kind](text):
                if span_score(text, kind, s, e) >= KEEP_SCORE and taken.free(s, e):
                    found.append((s, e, kind))
                    taken.add(s, e)
    return sorted(
        ((s, e, kind, span_score(text, kind, s, e)) for s, e, kind in found), key=lambda x: (x[0], KINDS.index(x[2]))
    )


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """Text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    parts, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, spans, redacted``: spans with kind, start, end (code points, end exclusive) and score.

    A null text counts as empty: no spans, and its redacted text is null. Every row is judged by itself, so repeated rows
    and null ids are kept; an empty table gives an empty table. Only the two named columns are read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        spans = [find_spans(t or "") for t in texts]
        items = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in row] for row in spans]
        clean = [t if t is None else redact(t, row) for t, row in zip(texts, spans)]
        arrays = [batch.column("doc_id"), pa.array(items, SPAN_TYPE), pa.array(clean, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "spans", "redacted"])

    rows = pick(df, doc_id=id_col, text=text_col)
    return map_slices(rows.withColumn("doc_id", F.col("doc_id").cast("bigint")), run, SPAN_SCHEMA, "text")


def redact_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in ``text_col`` replaced; null texts stay null."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else redact(t, find_spans(t)) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return map_texts(df, run, df.schema)


def spans_text(spans: str, kinds: tuple[str, ...] | None = None):
    """Column ``kind:start:end`` of the spans joined by commas, of the given kinds or all."""
    items = F.col(quoted(spans))
    if kinds:
        items = F.filter(items, lambda s: s["kind"].isin(*kinds))
    joined = F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(joined, ",")
