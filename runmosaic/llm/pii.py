"""Personal data: expressions propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runmosaic.llm.common import rows

# fixed values: the base expressions; runs of digits are taken whole and once, which changes no match but keeps long ones linear
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# proposals beyond the base
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-]?[0-9]{2,5}(?![0-9.-])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("iban", "local_phone", "national_id")
NEAR = 40
ACCEPT = 0.5
# fixed values: words before a span that speak for its kind, in four languages
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "telefon", "anruf", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "telefon", "anruf", "téléphone", "teléfono"),
    "national_id": ("ssn", "social", "security", "id"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.3, "national_id": 0.3}
# fixed values: words that speak against personal data
AGAINST = ("version", "order", "invoice", "sku", "isbn", "part", "release")
NEARBY = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of name@host: found at the sign and widened to the left, never into the match before."""
    last = 0
    for m in AT.finditer(text):
        s = m.start()
        while s > last and LOCAL.match(text, s - 1):
            s -= 1
        if s < m.start():
            yield s, m.end()
            last = m.end()


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Proposed spans that pass their validator; one that fails is dropped and not tried shorter."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(digits_of(m[0])) <= 12:
            yield "local_phone", m.start(), m.end()
    for m in NATIONAL_ID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int, near: int = NEAR) -> float:
    """The kind's prior, raised by words of its kind nearby and lowered by words against it."""
    around = {w.lower() for w in NEARBY.findall(text[max(0, start - near):start]) + NEARBY.findall(text[end:end + near])}
    p = PRIOR[kind] + 0.4 * bool(around & set(CONTEXT[kind])) - 0.3 * bool(around & set(AGAINST))
    return min(1.0, max(0.0, p))


def spans(text: str | None, accept: float = ACCEPT) -> list[Span]:
    """All base spans, and further ones whose score reaches ``accept`` and which meet no base span, by kind and place.

    Base spans are kept at any score. Null counts as empty. Offsets are code points, ends exclusive.
    """
    text = text or ""
    found = [Span(k, s, e, score(text, k, s, e)) for k, s, e in confirmed(text)]
    base = [x for x in found if x.kind in BASE]
    more = [x for x in found if x.kind not in BASE and x.score >= accept and all(x.end <= b.start or b.end <= x.start for b in base)]
    return sorted(base + more, key=lambda x: (KINDS.index(x.kind), x.start))


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, spans`` for every row of ``doc_id, text``, whole texts; null text has none, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            got = [[x._asdict() for x in spans(t, accept)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, ARROW_SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and the text of all spans."""
    found = find(docs)
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    line = "concat_ws(':', x.kind, x.start, x.end)"
    base = F.expr(f"array_join(transform(filter(spans, x -> x.kind in {BASE}), x -> {line}), ',')")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        F.expr(f"array_join(transform(spans, x -> {line}), ',')").alias("spans"))
