import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runmosaic.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        v = [int(c) for c in d[::-1]]
        return 13 <= len(d) <= 19 and (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def base(text):
    return [(x.kind, x.start, x.end) for x in pii.spans(text) if x.kind in pii.BASE]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@-+%_ 0123456789()é\n", max_size=60))
def test_base_spans_match_the_plain_expressions(text):
    assert base(text) == brute(text)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op6_validated_pii"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, r in got.items():
        want = brute(texts[d])
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        line = ",".join(":".join(map(str, x)) for x in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) - {""} <= set(r.spans.split(","))
    assert sum(len(brute(t)) for t in texts.values()) > 30


@pytest.mark.parametrize("text,kind", [
    ("IBAN DE89 3704 0044 0532 0130 00.", "iban"), ("pay to GB82WEST12345698765432 now", "iban"),
    ("call 030 1234567 today", "local_phone"), ("ssn 123-45-6789", "national_id")])
def test_added_kinds(text, kind):
    assert kind in {x.kind for x in pii.spans(text)}


@pytest.mark.parametrize("text", ["IBAN DE89 3704 0044 0532 0130 01.", "030 1234567", "123-45-6789", "order 123-45-6789 ssn", "version 1.2.3", "ssn 000-12-3456"])
def test_left_alone(text):
    assert pii.spans(text) == []


def test_context_moves_the_score():
    plain, near, against = (pii.spans(t)[0].score for t in ("x 10.0.0.1", "server 10.0.0.1", "version 10.0.0.1"))
    assert against < plain < near


def test_odd_rows(spark):
    long = "9" * 200_000 + " a@b.co " + "1." * 50_000 + "x" * 100_000 + "@" + "+1 " * 50_000
    rows = [(1, None), (1, None), (None, "mail é@b.co x@b.co"), (2, ""), (3, long)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id bigint, text string, spans string, n_email int")
    got = pii.pii_report(df).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == 2
    assert {r.spans for r in got if r.doc_id is None} == {"email:12:18"}
    assert {r.base_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_report(df.limit(0)).count() == 0
