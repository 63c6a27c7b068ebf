import hashlib
import random
import re

from pyspark.sql import functions as F

from fernloom.llm import pii
from tests.llm.util import TEXTS, documents

#: The contract's patterns as stated.
STATED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def confirmed(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), r, m.end(), k) for r, (k, rx) in enumerate(STATED) for m in re.finditer(rx, text or "") if confirmed(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def spans_of(spark, texts):
    out = pii.find_pii(documents(spark, texts))
    base = F.filter("spans", lambda m: m["rank"] < 4)
    return {r.doc_id: r.j for r in out.select("doc_id", pii._joined(base).alias("j")).collect()}


def test_base_spans_on_random_texts(spark):
    rng = random.Random(11)
    parts = ["a@b.co", "x.y@z-q.org.", "@", "..", "1.2.3.4", "256.1.1.1", "01.002.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "+1 (555) 010-9999", "+12", "+1 2", "é漢", "🤖", " ", "-", "--", "\n", "5500005555555559", "123456789012", "0", ".", "%_+", "+49.30.1234567 "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += TEXTS + ["a@b.c_d@e.f@g.h", "x@y", "1" * 40, "4" * 16 + " " + "4" * 3, "a@" + "b." * 5 + "c"]
    assert spans_of(spark, texts) == {i: brute(t) for i, t in enumerate(texts)}


def test_long_runs_stay_linear_and_shallow(spark):
    n = 60_000
    texts = ["a" * n, "1" * n, "1 " * n, "1." * n, "x@" + "a." * n + "b", "+1" + " " * n, "a@b.co " * 5000, "1.1.1.1 " * 3000, "%" * n + "@"]
    got = spans_of(spark, texts)
    assert got[0] == got[1] == got[2] == got[8] == "" and got[4] == f"email:0:{2 * n + 3}"
    assert got[6].count("email") == 5000 and got[6].endswith(f"email:{4999 * 7}:{4999 * 7 + 6}")
    assert got[7] == brute(texts[7]) and got[3] == brute(texts[3])


def test_checksums_and_context(spark):
    texts = ["My bank account GB82WEST12345698765432 here", "GB82WEST12345698765433", "social security 123-45-6789", "code 123-45-6789", "ssn 000-12-3456", "call +1 555 010 9999", "x +1 555 010 9999"]
    out = {r.doc_id: {(m.kind, m.score) for m in r.spans} for r in pii.find_pii(documents(spark, texts)).collect()}
    assert out[0] == {("iban", 1.0)} and out[1] == set()
    assert out[2] == {("ssn", 0.6)} and out[3] == out[4] == set()
    assert out[5] == {("phone", 0.9)} and out[6] == {("phone", 0.6)}
    assert {m.s for r in pii.find_pii(documents(spark, texts[:1])).collect() for m in r.spans} == {"GB82WEST12345698765432"}


def test_query_digest_nulls_and_empty(spark, tmp_path):
    texts = ["mail a@b.co and 10.0.0.1", None, "", "a@b.co", "a@b.co"]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in pii.op6_pii_spans(spark, str(tmp_path)).collect()}
    assert (out[0].n_email, out[0].n_ip, out[0].n_card, out[0].n_phone) == (1, 1, 0, 0)
    assert all(out[i].base_sha256 == hashlib.sha256(brute(t).encode()).hexdigest() for i, t in enumerate(texts))
    assert out[1].spans == out[2].spans == "" and out[3][1:] == out[4][1:]
    assert pii.find_pii(documents(spark, [])).count() == 0


def test_ibans_in_groups_and_context_on_both_sides(spark):
    iban, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [
        f"pay to {iban} now", f"pay to {spaced} now", f"{spaced} AND MORE", "GB82 WEST 1234 5698 7654 32 THEN", "NO93 8601 1117 947", "NL91 ABNA 0417 1643 00 IBAN OK", "DE89 3704 0044 0532 0130 01 wrong", "AB12 CDEF GHIJ is no account",
        "123-45-6789 is my social security number", "my ssn: 123-45-6789", "123-45-6789 alone", "number 123-45-6789",
    ]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], s.score) for s in r.spans if s.kind in ("iban", "ssn")] for r in rows}
    assert [x[1] for i in range(6) for x in got[i]] == [iban, spaced, spaced, "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "NL91 ABNA 0417 1643 00"]
    assert got[6] == [] and got[7] == []
    assert [got[i] for i in range(8, 12)] == [[("ssn", "123-45-6789", 0.6)], [("ssn", "123-45-6789", 0.6)], [], []]
