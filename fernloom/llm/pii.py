r"""Personal data spans with native functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for
IBANs, in one run or in groups of four), ranges and digit counts reject, and context words
shortly before or after a span adjust its score.  Offsets are code points, end exclusive.

Each base pattern is the contract's with possessive repetition, which Java runs as a loop
(no deep stack, no backtracking on very long runs): a match that starts inside a run of
its first character class can only follow a previous match (``\G``).

Positions come from one split and one extraction per kind: piece and match lengths add
up to the offsets.

Defined cases: a null text is empty and has no spans; repeated rows and doc_ids are rows
of their own; extra columns are ignored by ``find_pii``; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
CONTEXT_CHARS = 40
CHUNK = 128

#: The proposing patterns, in the order of KINDS.
EMAIL = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20\-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"

#: Score of a confirmed span, and words that raise it when they stand before it.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.95, "ssn": 0.3}
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|carte|karte|tarjeta",
    "phone": "phone|call|tel|mobile|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
CONTEXT_BONUS = 0.3
MIN_SCORE = {"email": 0.0, "ip": 0.0, "card": 0.0, "phone": 0.0, "iban": 0.5, "ssn": 0.5}


SPAN_TYPE = "array<struct<start:int,rank:int,end:int,kind:string,score:double,s:string>>"


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _chunks(xs: Column) -> Column:
    """A list cut in lists of CHUNK elements, so that running sums over long lists stay cheap."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, CHUNK))


def _running(chunks: Column) -> Column:
    """Sum of all elements before each one."""
    inside = F.transform(chunks, lambda xs: F.transform(xs, lambda x, i: _total(F.slice(xs, F.lit(1), i))))
    bases = F.aggregate(
        F.transform(chunks, _total),
        F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
        lambda a: a["out"],
    )
    return F.flatten(F.zip_with(inside, bases, lambda xs, b: F.transform(xs, lambda x: x + b)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Mod-97 checksum without spaces: the first four characters move to the end, letters count 10 to 35."""
    iban = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "iban":
        return mod97(s) & (F.length(F.replace(s, F.lit(" "), F.lit(""))) >= 15)
    if kind == "ssn":
        return ~s.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


#: A cheap test per kind that spares the pattern on texts that cannot match, and the pattern.
PROPOSALS = {
    "email": ("@", EMAIL),
    "ip": (r"[0-9]\.[0-9]", IP),
    "card": (r"[0-9](?:[\x20\-]?[0-9]){11}", CARD),
    "phone": (r"\+[0-9]", PHONE),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}| [A-Z0-9]{4} [A-Z0-9]{4})", IBAN),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]{4}", SSN),
}


def _score(kind: str, span: Column) -> Column:
    before = F.substr(F.col("text"), F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT_CHARS)))
    after = F.substr(F.col("text"), span["end"] + 1, F.lit(CONTEXT_CHARS))
    word = rf"(?i)\b(?:{CONTEXT_WORDS[kind]})\b"
    bonus = F.when(before.rlike(word) | after.rlike(word), CONTEXT_BONUS).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + bonus), 2)


def _cut_short(s: Column) -> Column:
    """A number in groups may have run into the capitals after it: up to two groups are left off until the checksum holds."""
    out = s
    for shorter in (F.regexp_replace(s, " [A-Z0-9]+ [A-Z0-9]+$", ""), F.regexp_replace(s, " [A-Z0-9]+$", ""), s):
        out = F.when(_confirmed("iban", shorter), shorter).otherwise(out)
    return out


def _scored(rank: int, kind: str) -> Column:
    """Confirmed and scored spans of one kind from its offsets, piece lengths and hits."""
    at = F.zip_with(F.col(f"off_{kind}"), F.col(f"len_{kind}"), lambda o, p: o + p)
    spans = F.zip_with(at, F.col(f"hit_{kind}"), lambda a, h: F.struct(a.alias("start"), (_cut_short(h) if kind == "iban" else h).alias("s")))
    spans = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["s"])).alias("end"), m["s"].alias("s")))
    good = F.filter(spans, lambda m: _confirmed(kind, m["s"]))
    scored = F.transform(
        good,
        lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), _score(kind, m).alias("score"), m["s"].alias("s")),
    )
    kept = F.filter(scored, lambda m: m["score"] >= MIN_SCORE[kind])
    return F.when(F.size(f"hit_{kind}") > 0, kept.cast(SPAN_TYPE)).otherwise(F.array().cast(SPAN_TYPE))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``; spans is array<struct<start,rank,end,kind,score,s>> by start, then kind as listed."""
    none = F.array().cast("array<string>")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one projection a step: a column used more than once is computed once
    out = out.select("*", *[F.when(F.col("text").rlike(test), F.regexp_extract_all(F.col("text"), F.lit(rx), F.lit(0))).otherwise(none).alias(f"hit_{k}") for k, (test, rx) in PROPOSALS.items()])
    cut = [F.when(F.size(f"hit_{k}") > 0, F.slice(F.split(F.col("text"), rx, -1), F.lit(1), F.size(f"hit_{k}"))).otherwise(none) for k, (_, rx) in PROPOSALS.items()]
    out = out.select("*", *[F.transform(c, lambda p: F.length(p)).alias(f"len_{k}") for k, c in zip(PROPOSALS, cut, strict=True)])
    step = [F.zip_with(F.col(f"len_{k}"), F.col(f"hit_{k}"), lambda n, h: n + F.length(h)) for k in PROPOSALS]
    out = out.select("*", *[_chunks(x).alias(f"chunk_{k}") for k, x in zip(PROPOSALS, step, strict=True)])
    out = out.select("*", *[F.when(F.size(f"hit_{k}") > 0, _running(F.col(f"chunk_{k}"))).alias(f"off_{k}") for k in PROPOSALS])
    return out.select("doc_id", F.array_sort(F.concat(*[_scored(r, k) for r, k in enumerate(KINDS)])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda m: m["rank"] < len(BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda m: m["score"].cast("string")), ",").alias("scores"))
