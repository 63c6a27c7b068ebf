"""Pay from free text: shapes of stated pay, figures that are none, ranges by place, and the choice among spans that overlap."""

import itertools
import random

import pytest

from fernloom.functions import pay
from fernloom.operators import domain
from fernloom.registry import Tables
from pyspark.sql import functions as F

STATED = [
    ("Our base salary for this role is $110,000 - $140,000 per year.", (110000, 140000, "USD", "year")),
    ("Compensation: $140K-$190K", (140000, 190000, "USD", "year")),
    ("Salary: $110-140k", (110000, 140000, "USD", "year")),
    ("Pay: $24 - $31 per hour", (24, 31, "USD", "hour")),
    ("$24 - $31 per hour", (24, 31, "USD", "hour")),
    ("Pay rate: $17.50/hr", (17.5, 17.5, "USD", "hour")),
    ("Salary: $84,000", (84000, 84000, "USD", "year")),
    ("Nurse on the road: $2,350/week", (2350, 2350, "USD", "week")),
    ("Base salary of $3,700 monthly", (3700, 3700, "USD", "month")),
    ("Hourly: $19-$34 | Start: soon", (19, 34, "USD", "hour")),
    ("You earn a base of $120,000 to $240,000.", (120000, 240000, "USD", "year")),
    ("Salary: Up to $140,000 per year", (None, 140000, "USD", "year")),
    ("Starting pay $15.04/hr.", (15.04, None, "USD", "hour")),
    ("Compensation $125,000+, by experience", (125000, None, "USD", "year")),
    ("Salary: €58.000 per year", (58000, 58000, "EUR", "year")),
    ("Gehalt: 58.000 € brutto jährlich", (58000, 58000, "EUR", "year")),
    ("Pay € 5500 - 8300 gross per month", (5500, 8300, "EUR", "month")),
    ("Salary: £41,000 – £52,000", (41000, 52000, "GBP", "year")),
    ("We pay CAD $71,000 to $86,000 annually", (71000, 86000, "CAD", "year")),
    ("$46/hr, plus $3/hr at night", (46, 46, "USD", "hour")),
    ("$61K base, $125K OTE", (61000, 61000, "USD", "year")),
    ("We expect to pay $27/hour to $46/hour in this job.", (27, 46, "USD", "hour")),
    ("Base salary: $120,000 ($10,000/month).", (120000, 120000, "USD", "year")),
]
NONE = [
    "$4,000 sign-on bonus", "Competitive salary and a $1,500 learning stipend", "Investors gave us $140M; revenue of $9B a year.", "The 401(k) match is 6%. Room 210, ZIP 94110.",
    "Fertility benefit of up to $12,000 per year", "Tuition: up to $5,100/year is reimbursed", "You bring 3 - 5 years of experience", "Cooks earn a median wage of $41,000 per year.",
    "Phone 555-321-7654, reference 58213", "Competitive salary", "Salary: DOE", "Pay: $0", "Salary: $ - $", "Other companies pay $61,000 - $78,000 per year.",
    "Your quota is $160,000 in sales a quarter.", "Barista wanted.\n\nSimilar jobs\nShift lead - $21/hr\nManager - $64,000 per year", "", None, "No digits at all",
]


@pytest.fixture(scope="module")
def read(spark):
    def run(texts, **kw):
        cols = "id int, text string, country string, places array<string>"
        df = spark.createDataFrame([(i, t, kw.get("country"), kw.get("places")) for i, t in enumerate(texts)], cols)
        return [r.pay for r in pay.with_pay(df, "text", "country", "places").orderBy("id").collect()]

    return run


def short(p):
    return None if p is None else (p.min, p.max, p.currency, p.period)


def test_stated_pay(read):
    got = read([t for t, _ in STATED])
    assert [(t, short(p)) for (t, _), p in zip(STATED, got, strict=True)] == STATED


def test_what_is_no_pay(read):
    got = read(NONE)
    assert [(t, short(p)) for t, p in zip(NONE, got, strict=True) if p is not None] == []


def test_country_place_and_number_of_ranges(read):
    assert short(read(["Salary: $81,000 - $96,000"], country="CA")[0]) == (81000, 96000, "CAD", "year")
    assert short(read(["Yearly salary 47k - 59k"], country="FR")[0]) == (47000, 59000, "EUR", "year")
    tiers = "In Phoenix we pay $68,000 - $84,000 per year; the range in Denver: $75,000 - $92,000 per year."
    first, denver = read([tiers])[0], read([tiers], places=["Denver"])[0]
    assert (first.min, first.max, first.ranges) == (68000, 84000, 2) and (denver.min, denver.max, denver.ranges) == (75000, 92000, 2)
    hour = read(["Pay: $50/hr"])[0]
    assert (hour.annual_min, hour.annual_max, "Pay: $50/hr"[hour.start : hour.end]) == (104000, 104000, "$50/hr")


def test_spans_apart_have_the_largest_sum(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        spans = [(s := rng.randrange(20), s + rng.randint(1, 6), float(rng.randint(1, 9))) for _ in range(rng.randrange(0, 7))]
        rows.append((i, [(e, s, w) for s, e, w in spans]))
    df = spark.createDataFrame(rows, "id int, c array<struct<end:int,start:int,weight:double>>")
    for r in df.select("id", "c", pay.best_apart(F.array_sort("c")).alias("p")).collect():
        def apart(xs):
            xs = sorted(xs, key=lambda m: m.start)
            return all(a.end <= b.start for a, b in itertools.pairwise(xs))

        best = max(sum(m.weight for m in xs) for n in range(len(r.c) + 1) for xs in itertools.combinations(r.c, n) if apart(xs))
        assert apart(r.p) and sum(m.weight for m in r.p) == best


def test_long_texts_of_many_figures(spark):
    """Places of spans in long texts with copies of figures, signs around them and figures of other kinds between."""
    fill = "In 2019 we had 1,200 people in 14 towns; A60,000 and 60,000.5.1 are no pay €. "
    texts = [fill * n + "Salary: $60,000 - $70,000 per year. " + fill * m + "\x00 35.000 € im Monat." for n, m in ((0, 0), (1, 3), (40, 40))]
    got = pay.with_pay(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").orderBy("id").collect()
    for r, text in zip(got, texts, strict=True):
        assert (r.pay.min, r.pay.max, r.pay.currency, r.pay.period) == (60000.0, 70000.0, "USD", "year")
        assert text[r.pay.start : r.pay.end] == "$60,000 - $70,000"


def test_work_on_a_text(spark, sf):
    """Spans are placed without searching the text again for each, and one small file is read by all cores."""
    plan = domain.parse_pay(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(_text" not in plan and "\nRepartition" in plan.replace("+- ", "\n")
