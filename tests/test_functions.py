"""Unit cases for what SQL cannot check."""

import datetime as dt
import io
import random
import struct
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fernloom.functions import facts, ranking, text
from fernloom.functions.filters import compile_filter
from fernloom.operators import domain, ingest, joins, ranking as rank_ops
from fernloom.operators.ingest import CSV_TEXT, upsert
from fernloom.registry import Tables
from fernloom.sources import boards, files


@pytest.fixture(scope="module")
def posts(spark, sf):
    return domain.posts(Tables(spark, sf))


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_pay(posts):
    got = {i: r.p and tuple(r.p) for i, r in by_id(posts.select("id", facts.parse_pay(F.col("text")).alias("p"))).items()}
    assert got[1] == (120000.0, 150000.0, "USD", "year") and got[2] == (60000.0, 70000.0, "EUR", "year")
    assert got[3] == (45.0, 60.0, "USD", "hour") and got[6] == (30000.0, 35000.0, "GBP", "year")
    assert got[4] is got[5] is got[7] is None


def test_years_level_model_and_statements(posts):
    f = by_id(posts.select("id", facts.years_required(F.col("text")).alias("y"), facts.level(F.col("title"), facts.years_required(F.col("text"))["min"], F.lit(None).cast("string")).alias("level"), facts.work_model(F.col("location"), F.col("text")).alias("m"), facts.statements(F.col("text")).alias("s")))
    assert f[1].y.min == 5 and f[2].y is None and f[3].y.min == 2 and f[4].y is None
    assert [f[i].level for i in range(1, 8)] == ["senior", None, "mid", "intern", "director", None, None]
    assert [f[i].m for i in range(1, 5)] == ["remote", "onsite", "hybrid", "onsite"]
    assert f[1].s.sponsorship == "yes" and f[2].s.sponsorship == "no" and f[3].s.us_citizen_only and f[4].s.clearance_required


def test_locations(posts):
    got = {}
    for r in posts.select("id", F.explode(facts.parse_location(F.col("location"))).alias("p")).collect():
        got.setdefault(r.id, []).append((r.p.city, r.p.region, r.p.country))
    assert got[2] == [("Berlin", None, "DE")] and got[3] == [("New York", "NY", "US"), ("Austin", "TX", "US")]


def test_dates_and_rounding(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("x")).first().x
    assert at(facts.connected_on(F.lit("03/04/2020"), F.lit(None).cast("string"))) is None
    assert at(facts.connected_on(F.lit("13/04/2020"), F.lit(None).cast("string"))) == dt.date(2020, 4, 13)
    assert at(facts.whole_years(F.lit("2020-02-29").cast("date"), F.lit("2021-02-28").cast("date"))) == 0
    assert at(facts.js_round(F.lit(-2.5))) == -2
    assert [at(facts.parse_number(F.lit(s))) for s in ("60,000", "60.000", "1,20,000", "18,50", "x")] == [60000.0, 60000.0, 120000.0, 18.5, None]


def test_thousands_behind_any_head(spark):
    tokens = ["1000,000", "1001.000", "12345,678", "1,234.50", "1002,50", "1002.5", "1000,0000", "1000,000,000"]
    got = spark.createDataFrame(list(enumerate(tokens)), "i int, s string").select("i", facts.parse_number(F.col("s")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [1000000.0, 1001000.0, 12345678.0, 1234.5, 1002.5, 1002.5, None, None]


def test_fnv_and_special_tokens(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    words = ["", "a", "foobar", "é漢", "x" * 500]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", ranking.fnv1a32(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: fnv(w) for w in words}
    tokens = spark.range(1).select(text.tokens(F.lit("C++ C# .NET Node.js 401(k) R&D Café")).alias("t")).first().t
    assert tokens == ["cplusplus", "csharp", "dotnet", "nodejs", "401k", "randd", "cafe"]


def test_unknown_fails_unless_included_and_exclusion_wins(spark):
    df = spark.createDataFrame([(1, "open", "senior", ["a"]), (2, "open", None, ["a", "b"]), (3, "closed", "senior", None)], "id int, status string, level string, skills array<string>")
    ids = lambda spec, inc=(): [r.id for r in df.where(compile_filter(spec, inc)).orderBy("id").collect()]
    assert ids({"levels": ["senior"]}) == [1] and ids({"levels": ["senior"]}, ["levels"]) == [1, 2]
    assert ids({"skills": ["a"], "exclude_skills": ["b"]}) == [1]
    with pytest.raises(ValueError):
        compile_filter({"nonsense": 1})


def test_radius_join_against_all_pairs(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-89.9, 89.9), rng.uniform(-180, 180)) for i in range(400)] + [(900, 10.0, 179.99), (901, 10.0, -179.99), (902, 89.9, 0.0), (903, 89.9, 180.0)]
    left = spark.createDataFrame(points, "id long, lat double, lon double")
    for miles in (30.0, 400.0):
        pairs = joins.within_radius(left, left.withColumnRenamed("id", "other"), miles)
        got = sorted((r.id, r.other) for r in pairs.collect())
        dist = joins.haversine_miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
        every = left.crossJoin(left.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")))
        assert got == sorted((r.id, r.other) for r in every.where(dist <= miles).collect())


def test_spread_keeps_the_cap_while_it_can():
    page = pd.DataFrame({"id": range(60), "employer": ["a"] * 20 + [f"e{i}" for i in range(40)], "n": range(60)})
    out = rank_ops.spread(page, 2, 20, 400)
    employers = out.sort_values("place")["employer"].tolist()
    assert sorted(out["id"]) == list(range(60))
    assert all(employers[i : i + 20].count("a") <= 2 for i in range(0, 21))


def test_upsert_counts(spark):
    old = spark.createDataFrame([(1, 5, "x"), (2, 5, "y")], "k int, v int, s string")
    new = spark.createDataFrame([(1, 6, None), (2, 4, "z"), (3, 1, "n")], "k int, v int, s string")
    assert sorted(tuple(r) for r in upsert(old, new, "k", "v").collect()) == [(1, 6, "x", "updated"), (2, 5, "y", "kept"), (3, 1, "n", "inserted")]


def test_contacts_csv(spark):
    rows = files.contacts(spark.createDataFrame([("f", CSV_TEXT), ("g", CSV_TEXT)], "path string, text string")).collect()
    own = [r for r in rows if r.path == "f"]
    assert len(rows) == 2 * len(own) and [(r.first, r.last) for r in own if r.error is None] == [("Ada", "Lo, Jr")]
    assert sorted(r.error for r in own if r.error) == ["no name", "unbalanced quotes"]


def test_spreadsheet_dbase_and_word(spark, tmp_path):
    sheet = io.BytesIO()
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{files.NS[1:-1]}"><si><t>name</t></si><si><r><t>A</t></r><r><t>da</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{files.NS[1:-1]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert list(files.xlsx_rows(sheet.getvalue())) == [(1, ["name", None, "7"]), (2, ["Ada", None, "x"])]
    assert list(files.xlsx_rows(sheet.getvalue(), {0})) == [(1, ["name"]), (2, ["Ada"])]
    fields = [("N", 5), ("C", 3)]
    head = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for name, w in fields)
    dbf = struct.pack("<BBBBIHH", 3, 24, 1, 1, 2, 32 + len(head) + 1, 9).ljust(32, b"\0") + head + b"\r" + b" Ada  US " + b"*Bo   FR "
    assert list(files.dbf_rows(dbf)) == [(0, ["Ada", "US"])]
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> you</w:t></w:r></w:p><w:p/></w:document>')
    assert list(files.docx_lines(doc.getvalue())) == [(0, ["Hello you"]), (1, [""])]
    (tmp_path / "a.xlsx").write_bytes(sheet.getvalue())
    out = files.binary_rows(spark.read.format("binaryFile").load(str(tmp_path / "a.xlsx")), files.xlsx_rows).collect()
    assert [r.cells for r in sorted(out, key=lambda r: r.row)] == [["name", None, "7"], ["Ada", None, "x"]]


MAPPED = {
    "greenhouse": '{"id": 5, "title": "T", "updated_at": "2024-01-02T00:00:00Z"}', "lever": '{"id": "5", "text": "T"}', "ashby": '{"id": "5", "title": "T", "location": "A"}', "workable": '{"shortcode": "5", "title": "T"}',
    "recruitee": '{"id": 5, "title": "T"}', "gem": '{"id": "5", "title": "T"}', "remotive": '{"id": 5, "title": "T"}', "remoteok": '{"id": "5", "position": "T"}', "github_json": '{"id": "5", "title": "T", "active": true, "is_visible": true}',
    "personio": "<position><id>5</id><name>T</name></position>", "teamtailor": "<item><guid>5</guid><title>T</title></item>", "jsonld": '{"@type": "JobPosting", "title": "T", "identifier": {"value": "5"}}',
}


@pytest.mark.parametrize("name", sorted(MAPPED))
def test_mappers_reject_what_is_no_posting(spark, name):
    broken = ["{broken", "<x>", "", None, "[]", "{}", "7", MAPPED[name][:-3]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([MAPPED[name], *broken])], "i int, payload string")
    rows = ingest.facts(df.select(getattr(boards, name)(F.col("payload")).alias("p")), "external_id", "title").collect()
    assert [tuple(r) for r in rows] == [("5", "T")]


def test_a_payload_is_parsed_once(spark):
    df = spark.createDataFrame([(MAPPED["greenhouse"],)], "payload string")
    out = ingest.facts(df.select(boards.greenhouse(F.col("payload")).alias("p")), "external_id", "title", "url", "posted_at", "pay_min", "text")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_least_of_others_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice("abc")) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, k string, c string")
    want = {i: min((j for j, l, d in rows if l == k and k is not None and d != c), default=None) for i, k, c in rows}
    assert {r.id: r.m for r in joins.least_of_others(df, df, ["k"], ["c"], "m").collect()} == want


def test_alias_fold_equals_the_plain_scan(spark):
    rng = random.Random(8)
    aliases = {"a b": "AB", "a": "A", "b c a": "BCA", "c": "C", "d d": "DD"}
    rows = [(i, [rng.choice("abcdx") for _ in range(rng.randint(0, 9))]) for i in range(80)]
    got = spark.createDataFrame(rows, "i int, t array<string>").select("i", domain.scan_aliases(F.col("t"), aliases).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: domain.greedy_spans(t, aliases, 3) for i, t in rows}
