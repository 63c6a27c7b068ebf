"""Dates, numbers, places, extractors and match scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions import facts as x
from fernloom.functions.filters import words
from fernloom.functions.pay import with_pay
from fernloom.operators.joins import haversine_miles
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


def frame(t: Tables, rows: list, schema: str) -> DataFrame:
    """A small constant table."""
    return t.spark.createDataFrame(rows, schema)


@query("d_iso_or_null", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS ts FROM orders")
def iso_or_null(t: Tables) -> DataFrame:
    shapes = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).otherwise("soon")
    return t.orders.select("o_orderkey", x.iso_or_null(shapes).cast("timestamp_ntz").alias("ts"))


@query("d_day_of", "SELECT o_orderkey, CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS day FROM orders")
def day_of(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.date_diff(F.to_date("o_orderdate"), F.expr("DATE '2000-01-01'")) + 1).alias("day"))


@query("d_connected_on", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def connected_on(t: Tables) -> DataFrame:
    """The same day written in six ways comes back as one date."""
    k = F.col("o_orderkey") % 6
    shape = x.first_case([(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(["dd MMM yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy"])])
    return t.orders.select("o_orderkey", x.connected_on(shape, F.lit("mdy")).alias("day"))


@query("d_learn_slash", "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'dmy' ELSE 'mdy' END AS slash FROM orders GROUP BY 1")
def learn_slash(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(x.slash_order(F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))).alias("slash"))


@query("d_years_between", "SELECT l_orderkey, l_linenumber, CAST(date_part('year', age(CAST(l_shipdate AS DATE), DATE '1990-03-15')) AS INT) AS years FROM lineitem")
def years_between(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", x.whole_years(F.expr("DATE '1990-03-15'"), F.to_date("l_shipdate")).alias("years"))


@query("d_days_between", "SELECT o_orderkey, date_diff('day', DATE '1998-02-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def days_between(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.expr("DATE '1998-02-01'")).cast("long").alias("days"))


@query("d_local_date", "SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events")
def local_date(t: Tables) -> DataFrame:
    """Calendar date in New York; January has a constant offset."""
    return t.events.select("event_id", F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")).alias("day"))


@query("d_local_range", "SELECT DISTINCT date_trunc('day', ts) AS day_start, date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS day_end FROM events")
def local_range(t: Tables) -> DataFrame:
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return t.events.select(day.alias("day_start"), (day + F.expr("INTERVAL 1 DAY - INTERVAL 0.001 SECOND")).alias("day_end")).distinct()


@query("d_fiscal_year", "SELECT o_orderkey, CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INT) AS fiscal_year FROM orders")
def fiscal_year(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", x.fiscal_year(F.col("o_orderdate")).alias("fiscal_year"))


@query("d_fiscal_quarter", "SELECT o_orderkey, CAST(quarter(o_orderdate + INTERVAL 3 MONTH) AS INT) AS fiscal_quarter FROM orders")
def fiscal_quarter(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", x.fiscal_quarter(F.col("o_orderdate")).alias("fiscal_quarter"))


@query("d_fiscal_range", "WITH q AS (SELECT DISTINCT CAST(year(o_orderdate + INTERVAL 3 MONTH) AS INT) AS y, CAST(quarter(o_orderdate + INTERVAL 3 MONTH) AS INT) AS q FROM orders) SELECT y, q, CAST(make_date(y - 1, 10, 1) + to_months((q - 1) * 3) AS DATE) AS first_day, CAST(make_date(y - 1, 10, 1) + to_months(q * 3) - INTERVAL 1 DAY AS DATE) AS last_day FROM q")
def fiscal_range(t: Tables) -> DataFrame:
    q = t.orders.select(x.fiscal_year(F.col("o_orderdate")).alias("y"), x.fiscal_quarter(F.col("o_orderdate")).alias("q")).distinct()
    start = F.make_date(F.col("y") - 1, F.lit(10), F.lit(1))
    return q.select("y", "q", F.add_months(start, (F.col("q") - 1) * 3).alias("first_day"), F.date_sub(F.add_months(start, F.col("q") * 3), 1).alias("last_day"))


@query("d_excel_date", "SELECT p_partkey, DATE '1899-12-30' + CAST(36000 + p_partkey AS INT) AS day FROM part")
def excel_date(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", x.excel_date(36000 + F.col("p_partkey")).alias("day"))


@query("d_month_index", "SELECT o_orderkey, CAST(year(o_orderdate) * 12 + CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE 12 END - 1 AS INT) AS month FROM orders")
def month_index(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return t.orders.select("o_orderkey", x.month_index(text, True).alias("month"))


@query("d_annualize", "SELECT p_partkey, CAST(floor((p_size - 25.5) * CASE p_partkey % 5 WHEN 0 THEN 2080 WHEN 1 THEN 260 WHEN 2 THEN 52 WHEN 3 THEN 12 ELSE 1 END + 0.5) AS BIGINT) AS annual FROM part")
def annualize(t: Tables) -> DataFrame:
    period = x.first_case([(F.col("p_partkey") % 5 == i, F.lit(p)) for i, p in enumerate(["hour", "day", "week", "month", "year"])])
    return t.part.select("p_partkey", x.annualize(F.col("p_size") - 25.5, period).cast("long").alias("annual"))


@query("d_parse_number", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey * 1000.0 WHEN 1 THEN s_suppkey * 1000.0 WHEN 2 THEN s_suppkey + 0.5 END::DOUBLE AS number FROM supplier")
def parse_number(t: Tables) -> DataFrame:
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    token = F.when(k % 4 == 0, F.when(k == 0, "0").otherwise(F.concat(s, F.lit(",000")))).when(k % 4 == 1, F.concat(s, F.lit(".000"))).when(k % 4 == 2, F.concat(s, F.lit(",50"))).otherwise("n/a")
    return t.supplier.select("s_suppkey", x.parse_number(token).alias("number"))


#: One SQL text for Spark and for the oracle: an ad per order whose title, place and text state facts of its columns.
#: ``lo`` and ``hi`` are thousands, ``y`` years; the remainders tell which sentence an ad has.
_ADS = """SELECT o_orderkey AS job_id, lo, hi, y, o_orderkey % 7 AS k7, o_orderkey % 6 AS k6, o_orderkey % 5 AS k5, o_custkey % 6 AS c6, o_custkey % 5 AS c5,
  CASE o_orderkey % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Junior ' WHEN 3 THEN 'Lead ' ELSE '' END
    || CASE o_custkey % 5 WHEN 0 THEN 'Marketing Intern' WHEN 1 THEN 'Analyst (part-time)' WHEN 2 THEN 'Contract Engineer' ELSE 'Engineer' END AS title,
  CASE o_custkey % 5 WHEN 0 THEN 'Berlin, Germany' WHEN 1 THEN 'New York, NY; Austin, TX' WHEN 2 THEN 'Paris, France' WHEN 3 THEN 'London, United Kingdom' END AS location,
  CASE o_orderkey % 7 WHEN 0 THEN 'Pay: $' || CAST(lo AS STRING) || ',000 - $' || CAST(hi AS STRING) || ',000 per year. ' WHEN 1 THEN '€' || CAST(lo AS STRING) || '.000 to €' || CAST(hi AS STRING) || '.000 salary. '
    WHEN 2 THEN '£' || CAST(lo AS STRING) || 'k to £' || CAST(hi AS STRING) || 'k. ' WHEN 3 THEN '$' || CAST(lo AS STRING) || ' - $' || CAST(hi AS STRING) || ' per hour. '
    WHEN 4 THEN 'Earn $' || CAST(lo AS STRING) || '00 a month. ' WHEN 5 THEN 'We raised $' || CAST(lo AS STRING) || ' million. ' ELSE '' END
    || CASE o_custkey % 6 WHEN 0 THEN CAST(y AS STRING) || '+ years of experience required. ' WHEN 1 THEN CAST(y AS STRING) || '-' || CAST(y + 2 AS STRING) || ' years of SQL. ' WHEN 2 THEN CAST(y AS STRING) || ' years preferred. '
    WHEN 3 THEN CAST(y AS STRING) || ' years or ' || CAST(y + 2 AS STRING) || ' years of Java. ' WHEN 4 THEN 'We have been in business for ' || CAST(y AS STRING) || ' years. ' ELSE '' END
    || CASE o_orderkey % 5 WHEN 0 THEN 'Visa sponsorship is available. ' WHEN 1 THEN 'We cannot sponsor visas. ' WHEN 2 THEN 'Must be a U.S. citizen. ' WHEN 3 THEN 'Security clearance required. ' ELSE 'An equal opportunity employer, no sponsorship question is asked. ' END
    || CASE o_orderkey % 6 WHEN 0 THEN 'This is a remote role. ' WHEN 1 THEN 'Hybrid. ' WHEN 2 THEN 'This is an on-site role. ' WHEN 3 THEN 'This role is not remote. ' WHEN 4 THEN 'Not remote, hybrid. ' ELSE '' END
    || CASE WHEN o_custkey % 5 = 3 THEN 'Job type: full-time.' ELSE '' END AS text
  FROM (SELECT o_orderkey, o_custkey, 40 + o_orderkey % 160 AS lo, 45 + o_orderkey % 160 + o_custkey % 40 AS hi, 1 + o_custkey % 9 AS y FROM orders)"""
_WITH = f"WITH ads AS ({_ADS}) "
_MIN_YEARS = "CASE WHEN c6 IN (0, 1, 3) THEN y END"


def ads(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    return t.spark.sql(_ADS.replace("FROM orders", "FROM {orders}"), orders=t.orders if orders is None else orders)


def dealt(t: Tables) -> DataFrame:
    """The keys of orders over all cores: a text takes far longer to read than its keys to move, and a small file is one task."""
    return t.orders.select("o_orderkey", "o_custkey").repartition(4 * t.spark.sparkContext.defaultParallelism)


#: Small texts of all kinds, for unit cases.
POSTS = [
    (1, "Senior Data Engineer", "Remote, USA", "Pay: $120,000 - $150,000 per year. 5+ years of experience required. Visa sponsorship is available."),
    (2, "Recruiter", "Berlin, Germany", "€60.000 - €70.000 salary. On-site. 3-5 years preferred. We cannot sponsor visas."),
    (3, "Software Developer II", "New York, NY; Austin, TX", "$45 - $60 per hour, hybrid. 2 years or 4 years of SQL. Must be a U.S. citizen."),
    (4, "Intern", "London, United Kingdom", "Internship. A 100 years old company. Not remote. Security clearance required."),
    (5, "Director of Data", None, "Great team."),
    (6, "Nurse", "Paris, France", "£30k to £35k. Job type: part-time"),
    (7, None, "", None),
]


def posts(t: Tables) -> DataFrame:
    return frame(t, POSTS, "id int, title string, location string, text string")


@query("d_parse_pay", f"""{_WITH} SELECT job_id, CAST(CASE WHEN k7 IN (0, 1, 2) THEN lo * 1000 WHEN k7 = 3 THEN lo WHEN k7 = 4 THEN lo * 100 END AS DOUBLE) AS "min", CAST(CASE WHEN k7 IN (0, 1, 2) THEN hi * 1000 WHEN k7 = 3 THEN hi WHEN k7 = 4 THEN lo * 100 END AS DOUBLE) AS "max",
  CASE k7 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'USD' WHEN 4 THEN 'USD' END AS currency, CASE k7 WHEN 0 THEN 'year' WHEN 1 THEN 'year' WHEN 2 THEN 'year' WHEN 3 THEN 'hour' WHEN 4 THEN 'month' END AS period FROM ads""")
def parse_pay(t: Tables) -> DataFrame:
    return with_pay(ads(t, dealt(t)).select("job_id", "text"), "text").select("job_id", "pay.min", "pay.max", "pay.currency", "pay.period")


#: Texts of every shape of pay, and of figures that are none, by the remainder ``k``; ``lo`` and ``hi`` are thousands or units.
_PAYS = """SELECT job_id, k, lo, hi, place, CASE WHEN c3 = 0 THEN 'CA' WHEN c3 = 1 THEN 'FR' END AS country, CASE WHEN place = 0 THEN {array}('Denver', 'CO') END AS places,
  CASE k WHEN 0 THEN 'Salary: Up to $' || h || ',000 per year' WHEN 1 THEN 'Starting pay $' || l || '/hr.' WHEN 2 THEN 'Compensation $' || l || ',000+, by experience' WHEN 3 THEN 'Salary: $' || l || '-' || h || 'k'
    WHEN 4 THEN 'Gehalt: ' || l || '.000 € brutto jährlich' WHEN 5 THEN '$' || l || '/hr, plus $3/hr at night' WHEN 6 THEN '$' || l || 'K base, $' || h || 'K OTE' WHEN 7 THEN 'We pay CAD $' || l || ',000 to $' || h || ',000 annually'
    WHEN 8 THEN '$' || l || ',000 sign-on bonus' WHEN 9 THEN 'In Phoenix we pay $' || l || ',000 - $' || h || ',000 per year; the range in Denver: $' || CAST(lo + 100 AS STRING) || ',000 - $' || CAST(hi + 100 AS STRING) || ',000 per year.'
    WHEN 10 THEN 'We raised $' || l || 'M this year.' WHEN 11 THEN 'Other companies pay $' || l || ',000 per year.' WHEN 12 THEN 'Salary range: ' || l || 'k - ' || h || 'k yearly' ELSE 'Salary: DOE' END AS text
  FROM (SELECT o_orderkey AS job_id, o_orderkey % 14 AS k, o_custkey % 3 AS c3, o_custkey % 2 AS place, 40 + o_orderkey % 160 AS lo, 45 + o_orderkey % 160 + o_custkey % 40 AS hi,
    CAST(40 + o_orderkey % 160 AS STRING) AS l, CAST(45 + o_orderkey % 160 + o_custkey % 40 AS STRING) AS h FROM orders)"""


@query("d_pay_spans", f"""WITH p AS ({_PAYS.format(array='list_value')}) SELECT job_id,
  CAST(CASE WHEN k IN (1, 5) THEN lo WHEN k IN (2, 3, 4, 6, 7) OR k = 12 AND country IS NOT NULL THEN lo * 1000 WHEN k = 9 THEN (lo + CASE WHEN place = 0 THEN 100 ELSE 0 END) * 1000 END AS DOUBLE) AS "min",
  CAST(CASE WHEN k = 5 THEN lo WHEN k IN (0, 3, 7) OR k = 12 AND country IS NOT NULL THEN hi * 1000 WHEN k IN (4, 6) THEN lo * 1000 WHEN k = 9 THEN (hi + CASE WHEN place = 0 THEN 100 ELSE 0 END) * 1000 END AS DOUBLE) AS "max",
  CASE WHEN k = 4 OR k = 12 AND country = 'FR' THEN 'EUR' WHEN k = 7 OR country = 'CA' AND (k <= 6 OR k IN (9, 12)) THEN 'CAD' WHEN k <= 6 OR k = 9 THEN 'USD' END AS currency,
  CASE WHEN k IN (1, 5) THEN 'hour' WHEN k <= 7 OR k = 9 OR k = 12 AND country IS NOT NULL THEN 'year' END AS period, CASE WHEN k = 9 THEN 2 WHEN k <= 7 OR k = 12 AND country IS NOT NULL THEN 1 END AS ranges FROM p""")
def pay_spans(t: Tables) -> DataFrame:
    """Pay of every shape, with the country's currency, the place's range and the number of ranges."""
    texts = t.spark.sql(_PAYS.format(array="array").replace("FROM orders", "FROM {{orders}}").replace("{{orders}}", "{orders}"), orders=dealt(t))
    read = with_pay(texts, "text", "country", "places")
    return read.select("job_id", *[f"pay.{c}" for c in ("min", "max", "currency", "period", "ranges")])


@query("d_pay_from_board", f"{JOBS} SELECT job_id, least(annual_min, annual_max) AS low, greatest(annual_min, annual_max) AS high, CASE WHEN annual_min >= 10000 THEN 'year' WHEN annual_min BETWEEN 5 AND 250 THEN 'hour' END AS period FROM jobs WHERE annual_min > 0")
def pay_from_board(t: Tables) -> DataFrame:
    """Zero is unset, a swapped range is put right, the period is told by size."""
    a, b = F.nullif("annual_min", F.lit(0.0)), F.nullif("annual_max", F.lit(0.0))
    period = F.when(a >= 10000, "year").when(a.between(5, 250), "hour")
    return jobs(t).where(a.isNotNull()).select("job_id", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), period.alias("period"))


@query("d_pay_sort_key", f"{JOBS} SELECT job_id, CASE WHEN currency = 'USD' THEN coalesce(annual_max, annual_min) END AS key FROM jobs")
def pay_sort_key(t: Tables) -> DataFrame:
    from fernloom.functions.filters import pay_top

    return jobs(t).select("job_id", pay_top().alias("key"))


@query("d_format_pay", f"{JOBS} SELECT job_id, currency || ' ' || format('{{:,}}', CAST(annual_min AS BIGINT)) || CASE WHEN annual_max IS NULL THEN '' ELSE ' to ' || format('{{:,}}', CAST(annual_max AS BIGINT)) END AS pay FROM jobs WHERE currency IS NOT NULL")
def format_pay(t: Tables) -> DataFrame:
    top = F.when(F.col("annual_max").isNull(), "").otherwise(F.concat(F.lit(" to "), F.format_number("annual_max", 0)))
    return jobs(t).where("currency IS NOT NULL").select("job_id", F.concat("currency", F.lit(" "), F.format_number("annual_min", 0), top).alias("pay"))


@query("d_years_required", f"""{_WITH} SELECT job_id, CAST({_MIN_YEARS} AS INT) AS "min", CAST(CASE WHEN c6 = 1 THEN y + 2 END AS INT) AS "max" FROM ads""")
def years_required(t: Tables) -> DataFrame:
    return ads(t).select("job_id", x.years_required(F.col("text")).alias("r")).select("job_id", "r.*")


@query("d_level", f"""{_WITH}, o AS (SELECT job_id, {_MIN_YEARS} AS years, CASE k5 WHEN 0 THEN 'senior' WHEN 1 THEN 'staff' WHEN 3 THEN 'lead' ELSE CASE WHEN c5 = 0 THEN 'intern' WHEN k5 = 2 THEN 'junior' END END AS own FROM ads)
  SELECT job_id, CASE WHEN own IN ('senior', 'staff', 'intern') THEN own WHEN years <= 1 THEN 'entry' WHEN years <= 4 THEN 'mid' WHEN years IS NOT NULL THEN 'senior' ELSE own END AS level FROM o""")
def level(t: Tables) -> DataFrame:
    return ads(t).select("job_id", x.level(F.col("title"), x.years_required(F.col("text"))["min"], F.lit(None).cast("string")).alias("level"))


@query("d_level_title", f"{JOBS} SELECT DISTINCT title, CASE title WHEN 'Senior Data Engineer' THEN 'senior' WHEN 'Engineering Manager' THEN 'manager' WHEN 'Registered Nurse II' THEN 'mid' WHEN 'Lead Analyst, 2024 Summer' THEN 'lead' WHEN 'Junior Software Engineer' THEN 'junior' WHEN 'Director of Data' THEN 'director' END AS level FROM jobs")
def level_title(t: Tables) -> DataFrame:
    return jobs(t).select("title").distinct().select("title", x.level_of_title(F.col("title")).alias("level"))


_LB = "CASE WHEN {0} IS NULL THEN [] WHEN {0} <= 1 THEN ['entry'] WHEN {0} <= 3 THEN ['entry', 'mid'] WHEN {0} <= 5 THEN ['mid'] WHEN {0} <= 8 THEN ['mid', 'senior'] ELSE ['senior'] END"


@query("d_buckets_years", f"{JOBS} SELECT job_id, {_LB.format('years_min')} AS buckets FROM jobs")
def buckets_years(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", x.level_buckets(F.col("years_min")).alias("buckets"))


@query("d_levels_of", f"{JOBS} SELECT job_id, list_sort(list_distinct(list_concat(CASE WHEN level IS NULL THEN [] ELSE [level] END, CASE WHEN level IS NULL OR list_contains({_LB.format('years_min')}, level) THEN {_LB.format('years_min')} ELSE [] END))) AS levels FROM jobs")
def levels_of(t: Tables) -> DataFrame:
    """The stated level, merged with the years' buckets where they agree."""
    by_years, none = x.level_buckets(F.col("years_min")), F.array().cast("array<string>")
    stated = F.when(F.col("level").isNull(), none).otherwise(F.array("level"))
    agreed = F.when(F.col("level").isNull() | F.array_contains(by_years, F.col("level")), by_years).otherwise(none)
    return jobs(t).select("job_id", F.array_sort(F.array_union(stated, agreed)).alias("levels"))


@query("d_level_bucket", f"{JOBS} SELECT job_id, CASE level WHEN 'manager' THEN 'lead' ELSE level END AS bucket FROM jobs")
def level_bucket(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", x.level_bucket(F.col("level")).alias("bucket"))


@query("d_work_model", f"""{_WITH} SELECT job_id, CASE k6 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'onsite' WHEN 4 THEN 'hybrid' END AS work_model FROM ads""")
def work_model(t: Tables) -> DataFrame:
    return ads(t).select("job_id", x.work_model(F.col("location"), F.col("text")).alias("work_model"))


@query("d_regions_of_area", "SELECT n_nationkey, CASE WHEN r_name = 'EUROPE' THEN ['EU', 'EMEA'] WHEN r_name = 'ASIA' THEN ['APAC'] WHEN r_name IN ('AFRICA', 'MIDDLE EAST') THEN ['EMEA'] ELSE ['AMER'] END AS regions FROM nation JOIN region ON n_regionkey = r_regionkey")
def regions_of_area(t: Tables) -> DataFrame:
    areas = {"EUROPE": ["EU", "EMEA"], "ASIA": ["APAC"], "AFRICA": ["EMEA"], "MIDDLE EAST": ["EMEA"], "AMERICA": ["AMER"]}
    table = F.create_map(*[c for k, v in areas.items() for c in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.element_at(table, F.col("r_name")).alias("regions"))


@query("d_statements", f"""{_WITH} SELECT job_id, CASE k5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS sponsorship, CASE WHEN k5 = 3 THEN TRUE END AS clearance_required, CASE WHEN k5 = 2 THEN TRUE END AS us_citizen_only FROM ads""")
def statements(t: Tables) -> DataFrame:
    return ads(t).select("job_id", x.statements(F.col("text")).alias("s")).select("job_id", "s.*")


@query("d_employment_type", f"""{_WITH} SELECT job_id, CASE c5 WHEN 0 THEN 'intern' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'full_time' END AS employment_type FROM ads""")
def employment_type(t: Tables) -> DataFrame:
    return ads(t).select("job_id", x.employment_type(F.lit(""), F.col("title"), F.col("text")).alias("employment_type"))


@query("d_parse_location", f"""{_WITH}, stated(c5, text, city, region, country) AS (VALUES (0, 'Berlin, Germany', 'Berlin', NULL, 'DE'), (1, 'New York, NY', 'New York', 'NY', 'US'), (1, 'Austin, TX', 'Austin', 'TX', 'US'), (2, 'Paris, France', 'Paris', NULL, 'FR'), (3, 'London, United Kingdom', 'London', NULL, 'GB'))
  SELECT job_id, stated.text, city, region, country FROM ads JOIN stated USING (c5)""")
def parse_location(t: Tables) -> DataFrame:
    return ads(t).select("job_id", F.explode(x.parse_location(F.col("location"))).alias("p")).select("job_id", "p.*")


@query("d_is_us", f"{JOBS} SELECT job_id, CASE WHEN country = 'NATION_7' OR coalesce(list_has_any(remote_regions, ['US', 'WORLDWIDE']), FALSE) THEN TRUE ELSE FALSE END AS is_us FROM jobs")
def is_us(t: Tables) -> DataFrame:
    places = F.array(F.struct(F.when(F.col("country") == "NATION_7", "US").otherwise(F.col("country")).alias("country")))
    return jobs(t).select("job_id", x.is_us(places, F.col("remote_regions")).alias("is_us"))


@query("d_extract_facts")
def extract_facts(t: Tables) -> DataFrame:
    return ads(t).select("job_id", F.to_json(x.extract_facts(F.col("title"), F.coalesce("location", F.lit("")), F.col("text"))).alias("facts"))


@query("d_facets", f"{JOBS} SELECT job_id, [country, area] AS tags, level IS NOT NULL AS has_level, coalesce(years_min, years_max, 254) AS years, coalesce(skills, []) AS skill_keys FROM jobs")
def facets(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.array("country", "area").alias("tags"), F.col("level").isNotNull().alias("has_level"), F.coalesce("years_min", "years_max", F.lit(254)).alias("years"), F.coalesce("skills", F.array().cast("array<string>")).alias("skill_keys"))


@query("d_embed_text", f"{JOBS} SELECT job_id, concat_ws(' | ', title, industry, array_to_string(skills, ', '), substr(company, 1, 450)) AS text FROM jobs")
def embed_text(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.concat_ws(" | ", "title", "industry", F.array_join(F.slice("skills", 1, 20), ", "), F.substr("company", F.lit(1), F.lit(450))).alias("text"))


@query("d_precedence", f"{JOBS} SELECT job_id, CAST(CASE ats WHEN 'greenhouse' THEN 3 WHEN 'lever' THEN 2 ELSE 1 END AS INT) AS precedence FROM jobs")
def precedence(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.when(F.col("ats") == "greenhouse", 3).when(F.col("ats") == "lever", 2).otherwise(1).alias("precedence"))


@query("d_haversine", "SELECT s_suppkey, round(2 * 3958.7613 * asin(sqrt(pow(sin(radians(a - 40) / 2), 2) + cos(radians(40)) * cos(radians(a)) * pow(sin(radians(b + 74) / 2), 2))), 3) AS miles FROM (SELECT s_suppkey, CAST(s_suppkey * 53 % 170 AS DOUBLE) - 85 AS a, CAST(s_suppkey * 71 % 360 AS DOUBLE) - 180 AS b FROM supplier)")
def haversine(t: Tables) -> DataFrame:
    lat, lon = (F.col("s_suppkey") * 53 % 170).cast("double") - 85, (F.col("s_suppkey") * 71 % 360).cast("double") - 180
    return t.supplier.select("s_suppkey", F.round(haversine_miles(F.lit(40.0), F.lit(-74.0), lat, lon), 3).alias("miles"))


@query("d_place_resolve", """WITH asked AS (SELECT DISTINCT o_orderkey % 30 AS id, CASE WHEN o_orderkey % 30 < 25 THEN (SELECT n_name FROM nation WHERE n_nationkey = o_orderkey % 30) ELSE 'NOWHERE' END AS text FROM orders)
  SELECT CAST(id AS BIGINT) AS id, n_nationkey AS place, n_nationkey IS NULL AS unknown FROM asked LEFT JOIN nation ON n_name = text""")
def place_resolve(t: Tables) -> DataFrame:
    """Text to a place of the dictionary; unknown where none has the name."""
    names = t.nation.select((F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("name"))
    asked = t.orders.select((F.col("o_orderkey") % 30).alias("id")).distinct().join(names, "id", "left").select("id", F.coalesce("name", F.lit("NOWHERE")).alias("text"))
    return asked.join(t.nation, F.col("n_name") == F.col("text"), "left").select("id", F.col("n_nationkey").alias("place"), F.col("n_nationkey").isNull().alias("unknown"))


#: A small occupation dictionary: phrase, family; longest and last phrase of a title wins.
FAMILIES = [("engineer", "engineering"), ("data engineer", "data"), ("engineering manager", "management"), ("nurse", "nursing"), ("analyst", "analysis"), ("software developer", "engineering"), ("director of data", "data"), ("recruiter", "people")]


def longest_phrases(rows: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """``(id, family)`` of the longest dictionary phrase among a title's word n-grams, the last of equals."""
    w = F.col("ws")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice(w, i, n), " ").alias("phrase")))))
    found = rows.where(F.size("ws") > 0).select("id", F.explode(grams).alias("g")).select("id", "g.*").join(phrases, "phrase")
    return found.groupBy("id").agg(F.max_by("family", F.struct(F.length("phrase"), "i")).alias("family"))


@query("d_title_family", f"{JOBS} SELECT DISTINCT title AS id, CASE title WHEN 'Senior Data Engineer' THEN 'data' WHEN 'Engineering Manager' THEN 'management' WHEN 'Registered Nurse II' THEN 'nursing' WHEN 'Software Developer (C++)' THEN 'engineering' WHEN 'Lead Analyst, 2024 Summer' THEN 'analysis' WHEN 'Recruiter' THEN 'people' WHEN 'Junior Software Engineer' THEN 'engineering' ELSE 'data' END AS family FROM jobs")
def title_family(t: Tables) -> DataFrame:
    titles = jobs(t).select(F.col("title").alias("id")).distinct().withColumn("ws", words(F.col("id")))
    return longest_phrases(titles, frame(t, FAMILIES, "phrase string, family string"))


def greedy_spans(tokens: list[str], aliases: dict[str, str], longest: int) -> list[str]:
    """Aliases left to right, the longest first, each token used once."""
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in range(longest, 0, -1) if " ".join(tokens[i : i + n]) in aliases and i + n <= len(tokens)), 0)
        if n:
            out.append(aliases[" ".join(tokens[i : i + n])])
        i += max(n, 1)
    return out


def scan_aliases(tokens: Column, aliases: dict[str, str]) -> Column:
    """The same as a fold over the places of the tokens; ``aliases`` is a bounded dictionary."""
    longest = max(len(a.split()) for a in aliases)
    table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, i: Column) -> Column:
        hits = [F.when(i + n <= F.size(tokens), F.element_at(table, F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))) for n in range(longest, 0, -1)]
        width = x.first_case([(h.isNotNull(), F.lit(n)) for h, n in zip(hits, range(longest, 0, -1), strict=True)])
        found = F.struct((i + F.coalesce(width, F.lit(1))).alias("next"), F.when(width.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(F.coalesce(*hits)))).alias("out"))
        return F.when(i < a["next"], a).otherwise(found)

    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda a: a["out"])


@query("d_family_related", "WITH e(a, b, w) AS (VALUES ('data', 'analysis', 0.6::DOUBLE), ('engineering', 'data', 0.5::DOUBLE)), f AS (SELECT DISTINCT x FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)) SELECT p.x AS a, q.x AS b, coalesce(max(w), CASE WHEN p.x = q.x THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS weight FROM f p CROSS JOIN f q LEFT JOIN e ON (e.a = p.x AND e.b = q.x) OR (e.a = q.x AND e.b = p.x) GROUP BY 1, 2")
def family_related(t: Tables) -> DataFrame:
    """Symmetric weights of a small edge table; unrelated families weigh nothing."""
    e = frame(t, [("data", "analysis", 0.6), ("engineering", "data", 0.5)], "a string, b string, w double")
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    f = both.select("a").distinct()
    pairs = f.crossJoin(F.broadcast(f.select(F.col("a").alias("b"))))  # the families of a constant table
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("w", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("weight"))


@query("d_role_family_soc", "SELECT p_partkey, CASE WHEN p_name LIKE '%widget' THEN 'SOC-1' WHEN p_name LIKE '%ring' THEN 'SOC-2' WHEN p_name LIKE '%red%' THEN 'SOC-3' END AS soc FROM part")
def role_family_soc(t: Tables) -> DataFrame:
    """The longest suffix in the title table, else keyword rules."""
    ws = F.split("p_name", " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(ws)), lambda i: F.array_join(F.slice(ws, i, F.size(ws)), " "))
    table = frame(t, [("widget", "SOC-1"), ("ring", "SOC-2")], "suffix string, soc string")
    found = t.part.select("p_partkey", F.posexplode(suffixes).alias("pos", "suffix")).join(F.broadcast(table), "suffix").groupBy("p_partkey").agg(F.min_by("soc", "pos").alias("soc"))  # a constant table
    return t.part.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("soc", F.when(F.col("p_name").contains("red"), "SOC-3")).alias("soc"))


@query("d_h1b_tag", f"{JOBS} SELECT job_id, CASE WHEN sponsorship = 'no' OR coalesce(us_citizen_only, FALSE) OR coalesce(clearance_required, FALSE) THEN 'no' WHEN sponsorship = 'yes' THEN 'yes' WHEN company_id % 3 = 0 THEN 'likely' ELSE 'unknown' END AS tag FROM jobs")
def h1b_tag(t: Tables) -> DataFrame:
    no = (F.coalesce("sponsorship", F.lit("")) == "no") | F.coalesce("us_citizen_only", F.lit(False)) | F.coalesce("clearance_required", F.lit(False))
    return jobs(t).select("job_id", F.when(no, "no").when(F.col("sponsorship") == "yes", "yes").when(F.col("company_id") % 3 == 0, "likely").otherwise("unknown").alias("tag"))


@query("d_requirements", f"""{_WITH} SELECT job_id, CASE c6 WHEN 0 THEN CAST(y AS STRING) || '+ years of experience required.' WHEN 1 THEN CAST(y AS STRING) || '-' || CAST(y + 2 AS STRING) || ' years of SQL.' WHEN 2 THEN CAST(y AS STRING) || ' years preferred.'
    ELSE CAST(y AS STRING) || ' years or ' || CAST(y + 2 AS STRING) || ' years of Java.' END AS s, 'years' AS kind, c6 = 2 AS preferred FROM ads WHERE c6 < 4
  UNION ALL SELECT job_id, CASE k5 WHEN 0 THEN 'Visa sponsorship is available.' WHEN 1 THEN 'We cannot sponsor visas.' WHEN 2 THEN 'Must be a U.S. citizen.' WHEN 3 THEN 'Security clearance required.'
    ELSE 'An equal opportunity employer, no sponsorship question is asked.' END, CASE k5 WHEN 3 THEN 'clearance' ELSE 'authorization' END, FALSE FROM ads""")
def requirements(t: Tables) -> DataFrame:
    """Must-haves named by sentences, with whether they are only preferred."""
    s = F.explode(F.split("text", x.SENTENCE_END)).alias("s")
    kinds = x.first_case([(F.col("s").rlike(x.YEARS) & ~F.col("s").rlike(x.NOT_ASKED), F.lit("years")), (F.col("s").rlike(r"(?i)\b(?:bachelor|master|degree|phd)\b"), F.lit("degree")), (F.col("s").rlike(r"(?i)clearance"), F.lit("clearance")), (F.col("s").rlike(r"(?i)citizen|sponsor"), F.lit("authorization"))])
    return ads(t).select("job_id", s).select("job_id", "s", kinds.alias("kind"), F.col("s").rlike("(?i)preferred|a plus").alias("preferred")).where("kind IS NOT NULL")


@query("d_primary_years", f"{JOBS} SELECT company_id, job_id, years_min FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY level IS NULL, years_min IS NULL, job_id) AS n FROM jobs) WHERE n = 1")
def primary_years(t: Tables) -> DataFrame:
    w = Window.partitionBy("company_id").orderBy(F.col("level").isNull(), F.col("years_min").isNull(), "job_id")
    return jobs(t).withColumn("n", F.row_number().over(w)).where("n = 1").select("company_id", "job_id", "years_min")


def profile_facts(profile: dict) -> dict:
    """Scoring facts of the one profile a search has: its skills, fields and months of work without overlap."""
    months, last = 0, -1
    for start, end in sorted(profile.get("work", [])):
        months += max(0, end - max(start, last + 1) + 1)
        last = max(last, end)
    return {"skills": sorted({s.lower() for s in profile.get("skills", [])}), "fields": sorted(set(profile.get("fields", []))), "years": months // 12}


PROFILE = {"skills": ["skill1", "Skill3", "skill4"], "fields": ["BUILDING"], "work": [(0, 59), (48, 83)]}


@query("d_profile_facts", "SELECT ['skill1', 'skill3', 'skill4'] AS skills, ['BUILDING'] AS fields, 7 AS years")
def profile_query(t: Tables) -> DataFrame:
    f = profile_facts(PROFILE)
    return frame(t, [(f["skills"], f["fields"], f["years"])], "skills array<string>, fields array<string>, years int")


@query("d_read_job", f"{JOBS} SELECT job_id, title, coalesce(level, 'unknown') AS level, coalesce(years_min, years_max) AS years, industry, coalesce(skills, []) AS skills FROM jobs WHERE status = 'open'")
def read_job(t: Tables) -> DataFrame:
    return jobs(t).where("status = 'open'").select("job_id", "title", F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("years_min", "years_max").alias("years"), "industry", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))


_SK = "CASE WHEN skills IS NULL THEN NULL ELSE 100.0::DOUBLE * len(list_intersect(skills, ['skill1', 'skill3', 'skill4'])) / len(list_distinct(skills)) END"
_EX = "CASE WHEN coalesce(years_min, years_max) IS NULL THEN NULL WHEN coalesce(years_min, years_max) <= 7 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100.0::DOUBLE - 20 * (coalesce(years_min, years_max) - 7)) END"
_IN = "CASE WHEN industry = 'BUILDING' THEN 100.0::DOUBLE WHEN industry IN ('MACHINERY', 'AUTOMOBILE') THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END"
_RAW = f"floor(36 + coalesce({_EX}, 0) * 0.24::DOUBLE + coalesce({_SK}, 0) * 0.29::DOUBLE + {_IN} * 0.08::DOUBLE + 0.5)"
_CAP = "least(CASE WHEN sponsorship = 'no' THEN 40 ELSE 100 END, CASE WHEN clearance_required THEN 60 ELSE 100 END)"


def skills_score(have: list[str]) -> Column:
    """Covered share of a posting's skills, null where it names none."""
    own = F.array_distinct("skills")
    return F.when(F.size(own) > 0, 100.0 * F.size(F.array_intersect(own, F.array(*[F.lit(s) for s in have]))) / F.size(own))


def experience_score(years: int) -> Column:
    asked = F.coalesce("years_min", "years_max")
    return F.when(asked <= years, 100.0).when(asked.isNotNull(), F.greatest(F.lit(0.0), 100.0 - 20 * (asked - years)))


def industry_score(fields: list[str], related: list[str]) -> Column:
    return F.when(F.col("industry").isin(fields), 100.0).when(F.col("industry").isin(related), 50.0).otherwise(0.0)


def scored(t: Tables) -> DataFrame:
    f = profile_facts(PROFILE)
    caps = F.array(F.when(F.col("sponsorship") == "no", 40).otherwise(100), F.when(F.col("clearance_required"), 60).otherwise(100))
    parts = jobs(t).select("job_id", skills_score(f["skills"]).alias("skills"), experience_score(f["years"]).alias("experience"), industry_score(f["fields"], ["MACHINERY", "AUTOMOBILE"]).alias("industry"), caps.alias("caps"))
    return parts.withColumn("percent", x.overall_match(F.col("experience"), F.col("skills"), F.col("industry"), F.col("caps")))


@query("d_compute_match", f"{JOBS} SELECT job_id, CAST(least({_RAW}, {_CAP}) AS BIGINT) AS percent FROM jobs")
def compute_match(t: Tables) -> DataFrame:
    return scored(t).select("job_id", "percent")


@query("d_score_skills", f"{JOBS} SELECT job_id, {_SK} AS skills FROM jobs")
def score_skills(t: Tables) -> DataFrame:
    return scored(t).select("job_id", "skills")


@query("d_score_experience", f"{JOBS} SELECT job_id, {_EX} AS experience FROM jobs")
def score_experience(t: Tables) -> DataFrame:
    return scored(t).select("job_id", "experience")


@query("d_score_industry", f"{JOBS} SELECT job_id, {_IN} AS industry FROM jobs")
def score_industry(t: Tables) -> DataFrame:
    return scored(t).select("job_id", "industry")


@query("d_must_haves", f"{JOBS} SELECT job_id, CASE WHEN coalesce(years_min, years_max) IS NULL THEN 'not_in_profile' WHEN coalesce(years_min, years_max) <= 7 THEN 'met' ELSE 'unmet' END AS years_state, CASE WHEN clearance_required THEN 'unmet' ELSE 'met' END AS clearance_state FROM jobs")
def must_haves(t: Tables) -> DataFrame:
    asked = F.coalesce("years_min", "years_max")
    return jobs(t).select("job_id", F.when(asked.isNull(), "not_in_profile").when(asked <= 7, "met").otherwise("unmet").alias("years_state"), F.when(F.col("clearance_required"), "unmet").otherwise("met").alias("clearance_state"))


@query("d_deal_breakers", f"{JOBS} SELECT job_id, list_filter([CASE WHEN work_model = 'onsite' THEN 'work_model' END, CASE WHEN currency = 'USD' AND coalesce(annual_max, annual_min) < 100000 THEN 'pay' END], lambda v: v IS NOT NULL) AS conflicts FROM jobs")
def deal_breakers(t: Tables) -> DataFrame:
    low = (F.col("currency") == "USD") & (F.coalesce("annual_max", "annual_min") < 100000)
    return jobs(t).select("job_id", F.array_compact(F.array(F.when(F.col("work_model") == "onsite", "work_model"), F.when(low, "pay"))).alias("conflicts"))


@query("d_band", f"{JOBS}, p AS (SELECT CAST(least({_RAW}, {_CAP}) AS BIGINT) AS percent FROM jobs) SELECT CASE WHEN percent >= 85 THEN 'strong' WHEN percent >= 70 THEN 'good' ELSE 'fair' END AS band, count(*) AS n FROM p GROUP BY 1")
def band(t: Tables) -> DataFrame:
    return scored(t).groupBy(x.band(F.col("percent")).alias("band")).agg(F.count("*").alias("n"))


@query("d_pref_score", f"{JOBS} SELECT job_id, CAST(100 * CAST(title LIKE '%Engineer%' AS INT) + 50 * CAST(area = 'EUROPE' AS INT) + 15 * CAST(coalesce(work_model = 'remote', FALSE) AS INT) + 10 * CAST(coalesce(employment_type = 'full_time', FALSE) AS INT) + 10 * CAST(coalesce(level = 'senior', FALSE) AS INT) AS INT) AS score FROM jobs")
def pref_score(t: Tables) -> DataFrame:
    point = lambda c, n: F.when(c, n).otherwise(0)
    score = point(F.col("title").contains("Engineer"), 100) + point(F.col("area") == "EUROPE", 50) + point(F.col("work_model") == "remote", 15) + point(F.col("employment_type") == "full_time", 10) + point(F.col("level") == "senior", 10)
    return jobs(t).select("job_id", score.alias("score"))


@query("d_contact_score", "SELECT c_custkey, CAST(30 * CAST(c_mktsegment = 'BUILDING' AS INT) + 20 * CAST(c_nationkey < 5 AS INT) + 15 * CAST(c_acctbal > 5000 AS INT) AS INT) AS score FROM customer")
def contact_score(t: Tables) -> DataFrame:
    point = lambda c, n: F.when(c, n).otherwise(0)
    return t.customer.select("c_custkey", (point(F.col("c_mktsegment") == "BUILDING", 30) + point(F.col("c_nationkey") < 5, 20) + point(F.col("c_acctbal") > 5000, 15)).alias("score"))


@query("d_read_title", f"{JOBS} SELECT DISTINCT title, title = 'Recruiter' AS recruiter, list_filter([CASE WHEN contains(lower(title), 'data') THEN 'data' END, CASE WHEN contains(lower(title), 'engineer') OR contains(lower(title), 'software') THEN 'engineering' END], lambda v: v IS NOT NULL) AS fields FROM jobs")
def read_title(t: Tables) -> DataFrame:
    low = F.lower("title")
    fields = F.array_compact(F.array(F.when(low.contains("data"), "data"), F.when(low.contains("engineer") | low.contains("software"), "engineering")))
    return jobs(t).select("title").distinct().select("title", low.rlike(r"\b(?:recruiter|talent)\b").alias("recruiter"), fields.alias("fields"))


@query("d_ats_score", "SELECT l_orderkey, CAST(least(CASE WHEN max(l_returnflag = 'R') THEN 70 ELSE 100 END, 100 - sum(CASE WHEN l_quantity > 40 THEN 10 ELSE 2 END)) AS BIGINT) AS score FROM lineitem GROUP BY l_orderkey")
def ats_score(t: Tables) -> DataFrame:
    """Weighted findings off a hundred; a grave one caps the score."""
    lost = F.sum(F.when(F.col("l_quantity") > 40, 10).otherwise(2))
    return t.lineitem.groupBy("l_orderkey").agg(F.least(F.when(F.max(F.col("l_returnflag") == "R"), 70).otherwise(100), 100 - lost).cast("long").alias("score"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def first_vector(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))


@query("d_vec_dot", f"SELECT e.vec_id, round({_DOT.format('e.embedding', 'q.embedding')}, 6) AS dot FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def vec_dot(t: Tables) -> DataFrame:
    return t.embeddings.crossJoin(F.broadcast(first_vector(t))).select("vec_id", F.round(x.dot(F.col("embedding"), F.col("q")), 6).alias("dot"))  # one query vector


@query("d_vec_cosine", f"SELECT e.vec_id, round({_DOT.format('e.embedding', 'q.embedding')} / sqrt({_DOT.format('e.embedding', 'e.embedding')}) / sqrt({_DOT.format('q.embedding', 'q.embedding')}), 6) AS cosine FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def vec_cosine(t: Tables) -> DataFrame:
    return t.embeddings.crossJoin(F.broadcast(first_vector(t))).select("vec_id", F.round(x.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))  # one query vector


@query("d_vec_fit", f"""WITH m AS (SELECT list(a ORDER BY i) AS mean FROM (SELECT i, avg(CAST(v AS DOUBLE)) AS a FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))
  SELECT e.vec_id, round({_DOT.format('e.embedding', 'q.embedding')} - 0.5 * {_DOT.format('e.embedding', 'm.mean')}, 6) AS fit FROM embeddings e, embeddings q, m WHERE q.vec_id = 0""")
def vec_fit(t: Tables) -> DataFrame:
    """Profile less half the mean, folded into one query vector."""
    from fernloom.operators.aggregates import centroid

    mean = centroid(t.embeddings).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"))
    folded = first_vector(t).crossJoin(mean).select(F.zip_with("q", "mean", lambda a, b: a.cast("double") - 0.5 * b).alias("v"))  # one row each
    return t.embeddings.crossJoin(F.broadcast(folded)).select("vec_id", F.round(x.dot(F.col("embedding"), F.col("v")), 6).alias("fit"))  # one query vector


@query("d_vec_half")
def vec_half(t: Tables) -> DataFrame:
    """Half-precision bytes, rounded half to even, in Arrow batches."""

    def pack(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            sizes = column.map(len).to_numpy()
            flat = (np.concatenate(column.to_list()) if len(column) else np.zeros(0)).astype(np.float32).astype("<f2").tobytes()  # one cast a batch
            ends = np.concatenate(([0], np.cumsum(sizes))) * 2
            yield pd.Series([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], dtype=object)

    pack.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return t.embeddings.select("vec_id", F.hex(F.pandas_udf(pack, "binary")("embedding")).alias("half"))


@query("d_percent_diff", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE CAST(floor((p_size % 3 - p_size % 4) * 100.0::DOUBLE / (p_size % 4) + 0.5) AS DOUBLE) END AS diff FROM part")
def percent_diff(t: Tables) -> DataFrame:
    from fernloom.operators.aggregates import percent_difference

    return t.part.select("p_partkey", percent_difference(F.col("p_size") % 3, F.col("p_size") % 4).alias("diff"))


@query("d_cooldown", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 >= 3 THEN least(6 * pow(2, s_suppkey % 7 - 3), 24.0::DOUBLE) END AS hours FROM supplier")
def cooldown(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", x.cooldown_hours(F.col("s_suppkey") % 7).alias("hours"))


@query("d_backoff", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 >= 1 THEN least(15 * pow(2, s_suppkey % 7 - 1), 360.0::DOUBLE) ELSE 0.0::DOUBLE END AS minutes FROM supplier")
def backoff(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", x.backoff_minutes(F.col("s_suppkey") % 7).alias("minutes"))
