"""Aggregation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


def share_pct(condition: Column) -> Column:
    """Rows that meet a condition, in per cent with one decimal."""
    return F.round(100 * F.avg(F.coalesce(condition, F.lit(False)).cast("int")), 1)


@query("a_total_count", f"{JOBS} SELECT count(*) AS total FROM jobs WHERE status = 'open' AND level = 'senior'")
def total_count(t: Tables) -> DataFrame:
    return jobs(t).where("status = 'open' AND level = 'senior'").agg(F.count("*").alias("total"))


@query("a_open_closed", f"{JOBS} SELECT ats, count(*) AS total, count(*) FILTER (status = 'open') AS open FROM jobs GROUP BY ats")
def open_closed(t: Tables) -> DataFrame:
    return jobs(t).groupBy("ats").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"))


@query("a_by_ats", f"{JOBS} SELECT ats, count(*) AS n, count(DISTINCT board) AS boards FROM jobs GROUP BY ats")
def by_ats(t: Tables) -> DataFrame:
    return jobs(t).groupBy("ats").agg(F.count("*").alias("n"), F.count_distinct("board").alias("boards"))


@query("a_by_level", f"{JOBS} SELECT coalesce(level, '(none)') AS level, count(*) AS n FROM jobs GROUP BY 1")
def by_level(t: Tables) -> DataFrame:
    return jobs(t).groupBy(F.coalesce("level", F.lit("(none)")).alias("level")).agg(F.count("*").alias("n"))


@query("a_pay_bands", f"{JOBS} SELECT currency, min(annual_min) AS low, max(annual_max) AS high, round(avg((annual_min + coalesce(annual_max, annual_min)) / 2)) AS mid FROM jobs WHERE currency IS NOT NULL GROUP BY currency")
def pay_bands(t: Tables) -> DataFrame:
    mid = (F.col("annual_min") + F.coalesce("annual_max", "annual_min")) / 2
    return jobs(t).where("currency IS NOT NULL").groupBy("currency").agg(F.min("annual_min").alias("low"), F.max("annual_max").alias("high"), F.round(F.avg(mid)).alias("mid"))


@query("a_per_board_pct", f"{JOBS} SELECT ats, board, round(100 * avg(CASE WHEN currency IS NOT NULL THEN 1 ELSE 0 END), 1) AS pay_pct, round(100 * avg(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END), 1) AS level_pct FROM jobs GROUP BY ats, board")
def per_board_pct(t: Tables) -> DataFrame:
    return jobs(t).groupBy("ats", "board").agg(share_pct(F.col("currency").isNotNull()).alias("pay_pct"), share_pct(F.col("level").isNotNull()).alias("level_pct"))


#: Predicates of the coverage report.
COVERAGE = {
    "pay": "currency IS NOT NULL", "level": "level IS NOT NULL", "work_model": "work_model IS NOT NULL", "posted": "posted_at IS NOT NULL", "years": "coalesce(years_min, years_max) IS NOT NULL",
    "skills": "skills IS NOT NULL", "sponsorship": "sponsorship IS NOT NULL", "clearance": "clearance_required IS NOT NULL", "remote_scope": "remote_regions IS NOT NULL", "employment": "employment_type IS NOT NULL",
}


@query("a_coverage_report", f"{JOBS} " + " UNION ALL ".join(f"SELECT '{k}' AS fact, count(*) FILTER ({v}) AS n, round(100.0 * count(*) FILTER ({v}) / count(*), 1) AS pct FROM jobs" for k, v in COVERAGE.items()))
def coverage_report(t: Tables) -> DataFrame:
    """Ten predicates counted in one pass, then unpivoted."""
    counts = jobs(t).agg(F.count("*").alias("all"), *[F.count_if(F.expr(v)).alias(k) for k, v in COVERAGE.items()])
    rows = counts.select("all", F.explode(F.array(*[F.struct(F.lit(k).alias("fact"), F.col(k).alias("n")) for k in COVERAGE])).alias("r"))
    return rows.select("r.fact", "r.n", F.round(100 * F.col("r.n") / F.col("all"), 1).alias("pct"))


@query("a_db_verify", """SELECT 'blank_names' AS check_name, count(*) FILTER (trim(c_name) = '') AS n FROM customer UNION ALL SELECT 'bad_links', count(*) FILTER (NOT regexp_matches(url, '^https?://[^/]+')) FROM pages
  UNION ALL SELECT 'orphan_lines', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'orphan_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def db_verify(t: Tables) -> DataFrame:
    one = lambda name, df: df.select(F.lit(name).alias("check_name"), "n")
    blank = t.customer.agg(F.count_if(F.trim("c_name") == "").alias("n"))
    links = t.pages.agg(F.count_if(~F.col("url").rlike("^https?://[^/]+")).alias("n"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(F.count("*").alias("n"))
    labels = t.labels.join(t.documents, "doc_id", "left_anti").agg(F.count("*").alias("n"))
    return one("blank_names", blank).unionAll(one("bad_links", links)).unionAll(one("orphan_lines", lines)).unionAll(one("orphan_labels", labels))


@query("a_tracker_counts", "SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) AS total FROM orders")
def tracker_counts(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count("*").alias("total"))


@query("a_tracker_summary", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers")
def tracker_summary(t: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.orders, "orders").crossJoin(n(t.customer, "customers")).crossJoin(n(t.supplier, "suppliers"))  # one row each


@query("a_band_counts", "SELECT CASE WHEN p_size >= 43 THEN 'strong' WHEN p_size >= 35 THEN 'good' WHEN p_size < 5 THEN 'incomplete' ELSE 'fair' END AS band, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM part")
def band_counts(t: Tables) -> DataFrame:
    size = F.col("p_size")
    band = F.when(size >= 43, "strong").when(size >= 35, "good").when(size < 5, "incomplete").otherwise("fair")
    return t.part.select(band.alias("b")).rollup("b").agg(F.count("*").alias("n")).select(F.coalesce("b", F.lit("total")).alias("band"), "n")


@query("a_company_groups", """SELECT company, name, n, CAST(row_number() OVER (PARTITION BY company ORDER BY n DESC, name) AS INTEGER) AS place, CAST(sum(n) OVER (PARTITION BY company) AS BIGINT) AS contacts
  FROM (SELECT lower(p_brand) AS company, p_brand || ' ' || p_type AS name, count(*) AS n FROM part GROUP BY 1, 2)""")
def company_groups(t: Tables) -> DataFrame:
    """The names of a company, a row each, the most frequent first, with the contacts of the whole company."""
    named = t.part.groupBy(F.lower("p_brand").alias("company"), F.concat_ws(" ", "p_brand", "p_type").alias("name")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("company")
    return named.select("company", "name", "n", F.row_number().over(own.orderBy(F.col("n").desc(), "name")).alias("place"), F.sum("n").over(own).alias("contacts"))


@query("a_name_mode", "SELECT l_suppkey, l_returnflag FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag = 'N' DESC, count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def name_mode(t: Tables) -> DataFrame:
    """The preferred form first, then the most frequent, then A to Z."""
    counted = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    best = counted.groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct(F.col("l_returnflag") != "N", -F.col("n"), "l_returnflag")).alias("l_returnflag"))
    return best


@query("a_top_company", f"{JOBS} SELECT board, company FROM (SELECT board, company, row_number() OVER (PARTITION BY board ORDER BY count(*) DESC, company) AS r FROM jobs GROUP BY 1, 2) WHERE r = 1")
def top_company(t: Tables) -> DataFrame:
    counted = jobs(t).groupBy("board", "company").agg(F.count("*").alias("n"))
    return counted.groupBy("board").agg(F.min_by("company", F.struct(-F.col("n"), "company")).alias("company"))


@query("a_boards_counts", "SELECT n_regionkey, count(*) AS total, count(*) FILTER (s_acctbal < 0) AS failing, count(*) FILTER (s_suppkey % 2 = 0) AS followed FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def boards_counts(t: Tables) -> DataFrame:
    out = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_regionkey").agg(F.count("*").alias("total"), F.count_if(F.col("s_acctbal") < 0).alias("failing"), F.count_if(F.col("s_suppkey") % 2 == 0).alias("followed"))


def top_k_struct(counts: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """``by`` and the ``k`` most frequent values, ties A to Z."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), value)
    ranked = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("r", value))).alias("s")).select(*by, F.transform("s", lambda x: x[value]).alias("top"))


@query("a_h1b_build", """WITH c AS (SELECT l_suppkey, l_partkey % 10 AS fein, l_linestatus, l_returnflag, l_shipdate, l_quantity FROM lineitem WHERE l_returnflag <> 'A'),
  top AS (SELECT l_suppkey, fein, list(q ORDER BY r) AS top FROM (SELECT l_suppkey, fein, 'q' || CAST(CAST(l_quantity AS INT) AS STRING) AS q, row_number() OVER (PARTITION BY l_suppkey, fein ORDER BY count(*) DESC, 'q' || CAST(CAST(l_quantity AS INT) AS STRING)) AS r FROM c GROUP BY 1, 2, 3) WHERE r <= 6 GROUP BY 1, 2)
  SELECT c.l_suppkey, c.fein, count(*) AS certified, count(*) FILTER (l_linestatus = 'O') AS recent, count(*) FILTER (quarter(l_shipdate + INTERVAL 3 MONTH) = 1) AS q1, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, any_value(top) AS top
  FROM c JOIN top ON c.l_suppkey = top.l_suppkey AND c.fein = top.fein GROUP BY 1, 2""")
def filer_table(t: Tables) -> DataFrame:
    """Certified filings by filer and tax id: counts, fiscal quarter, first and last, six most frequent names."""
    c = t.lineitem.where("l_returnflag <> 'A'").select("l_suppkey", (F.col("l_partkey") % 10).alias("fein"), "l_linestatus", "l_shipdate", F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("q"))
    first = F.quarter(F.add_months("l_shipdate", 3)) == 1
    base = c.groupBy("l_suppkey", "fein").agg(F.count("*").alias("certified"), F.count_if(F.col("l_linestatus") == "O").alias("recent"), F.count_if(first).alias("q1"), F.min("l_shipdate").alias("first_at"), F.max("l_shipdate").alias("last_at"))
    names = top_k_struct(c.groupBy("l_suppkey", "fein", "q").agg(F.count("*").alias("n")), ["l_suppkey", "fein"], "q", 6)
    return base.join(names, ["l_suppkey", "fein"])


@query("a_h1b_title_table", """WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_brand AS major, round(n / total, 6) AS share, total FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY p_type) AS BIGINT) AS total, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM n) WHERE r = 1 AND total >= 5""")
def title_table(t: Tables) -> DataFrame:
    n = t.part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    best = n.groupBy("p_type").agg(F.sum("n").alias("total"), F.min_by(F.struct("p_brand", "n"), F.struct(-F.col("n"), "p_brand")).alias("b"))
    return best.where("total >= 5").select("p_type", F.col("b.p_brand").alias("major"), F.round(F.col("b.n") / F.col("total"), 6).alias("share"), "total")


@query("a_h1b_status_counts", "SELECT l_returnflag || ' | ' || l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat_ws(" | ", "l_returnflag", "l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query("a_h1b_summarize", """WITH m AS (SELECT max(l_shipdate) AS newest FROM lineitem) SELECT l_suppkey, count(*) AS certified, count(*) FILTER (l_shipdate > newest - INTERVAL 12 MONTH) AS recent, count(*) FILTER (l_linenumber = 1) AS new_hires,
  count(*) >= 10 AND count(*) FILTER (l_shipdate > newest - INTERVAL 12 MONTH) >= 3 AND count(*) FILTER (l_linenumber = 1) >= 1 AS likely FROM lineitem, m GROUP BY l_suppkey""")
def summarize_filers(t: Tables) -> DataFrame:
    """Likely: at least 10 certified, 3 of them in the newest 12 months, 1 new hire."""
    newest = t.lineitem.agg(F.max("l_shipdate").alias("newest"))
    recent = F.col("l_shipdate") > F.col("newest") - F.expr("INTERVAL 12 MONTH")
    out = t.lineitem.crossJoin(F.broadcast(newest)).groupBy("l_suppkey").agg(F.count("*").alias("certified"), F.count_if(recent).alias("recent"), F.count_if(F.col("l_linenumber") == 1).alias("new_hires"))  # one row
    return out.withColumn("likely", (F.col("certified") >= 10) & (F.col("recent") >= 3) & (F.col("new_hires") >= 1))


@query("a_h1b_dominant_fein", """WITH n AS (SELECT l_suppkey, l_partkey % 7 AS fein, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, fein) AS r, max(n) OVER (PARTITION BY l_suppkey) AS top FROM n)
  SELECT l_suppkey, max(fein) FILTER (r = 1) AS fein, max(top) AS certified, coalesce(bool_or(n >= 3 AND n * 3 >= top) FILTER (r > 1), FALSE) AS ambiguous FROM d GROUP BY l_suppkey""")
def dominant_fein(t: Tables) -> DataFrame:
    """The tax id with most filings; ambiguous if another has at least 3 and a third of them."""
    n = t.lineitem.groupBy("l_suppkey", (F.col("l_partkey") % 7).alias("fein")).agg(F.count("*").alias("n"))
    best = n.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("n")).alias("m"), "fein")).alias("b"))
    rivals = n.join(best, "l_suppkey").where("fein <> b.fein").groupBy("l_suppkey").agg(F.max((F.col("n") >= 3) & (F.col("n") * 3 >= -F.col("b.m"))).alias("ambiguous"))
    out = best.join(rivals, "l_suppkey", "left")
    return out.select("l_suppkey", F.col("b.fein").alias("fein"), (-F.col("b.m")).alias("certified"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


@query("a_h1b_count_oracle", "SELECT l_suppkey, l_partkey % 7 AS fein, count(*) FILTER (l_returnflag = 'N') AS certified, count(*) FILTER (l_returnflag <> 'N') AS other FROM lineitem GROUP BY 1, 2")
def count_filings(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey", (F.col("l_partkey") % 7).alias("fein")).agg(F.count_if(F.col("l_returnflag") == "N").alias("certified"), F.count_if(F.col("l_returnflag") != "N").alias("other"))


def union_length(rows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Length of the union of closed integer intervals per key: overlaps count once."""
    w = Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("__e", F.max(end).over(w))
    fresh = F.greatest(F.col(start), F.coalesce(F.col("__e") + 1, F.col(start)))
    return seen.groupBy(by).agg(F.sum(F.greatest(F.col(end) - fresh + 1, F.lit(0))).cast("long").alias("months"))


@query("a_union_months", """WITH i AS (SELECT o_custkey, unnest(range(CAST(o_orderkey % 120 AS BIGINT), CAST(o_orderkey % 120 + o_orderkey % 9 + 1 AS BIGINT))) AS m FROM orders) SELECT o_custkey, count(DISTINCT m) AS months FROM i GROUP BY o_custkey""")
def union_months(t: Tables) -> DataFrame:
    i = t.orders.select("o_custkey", (F.col("o_orderkey") % 120).alias("a"), (F.col("o_orderkey") % 120 + F.col("o_orderkey") % 9).alias("b"))
    return union_length(i, "o_custkey", "a", "b")


@query("a_family_votes", """WITH v AS (SELECT l_orderkey, f, sum(1.0 / 2) AS votes FROM (SELECT l_orderkey, unnest([l_partkey % 3, l_suppkey % 4]) AS f FROM lineitem) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, f) AS n, coalesce(lead(votes) OVER (PARTITION BY l_orderkey ORDER BY votes DESC, f), 0) AS next_votes FROM v)
  SELECT l_orderkey, f AS family FROM r WHERE n = 1 AND votes >= 1.5 AND votes >= 1.5 * next_votes""")
def family_votes(t: Tables) -> DataFrame:
    """A skill votes 1/families for each of its families; the winner needs 1.5 and 1.5 times the runner-up."""
    v = t.lineitem.select("l_orderkey", F.explode(F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 4)).alias("f")).groupBy("l_orderkey", "f").agg(F.sum(F.lit(0.5)).alias("votes"))
    w = Window.partitionBy("l_orderkey").orderBy(F.col("votes").desc(), "f")
    r = v.select("l_orderkey", "f", "votes", F.row_number().over(w).alias("n"), F.coalesce(F.lead("votes").over(w), F.lit(0.0)).alias("next_votes"))
    return r.where("n = 1 AND votes >= 1.5 AND votes >= 1.5 * next_votes").select("l_orderkey", F.col("f").alias("family"))


@query("a_industry_scores", """WITH s AS (SELECT l_orderkey AS job, l_suppkey % 9 AS industry, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END) AS BIGINT) AS score FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem) GROUP BY 1, 2),
  r AS (SELECT *, max(score) OVER (PARTITION BY job) AS best, row_number() OVER (PARTITION BY job ORDER BY score DESC, industry) AS n FROM s WHERE score >= 3) SELECT job, industry, score FROM r WHERE score * 2 >= best AND n <= 3""")
def industry_scores(t: Tables) -> DataFrame:
    """Distinct strong phrases count 3, weak ones 1; at least 3, half of the best, the top three."""
    hits = t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag").distinct()
    s = hits.groupBy(F.col("l_orderkey").alias("job"), (F.col("l_suppkey") % 9).alias("industry")).agg(F.sum(F.when(F.col("l_returnflag") == "R", 3).otherwise(1)).alias("score")).where("score >= 3")
    w = Window.partitionBy("job").orderBy(F.col("score").desc(), "industry")
    r = s.select("*", F.first("score").over(w).alias("best"), F.row_number().over(w).alias("n"))
    return r.where("score * 2 >= best AND n <= 3").select("job", "industry", "score")


@query("a_sweep_totals", f"{JOBS}, b AS (SELECT ats, board, count(DISTINCT area) AS regions, count(*) AS n FROM jobs GROUP BY 1, 2) SELECT ats, board, regions, CAST(sum(n) OVER (PARTITION BY ats) AS BIGINT) AS ats_total FROM b")
def sweep_totals(t: Tables) -> DataFrame:
    b = jobs(t).groupBy("ats", "board").agg(F.count_distinct("area").alias("regions"), F.count("*").alias("n"))
    return b.join(b.groupBy("ats").agg(F.sum("n").alias("ats_total")), "ats").select("ats", "board", "regions", "ats_total")


@query("a_run_totals", "SELECT event_type, count(*) AS runs, count(DISTINCT user_id) AS boards, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS items FROM events GROUP BY event_type")
def run_totals(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("boards"), F.sum(k).alias("items"))


@query("a_pending_misses", "SELECT count(*) AS n, min(o_orderdate) AS first_missed_at FROM orders WHERE o_orderkey % 5 > 3")
def pending_misses(t: Tables) -> DataFrame:
    return t.orders.where("o_orderkey % 5 > 3").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_missed_at"))


@query("a_source_open_distinct", "SELECT l_suppkey, count(DISTINCT o_orderkey) AS open_jobs FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY l_suppkey")
def source_open(t: Tables) -> DataFrame:
    out = t.lineitem.join(t.orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return out.groupBy("l_suppkey").agg(F.count_distinct("o_orderkey").alias("open_jobs"))


def date_spine(spark, first: str, days: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE '{first}', date_add(DATE '{first}', {days - 1}))")).alias("day"))


@query("a_activity_by_day", """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27' GROUP BY 1, 2),
  top AS (SELECT event_type FROM e GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 3),
  g AS (SELECT day, CASE WHEN event_type IN (SELECT event_type FROM top) THEN event_type ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY 1, 2),
  d AS (SELECT CAST(unnest(range(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-27', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT d.day, l.label, coalesce(g.n, 0) AS n FROM d CROSS JOIN (SELECT DISTINCT label FROM g) l LEFT JOIN g ON g.day = d.day AND g.label = l.label""")
def activity_by_day(t: Tables) -> DataFrame:
    """Seven zero-filled days by type: the three most frequent types and the rest as Other."""
    days = date_spine(t.spark, "2024-01-20", 7)
    e = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-27 00:00:00'").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    top = e.groupBy("event_type").agg(F.sum("n").alias("s")).orderBy(F.col("s").desc(), "event_type").limit(3).select("event_type", F.lit(True).alias("is_top"))
    g = e.join(top, "event_type", "left").groupBy("day", F.when(F.col("is_top"), F.col("event_type")).otherwise("Other").alias("label")).agg(F.sum("n").alias("n"))
    grid = days.crossJoin(g.select("label").distinct())  # seven days by at most four labels
    return grid.join(g, ["day", "label"], "left").select("day", "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("a_jobs_by_day", """WITH d AS (SELECT CAST(unnest(range(TIMESTAMP '2001-07-20', TIMESTAMP '2001-07-27', INTERVAL 1 DAY)) AS DATE) AS day) SELECT d.day, count(o_orderkey) AS n FROM d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.day GROUP BY d.day""")
def jobs_by_day(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return date_spine(t.spark, "2001-07-20", 7).join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("a_calendar_year", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS jobs FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS ships FROM lineitem WHERE l_quantity > 49 GROUP BY 1)
  SELECT coalesce(a.day, b.day) AS day, CAST(year(coalesce(a.day, b.day)) AS INT) AS year, coalesce(jobs, 0) AS jobs, coalesce(ships, 0) AS ships FROM a FULL OUTER JOIN b ON a.day = b.day""")
def calendar_year(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("jobs"))
    b = t.lineitem.where("l_quantity > 49").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("ships"))
    out = a.join(b, "day", "full_outer")
    return out.select("day", F.year("day").alias("year"), F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("ships", F.lit(0)).alias("ships"))


def percent_difference(now: Column, before: Column) -> Column:
    """Change in per cent; from nothing to something is 100, from nothing to nothing 0."""
    return F.when(before == 0, F.when(now == 0, 0.0).otherwise(100.0)).otherwise(F.floor((now - before) * 100.0 / before + 0.5).cast("double"))


@query("a_period_trend", """WITH c AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS this_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-24') AS last_week FROM events GROUP BY 1)
  SELECT event_type, this_week, last_week, CASE WHEN last_week = 0 THEN CASE WHEN this_week = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END ELSE CAST(floor((this_week - last_week) * 100.0::DOUBLE / last_week + 0.5) AS DOUBLE) END AS trend FROM c""")
def period_trend(t: Tables) -> DataFrame:
    ts = F.col("ts")
    at = lambda d: F.expr(f"TIMESTAMP_NTZ '{d} 00:00:00'")
    c = t.events.groupBy("event_type").agg(F.count_if(ts >= at("2024-01-24")).alias("this_week"), F.count_if((ts >= at("2024-01-17")) & (ts < at("2024-01-24"))).alias("last_week"))
    return c.withColumn("trend", percent_difference(F.col("this_week"), F.col("last_week")))


@query("a_duration_by_type", """SELECT r_name, coalesce(CAST(sum(n) AS BIGINT), 0) AS total FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1) ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total DESC, r_name LIMIT 4 OFFSET 1""")
def duration_by_type(t: Tables) -> DataFrame:
    n = t.customer.where("c_acctbal > 5000").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("total"))
    out = t.region.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_name", F.coalesce("total", F.lit(0)).alias("total"))
    return out.orderBy(F.col("total").desc(), "r_name").offset(1).limit(4)


def centroid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Element-wise mean, one row a dimension; dimensions are summed in parallel."""
    return vectors.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


@query("a_centroid", "SELECT CAST(i - 1 AS INT) AS dim, round(avg(CAST(x AS DOUBLE)), 9) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def centroid_query(t: Tables) -> DataFrame:
    return centroid(t.embeddings).withColumn("mean", F.round("mean", 9))


@query("a_fit_counts", "SELECT count(*) FILTER (vec_id IS NOT NULL) AS indexed, count(*) FILTER (vec_id IS NULL) AS waiting FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def fit_counts(t: Tables) -> DataFrame:
    out = t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("v")), "doc_id", "left")
    return out.agg(F.count("v").alias("indexed"), F.count_if(F.col("v").isNull()).alias("waiting"))


@query("a_due_reminders", "SELECT c_custkey AS id, count(*) OVER () AS n FROM customer WHERE c_acctbal < -900 AND c_custkey % 2 = 0")
def due_reminders(t: Tables) -> DataFrame:
    """Due reminders, a row each, beside their number."""
    due = t.customer.where("c_acctbal < -900 AND c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return due.crossJoin(F.broadcast(due.agg(F.count("*").alias("n"))))  # one row


@query("a_stamp", "SELECT CAST(count(*) AS STRING) || ':' || CAST(max(o_orderkey) AS STRING) || ':' || CAST(CAST(sum(o_orderkey) AS BIGINT) AS STRING) AS stamp FROM orders")
def stamp(t: Tables) -> DataFrame:
    return t.orders.agg(F.concat_ws(":", F.count("*"), F.max("o_orderkey"), F.sum("o_orderkey")).alias("stamp"))
