"""Ranking, paging and scheduling operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions import ranking as r
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query

DAY = "CASE WHEN posted_at IS NULL THEN 0 ELSE date_diff('day', DATE '2000-01-01', CAST(posted_at AS DATE)) + 1 END"


def top(frame: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows without a full sort."""
    return frame.orderBy(*order).limit(k)


@query("w_key_recent", f"{JOBS} SELECT job_id, posted_at FROM jobs ORDER BY posted_at DESC NULLS LAST, job_id LIMIT 50")
def recent(t: Tables) -> DataFrame:
    return top(jobs(t).select("job_id", "posted_at"), 50, F.col("posted_at").desc_nulls_last(), F.col("job_id"))


@query("w_key_recommended", f"{JOBS} SELECT job_id, CAST({DAY} * 16 + CASE WHEN currency IS NULL THEN 0 ELSE 4 END + CASE WHEN work_model IS NULL THEN 0 ELSE 2 END + CASE WHEN level IS NULL THEN 0 ELSE 1 END + 1 AS INT) AS key FROM jobs")
def recommended(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", r.recommended_key().alias("key"))


@query("w_key_fit", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(2097152 + floor((greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (o_orderkey % 2001 - 1000) / 900.0::DOUBLE)) + 1) / 2 * 2097151 + 0.5) AS BIGINT) END AS key FROM orders""")
def fit(t: Tables) -> DataFrame:
    score = F.when(F.col("o_orderkey") % 10 != 0, (F.col("o_orderkey") % 2001 - 1000) / F.lit(900.0))
    return t.orders.select("o_orderkey", r.fit_key(score).cast("long").alias("key"))


@query("w_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'P' ORDER BY n LIMIT 500")
def total_order(t: Tables) -> DataFrame:
    """Primary descending, id ascending; numbered on the page only."""
    page = top(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice"), 500, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return page.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("n"))


@query("w_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk(t: Tables) -> DataFrame:
    return top(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))


@query("w_snapshot_paging", f"{JOBS} SELECT job_id FROM jobs WHERE status = 'open' AND (annual_min IS NULL OR annual_min < 150000 OR (annual_min = 150000 AND job_id > 0)) ORDER BY annual_min DESC NULLS LAST, job_id LIMIT 20")
def next_page(t: Tables) -> DataFrame:
    """The page after a cursor of a frozen order; rows closed since are skipped by the filter."""
    rest = r.after(jobs(t).where("status = 'open'").select("job_id", "annual_min"), "annual_min", "job_id", (150000.0, 0))
    return top(rest, 20, F.col("annual_min").desc_nulls_last(), F.col("job_id")).select("job_id")


@query("w_position_after", "SELECT min(n) AS position FROM (SELECT o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 5)")
def position_after(t: Tables) -> DataFrame:
    """Place of the first row after a cursor: one more than the rows up to it, so nothing is sorted."""
    upto = (F.col("o_totalprice") > 200000) | ((F.col("o_totalprice") == 200000) & (F.col("o_orderkey") <= 5))
    return t.orders.agg((F.count_if(upto) + 1).alias("position"))


@query("w_keyset_sql", f"{JOBS} SELECT job_id FROM jobs WHERE posted_at IS NULL AND job_id > 3000 ORDER BY job_id LIMIT 20")
def keyset_null_branch(t: Tables) -> DataFrame:
    """A cursor inside the rows without a date."""
    return top(r.after(jobs(t).select("job_id", "posted_at"), "posted_at", "job_id", (None, 3000)), 20, F.col("job_id")).select("job_id")


@query("w_rank_top_matched", f"{JOBS} SELECT job_id FROM jobs WHERE status = 'open' AND job_id % 10 <> 0 ORDER BY job_id % 101 DESC, level IS NOT NULL DESC, job_id LIMIT 60")
def top_matched(t: Tables) -> DataFrame:
    """Percent, complete results first, id; closed postings and duplicates are left out."""
    return top(jobs(t).where("status = 'open' AND job_id % 10 <> 0"), 60, (F.col("job_id") % 101).desc(), F.col("level").isNotNull().desc(), F.col("job_id")).select("job_id")


@query("w_rank_contacts", "SELECT c_custkey FROM customer ORDER BY c_nationkey % 4 DESC, lower(c_mktsegment), c_custkey LIMIT 80")
def rank_contacts(t: Tables) -> DataFrame:
    return top(t.customer, 80, (F.col("c_nationkey") % 4).desc(), F.collate("c_mktsegment", "UNICODE_CI_AI"), F.col("c_custkey")).select("c_custkey")


def spread(order: pd.DataFrame, cap: int, window: int, ahead: int) -> pd.DataFrame:
    """Greedy reorder of one bounded page: at most ``cap`` rows of an employer in any ``window`` places.

    The next place takes the first of the ``ahead`` waiting rows that fits, else the one
    whose employer stands least often in the window.
    """
    waiting, out = list(order.sort_values("n")[["id", "employer"]].itertuples(index=False)), []
    while waiting:
        recent = [e for _, e in out[-(window - 1) :]]
        some = waiting[:ahead]
        pick = next((i for i, (_, e) in enumerate(some) if recent.count(e) < cap), None)
        if pick is None:
            pick = min(range(len(some)), key=lambda i: (recent.count(some[i][1]), i))
        out.append(waiting.pop(pick))
    return pd.DataFrame({"id": [i for i, _ in out], "employer": [e for _, e in out], "place": range(1, len(out) + 1)})


@query("w_spread_employers")
def spread_employers(t: Tables) -> DataFrame:
    """Sequential by nature; it runs on the ranked first 400 rows, a bound of the operator itself."""
    page = top(jobs(t).select(F.col("job_id").alias("id"), F.col("board").alias("employer"), "annual_min"), 400, F.col("annual_min").desc_nulls_last(), F.col("id"))
    numbered = page.select("id", "employer", F.row_number().over(Window.orderBy(F.col("annual_min").desc_nulls_last(), "id")).alias("n"), F.lit(0).alias("page"))
    return numbered.groupBy("page").applyInPandas(lambda df: spread(df, 2, 20, 400), "id long, employer string, place long")


@query("w_personal_rank", f"{JOBS}, p AS (SELECT job_id, job_id % 97 AS pref, job_id % 89 AS percent FROM jobs WHERE status = 'open'), pool AS (SELECT *, row_number() OVER (ORDER BY pref DESC, job_id) AS n FROM p) SELECT job_id FROM pool WHERE n <= 200 ORDER BY pref + 0.3 * percent DESC, n LIMIT 50")
def personal_rank(t: Tables) -> DataFrame:
    """The best 200 by preference, reordered with the match percentage."""
    p = jobs(t).where("status = 'open'").select("job_id", (F.col("job_id") % 97).alias("pref"), (F.col("job_id") % 89).alias("percent"))
    pool = top(p, 200, F.col("pref").desc(), F.col("job_id"))
    return top(pool, 50, (F.col("pref") * 10 + 3 * F.col("percent")).desc(), F.col("pref").desc(), F.col("job_id")).select("job_id")


@query("w_rank_top_matched_feed", f"{JOBS} SELECT job_id FROM jobs ORDER BY CASE WHEN level IS NULL THEN 2 WHEN job_id % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN level IS NOT NULL AND job_id % 3 <> 0 THEN job_id % 101 ELSE 0 END DESC, job_id LIMIT 70")
def matched_feed(t: Tables) -> DataFrame:
    """Scored by percent, then unscored, then unscorable."""
    group = F.when(F.col("level").isNull(), 2).when(F.col("job_id") % 3 == 0, 1).otherwise(0)
    percent = F.when(group == 0, F.col("job_id") % 101).otherwise(0)
    return top(jobs(t), 70, group, percent.desc(), F.col("job_id")).select("job_id")


@query("w_queue_order", f"{JOBS} SELECT job_id FROM jobs ORDER BY CASE WHEN level = 'senior' THEN 0 WHEN job_id % 7 = 0 THEN 1 ELSE 2 END, posted_at DESC NULLS LAST, job_id DESC LIMIT 90")
def queue_order(t: Tables) -> DataFrame:
    bucket = F.when(F.col("level") == "senior", 0).when(F.col("job_id") % 7 == 0, 1).otherwise(2)
    return top(jobs(t), 90, bucket, F.col("posted_at").desc_nulls_last(), F.col("job_id").desc()).select("job_id")


@query("w_due_plan", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0 WHEN s_acctbal < 0 THEN least(60 * CAST(pow(2, s_suppkey % 4) AS BIGINT), 240) ELSE 1440 END AS due_minutes FROM supplier")
def due_plan(t: Tables) -> DataFrame:
    """Never checked boards at once, failing ones on a doubling delay, the rest daily."""
    back_off = F.least(60 * F.pow(F.lit(2), F.col("s_suppkey") % 4).cast("long"), F.lit(240))
    return t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, 0).when(F.col("s_acctbal") < 0, back_off).otherwise(1440).cast("long").alias("due_minutes"))


@query("w_due_boards", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 ORDER BY s_nationkey % 3 = 0 DESC, s_suppkey % 7 = 0 DESC, s_acctbal, s_suppkey LIMIT 15")
def due_boards(t: Tables) -> DataFrame:
    """Mine first, then never checked, then longest unchecked."""
    return top(t.supplier.where("s_acctbal > 0"), 15, (F.col("s_nationkey") % 3 == 0).desc(), (F.col("s_suppkey") % 7 == 0).desc(), F.col("s_acctbal"), F.col("s_suppkey")).select("s_suppkey")


@query("w_directory_rank", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 0 WHEN starts_with(p_name, 'red') THEN 1 WHEN contains(' ' || p_name, ' red') THEN 2 ELSE 3 END AS tier FROM part WHERE contains(p_name, 'red') ORDER BY tier, length(p_name), p_partkey LIMIT 40")
def directory_rank(t: Tables) -> DataFrame:
    found = t.part.select("p_partkey", "p_name", F.when(F.col("p_name") == "red widget", 0).otherwise(r.rank_tiers(F.col("p_name"), "red")).alias("tier")).where("tier IS NOT NULL")
    return top(found, 40, F.col("tier"), F.length("p_name"), F.col("p_partkey")).select("p_partkey", "tier")


@query("w_best_place", "SELECT c_nationkey, c_custkey AS pick, coalesce(c_acctbal < 5 * nxt, FALSE) AS ambiguous FROM (SELECT *, row_number() OVER w AS n, lead(c_acctbal) OVER w AS nxt FROM customer WHERE c_acctbal > 0 WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE n = 1")
def best_place(t: Tables) -> DataFrame:
    best = r.dominant(t.customer.where("c_acctbal > 0"), ["c_nationkey"], "c_acctbal", 5.0, "c_custkey")
    return best.select("c_nationkey", F.col("c_custkey").alias("pick"), "ambiguous")


@query("w_bare_city", """WITH b AS (SELECT c_mktsegment, c_nationkey, max(c_acctbal) AS pop FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS n, lead(pop) OVER w AS nxt FROM b WINDOW w AS (PARTITION BY c_mktsegment ORDER BY pop DESC, c_nationkey))
  SELECT c_mktsegment, c_nationkey AS pick, coalesce(pop < 20 * nxt, FALSE) AS ambiguous FROM r WHERE n = 1""")
def bare_city(t: Tables) -> DataFrame:
    """Best place per country first, then dominance over the other countries' best."""
    best = t.customer.where("c_acctbal > 0").groupBy("c_mktsegment", "c_nationkey").agg(F.max("c_acctbal").alias("pop"))
    return r.dominant(best, ["c_mktsegment"], "pop", 20.0, "c_nationkey").select("c_mktsegment", F.col("c_nationkey").alias("pick"), "ambiguous")


@query("w_recent_n", "SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id LIMIT 10")
def recent_n(t: Tables) -> DataFrame:
    kind = t.events.agg(F.min("event_type").alias("event_type"))
    return top(t.events.join(F.broadcast(kind), "event_type"), 10, F.col("ts").desc(), F.col("event_id")).select("event_id")  # one row


@query("w_pagination", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def pagination(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("w_iterate_pages", "SELECT o_orderkey // 200 AS page, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def iterate_pages(t: Tables) -> DataFrame:
    """Pages by key range, each readable on its own."""
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 200).alias("page")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("w_retry_ladder", "SELECT s_suppkey, list_extract([5, 15, 60, 240], least(greatest(s_suppkey % 6, 1), 4)) AS delay FROM supplier")
def retry_ladder(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", r.retry_delay(F.col("s_suppkey") % 6, [5, 15, 60, 240]).alias("delay"))


@query("w_jitter", "SELECT s_suppkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(s_name, ''), lambda c: CAST(ord(c) AS UBIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 3600 AS BIGINT) AS jitter_s FROM supplier")
def jitter(t: Tables) -> DataFrame:
    """Stable jitter per board: FNV-1a of its key over the refresh period."""
    return t.supplier.select("s_suppkey", (r.fnv1a32(F.col("s_name")) % 3600).alias("jitter_s"))
