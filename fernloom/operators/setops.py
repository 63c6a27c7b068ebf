"""Set operations, deduplication and identity keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


def first_of(frame: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


@query("s_board_dedupe", f"{JOBS} SELECT ats, board, min(job_id) AS first_job FROM jobs GROUP BY ats, board")
def board_dedupe(t: Tables) -> DataFrame:
    return jobs(t).groupBy("ats", "board").agg(F.min("job_id").alias("first_job"))


@query("s_dedupe_batch", f"""{JOBS}, b AS (SELECT url, job_id, job_id % 3 AS trust, row_number() OVER (PARTITION BY url ORDER BY job_id % 3 DESC, job_id) AS n, min(job_id) OVER (PARTITION BY url) AS slot FROM jobs) SELECT slot, job_id FROM b WHERE n = 1""")
def dedupe_batch(t: Tables) -> DataFrame:
    """The most trusted posting of a URL in the place of its first."""
    b = jobs(t).groupBy("url").agg(F.min("job_id").alias("slot"), F.min_by("job_id", F.struct(-(F.col("job_id") % 3), "job_id")).alias("job_id"))
    return b.select("slot", "job_id")


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


@query("s_content_hash", "SELECT c_custkey, sha256(concat_ws(chr(1), c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), ''), CAST(c_nationkey AS STRING))) AS hash FROM customer")
def content_hash_query(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", content_hash(F.col("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_nationkey")).alias("hash"))


@query("s_content_hash_store", "SELECT c_custkey, substr(sha256('[' || '\"' || c_name || '\",' || CAST(c_nationkey AS STRING) || ']'), 1, 32) AS hash FROM customer")
def content_hash_store(t: Tables) -> DataFrame:
    """A canonical JSON array of the parts, first 32 hex digits."""
    text = F.concat(F.lit('["'), "c_name", F.lit('",'), F.col("c_nationkey").cast("string"), F.lit("]"))
    return t.customer.select("c_custkey", F.substr(F.sha2(text, 256), F.lit(1), F.lit(32)).alias("hash"))


@query("s_dedup_hash", f"{JOBS} SELECT job_id, sha256(lower(company) || '|' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS hash FROM jobs")
def dedup_hash(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.sha2(F.concat_ws("|", F.lower("company"), F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))), 256).alias("hash"))


def role_key(company: Column, title: Column, places: Column, details: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(company), F.lower(title), F.array_join(F.array_sort(places), "|"), details), 256)


@query("s_role_key", f"{JOBS} SELECT job_id, sha256(concat_ws('|', lower(company), lower(title), array_to_string(list_sort([country, area]), '|'), '')) AS role FROM jobs")
def role_key_query(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", role_key(F.col("company"), F.col("title"), F.array("country", "area"), F.lit("")).alias("role"))


@query("s_keys_of", f"{JOBS} SELECT job_id, unnest(list_distinct(['id:' || external_id, 'url:' || url, 'post:' || ats || ':' || external_id])) AS key FROM jobs")
def keys_of(t: Tables) -> DataFrame:
    keys = F.array_distinct(F.array(F.concat(F.lit("id:"), "external_id"), F.concat(F.lit("url:"), "url"), F.concat(F.lit("post:"), "ats", F.lit(":"), "external_id")))
    return jobs(t).select("job_id", F.explode(keys).alias("key"))


@query("s_posting_keys_url", f"{JOBS} SELECT job_id, list_filter([CASE WHEN url LIKE '%gh_jid=%' THEN 'gh:' || regexp_extract(url, 'gh_jid=([0-9]+)', 1) END, 'p:' || regexp_extract(url, '/(b[0-9]+)/([0-9]+)', 1) || ':' || regexp_extract(url, '/(b[0-9]+)/([0-9]+)', 2)], lambda x: x IS NOT NULL) AS keys FROM jobs")
def posting_keys(t: Tables) -> DataFrame:
    gh = F.when(F.col("url").contains("gh_jid="), F.concat(F.lit("gh:"), F.regexp_extract("url", "gh_jid=([0-9]+)", 1)))
    path = F.concat_ws(":", F.lit("p"), F.regexp_extract("url", "/(b[0-9]+)/([0-9]+)", 1), F.regexp_extract("url", "/(b[0-9]+)/([0-9]+)", 2))
    return jobs(t).select("job_id", F.array_compact(F.array(gh, path)).alias("keys"))


@query("s_merge_sources", "SELECT l_orderkey, l_suppkey % 5 AS source, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1, 2")
def merge_sources(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 5).alias("source")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))


@query("s_scraper_dedupe", f"{JOBS}, b AS (SELECT min(job_id) AS job_id, url FROM jobs WHERE job_id % 2 = 1 GROUP BY url) SELECT job_id FROM b WHERE url NOT IN (SELECT url FROM jobs WHERE job_id % 2 = 0 AND status = 'closed')")
def scraper_dedupe(t: Tables) -> DataFrame:
    base = jobs(t).select("job_id", "url", "status")
    fresh = base.where("job_id % 2 = 1").groupBy("url").agg(F.min("job_id").alias("job_id"))
    return fresh.join(base.where("job_id % 2 = 0 AND status = 'closed'"), "url", "left_anti").select("job_id")


@query("s_entity_dedupe_key", f"{JOBS} SELECT job_id, CASE WHEN job_id % 4 <> 0 THEN 'url:' || url ELSE lower(title) || '|' || lower(company) || '|' || lower(country) END AS key FROM jobs")
def entity_key(t: Tables) -> DataFrame:
    url = F.when(F.col("job_id") % 4 != 0, F.concat(F.lit("url:"), "url"))
    return jobs(t).select("job_id", F.coalesce(url, F.concat_ws("|", F.lower("title"), F.lower("company"), F.lower("country"))).alias("key"))


def distinct_spelling(items: Column) -> Column:
    """Distinct without regard to case, first spelling kept."""
    lowered = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


@query("s_distinct_list", "SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_type) THEN [p_brand, p_name] ELSE [p_brand, p_name, p_type] END AS items FROM part")
def distinct_list(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", distinct_spelling(F.array("p_brand", F.upper("p_brand"), "p_name", F.initcap("p_name"), "p_type")).alias("items"))


@query("s_union_feeds", "SELECT c_custkey AS id, c_name AS name, NULL AS brand FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT p_partkey, p_name, p_brand FROM part")
def union_feeds(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b).unionByName(t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("s_except_missing", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def except_missing(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("s_seed_cross_union", "SELECT n_nationkey, role FROM nation CROSS JOIN (SELECT 'recruiter' AS role UNION ALL SELECT 'manager' UNION ALL SELECT 'peer')")
def seed_cross_union(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame([("recruiter",), ("manager",), ("peer",)], "role string")
    return t.nation.select("n_nationkey").crossJoin(F.broadcast(roles))  # three constant rows


@query("s_min_id_dedupe", "SELECT p_name, p_brand, min(p_partkey) AS keep FROM part GROUP BY 1, 2")
def min_id_dedupe(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("keep"))


@query("s_shared_fields", "SELECT p_partkey, list_sort(list_intersect(string_split(p_name, ' '), ['red', 'small', 'widget'])) AS shared FROM part")
def shared_fields(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_sort(F.array_intersect(F.split("p_name", " "), F.array(F.lit("red"), F.lit("small"), F.lit("widget")))).alias("shared"))
