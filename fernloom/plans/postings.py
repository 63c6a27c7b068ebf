"""The driver's tables seen as postings, companies and places.

One SQL text defines the view for Spark and for the oracle; only the array constructor
differs.  Every fact is unknown (NULL) for some postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fernloom.registry import Tables

_VIEW = """
SELECT o_orderkey AS job_id, c_custkey AS company_id, c_name AS company, lower(replace(c_name, '#', ' ')) AS company_key,
  c_mktsegment AS industry, n_name AS country, r_name AS area,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status,
  CASE o_orderkey % 8 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Engineering Manager' WHEN 2 THEN 'Registered Nurse II'
    WHEN 3 THEN 'Software Developer (C++)' WHEN 4 THEN 'Lead Analyst, 2024 Summer' WHEN 5 THEN 'Recruiter' WHEN 6 THEN 'Junior Software Engineer'
    ELSE 'Director of Data' END AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'senior' WHEN '2-HIGH' THEN 'mid' WHEN '3-MEDIUM' THEN 'entry' WHEN '5-LOW' THEN 'manager' END AS level,
  CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS work_model,
  CASE o_orderkey % 5 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' WHEN 2 THEN 'contract' WHEN 3 THEN 'intern' END AS employment_type,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 13 AS INT) END AS years_min,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 13 + 2 AS INT) END AS years_max,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS posted_at, o_orderdate AS first_seen_at,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS annual_min,
  CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 1 THEN CAST(floor(o_totalprice * 1.25) AS DOUBLE) END AS annual_max,
  CASE WHEN o_orderkey % 6 <> 0 THEN CASE WHEN o_orderkey % 3 = 1 THEN 'EUR' ELSE 'USD' END END AS currency,
  CASE WHEN o_orderkey % 5 <> 0 THEN {array}('skill' || CAST(o_orderkey % 7 AS STRING), 'skill' || CAST(o_orderkey % 11 AS STRING)) END AS skills,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 0 THEN {array}('US') WHEN o_orderkey % 4 = 0 AND o_orderkey % 3 = 1 THEN {array}('WORLDWIDE', 'EU') END AS remote_regions,
  CASE o_orderkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS sponsorship,
  CASE o_orderkey % 10 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS clearance_required,
  CASE o_orderkey % 12 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS us_citizen_only,
  CASE o_orderkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS ats,
  'b' || CAST(c_custkey % 50 AS STRING) AS board, CAST(o_orderkey AS STRING) AS external_id,
  {array}('s' || CAST(o_orderkey % 3 AS STRING), 's' || CAST(o_orderkey % 4 AS STRING)) AS source_ids,
  'https://jobs.example.com/b' || CAST(c_custkey % 50 AS STRING) || '/' || CAST(o_orderkey % 2000 AS STRING) || '?utm_source=x&gh_jid=' || CAST(o_orderkey % 2000 AS STRING) AS url
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: DuckDB's WITH clause that defines ``jobs``.
JOBS = f"WITH jobs AS ({_VIEW.format(array='list_value')}) "


def jobs(t: Tables) -> DataFrame:
    """Postings with company, place, level, pay, skills and statements."""
    names = {n: f"{{{n}}}" for n in ("orders", "customer", "nation", "region")}
    text = _VIEW.format(array="array")
    for n in names:
        text = text.replace(f" {n} ", f" {{{n}}} ")
    return t.spark.sql(text.replace("JOIN region ON", "JOIN {region} ON"), orders=t.orders, customer=t.customer, nation=t.nation, region=t.region)
