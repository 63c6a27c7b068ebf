"""Filtered, ranked first page with a true total."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.scratch import table


def search_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open postings (orders) of one market, unknown priority passing, newest first, 20 rows."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    nation = table(spark, sf_dir, "nation")
    level = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    hits = (
        orders.where((F.col("o_orderstatus") == "O") & (level.isin("1-URGENT", "2-HIGH") | level.isNull()))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(20)
    return page.crossJoin(total).select("o_orderkey", "c_name", "n_name", "o_orderdate", "o_totalprice", "total")


QUERIES = {"search_first_page": search_first_page}
ORACLE_SQL = {
    "search_first_page": """
SELECT o_orderkey, c_name, n_name, o_orderdate, o_totalprice, count(*) OVER () AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'
  AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR nullif(o_orderpriority, '5-LOW') IS NULL)
ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 20
"""
}
