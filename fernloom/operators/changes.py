"""Incremental mirrors and change feeds over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.registry import Tables, query
from fernloom.scratch import scratch_path
from fernloom.streaming.mirror import Mirror, newer_than

#: Changes of orders: made, priced anew with each line, some withdrawn and some made again; revisions follow the key and the kind.
_CHANGES = """SELECT o_orderkey AS id, o_orderkey * 16 AS rev, FALSE AS deleted, o_orderstatus AS status, o_totalprice AS price FROM orders
  UNION ALL SELECT l_orderkey, l_orderkey * 16 + l_linenumber, FALSE, l_returnflag || l_linestatus, l_extendedprice FROM lineitem
  UNION ALL SELECT o_orderkey, o_orderkey * 16 + 9, TRUE, NULL, NULL FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_orderkey * 16 + 10, FALSE, 'again', o_totalprice / 2 FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000"""
_LAST = f"SELECT id, max(rev) AS rev, {', '.join(f"arg_max({c}, {{'r': rev, 's': status, 'p': price}}) AS {n}" for c, n in (('deleted', 'deleted'), ("coalesce(status, '-')", 'status'), ('coalesce(price, -1)', 'price')))} FROM ({_CHANGES}) GROUP BY id"


def changes(t: Tables) -> DataFrame:
    text = _CHANGES.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}")
    return t.spark.sql(text, orders=t.orders, lineitem=t.lineitem)


def streamed_mirror(t: Tables) -> Mirror:
    """The changes dealt over four files in no order of revision, followed as a stream of a file a batch; two batches come twice."""
    source = scratch_path(t.spark, "changes")
    changes(t).repartition(4, F.xxhash64("rev", "deleted")).write.parquet(source)
    mirror = Mirror(t.spark, scratch_path(t.spark, "mirror"), "id", "id long, status string, price double")
    feed = t.spark.readStream.schema(mirror.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = mirror.follow(feed, scratch_path(t.spark, "mirror-progress"))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    for number in (0, 2):
        mirror.apply(changes(t).where("deleted"), number)  # known by their numbers: nothing changes
    return mirror


@query("st_change_feed", f"SELECT id, rev, CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN NOT deleted THEN status END AS status, CASE WHEN NOT deleted THEN price END AS price FROM ({_LAST}) WHERE rev > (SELECT max(o_orderkey) * 12 FROM orders)")
def st_change_feed(t: Tables) -> DataFrame:
    """Rows and tombstones above a revision, from a mirror that was fed by a stream."""
    mark = t.orders.agg(F.max("o_orderkey") * 12).first()[0]
    return streamed_mirror(t).changes(mark).select("id", "rev", F.when(F.col("deleted"), "delete").otherwise("upsert").alias("op"), "status", "price")


@query("st_mirror", f"SELECT id, status, price FROM ({_LAST}) WHERE NOT deleted")
def st_mirror(t: Tables) -> DataFrame:
    """The mirrored table itself."""
    return streamed_mirror(t).rows()


@query("scan_incremental_sync", """WITH w AS (SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS made, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400 * 400 ELSE 0 END AS closed FROM orders),
  r AS (SELECT *, CASE WHEN made <= 800000000 THEN 1 WHEN made <= 900000000 THEN 2 ELSE 3 END AS first_round, CASE WHEN closed = 0 THEN 0 WHEN closed <= 800000000 THEN 1 WHEN closed <= 900000000 THEN 2 ELSE 3 END AS close_round FROM w)
  SELECT o_orderkey AS id, CASE WHEN closed > 0 THEN 'closed' ELSE 'open' END AS status, greatest(first_round, close_round) AS round FROM r""")
def scan_incremental(t: Tables) -> DataFrame:
    """Three runs of an incremental mirror: each reads the rows made or closed above the mark that the last one left."""
    second = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    orders = t.orders.select(F.col("o_orderkey").alias("id"), second.alias("made"), F.when(F.col("o_orderstatus") == "F", second + 86400 * 400).otherwise(F.lit(0)).alias("closed"))
    mirror = Mirror(t.spark, scratch_path(t.spark, "sync"), "id", "id long, status string, round int")
    mark = None
    for run, now in enumerate((800_000_000, 900_000_000, 4_000_000_000), 1):
        source = orders.where(F.col("made") <= now).withColumn("closed", F.when(F.col("closed") <= now, F.col("closed")).otherwise(0))  # as it stands at that time
        fresh = newer_than(source, mark, "made", "closed")
        status = F.when(F.col("closed") > 0, "closed").otherwise("open")
        mirror.apply(fresh.select("id", F.greatest("made", "closed").alias("rev"), F.lit(False).alias("deleted"), status.alias("status"), F.lit(run).alias("round")), run)
        mark = mirror.manifest["rev"]
    return mirror.rows()
