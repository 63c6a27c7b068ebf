"""Transitive identities: chains of duplicates to their root, and rows that share keys to one identity.

``roots`` follows pointers by doubling: every round each row points where its target points, so a
chain of n links takes log2(n) rounds.  ``identities`` contracts the graph of rows and keys by large and
small stars: in turn every node's larger, then smaller neighbours are linked to its least one, until
nothing changes; a hub is a group in a sum and one side of a join, never one task's list.  Each
round's result is a table in the shared folder, so a lost executor costs a task.

Defined cases: a null pointer is a root, and so is a pointer to itself; a pointer to a row that is
not there is followed to it; of rows that point in a circle the least id is the root of all that
lead there; null keys identify nothing; rows that repeat count once; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.registry import Tables, query
from fernloom.scratch import materialize, temporary

#: More rounds than any table needs; a table that is not done then is a fault.
MOST_ROUNDS = 64


def roots(rows: DataFrame, key: str, pointer: str) -> DataFrame:
    """``(key, root, hops)`` of ``(key, pointer)``, one row a key; ``hops`` counts the links up to the root, null in a circle."""
    spark = rows.sparkSession
    with temporary(spark):
        own = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(pointer).alias("to"))
        start = own.select("id", F.coalesce("to", "id").alias("to"), F.when(F.col("to").isNull() | (F.col("to") == F.col("id")), 0).otherwise(1).cast("long").alias("hops"), F.least("id", "to").alias("least"))
        now = materialize(start, "pointers")
        total = now.count()
        for _ in range(MOST_ROUNDS):
            next_ = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("least").alias("least2"))
            jumped = now.join(next_, "to", "left").select(
                "id", F.coalesce("to2", "to").alias("to"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.least("least", "least2").alias("least"), (F.coalesce("to2", "to") != F.col("to")).alias("moved")
            )
            now = materialize(jumped, "pointers")
            moved = now.where("moved AND hops <= " + str(2 * total)).limit(1).count()  # rows in a circle move on for ever, past any chain's length
            if not moved:
                break
        else:
            raise RuntimeError(f"pointers did not settle in {MOST_ROUNDS} rounds")
        ends = now.select(F.col("id").alias("to"), F.col("least").alias("circle"))
        done = now.join(ends, "to", "left").select("id", F.when(F.col("hops") > total, F.col("circle")).otherwise(F.col("to")).alias("root"), F.when(F.col("hops") <= total, F.col("hops")).alias("hops"))
        return materialize(done, "roots", keep=True).withColumnRenamed("id", key)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller and own) neighbours linked to its least one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = both.join(least, "u")  # two plain exchanges: AQE can split a hub
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` of every node of ``(u, v)``: the least node of its component."""
    with temporary(edges.sparkSession):
        now = materialize(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
        before = None
        for _ in range(MOST_ROUNDS):
            now = materialize(_star(_star(now, True), False), "edges")
            mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if mark == before:
                break
            before = mark
        else:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
        inner = now.select("u", F.col("v").alias("root"))
        return materialize(inner.unionAll(inner.select("root", "root")).distinct(), "components", keep=True)


def identities(rows: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """``(key, identity, members)``: rows that share a value of any ``shared`` column, through any number of others, are one; the least key names it."""
    parts = None
    for c in shared:
        known = rows.where(F.col(key).isNotNull() & F.col(c).isNotNull()).select(F.col(key).alias("id"), F.col(c).cast("string").alias("value")).distinct()
        first = known.groupBy("value").agg(F.min("id").alias("v"))
        own = known.join(first, "value").select(F.col("id").alias("u"), "v")  # each holder of a value is linked to its least holder
        parts = own if parts is None else parts.unionAll(own)
    found = components(parts).withColumnRenamed("u", key)
    all_ = rows.where(F.col(key).isNotNull()).select(key).distinct().join(found, key, "left").select(key, F.coalesce("root", key).alias("identity"))
    sizes = all_.groupBy("identity").agg(F.count("*").alias("members"))
    return all_.join(sizes, "identity").select(key, "identity", "members")


@query("j_duplicate_roots", """WITH d AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) AS up, o_custkey % 7 AS g FROM orders)
  SELECT id AS job_id, min(id) OVER (PARTITION BY g) AS canonical_id, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS hops FROM d""")
def duplicate_roots(t: Tables) -> DataFrame:
    """Chains of duplicates, thousands of links long: each posting repeats the one before it of its group."""
    before = F.lag("o_orderkey").over(Window.partitionBy(F.col("o_custkey") % 7).orderBy("o_orderkey"))
    chained = t.orders.select(F.col("o_orderkey").alias("job_id"), before.alias("duplicate_of"))
    return roots(chained, "job_id", "duplicate_of").withColumnRenamed("root", "canonical_id")


@query("s_identity_groups", """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 NOT IN (0, 17) THEN 'p' || CAST(c_custkey // 3 AS VARCHAR) END AS phone, CASE WHEN c_custkey % 40 NOT IN (0, 17) THEN 'm' || CAST((c_custkey + 1) // 7 AS VARCHAR) END AS mail FROM customer),
  e AS (SELECT DISTINCT a.id AS u, b.id AS v FROM c a JOIN c b ON a.phone = b.phone UNION SELECT a.id, b.id FROM c a JOIN c b ON a.mail = b.mail),
  r AS (SELECT id, id AS reach FROM c UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach)
  SELECT id AS person, identity, count(*) OVER (PARTITION BY identity) AS members FROM (SELECT id, min(reach) AS identity FROM r GROUP BY id)""")
def identity_groups(t: Tables) -> DataFrame:
    """People who share a phone or a mail address, through others too."""
    known = F.col("c_custkey") % 40
    people = t.customer.select(
        F.col("c_custkey").alias("person"),
        F.when(~known.isin(0, 17), F.concat(F.lit("p"), F.floor(F.col("c_custkey") / 3))).alias("phone"),
        F.when(~known.isin(0, 17), F.concat(F.lit("m"), F.floor((F.col("c_custkey") + 1) / 7))).alias("mail"),
    )
    return identities(people, "person", ["phone", "mail"])
