"""Join operators.  Dimension sides are left to Catalyst and AQE, which broadcast what they measure as small."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


@query("j_materialize", f"""{JOBS}, page AS (SELECT job_id, annual_min FROM jobs WHERE status = 'open' ORDER BY annual_min DESC NULLS LAST, job_id LIMIT 30)
  SELECT p.job_id, j.title, j.company, j.posted_at, count(l_linenumber) AS n_lines FROM page p JOIN jobs j ON p.job_id = j.job_id LEFT JOIN lineitem ON l_orderkey = p.job_id GROUP BY 1, 2, 3, 4""")
def materialize_page(t: Tables) -> DataFrame:
    """Late materialisation: rank narrow columns, then join the wide ones to the page's rows only."""
    base = jobs(t)
    page = base.where("status = 'open'").select("job_id", "annual_min").orderBy(F.col("annual_min").desc_nulls_last(), "job_id").limit(30).select("job_id")
    wide = page.join(base.select("job_id", "title", "company", "posted_at"), "job_id")
    lines = t.lineitem.select(F.col("l_orderkey").alias("job_id"), "l_linenumber").join(page, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("n_lines"))
    return wide.join(lines, "job_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


@query("j_left_self_dup", """SELECT a.o_orderkey AS job_id, b.o_orderkey AS canonical_id, b.o_orderstatus AS canonical_status, c.c_custkey IS NOT NULL AS tracked
  FROM orders a LEFT JOIN orders b ON b.o_orderkey = CASE WHEN a.o_orderkey % 10 = 0 THEN a.o_orderkey - 1 END LEFT JOIN customer c ON 'c:' || CAST(a.o_custkey AS STRING) = 'c:' || CAST(c.c_custkey AS STRING) AND c.c_acctbal > 0""")
def left_self_dup(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") - 1).alias("duplicate_of"), F.concat_ws(":", F.lit("c"), "o_custkey").alias("key"))
    b = t.orders.select(F.col("o_orderkey").alias("canonical_id"), F.col("o_orderstatus").alias("canonical_status"))
    tracked = t.customer.where("c_acctbal > 0").select(F.concat_ws(":", F.lit("c"), "c_custkey").alias("key"), F.lit(True).alias("tracked"))
    out = a.join(b, a.duplicate_of == b.canonical_id, "left").join(tracked, "key", "left")
    return out.select("job_id", "canonical_id", "canonical_status", F.coalesce("tracked", F.lit(False)).alias("tracked"))


@query("j_alias_key", "SELECT l_orderkey AS asked, l_linenumber AS line, o_orderkey AS job_id FROM lineitem JOIN orders ON 'id:' || CAST(l_orderkey AS STRING) = 'id:' || CAST(o_orderkey AS STRING) WHERE l_linenumber = 1")
def alias_key(t: Tables) -> DataFrame:
    asked = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("asked"), F.col("l_linenumber").alias("line"), F.concat(F.lit("id:"), F.col("l_orderkey").cast("string")).alias("key"))
    keys = t.orders.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("id:"), F.col("o_orderkey").cast("string")).alias("key"))
    return asked.join(keys, "key").drop("key")


@query("j_hidden_flags", "SELECT o_orderkey AS job_id, c_acctbal < 0 AS hidden FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def hidden_flags(t: Tables) -> DataFrame:
    changed = t.orders.where(F.col("o_orderdate") > F.expr("TIMESTAMP_NTZ '2000-06-01 00:00:00'"))
    return changed.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("job_id"), (F.col("c_acctbal") < 0).alias("hidden"))


@query("j_exists_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def exists_semi(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("j_not_exists_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j_missing_anti", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def missing_anti(t: Tables) -> DataFrame:
    """Open rows that a complete reading did not list."""
    listed = t.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.where("o_orderstatus <> 'F'").join(listed, "o_orderkey", "left_anti").select("o_orderkey")


def resolve_by_keys(asked: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` ids to ``known`` ids by the first key that matches, smallest known id on ties.

    Both sides have ``id`` and the key columns.  The known side comes down to one id per key first, so a hot
    key makes no pairs.
    """
    stack = lambda df: df.select("id", F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("rank", "key")).where("key IS NOT NULL")
    least = stack(known).groupBy("rank", "key").agg(F.min("id").alias("k_id"))
    return stack(asked).join(least, ["rank", "key"]).groupBy("id").agg(F.min(F.struct("rank", "k_id")).alias("m")).select("id", F.col("m.k_id").alias("match_id"), F.col("m.rank").alias("rank"))


def least_of_others(asked: DataFrame, known: DataFrame, key: list[str], kind: list[str], name: str) -> DataFrame:
    """``asked`` (id, key, kind) plus ``name``: the least known id of the same key and another kind, null if there is none.

    Per key only the least ids of two kinds are kept: whichever kind asks, one of them is the answer.  A null key
    part matches nothing.
    """
    mins = known.select("id", *key, F.struct(*kind).alias("kind")).dropna(subset=key).groupBy(*key, "kind").agg(F.min("id").alias("m"))
    first = mins.groupBy(*key).agg(F.min(F.struct("m", "kind")).alias("a"))
    rest = mins.join(first, key).where(F.col("kind") != F.col("a.kind")).groupBy(*key).agg(F.min("m").alias("b"))
    two = first.join(rest, key, "left").select(*key, F.col("a.m").alias("m1"), F.col("a.kind").alias("k1"), F.col("b").alias("m2"))
    out = asked.join(two, key, "left")
    return out.select(*asked.columns, F.when(F.struct(*kind) == F.col("k1"), F.col("m2")).otherwise(F.col("m1")).alias(name))


@query("j_identity_resolve", """WITH a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS k0, CASE WHEN s_suppkey % 3 <> 2 THEN s_nationkey * 100 END AS k1, s_name AS k2 FROM supplier),
  k AS (SELECT c_custkey AS id, c_custkey AS k0, c_custkey AS k1, replace(c_name, 'Customer', 'Supplier') AS k2 FROM customer),
  m AS (SELECT a.id, k.id AS kid, 0 AS rank FROM a JOIN k ON a.k0 = k.k0 UNION ALL SELECT a.id, k.id, 1 FROM a JOIN k ON a.k1 = k.k1 UNION ALL SELECT a.id, k.id, 2 FROM a JOIN k ON a.k2 = k.k2)
  SELECT id, kid AS match_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, kid) AS n FROM m) WHERE n = 1""")
def identity_resolve(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    asked = t.supplier.select(key.alias("id"), F.when(key % 3 == 0, key).alias("k0"), F.when(key % 3 != 2, (F.col("s_nationkey") * 100).cast("long")).alias("k1"), F.col("s_name").alias("k2"))
    known = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("k0"), F.col("c_custkey").alias("k1"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("k2"))
    return resolve_by_keys(asked, known, ["k0", "k1", "k2"])


@query("j_content_merge_veto", f"""{JOBS} SELECT a.job_id AS id, min(b.job_id) AS match_id, CAST(0 AS INT) AS rank FROM jobs a JOIN jobs b ON a.company || a.title = b.company || b.title
  WHERE a.job_id % 50 = 0 AND b.job_id <> a.job_id AND NOT (a.ats = b.ats AND a.external_id <> b.external_id) GROUP BY a.job_id""")
def content_merge_veto(t: Tables) -> DataFrame:
    """A content match does not merge postings whose ids of one family differ: it takes another family, or the same id."""
    base = jobs(t).select(F.col("job_id").alias("id"), "ats", "external_id", F.concat("company", "title").alias("content"))
    other = least_of_others(base.where("id % 50 = 0"), base, ["content"], ["ats"], "other")
    twin = least_of_others(other, base, ["content", "ats", "external_id"], ["id"], "twin")
    return twin.select("id", F.least("other", "twin").alias("match_id"), F.lit(0).alias("rank")).where("match_id IS NOT NULL")


@query("j_url_owner", f"""{JOBS} SELECT a.job_id, min(b.job_id) AS owner_id FROM jobs a JOIN jobs b ON a.url = b.url AND a.title = b.title AND NOT (a.ats = b.ats AND a.board = b.board) AND (a.country = b.country OR a.level = b.level) GROUP BY a.job_id""")
def url_owner(t: Tables) -> DataFrame:
    """The same URL and title on another board, with a compatible place or level; the smallest id owns it."""
    a = jobs(t).select(F.col("job_id").alias("id"), "url", "title", "ats", "board", "country", "level")
    out = least_of_others(a, a, ["url", "title", "country"], ["ats", "board"], "by_place")
    out = least_of_others(out, a, ["url", "title", "level"], ["ats", "board"], "by_level")
    return out.select(F.col("id").alias("job_id"), F.least("by_place", "by_level").alias("owner_id")).where("owner_id IS NOT NULL")


@query("j_role_canonical", f"""{JOBS} SELECT a.job_id, min(b.job_id) AS canonical_id FROM jobs a JOIN jobs b ON a.company = b.company AND a.title = b.title AND a.country = b.country AND a.ats <> b.ats GROUP BY a.job_id""")
def role_canonical(t: Tables) -> DataFrame:
    """Lowest id of the role on another board."""
    base = jobs(t).select(F.col("job_id").alias("id"), "ats", "company", "title", "country")
    out = least_of_others(base, base, ["company", "title", "country"], ["ats"], "canonical_id")
    return out.select(F.col("id").alias("job_id"), "canonical_id").where("canonical_id IS NOT NULL")


@query("j_h1b_lookup", """WITH v AS (SELECT s_suppkey, unnest([s_name, replace(s_name, 'Supplier', 'Customer'), 'Customer#000000001']) AS name, unnest([0, 1, 2]) AS rank FROM supplier)
  SELECT s_suppkey, arg_min(c_custkey, rank) AS filer, CAST(min(rank) AS INT) AS rank FROM v JOIN customer ON c_name = name GROUP BY s_suppkey""")
def filer_lookup(t: Tables) -> DataFrame:
    """Name variants in order; the first that any filer has decides."""
    variants = F.array("s_name", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")), F.lit("Customer#000000001"))
    asked = t.supplier.select("s_suppkey", F.posexplode(variants).alias("rank", "c_name"))
    found = asked.join(t.customer.select("c_name", "c_custkey"), "c_name").groupBy("s_suppkey").agg(F.min(F.struct("rank", "c_custkey")).alias("m"))
    return found.select("s_suppkey", F.col("m.c_custkey").alias("filer"), F.col("m.rank").alias("rank"))


def name_variants(name: Column) -> Column:
    """As written, without parentheses, the halves around dba, and what stands in parentheses."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    halves = F.split(bare, r"(?i)\s+d/?b/?a\s+")
    inside = F.regexp_extract(name, r"\(([^)]+)\)", 1)
    return F.array_distinct(F.filter(F.concat(F.array(name, bare), halves, F.array(inside)), lambda x: x != ""))


@query("j_h1b_variants", "SELECT p_partkey, list_sort(list_distinct([p_name || ' (' || p_brand || ') dba ' || p_type, p_name || ' dba ' || p_type, p_name, p_type, p_brand])) AS variants FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) ORDER BY 1")
def filer_variants(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") dba "), "p_type")
    return t.part.select("p_partkey", F.array_sort(name_variants(name)).alias("variants"))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * 3958.7613 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within_radius(left: DataFrame, right: DataFrame, miles: float) -> DataFrame:
    """Pairs of ``(id, lat, lon)`` and ``(other, lat, lon)`` rows within ``miles``: a grid equi-join, then the exact distance.

    A cell is as high as the radius; columns widen towards the poles so that one
    neighbour on each side suffices.  Longitudes wrap.
    """
    step = miles / 69.0
    band = lambda lat: F.floor((lat + 90) / step)

    def cells(b: Column) -> Column:
        """Cells of a band: as many as the radius fits at its higher latitude; one where it comes near a pole."""
        edge = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90))
        fit = F.floor(360 * F.cos(F.radians(edge)) / step - 1).cast("long")
        return F.when(edge > 90 - 2 * step, F.lit(1)).otherwise(F.greatest(F.lit(1), fit)).cast("long")

    column = lambda lon, b: F.pmod(F.floor((lon + 180) / 360 * cells(b)), cells(b))
    l_side = left.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("band"))
    l_side = l_side.withColumn("column", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("lon1"), F.col("band")) + d, cells(F.col("band")))))))
    r_side = right.select("other", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), band(F.col("lat")).alias("band")).withColumn("column", column(F.col("lon2"), F.col("band")))
    dist = haversine_miles(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return l_side.join(r_side, ["band", "column"]).withColumn("miles", dist).where(F.col("miles") <= miles).select("id", "other", "miles")


_MILES = "2 * 3958.7613 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


@query("j_radius", f"""WITH p AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 170 AS DOUBLE) - 85 AS lat, CAST(c_custkey * 101 % 360 AS DOUBLE) - 180 AS lon FROM customer),
  q AS (SELECT s_suppkey AS other, CAST(s_suppkey * 53 % 170 AS DOUBLE) - 85 AS lat, CAST(s_suppkey * 71 % 360 AS DOUBLE) - 180 AS lon FROM supplier)
  SELECT id, other, round({_MILES}, 3) AS miles FROM p a, q b WHERE {_MILES} <= 100""")
def radius(t: Tables) -> DataFrame:
    place = lambda df, k, n, x, y: df.select(F.col(k).alias(n), ((F.col(k) * x % 170).cast("double") - 85).alias("lat"), ((F.col(k) * y % 360).cast("double") - 180).alias("lon"))
    out = within_radius(place(t.customer, "c_custkey", "id", 37, 101), place(t.supplier, "s_suppkey", "other", 53, 71), 100.0)
    return out.withColumn("miles", F.round("miles", 3))


@query("j_place_compare", """SELECT n.n_nationkey, w.n_nationkey AS wanted, CASE WHEN n.n_name = w.n_name THEN 'match' WHEN n.n_nationkey % 6 = 0 THEN 'unknown' WHEN n.n_regionkey = w.n_regionkey THEN 'same_region_unknown_distance' ELSE 'different' END AS verdict
  FROM nation n, nation w WHERE w.n_nationkey < 5""")
def place_compare(t: Tables) -> DataFrame:
    """Four verdicts of each place against each of the few wanted ones."""
    wanted = t.nation.where("n_nationkey < 5").select(F.col("n_nationkey").alias("wanted"), F.col("n_name").alias("w_name"), F.col("n_regionkey").alias("w_region"))
    verdict = F.when(F.col("n_name") == F.col("w_name"), "match").when(F.col("n_nationkey") % 6 == 0, "unknown").when(F.col("n_regionkey") == F.col("w_region"), "same_region_unknown_distance").otherwise("different")
    return t.nation.crossJoin(F.broadcast(wanted)).select("n_nationkey", "wanted", verdict.alias("verdict"))  # five wanted places


@query("j_network_counts", """WITH k AS (SELECT c_custkey, unnest(list_distinct([c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)), c_mktsegment])) AS key FROM customer)
  SELECT key, count(*) AS contacts FROM k GROUP BY key""")
def network_counts(t: Tables) -> DataFrame:
    """Contacts per company under primary and raw key, once each."""
    keys = F.array_distinct(F.array("c_mktsegment", F.initcap("c_mktsegment")))
    return t.customer.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("contacts"))


@query("j_network_coverage", """WITH r AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_mktsegment = 'BUILDING')
  SELECT n_name, count(c_name) AS contacts, list(c_name ORDER BY n) FILTER (n <= 3) AS top FROM nation LEFT JOIN r ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(c_name) > 0""")
def network_coverage(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    ranked = t.customer.where("c_mktsegment = 'BUILDING'").withColumn("n", F.row_number().over(w))
    per = ranked.groupBy("c_nationkey").agg(F.count("*").alias("contacts"), F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "c_name")))).alias("t"))
    out = t.nation.join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").where("contacts > 0")
    return out.select("n_name", "contacts", F.transform("t", lambda x: x["c_name"]).alias("top"))


@query("j_import_match", """WITH old AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey AS STRING) END AS url, 'n' || CAST(c_custkey % 700 AS STRING) AS name FROM customer),
  new AS (SELECT s_suppkey AS row_no, CASE WHEN s_suppkey % 2 = 0 THEN 'u' || CAST(s_suppkey * 3 AS STRING) END AS url, 'n' || CAST(s_suppkey * 9 AS STRING) AS name FROM supplier),
  u AS (SELECT row_no, id FROM new JOIN old USING (url)),
  n AS (SELECT row_no, any_value(id) AS id FROM new JOIN old ON new.name = old.name WHERE row_no NOT IN (SELECT row_no FROM u) GROUP BY row_no HAVING count(*) = 1)
  SELECT row_no, id, how FROM (SELECT new.row_no, coalesce(u.id, n.id) AS id, CASE WHEN u.id IS NOT NULL THEN 'url' WHEN n.id IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM new LEFT JOIN u ON u.row_no = new.row_no LEFT JOIN n ON n.row_no = new.row_no)""")
def import_match(t: Tables) -> DataFrame:
    """Imported rows to contacts: by link, else by a name that only one contact has."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("url"), F.concat(F.lit("n"), (F.col("c_custkey") % 700).cast("string")).alias("name"))
    key = F.col("s_suppkey")
    new = t.supplier.select(key.alias("row_no"), F.when(key % 2 == 0, F.concat(F.lit("u"), (key * 3).cast("string"))).alias("url"), F.concat(F.lit("n"), (key * 9).cast("string")).alias("name"))
    by_url = old.where("url IS NOT NULL").select("url", F.col("id").alias("url_id"))
    by_name = old.groupBy("name").agg(F.count("*").alias("same"), F.min("id").alias("name_id")).where("same = 1").drop("same")
    out = new.join(by_url, "url", "left").join(by_name, "name", "left")
    how = F.when(F.col("url_id").isNotNull(), "url").when(F.col("name_id").isNotNull(), "name").otherwise("new")
    return out.select("row_no", F.coalesce("url_id", "name_id").alias("id"), how.alias("how"))


@query("j_tracker_list", """SELECT o_orderkey, c_name, count(l_linenumber) > 0 AS has_notes, coalesce(max(CASE WHEN l_returnflag = 'R' THEN 1 END), 0) = 1 AS has_reminder FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'P' GROUP BY 1, 2""")
def tracker_list(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit(True).alias("has_notes"), F.max(F.col("l_returnflag") == "R").alias("has_reminder"))
    out = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(flags, "o_orderkey", "left")
    return out.select("o_orderkey", "c_name", F.coalesce("has_notes", F.lit(False)).alias("has_notes"), F.coalesce("has_reminder", F.lit(False)).alias("has_reminder"))


@query("j_boards_entries", """SELECT coalesce(s_suppkey, c_custkey) AS board, s_name, c_name, p_partkey IS NOT NULL AS checked FROM supplier FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 0) ON s_suppkey = c_custkey
  LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) ON p_partkey = coalesce(s_suppkey, c_custkey)""")
def boards_entries(t: Tables) -> DataFrame:
    directory = t.supplier.select(F.col("s_suppkey").alias("board"), "s_name")
    prefs = t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("board"), "c_name")
    checks = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("board"), F.lit(True).alias("checked"))
    return directory.join(prefs, "board", "full_outer").join(checks, "board", "left").withColumn("checked", F.coalesce("checked", F.lit(False)))


@query("j_ref_counts", "SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'O') AS applied, count(*) FILTER (o_orderstatus = 'F') AS rejected FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ref_counts(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("applied"), F.count_if(F.col("o_orderstatus") == "F").alias("rejected"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["total", "applied", "rejected"])


@query("j_vectors_fresh", "SELECT vec_id, label FROM embeddings JOIN documents ON vec_id = doc_id AND n_chars % 5 = label % 5")
def vectors_fresh(t: Tables) -> DataFrame:
    """A vector counts only when its stored hash equals the row's current one."""
    fresh = (F.col("vec_id") == F.col("doc_id")) & (F.col("n_chars") % 5 == F.col("label") % 5)
    return t.embeddings.select("vec_id", "label").join(t.documents.select("doc_id", "n_chars"), fresh).select("vec_id", "label")


@query("j_page_match", f"""{JOBS}, k AS (SELECT url, count(*) FILTER (status = 'open') AS n_open, count(*) AS n, min(job_id) FILTER (status = 'open') AS open_id, min(job_id) AS any_id FROM jobs GROUP BY url)
  SELECT url, CASE WHEN n_open = 1 THEN open_id WHEN n_open = 0 AND n = 1 THEN any_id END AS job_id FROM k""")
def page_match(t: Tables) -> DataFrame:
    """URL to posting: the only open one, else the only one, else none."""
    is_open = F.col("status") == "open"
    k = jobs(t).groupBy("url").agg(F.count_if(is_open).alias("n_open"), F.count("*").alias("n"), F.min(F.when(is_open, F.col("job_id"))).alias("open_id"), F.min("job_id").alias("any_id"))
    return k.select("url", F.when(F.col("n_open") == 1, F.col("open_id")).when((F.col("n_open") == 0) & (F.col("n") == 1), F.col("any_id")).alias("job_id"))


@query("j_partition_new", """WITH seen AS (SELECT 'u' || CAST(o_orderkey AS STRING) AS url, 'h' || CAST(o_orderkey % 997 AS STRING) AS hash FROM orders WHERE o_orderkey % 100 = 0),
  batch AS (SELECT o_orderkey AS ord, 'u' || CAST(o_orderkey % 5000 AS STRING) AS url, 'h' || CAST(o_orderkey % 1999 AS STRING) AS hash FROM orders),
  fresh AS (SELECT * FROM batch WHERE url NOT IN (SELECT url FROM seen) AND hash NOT IN (SELECT hash FROM seen))
  SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY url ORDER BY ord) AS n, row_number() OVER (PARTITION BY hash ORDER BY ord) AS m FROM fresh) WHERE n = 1 AND m = 1""")
def partition_new(t: Tables) -> DataFrame:
    """Rows of a batch that no seen row and no earlier row of the batch shares a URL or a hash with."""
    key = F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    seen = t.orders.where("o_orderkey % 100 = 0").select(name("u", key).alias("url"), name("h", key % 997).alias("hash"))
    batch = t.orders.select(key.alias("ord"), name("u", key % 5000).alias("url"), name("h", key % 1999).alias("hash"))
    fresh = batch.join(seen.select("url"), "url", "left_anti").join(seen.select("hash"), "hash", "left_anti")
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ord"))
    return fresh.select("ord", first("url").alias("n"), first("hash").alias("m")).where("n = 1 AND m = 1").select("ord")


