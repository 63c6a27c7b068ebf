"""Scans, sinks and state maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query
from fernloom.scratch import scratch_path
from fernloom.sources import boards as b
from fernloom.sources import files as fs



def _key() -> Column:
    return F.col("o_orderkey")


DAY = "date_format(o_orderdate, \"yyyy-MM-dd'T'00:00:00'Z'\")"


def payloads(t: Tables, **fields: str) -> DataFrame:
    """Orders as JSON payloads; each field is a SQL expression."""
    return t.orders.select(F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])).alias("payload"))


def facts(rows: DataFrame, *names: str) -> DataFrame:
    """The named facts of the postings ``p``; rejects go.  Behind the explode a mapper's work is not repeated per fact."""
    kinds = {"posted_at": "timestamp_ntz"}
    return rows.select(F.explode(F.array_compact(F.array("p"))).alias("p")).select(*[F.col(f"p.{n}").cast(kinds[n]).alias(n) if n in kinds else F.col(f"p.{n}").alias(n) for n in names])


_ID, _TITLE, _URL, _AT = "CAST(o_orderkey AS STRING) AS external_id", "'Job ' || o_orderpriority AS title", "'https://x.org/' || CAST(o_orderkey AS STRING) AS url", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS posted_at"
_U = "concat('https://x.org/', o_orderkey)"
_T = "concat('Job ', o_orderpriority)"


@query("scan_board_greenhouse", f"SELECT {_ID}, {_TITLE}, 'nation ' || CAST(o_custkey % 25 AS STRING) AS location, {_URL}, {_AT}, CAST(o_orderkey % 900 AS DOUBLE) AS pay_min FROM orders")
def scan_greenhouse(t: Tables) -> DataFrame:
    rows = payloads(t, id="o_orderkey", title=_T, location="named_struct('name', concat('nation ', o_custkey % 25))", absolute_url=_U, updated_at=DAY, pay_input_ranges="array(named_struct('min_cents', (o_orderkey % 900) * 100, 'max_cents', 100000, 'currency_type', 'USD'))")
    return facts(rows.select(b.greenhouse(F.col("payload")).alias("p")), "external_id", "title", "location", "url", "posted_at", "pay_min")


@query("scan_board_lever", f"SELECT {_ID}, {_TITLE}, {_AT}, 'body' || chr(10) || 'need' || chr(10) || o_orderstatus AS text FROM orders")
def scan_lever(t: Tables) -> DataFrame:
    rows = payloads(t, id="string(o_orderkey)", text=_T, createdAt="unix_millis(cast(to_date(o_orderdate) as timestamp))", lists="array(named_struct('text', 'need', 'content', o_orderstatus))", descriptionPlain="'body'")
    return facts(rows.select(b.lever(F.col("payload")).alias("p")), "external_id", "title", "posted_at", "text")


@query("scan_board_ashby", f"SELECT {_ID}, {_TITLE}, 'A; ' || o_orderstatus AS location, {_AT}, o_totalprice AS pay_max FROM orders")
def scan_ashby(t: Tables) -> DataFrame:
    rows = payloads(t, id="string(o_orderkey)", title=_T, location="'A'", secondaryLocations="array(named_struct('location', o_orderstatus))", publishedAt=DAY, compensation="named_struct('tiers', array(named_struct('min', 1.0D, 'max', o_totalprice, 'currency', 'USD')))")
    return facts(rows.select(b.ashby(F.col("payload")).alias("p")), "external_id", "title", "location", "posted_at", "pay_max")


@query("scan_board_workable", f"SELECT {_ID}, {_TITLE}, 'City, ' || o_orderstatus AS location, {_URL} FROM orders")
def scan_workable(t: Tables) -> DataFrame:
    rows = payloads(t, shortcode="string(o_orderkey)", title=_T, city="'City'", country="o_orderstatus", url=_U)
    return facts(rows.select(b.workable(F.col("payload")).alias("p")), "external_id", "title", "location", "url")


@query("merge_by_shortcode", "SELECT CAST(o_custkey AS STRING) AS external_id, arg_min('Job ' || o_orderpriority, o_orderkey) AS title, array_to_string(list_transform(list_sort(list_transform(list_distinct(list(o_orderstatus)), lambda s: [CAST(CASE s WHEN 'F' THEN f WHEN 'O' THEN o ELSE p END AS STRING), s])), lambda x: x[2]), '; ') AS location FROM (SELECT *, lpad(CAST(min(o_orderkey) FILTER (o_orderstatus = 'F') OVER w AS STRING), 12, '0') AS f, lpad(CAST(min(o_orderkey) FILTER (o_orderstatus = 'O') OVER w AS STRING), 12, '0') AS o, lpad(CAST(min(o_orderkey) FILTER (o_orderstatus = 'P') OVER w AS STRING), 12, '0') AS p FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY o_custkey, f, o, p")
def merge_by_shortcode(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("external_id"), F.concat(F.lit("Job "), "o_orderpriority").alias("title"), F.col("o_orderstatus").alias("location"), _key().alias("ord"))
    return b.merge_by_id(rows)


@query("scan_board_recruitee", f"SELECT {_ID}, {_TITLE}, 'Co' AS company, {_AT}, o_totalprice AS pay_min FROM orders")
def scan_recruitee(t: Tables) -> DataFrame:
    rows = payloads(t, id="o_orderkey", title=_T, company_name="'Co'", published_at="concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 00:00:00 UTC')", salary="named_struct('min', o_totalprice, 'max', 2.0D, 'currency', 'EUR')")
    return facts(rows.select(b.recruitee(F.col("payload")).alias("p")), "external_id", "title", "company", "posted_at", "pay_min")


@query("scan_board_personio", f"SELECT {_ID}, {_TITLE}, o_orderstatus AS location, 'Tasks' || chr(10) || 'Do <b>it</b>' AS text FROM orders")
def scan_personio(t: Tables) -> DataFrame:
    xml = F.format_string("<position><id>%s</id><name>%s</name><office>%s</office><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[Do <b>it</b>]]></value></jobDescription></jobDescriptions></position>", _key(), F.expr(_T), F.col("o_orderstatus"))
    return facts(t.orders.select(b.personio(xml).alias("p")), "external_id", "title", "location", "text")


@query("scan_board_teamtailor", f"SELECT {_ID}, {_TITLE}, {_URL}, {_AT} FROM orders")
def scan_teamtailor(t: Tables) -> DataFrame:
    xml = F.format_string("<item><guid>%s</guid><title>%s</title><link>%s</link><pubDate>%s</pubDate></item>", _key(), F.expr(_T), F.expr(_U), F.date_format("o_orderdate", "EEE, dd MMM yyyy '00:00:00 +0000'"))
    return facts(t.orders.select(b.teamtailor(xml).alias("p")), "external_id", "title", "url", "posted_at")


@query("scan_board_gem", f"SELECT {_ID}, {_TITLE}, o_orderstatus AS location, {_URL} FROM orders")
def scan_gem(t: Tables) -> DataFrame:
    rows = payloads(t, id="string(o_orderkey)", title=_T, location="named_struct('name', o_orderstatus)", absolute_url=_U)
    return facts(rows.select(b.gem(F.col("payload")).alias("p")), "external_id", "title", "location", "url")


@query("scan_xml_parse", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status FROM orders")
def scan_xml(t: Tables) -> DataFrame:
    """Broken XML gives unknown facts, not a failed job."""
    xml = F.when(_key() % 10 != 0, F.concat(F.lit("<o><s>"), "o_orderstatus", F.lit("</s></o>"))).otherwise("<o><s>")
    return t.orders.select(_key().alias("id"), F.from_xml(xml, "s string", {"mode": "PERMISSIVE"})["s"].alias("status"))


@query("scan_feed_remoteok", f"SELECT {_ID}, {_TITLE}, {_AT} FROM orders WHERE o_orderkey % 7 <> 0")
def scan_remoteok(t: Tables) -> DataFrame:
    rows = payloads(t, id="CASE WHEN o_orderkey % 7 <> 0 THEN string(o_orderkey) END", position=_T, epoch="unix_seconds(cast(to_date(o_orderdate) as timestamp))", legal="'notice'")
    return facts(rows.select(b.remoteok(F.col("payload")).alias("p")), "external_id", "title", "posted_at")


@query("scan_feed_themuse", f"SELECT {_ID}, {_TITLE}, o_orderstatus AS location FROM orders")
def scan_themuse(t: Tables) -> DataFrame:
    result = F.struct(_key().alias("id"), F.expr(_T).alias("name"), F.array(F.struct(F.col("o_orderstatus").alias("name"))).alias("locations"))
    pages = t.orders.groupBy(F.floor(_key() / 20).alias("page")).agg(F.collect_list(result).alias("results"))  # twenty a page
    answers = pages.select(F.to_json(F.struct(F.col("page").cast("int").alias("page"), F.lit(1).alias("page_count"), "results")).alias("payload"))
    return facts(b.themuse(answers), "external_id", "title", "location")


@query("scan_feed_hn_pick", "SELECT arg_max(event_id, ts) AS thread FROM events WHERE event_type = (SELECT max(event_type) FROM events)")
def scan_hn_pick(t: Tables) -> DataFrame:
    """The newest thread whose title fits."""
    kind = t.events.agg(F.max("event_type").alias("k"))
    return t.events.crossJoin(kind).where("event_type = k").agg(F.max_by("event_id", "ts").alias("thread"))  # one row


@query("scan_feed_hn_comment", "SELECT 'Co ' || o_orderstatus AS company, 'Job ' || o_orderpriority AS title, 'Place' AS location FROM orders WHERE o_orderkey % 3 <> 0")
def scan_hn_comment(t: Tables) -> DataFrame:
    body = F.when(_key() % 3 != 0, F.concat(F.lit("Co "), "o_orderstatus", F.lit(" | Job "), "o_orderpriority", F.lit(" | Place\nmore"))).otherwise("just a remark")
    return facts(t.orders.select(b.hn_comment(body).alias("p")), "company", "title", "location")


@query("scan_feed_github_json", f"SELECT {_ID}, {_TITLE}, 'A; B' AS location, {_AT} FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 <> 0")
def scan_github_json(t: Tables) -> DataFrame:
    rows = payloads(t, id="string(o_orderkey)", title=_T, locations="array('A', 'B')", date_posted="unix_seconds(cast(to_date(o_orderdate) as timestamp))", active="o_orderstatus = 'O'", is_visible="o_orderkey % 5 <> 0")
    return facts(rows.select(b.github_json(F.col("payload")).alias("p")), "external_id", "title", "location", "posted_at")


@query("scan_feed_github_md", f"SELECT 'Co ' || CAST(o_orderkey AS STRING) AS company, {_TITLE}, {_URL} FROM orders")
def scan_github_md(t: Tables) -> DataFrame:
    line = F.format_string("| **Co %s** | %s | X | [apply](%s) |", _key(), F.expr(_T), F.expr(_U))
    tables = t.orders.groupBy(F.floor(_key() / 50).alias("n")).agg(F.concat(F.lit("# Jobs\n| Company | Role | Location | Link |\n| --- | --- | --- | --- |\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))  # fifty a file
    return facts(b.markdown_table(tables), "company", "title", "url")


@query("scan_feed_remotive", f"SELECT {_ID}, {_TITLE}, 'Worldwide' AS location, {_AT} FROM orders")
def scan_remotive(t: Tables) -> DataFrame:
    rows = payloads(t, id="o_orderkey", title=_T, candidate_required_location="'Worldwide'", publication_date="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")")
    return facts(rows.select(b.remotive(F.col("payload")).alias("p")), "external_id", "title", "location", "posted_at")


@query("scan_feed_usajobs", f"SELECT {_ID}, {_TITLE}, CAST(o_orderkey % 100 AS DOUBLE) AS pay_min FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def scan_usajobs(t: Tables) -> DataFrame:
    """Expired rows are left out by their closing date."""
    body = F.struct(F.expr(_T).alias("PositionTitle"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ApplicationCloseDate"), F.array(F.struct((_key() % 100).cast("string").alias("MinimumRange"))).alias("PositionRemuneration"))
    items = t.orders.select(F.floor(_key() / 25).alias("page"), F.struct(_key().cast("string").alias("MatchedObjectId"), body.alias("MatchedObjectDescriptor")).alias("i")).groupBy("page").agg(F.collect_list("i").alias("SearchResultItems"))  # 25 a page
    pages = items.select(F.to_json(F.struct(F.struct("SearchResultItems").alias("SearchResult"))).alias("payload"))
    return facts(b.usajobs(pages, "1999-01-01"), "external_id", "title", "pay_min")


def mixed(t: Tables) -> DataFrame:
    """Payloads of several formats, some broken."""
    key = F.when(_key() % 5 == 0, "absolute_url").when(_key() % 5 == 1, "hostedUrl").when(_key() % 5 == 2, "jobUrl").when(_key() % 5 == 3, "other")
    good = F.concat(F.lit('{"id":'), _key().cast("string"), F.lit(',"title":"T","text":"T","'), key, F.lit('":"u"}'))
    return t.orders.select(_key().alias("o_orderkey"), F.when(key.isNotNull(), good).otherwise("{broken").alias("payload"))


@query("scan_board_format_detect", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' END AS format FROM orders")
def scan_detect(t: Tables) -> DataFrame:
    return mixed(t).select("o_orderkey", b.detect(F.col("payload")).alias("format"))


@query("scan_postings_from_board", "SELECT CAST(o_orderkey AS STRING) AS external_id, 'T' AS title, 'u' AS url FROM orders WHERE o_orderkey % 5 < 3")
def scan_any_board(t: Tables) -> DataFrame:
    return facts(mixed(t).select(b.any_board(F.col("payload")).alias("p")), "external_id", "title", "url")


_LD = "to_json(struct('JobPosting' AS `@type`, concat('Job ', o_orderpriority) AS title, named_struct('name', 'Co') AS hiringOrganization, named_struct('address', named_struct('addressLocality', 'City', 'addressCountry', 'US')) AS jobLocation, named_struct('value', string(o_orderkey)) AS identifier))"


@query("scan_jsonld", f"SELECT {_ID}, {_TITLE}, 'Co' AS company, 'City, US' AS location FROM orders")
def scan_jsonld(t: Tables) -> DataFrame:
    return facts(t.orders.select(b.jsonld(F.expr(_LD)).alias("p")), "external_id", "title", "company", "location")


@query("scan_html_jsonld", f"SELECT {_ID}, {_TITLE} FROM orders")
def scan_html_jsonld(t: Tables) -> DataFrame:
    html = F.concat(F.lit('<html><script>x()</script><script type="application/ld+json">'), F.expr(_LD), F.lit('</script><p>y</p></html>'))
    blocks = t.orders.select(F.explode(b.html_jsonld(html)).alias("block"))
    return facts(blocks.select(b.jsonld(F.col("block")).alias("p")), "external_id", "title")


CSV_TEXT = '﻿Notes:\n"Some preamble"\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nAda,"Lo, Jr",https://x.org/a,,Acme,Engineer,01 Feb 2020\n,Nobody,,,,,\nAda,"Lo, Jr",https://x.org/a,,Acme,Engineer,01 Feb 2020\nBo,"Broken,,,Acme,,\n'


@query("scan_csv_connections", """SELECT 'f.csv' AS path, pos, "first", "last", url, NULL::STRING AS email, company, "position", connected, error FROM (VALUES
  (4, 'Ada', 'Lo, Jr', 'https://x.org/a', 'Acme', 'Engineer', '01 Feb 2020', NULL), (5, NULL, 'Nobody', NULL, NULL, NULL, NULL, 'no name'), (7, 'Bo', 'Broken,,,Acme,,', NULL, NULL, NULL, NULL, 'unbalanced quotes')) v(pos, "first", "last", url, company, "position", connected, error)""")
def scan_csv(t: Tables) -> DataFrame:
    return fs.contacts(t.spark.createDataFrame([("f.csv", CSV_TEXT)], "path string, text string")).drop("line")


@query("scan_csv_decode", "SELECT * FROM (VALUES (1, 'é,x'), (2, 'é,x'), (3, 'é,x')) v(id, text)")
def scan_csv_decode(t: Tables) -> DataFrame:
    rows = [(1, bytearray("é,x".encode())), (2, bytearray("é,x".encode("utf-16"))), (3, bytearray("é,x".encode("latin-1")))]
    return t.spark.createDataFrame(rows, "id int, content binary").select("id", fs.decode_bytes(F.col("content")).alias("text"))


@query("scan_gz_lines", "SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer")
def scan_gz(t: Tables) -> DataFrame:
    """gzip lines written and read again."""
    path = scratch_path(t.spark, "gz")
    t.customer.select(F.to_json(F.struct("c_custkey")).alias("value")).write.option("compression", "gzip").text(path)
    return t.spark.read.text(path).select(F.from_json("value", "c_custkey long").alias("r")).agg(F.count("*").alias("n"), F.sum("r.c_custkey").alias("total"))


@query("scan_ndjson_import", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' ELSE 'kept' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def scan_ndjson(t: Tables) -> DataFrame:
    """Lines that are broken or lack a required field are rejected, each on its own."""
    line = F.when(_key() % 10 == 0, F.when(_key() % 20 == 0, "{oops").otherwise('{"company":"x"}')).otherwise(F.concat(F.lit('{"title":"'), "o_orderpriority", F.lit('"}')))
    parsed = t.orders.select(F.from_json(line, "title string, company string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r.title").isNull()
    return parsed.select(F.when(bad, "rejected").otherwise("kept").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def one_of(column: Column, allowed: list[str]) -> Column:
    """The value if it is an allowed one, else unknown."""
    return F.when(column.isin(allowed), column)


@query("scan_lenient_normalize", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS level, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS pay, CASE WHEN o_orderkey % 50 = 0 THEN 'no title' END AS error FROM orders")
def scan_lenient(t: Tables) -> DataFrame:
    raw = t.orders.select("o_orderkey", "o_orderpriority", F.when(_key() % 3 == 0, "a lot").otherwise(_key().cast("string")).alias("pay"), F.when(_key() % 50 == 0, "  ").otherwise("T").alias("title"))
    return raw.select("o_orderkey", one_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("level"), F.col("pay").try_cast("double").alias("pay"), F.when(F.trim("title") == "", "no title").alias("error"))


@query("scan_synthetic")
def scan_synthetic(t: Tables) -> DataFrame:
    """Seeded postings; every fact is unknown for some."""
    pick = lambda seed, *xs: F.element_at(F.array(*[F.lit(v) for v in xs]), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(xs))) + 1).cast("int"))
    return t.spark.range(1000).select("id", pick(1, "Engineer", "Nurse", "Analyst").alias("title"), pick(2, "remote", "hybrid", None).alias("work_model"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(150000)) + 30000).alias("pay"))


# Sinks


def upsert(store: DataFrame, batch: DataFrame, key: str, newer: str) -> DataFrame:
    """Store rows with the batch's over them where they are as new; counters by outcome in ``outcome``."""
    fields = [c for c in store.columns if c != key]
    new = batch.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = store.withColumn("__old", F.lit(True)).join(new.withColumn("__new", F.lit(True)), key, "full_outer")
    wins = F.col("__new").isNotNull() & (F.col("__old").isNull() | (F.col(f"n_{newer}") >= F.col(newer)))
    outcome = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull() | ~wins, "kept").otherwise("updated")
    return both.select(key, *[F.when(wins, F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c) for c in fields], outcome.alias("outcome"))


@query("sink_upsert_store", "SELECT outcome, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'inserted' WHEN b.k IS NULL OR b.v < a.v THEN 'kept' ELSE 'updated' END AS outcome, CASE WHEN a.k IS NULL OR b.v >= a.v THEN coalesce(b.price, a.price) ELSE a.price END AS price FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS v, 1 AS price FROM orders WHERE o_orderkey % 3 <> 0) a FULL OUTER JOIN (SELECT o_orderkey AS k, o_orderkey % 4 AS v, CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS price FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k) GROUP BY outcome")
def sink_upsert(t: Tables) -> DataFrame:
    store = t.orders.where("o_orderkey % 3 <> 0").select(_key().alias("k"), (_key() % 5).alias("v"), F.lit(1).alias("price"))
    batch = t.orders.where("o_orderkey % 2 = 0").select(_key().alias("k"), (_key() % 4).alias("v"), F.when(_key() % 2 == 0, 2).alias("price"))
    return upsert(store, batch, "k", "v").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("sink_upsert_crawler", "SELECT b.o_orderkey AS job_id, CASE WHEN a.o_orderkey IS NULL THEN 'new' WHEN a.o_orderstatus = b.o_orderstatus AND a.o_orderkey % 4 <> 0 THEN 'unchanged' ELSE 'changed' END AS outcome FROM orders b LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) a ON a.o_orderkey = b.o_orderkey")
def sink_upsert_crawler(t: Tables) -> DataFrame:
    """Equal content hash and open: only seen again."""
    saved = t.orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(_key() % 4 != 0, F.col("o_orderstatus")).alias("hash"), F.lit(True).alias("known"))
    outcome = F.when(F.col("known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("o_orderstatus")), "unchanged").otherwise("changed")
    return t.orders.join(saved, "o_orderkey", "left").select(_key().alias("job_id"), outcome.alias("outcome"))


@query("sink_chunked_write", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sink_chunked(t: Tables) -> DataFrame:
    """Bulk writes in files of at most 2,000 rows; tasks commit on their own."""
    path = scratch_path(t.spark, "chunks")
    t.orders.select("o_orderkey", "o_orderstatus").write.option("maxRecordsPerFile", 2000).parquet(path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("sink_credit_sources", "SELECT l_orderkey, l_suppkey % 5 AS source, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS last_line FROM lineitem GROUP BY 1, 2")
def sink_credit(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", (F.col("l_suppkey") % 5).alias("source")).agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"), F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("last_line"))


@query("sink_feed_apply", "WITH s AS (SELECT o_orderkey AS k, o_orderstatus = 'O' AS open FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0) SELECT coalesce(s.k, f.k) AS k, CASE WHEN s.k IS NULL THEN 'new' WHEN f.k IS NOT NULL AND NOT open THEN 'reopened' WHEN f.k IS NOT NULL THEN 'seen' WHEN open THEN 'closed' ELSE 'still_closed' END AS outcome FROM s FULL OUTER JOIN f ON s.k = f.k")
def sink_feed(t: Tables) -> DataFrame:
    """One complete answer of a feed against the store."""
    s = t.orders.where("o_orderkey % 3 <> 0").select(_key().alias("k"), (F.col("o_orderstatus") == "O").alias("open"))
    f = t.orders.where("o_orderkey % 2 = 0").select(_key().alias("k"), F.lit(True).alias("listed"))
    outcome = F.when(F.col("open").isNull(), "new").when(F.col("listed") & ~F.col("open"), "reopened").when(F.col("listed"), "seen").when(F.col("open"), "closed").otherwise("still_closed")
    return s.join(f, "k", "full_outer").select("k", outcome.alias("outcome"))


def exported(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines."""
    return rows.select(F.to_json(F.struct("*")).alias("line"))


@query("sink_export_saved", "SELECT '{\"c_custkey\":' || CAST(c_custkey AS STRING) || ',\"c_name\":\"' || c_name || '\"}' AS line FROM customer WHERE c_acctbal > 9000")
def sink_export_saved(t: Tables) -> DataFrame:
    return exported(t.customer.where("c_acctbal > 9000").select("c_custkey", "c_name"))


@query("sink_export_feed", f"{JOBS} SELECT '{{\"job_id\":' || CAST(job_id AS STRING) || ',\"credit\":\"' || array_to_string(source_ids, ', ') || '\"}}' AS line FROM jobs WHERE status = 'open'")
def sink_export_feed(t: Tables) -> DataFrame:
    return exported(jobs(t).where("status = 'open'").select("job_id", F.array_join("source_ids", ", ").alias("credit")))


@query("sink_export_boards", "SELECT '{\"s_suppkey\":' || CAST(s_suppkey AS STRING) || ',\"s_name\":\"' || s_name || '\"}' AS line FROM supplier ORDER BY s_suppkey")
def sink_export_boards(t: Tables) -> DataFrame:
    return exported(t.supplier.orderBy("s_suppkey").select("s_suppkey", "s_name"))


@query("sink_export_all", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation")
def sink_export_all(t: Tables) -> DataFrame:
    """A folder with one JSON export a table, counted as read back."""
    root, out = scratch_path(t.spark, "export"), None
    for name, schema in (("customer", "c_custkey long"), ("supplier", "s_suppkey long"), ("nation", "n_nationkey int")):
        getattr(t, name).write.json(f"{root}/{name}")
        n = t.spark.read.schema(schema).json(f"{root}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("sink_dataset_build", "SELECT count(*) AS n, max(p_partkey) AS last FROM part")
def sink_dataset(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "dataset")
    t.part.write.option("compression", "gzip").json(path)
    return t.spark.read.schema("p_partkey long").json(path).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


@query("sink_close_board", "SELECT o_orderkey, CASE WHEN o_custkey % 50 = 7 AND o_orderstatus = 'O' THEN 'board_empty' END AS closed_reason FROM orders")
def sink_close_board(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when((F.col("o_custkey") % 50 == 7) & (F.col("o_orderstatus") == "O"), "board_empty").alias("closed_reason"))


@query("sink_purge_untracked", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def sink_purge(t: Tables) -> DataFrame:
    """Closed rows that nobody tracks go."""
    tracked = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    closed = t.orders.where("o_orderstatus = 'F'").join(tracked, "o_custkey", "left_semi").select("o_orderkey")
    return t.orders.where("o_orderstatus <> 'F'").select("o_orderkey").unionAll(closed)


@query("sink_release_dups", "SELECT a.o_orderkey, CASE WHEN b.o_orderstatus = 'F' THEN NULL ELSE b.o_orderkey END AS duplicate_of FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 1 AND a.o_orderkey % 10 = 0")
def sink_release(t: Tables) -> DataFrame:
    """A duplicate is its own posting again when its canonical row closes."""
    a = t.orders.select("o_orderkey", F.when(_key() % 10 == 0, _key() - 1).alias("d"))
    live = t.orders.where("o_orderstatus <> 'F'").select(_key().alias("d"), _key().alias("duplicate_of"))
    return a.join(live, "d", "left").select("o_orderkey", "duplicate_of")


@query("sink_company_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.industry, a.industry) AS industry, coalesce(a.size, b.size) AS size FROM (SELECT c_custkey AS k, c_mktsegment AS industry, c_nationkey AS size FROM customer WHERE c_custkey % 2 = 0) a FULL OUTER JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' END AS industry, NULL::INT AS size FROM customer WHERE c_custkey % 5 = 0) b ON a.k = b.k")
def sink_company(t: Tables) -> DataFrame:
    """A fact that the patch lacks keeps its old value."""
    a = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("i0"), F.col("c_nationkey").alias("s0"))
    p = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "NEW").alias("i1"), F.lit(None).cast("int").alias("s1"))
    return a.join(p, "k", "full_outer").select("k", F.coalesce("i1", "i0").alias("industry"), F.coalesce("s1", "s0").alias("size"))


@query("sink_codec", "SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def sink_codec(t: Tables) -> DataFrame:
    """zstd Parquet does what the row codec does."""
    path = scratch_path(t.spark, "zstd")
    t.documents.select("doc_id", "text").write.option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sink_vacuum", "SELECT count(*) AS n FROM orders")
def sink_vacuum(t: Tables) -> DataFrame:
    """Compaction: rewritten in files of the advisory partition size, many or few as the bytes ask."""
    path = scratch_path(t.spark, "compact")
    t.orders.hint("rebalance").write.parquet(path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


def small_sheet(rows: list[list[str]]) -> bytes:
    """A spreadsheet with inline strings, for readers to be tried on."""
    import io
    import zipfile

    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{fs.NS[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


@query("scan_xlsx_rows", "SELECT 'f.xlsx' AS path, row_no::BIGINT AS row, cells FROM (VALUES (1, ['EMPLOYER', 'CITY']), (2, ['Acme', 'Bonn']), (3, ['Bolt', 'Rome'])) v(row_no, cells)")
def scan_xlsx(t: Tables) -> DataFrame:
    data = small_sheet([["EMPLOYER", "CITY"], ["Acme", "Bonn"], ["Bolt", "Rome"]])
    return fs.binary_rows(t.spark.createDataFrame([("f.xlsx", bytearray(data))], "path string, content binary"), fs.xlsx_rows)


@query("scan_dbf", "SELECT 'f.dbf' AS path, row_no::BIGINT AS row, cells FROM (VALUES (0, ['Ada', 'US']), (2, ['Cy', 'FR'])) v(row_no, cells)")
def scan_dbf(t: Tables) -> DataFrame:
    """A deleted record is left out."""
    import struct

    head = b"".join(n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, w in ((b"N", 5), (b"C", 3)))
    data = struct.pack("<BBBBIHH", 3, 24, 1, 1, 3, 32 + len(head) + 1, 9).ljust(32, b"\0") + head + b"\r" + b" Ada  US *Bo   DE  Cy   FR "
    return fs.binary_rows(t.spark.createDataFrame([("f.dbf", bytearray(data))], "path string, content binary"), fs.dbf_rows)


@query("scan_docx_lines", "SELECT 'f.docx' AS path, row_no::BIGINT AS row, cells FROM (VALUES (0, ['Ada Lo']), (1, ['Engineer'])) v(row_no, cells)")
def scan_docx(t: Tables) -> DataFrame:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{fs.WORD[1:-1]}"><w:p><w:r><w:t>Ada</w:t></w:r><w:r><w:t> Lo</w:t></w:r></w:p><w:p><w:r><w:t>Engineer</w:t></w:r></w:p></w:document>')
    return fs.binary_rows(t.spark.createDataFrame([("f.docx", bytearray(out.getvalue()))], "path string, content binary"), fs.docx_lines)
