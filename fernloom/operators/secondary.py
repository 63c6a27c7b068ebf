"""Operators of the secondary modules: lexical funnel, reports, links, names, registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions import facts, text, urls
from fernloom.operators.domain import ads
from fernloom.operators.setops import first_of
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import ORACLE_SQL, Tables, query

TERMS = ["engineer", "data", "nurse", "analyst"]


def whole_term(column: Column, term: str) -> Column:
    return F.lower(column).rlike(rf"(^|[^a-z0-9]){term}([^a-z0-9]|$)")


def idf_table(rows: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """``(term, idf)`` with ln((n+1)/(df+1))/ln(n+1), all terms counted in one pass."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count_if(whole_term(F.col(column), w)).alias(w) for w in terms])
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(w).alias("term"), F.col(w).alias("df")) for w in terms])).alias("r"))
    return long.select("r.term", (F.log((F.col("n") + 1) / (F.col("r.df") + 1)) / F.log(F.col("n") + 1)).alias("idf"))


_RX = lambda w: f"regexp_matches(lower(title), '(^|[^a-z0-9]){w}([^a-z0-9]|$)')"
_IDF = "idf AS (" + " UNION ALL ".join(f"SELECT '{w}' AS term, ln((count(*) + 1) / (count(*) FILTER ({_RX(w)}) + 1)) / ln(count(*) + 1) AS idf FROM jobs" for w in TERMS) + ")"


@query("x_idf", f"{JOBS}, {_IDF} SELECT term, round(idf, 9) AS idf FROM idf")
def idf(t: Tables) -> DataFrame:
    return idf_table(jobs(t), "title", TERMS).withColumn("idf", F.round("idf", 9))


def lexical(t: Tables) -> DataFrame:
    """Title hits weighted by idf, at most 1, plus a little for recency."""
    base = jobs(t).where("posted_at IS NOT NULL").select("job_id", "title", "posted_at")
    hits = F.array_compact(F.array(*[F.when(whole_term(F.col("title"), w), w) for w in TERMS]))
    weight = base.select("job_id", F.explode(hits).alias("term")).join(idf_table(jobs(t), "title", TERMS), "term").groupBy("job_id").agg(F.sum("idf").alias("w"), F.count("*").alias("hits"))
    age = F.date_diff(F.expr("DATE '2001-08-01'"), F.to_date("posted_at"))
    score = 0.7 * F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0)) / 2) + 0.01 * F.greatest(F.lit(0.0), 1 - age / 180)
    return base.join(weight, "job_id", "left").select("job_id", F.coalesce("hits", F.lit(0)).alias("hits"), score.alias("score"))


_LEX = f"""{JOBS}, {_IDF}, b AS (SELECT * FROM jobs WHERE posted_at IS NOT NULL), h AS (SELECT job_id, sum(idf) AS w, count(*) AS hits FROM b JOIN idf ON regexp_matches(lower(title), '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY job_id),
  lex AS (SELECT b.job_id, coalesce(hits, 0) AS hits, 0.7::DOUBLE * least(1.0::DOUBLE, coalesce(w, 0) / 2) + 0.01::DOUBLE * greatest(0.0::DOUBLE, 1 - date_diff('day', CAST(posted_at AS DATE), DATE '2001-08-01') / 180) AS score FROM b LEFT JOIN h ON b.job_id = h.job_id) """


@query("x_lexical_score", _LEX + "SELECT job_id, round(score, 6) AS score FROM lex")
def lexical_score(t: Tables) -> DataFrame:
    return lexical(t).select("job_id", F.round("score", 6).alias("score"))


@query("x_floor", _LEX + "SELECT job_id FROM lex WHERE hits >= 1")
def floor(t: Tables) -> DataFrame:
    return lexical(t).where("hits >= 1").select("job_id")


@query("x_location_gate", f"{JOBS} SELECT job_id FROM jobs WHERE country IN ('NATION_2', 'NATION_5')")
def location_gate(t: Tables) -> DataFrame:
    """Whole-term match of any wanted place; nothing wanted lets all pass."""
    return jobs(t).where(place_gate(F.col("country"), ["nation_2", "nation_5"])).select("job_id")


def place_gate(location: Column, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [whole_term(location, w) for w in wanted]) if wanted else F.lit(True)


@query("x_funnel", _LEX + "SELECT count(*) AS gated, count(*) FILTER (hits >= 1) AS floored, CASE WHEN count(*) FILTER (hits >= 1 AND score >= 0.3) = 0 THEN count(*) FILTER (hits >= 1) ELSE count(*) FILTER (hits >= 1 AND score >= 0.3) END AS strong FROM lex")
def funnel(t: Tables) -> DataFrame:
    """Stage counts; the score cut is skipped where it would drop everything."""
    strong = F.count_if((F.col("hits") >= 1) & (F.col("score") >= 0.3))
    floored = F.count_if(F.col("hits") >= 1)
    return lexical(t).agg(F.count("*").alias("gated"), floored.alias("floored"), F.when(strong == 0, floored).otherwise(strong).alias("strong"))


@query("x_scale_prerank", "SELECT p_partkey, CAST(least(99, greatest(0, floor((p_size - 10) * 3.5 + 0.5))) AS BIGINT) AS rank FROM part")
def scale_prerank(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.least(F.lit(99), F.greatest(F.lit(0), facts.js_round((F.col("p_size") - 10) * 3.5))).cast("long").alias("rank"))


@query("x_skill_tags", "WITH c AS (SELECT item_id, term, r, len(regexp_extract_all(lower(text), '\\b' || term || '\\b')) AS n FROM benchmark, (VALUES ('the', 0), ('and', 1), ('of', 2), ('in', 3)) v(term, r)) SELECT item_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, r) AS k FROM c WHERE n > 0) WHERE k <= 2")
def skill_tags(t: Tables) -> DataFrame:
    """Whole-term counts, most frequent first, then the given order; two a text."""
    counts = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(i).alias("r"), F.regexp_count(F.lower("text"), F.lit(rf"\b{w}\b")).cast("long").alias("n")) for i, w in enumerate(["the", "and", "of", "in"])])
    c = t.benchmark.select("item_id", F.explode(counts).alias("c")).select("item_id", "c.*").where("n > 0")
    return c.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("n").desc(), "r"))).where("k <= 2").select("item_id", "term", "n")


@query("x_skill_terms", "SELECT term, CAST(min(p_partkey) AS BIGINT) AS ord FROM (SELECT p_partkey, lower(p_name) AS term FROM part) GROUP BY term")
def skill_terms(t: Tables) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))), r"\([^)]*\)", ""))
    return t.part.select(plain.alias("term"), "p_partkey").groupBy("term").agg(F.min("p_partkey").alias("ord"))


@query("x_completeness", "SELECT doc_id, CASE WHEN n < 10 THEN 'title_only' WHEN n < 100 THEN 'partial' ELSE 'full' END AS class FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)")
def completeness(t: Tables) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"\S+"))
    return t.documents.select("doc_id", F.when(n < 10, "title_only").when(n < 100, "partial").otherwise("full").alias("class"))


@query("x_resolve_entity", "SELECT DISTINCT lower(p_brand) AS value, substr(sha256(lower(p_brand)), 1, 16) AS entity_id, FALSE AS known FROM part WHERE lower(p_brand) NOT IN ('brand#1', 'brand#2') UNION ALL SELECT 'brand#1', 'old-1', TRUE UNION ALL SELECT 'brand#2', 'old-2', TRUE")
def resolve_entity(t: Tables) -> DataFrame:
    """New values get a row of their own, known ones keep theirs."""
    old = t.spark.createDataFrame([("brand#1", "old-1", True), ("brand#2", "old-2", True)], "value string, entity_id string, known boolean")
    fresh = t.part.select(F.lower("p_brand").alias("value")).distinct().join(old, "value", "left_anti")
    return fresh.select("value", F.substr(F.sha2("value", 256), F.lit(1), F.lit(16)).alias("entity_id"), F.lit(False).alias("known")).unionByName(old)


@query("x_existing_map", f"{JOBS} SELECT company || '|' || title AS key, min(job_id) AS job_id FROM jobs GROUP BY 1")
def existing_map(t: Tables) -> DataFrame:
    return jobs(t).groupBy(F.concat_ws("|", "company", "title").alias("key")).agg(F.min("job_id").alias("job_id"))


@query("x_find_by_url", f"{JOBS}, u AS (SELECT url, min(job_id) AS id FROM jobs WHERE job_id % 2 = 0 GROUP BY url), p AS (SELECT split_part(url, '?', 1) AS bare, min(job_id) AS id FROM jobs WHERE job_id % 2 = 0 GROUP BY 1) SELECT j.job_id, coalesce(u.id, p.id) AS found FROM jobs j LEFT JOIN u ON u.url = j.url LEFT JOIN p ON p.bare = split_part(j.url, '?', 1) WHERE j.job_id % 2 = 1")
def find_by_url(t: Tables) -> DataFrame:
    """The exact URL first, then the bare one."""
    base = jobs(t).select("job_id", "url", F.substring_index("url", "?", 1).alias("bare"))
    saved = base.where("job_id % 2 = 0")
    exact, loose = saved.groupBy("url").agg(F.min("job_id").alias("u_id")), saved.groupBy("bare").agg(F.min("job_id").alias("p_id"))
    return base.where("job_id % 2 = 1").join(exact, "url", "left").join(loose, "bare", "left").select("job_id", F.coalesce("u_id", "p_id").alias("found"))


@query("x_discovered", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
def discovered(t: Tables) -> DataFrame:
    """Status counts that ignore the status filter."""
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


ORDERS = {"newest": ("o_orderdate", False), "oldest": ("o_orderdate", True), "priority": ("o_orderpriority", True), "price": ("o_totalprice", False), "key": ("o_orderkey", True)}


@query("x_tasks_list", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'P') AND contains(c_name, '00001') ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def tasks_list(t: Tables, mode: str = "price") -> DataFrame:
    column, up = ORDERS[mode]
    found = t.orders.where(F.col("o_orderstatus").isin("O", "P")).join(t.customer.where(F.col("c_name").contains("00001")), F.col("o_custkey") == F.col("c_custkey"))
    return found.orderBy(F.col(column).asc() if up else F.col(column).desc(), "o_orderkey").limit(40).select("o_orderkey")


@query("x_task_counts", "SELECT n_name, count(o_orderkey) AS open_tasks FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY n_name")
def task_counts(t: Tables) -> DataFrame:
    per = t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("open_tasks"))
    return t.nation.join(per, "n_nationkey", "left").select("n_name", F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"))


@query("x_tag_counts", "SELECT p_brand, count(*) AS parts, (SELECT count(*) FROM lineitem JOIN part q ON l_partkey = q.p_partkey WHERE q.p_brand = p.p_brand) AS lines, count(DISTINCT p_type) AS types FROM part p GROUP BY p_brand")
def tag_counts(t: Tables) -> DataFrame:
    a = t.part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_distinct("p_type").alias("types"))
    b = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("lines"))
    return a.join(b, "p_brand", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


@query("x_tag_having", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 45 GROUP BY p_brand HAVING count(*) > 5")
def tag_having(t: Tables) -> DataFrame:
    return t.part.where("p_size > 45").groupBy("p_brand").agg(F.count("*").alias("n")).where("n > 5")


@query("x_company_detail", f"{JOBS} SELECT company_id, count(*) FILTER (status = 'open') AS visible, count(*) FILTER (level = 'senior') AS applied, count(*) FILTER (status = 'closed') AS dismissed FROM jobs GROUP BY company_id")
def company_detail(t: Tables) -> DataFrame:
    c = lambda e: F.count_if(F.expr(e))
    return jobs(t).groupBy("company_id").agg(c("status = 'open'").alias("visible"), c("level = 'senior'").alias("applied"), c("status = 'closed'").alias("dismissed"))


@query("x_watched", "SELECT s_suppkey, s_name FROM supplier WHERE nullif(s_suppkey % 3, 0) IS NOT NULL ORDER BY s_name, s_suppkey")
def watched(t: Tables) -> DataFrame:
    return t.supplier.where("nullif(s_suppkey % 3, 0) IS NOT NULL").orderBy("s_name", "s_suppkey").select("s_suppkey", "s_name")


@query("x_contact_list", "SELECT c_custkey, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def contact_list(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("jobs"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["jobs"])


@query("x_activities_list", "SELECT event_id, event_type, r_name FROM events JOIN region ON user_id % 5 = r_regionkey WHERE value > 50 ORDER BY ts DESC, event_id LIMIT 30")
def activities_list(t: Tables) -> DataFrame:
    return t.events.where("value > 50").join(t.region, F.col("user_id") % 5 == F.col("r_regionkey")).orderBy(F.col("ts").desc(), "event_id").limit(30).select("event_id", "event_type", "r_name")


@query("x_automation_runs", "SELECT event_id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 20")
def automation_runs(t: Tables) -> DataFrame:
    return t.events.where("user_id = 7").orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id")


@query("x_next_run", "SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 9 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 9 HOUR ELSE date_trunc('day', ts) + INTERVAL 33 HOUR END AS next_run FROM events")
def next_run(t: Tables) -> DataFrame:
    at = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz") + F.expr("INTERVAL 9 HOUR")
    return t.events.select("event_id", F.when(at > F.col("ts"), at).otherwise(at + F.expr("INTERVAL 1 DAY")).alias("next_run"))


@query("x_break_minutes", "SELECT event_id, greatest(0, date_diff('minute', ts, TIMESTAMP '2024-01-15')) AS minutes FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)")
def break_minutes(t: Tables) -> DataFrame:
    start = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.greatest(F.lit(0), F.timestamp_diff("MINUTE", start, F.expr("TIMESTAMP '2024-01-15'"))).alias("minutes"))


@query("x_last7", "SELECT CAST(unnest(range(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day")
def last7(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.explode(F.expr("sequence(DATE '2024-01-24', DATE '2024-01-30')")).alias("day"))


@query("x_health_report", f"{JOBS} SELECT ats, board, count(*) AS n, count(*) FILTER (currency IS NULL) * 5 > count(*) AS flagged FROM jobs GROUP BY ROLLUP (ats, board)")
def health_report(t: Tables) -> DataFrame:
    """Boards, systems and the grand total in one rollup."""
    return jobs(t).rollup("ats", "board").agg(F.count("*").alias("n"), (F.count_if(F.col("currency").isNull()) * 5 > F.count("*")).alias("flagged"))


_HOSTX = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1))"


@query("x_discover_boards", f"WITH h AS (SELECT regexp_replace({_HOSTX}, '^[^.]*\\.', '') AS site, page_id % 7 AS source, split_part({_HOSTX}, '.', 1) AS name FROM pages), m AS (SELECT site, name, row_number() OVER (PARTITION BY site ORDER BY count(*) DESC, name) AS r FROM h GROUP BY 1, 2) SELECT h.site, count(*) AS postings, count(DISTINCT source) AS sources, any_value(m.name) AS name FROM h JOIN m ON m.site = h.site AND r = 1 GROUP BY h.site")
def discover_boards(t: Tables) -> DataFrame:
    h = t.pages.select(F.regexp_replace(urls.host(F.col("url")), r"^[^.]*\.", "").alias("site"), (F.col("page_id") % 7).alias("source"), F.substring_index(urls.host(F.col("url")), ".", 1).alias("name"))
    name = h.groupBy("site", "name").agg(F.count("*").alias("n")).groupBy("site").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("name"))
    return h.groupBy("site").agg(F.count("*").alias("postings"), F.count_distinct("source").alias("sources")).join(name, "site")


@query("x_ats_from_url", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' END AS ats, 'b' || CAST(s_suppkey AS STRING) AS board FROM supplier")
def ats_from_url(t: Tables) -> DataFrame:
    site = facts.first_case([(F.col("s_suppkey") % 4 == i, F.lit(h)) for i, h in enumerate(["boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "example.org"])])
    url = F.concat(F.lit("https://"), site, F.lit("/b"), F.col("s_suppkey").cast("string"), F.lit("/jobs/1"))
    return t.supplier.select("s_suppkey", urls.ats_family(url).alias("ats"), F.regexp_extract(urls.path(url), "^/([^/]+)", 1).alias("board"))


@query("x_detect_board", f"SELECT page_id, CASE WHEN starts_with({_HOSTX}, 'spam') OR starts_with({_HOSTX}, 'ads') THEN 'refused' WHEN starts_with({_HOSTX}, 'blog.') THEN 'board' ELSE 'page' END AS kind FROM pages")
def detect_board(t: Tables) -> DataFrame:
    h = urls.host(F.col("url"))
    return t.pages.select("page_id", F.when(h.startswith("spam") | h.startswith("ads"), "refused").when(h.startswith("blog."), "board").otherwise("page").alias("kind"))


@query("x_classify_url", f"SELECT page_id, CASE WHEN ends_with({_HOSTX}, '.example.org') THEN 'crawlable' WHEN ends_with({_HOSTX}, '.example.net') THEN 'recognised' ELSE 'never' END AS class FROM pages")
def classify_url(t: Tables) -> DataFrame:
    """Host suffixes against a small rule table."""
    rules = t.spark.createDataFrame([("example.org", "crawlable"), ("example.net", "recognised")], "suffix string, class string")
    parts = F.split(urls.host(F.col("url")), r"\.")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    return t.pages.select("page_id", tail.alias("suffix")).join(F.broadcast(rules), "suffix", "left").select("page_id", F.coalesce("class", F.lit("never")).alias("class"))  # constant rules


@query("x_forbidden_host", f"SELECT page_id FROM pages WHERE NOT regexp_matches({_HOSTX}, '(^|\\.)(spam-farm|ads-track)\\.')")
def forbidden_host(t: Tables) -> DataFrame:
    return t.pages.where(~urls.host(F.col("url")).rlike(r"(^|\.)(spam-farm|ads-track)\.")).select("page_id")


@query("x_cdx", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def cdx(t: Tables) -> DataFrame:
    """JSON lines to rows; a cut-off line is null."""
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("x_cdx_slugs", "SELECT user_id, min(event_id) AS first_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 GROUP BY user_id")
def cdx_slugs(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.from_json("props", "k long")["k"].alias("k")).where("k % 2 = 0")
    return first_of(rows, ["user_id"], "event_id").select("user_id", F.col("event_id").alias("first_id"))


@query("x_shape_of", "SELECT 'OBJECT<' || string_agg(k || ': BIGINT', ', ' ORDER BY k) || '>' AS shape FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)")
def shape_of(t: Tables) -> DataFrame:
    """Structural signature of a JSON column: the schema all its values fit."""
    return t.events.agg(F.schema_of_variant_agg(F.parse_json("props")).alias("shape"))


@query("x_shape_drift", "SELECT unnest(['$.k:BIGINT', '$.old:STRING']) AS path EXCEPT SELECT '$.' || k || ':BIGINT' FROM (SELECT DISTINCT unnest(json_keys(props)) AS k FROM events)")
def shape_drift(t: Tables) -> DataFrame:
    """Paths of a fixture that no real value has."""
    fixture = t.spark.createDataFrame([("$.k:BIGINT",), ("$.old:STRING",)], "path string")
    real = t.events.select(F.explode(F.json_object_keys("props")).alias("k")).distinct().select(F.concat(F.lit("$."), "k", F.lit(":BIGINT")).alias("path"))
    return fixture.subtract(real)


@query("x_scan_page", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def scan_page(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))


@query("x_remote_scope", "SELECT r_regionkey, CASE r_name WHEN 'EUROPE' THEN ['EU'] WHEN 'ASIA' THEN ['APAC'] WHEN 'AMERICA' THEN ['US', 'CA'] END AS regions FROM region")
def remote_scope(t: Tables) -> DataFrame:
    some = lambda *r: F.array(*[F.lit(v) for v in r])
    said = F.lower(F.concat(F.lit("Remote within "), "r_name"))
    return t.region.select("r_regionkey", F.when(said.contains("europe"), some("EU")).when(said.contains("asia"), some("APAC")).when(said.contains("america"), some("US", "CA")).alias("regions"))


@query("x_scope_us", f"{JOBS} SELECT job_id, list_has_any(remote_regions, ['US', 'WORLDWIDE', 'NA']) AS open_to_us FROM jobs")
def scope_us(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.arrays_overlap("remote_regions", F.array(F.lit("US"), F.lit("WORLDWIDE"), F.lit("NA"))).alias("open_to_us"))


@query("x_salary_field", "SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS low, CAST(p_size * 2000 AS DOUBLE) AS high, 'USD' AS currency FROM part WHERE p_size > 9")
def salary_field(t: Tables) -> DataFrame:
    field = F.concat(F.lit("$"), F.format_number(F.col("p_size") * 1000, 0), F.lit(" - $"), F.format_number(F.col("p_size") * 2000, 0), F.lit(" per year"))
    return t.part.where("p_size > 9").select("p_partkey", facts.parse_pay(field).alias("p")).select("p_partkey", F.col("p.min").alias("low"), F.col("p.max").alias("high"), F.col("p.currency").alias("currency"))


@query("x_credit_line", f"{JOBS} SELECT job_id, array_to_string(list_sort(list_distinct(source_ids)), ' · ') AS credit FROM jobs")
def credit_line(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", F.array_join(F.array_sort(F.array_distinct("source_ids")), " · ").alias("credit"))


@query("x_euro_pay", "SELECT p_partkey, CAST(p_size * 1000 AS DOUBLE) AS low, 'EUR' AS currency FROM part WHERE p_size > 9")
def euro_pay(t: Tables) -> DataFrame:
    field = F.concat(F.lit("€"), (F.col("p_size")).cast("string"), F.lit(".000 - €"), (F.col("p_size") + 5).cast("string"), F.lit(".000 annually"))
    return t.part.where("p_size > 9").select("p_partkey", facts.parse_pay(field).alias("p")).select("p_partkey", F.col("p.min").alias("low"), F.col("p.currency").alias("currency"))


@query("x_country_codes", "SELECT n_nationkey, [upper(substr(n_name, 1, 2))] AS codes FROM nation")
def country_codes(t: Tables) -> DataFrame:
    raw = F.array(F.lower(F.substr("n_name", F.lit(1), F.lit(2))), F.lit(""), F.lit("xyz"), F.lit(None).cast("string"))
    return t.nation.select("n_nationkey", F.filter(F.transform(raw, F.upper), lambda c: F.coalesce(c.rlike("^[A-Z]{2}$"), F.lit(False))).alias("codes"))


@query("x_join_distinct", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ' / ' || p_type END AS joined FROM part")
def join_distinct(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.array_distinct(F.array("p_brand", "p_type", "p_brand")), " / ").alias("joined"))


#: Registry answers in the public JSON shapes, made up.
ENTITY = '{"id":"Q1","claims":{"inception":[{"time":"+1998-09-04","rank":"normal"},{"time":"+1997-01-01","rank":"deprecated"}],"employees":[{"amount":"+120"}]}}'
FILINGS = '{"cik":"320","name":"ACME INC","tickers":["ACM"],"sic":"7372","filings":{"recent":{"form":["10-K","8-K"],"filingDate":["2024-02-01","2023-12-01"]}}}'
REGISTRY = '[{"lei":"L1","name":"ACME INC","country":"US"},{"lei":"L2","name":"ACME GMBH","country":"DE"},{"lei":"L3","name":"ACME INC","country":"CA"}]'


@query("x_wikidata_facts", "SELECT 'Q1' AS id, '1998-09-04' AS founded, 120 AS employees")
def wikidata_facts(t: Tables) -> DataFrame:
    """Dated facts of an entity; deprecated claims are left out."""
    e = F.from_json(F.lit(ENTITY), "id string, claims struct<inception:array<struct<time:string,rank:string>>,employees:array<struct<amount:string>>>")
    kept = F.filter(e["claims"]["inception"], lambda c: c["rank"] != "deprecated")
    return t.spark.range(1).select(e["id"].alias("id"), F.substr(F.get(kept, F.lit(0))["time"], F.lit(2), F.lit(10)).alias("founded"), F.get(e["claims"]["employees"], F.lit(0))["amount"].try_cast("int").alias("employees"))


@query("x_gleif_pick", "SELECT 'L1' AS lei")
def gleif_pick(t: Tables) -> DataFrame:
    """The one record that fits name and country, else none."""
    r = F.from_json(F.lit(REGISTRY), "array<struct<lei:string,name:string,country:string>>")
    fit = F.filter(r, lambda x: (text.company_key(x["name"]) == "acme") & (x["country"] == "US"))
    return t.spark.range(1).select(F.when(F.size(fit) == 1, F.get(fit, F.lit(0))["lei"]).alias("lei"))


@query("x_sec_facts", "SELECT '320' AS cik, 'ACME INC' AS name, ['ACM'] AS tickers, '2024-02-01' AS last_filing")
def sec_facts(t: Tables) -> DataFrame:
    s = F.from_json(F.lit(FILINGS), "cik string, name string, tickers array<string>, sic string, filings struct<recent:struct<form:array<string>,filingDate:array<string>>>")
    return t.spark.range(1).select(s["cik"].alias("cik"), s["name"].alias("name"), s["tickers"].alias("tickers"), F.get(s["filings"]["recent"]["filingDate"], F.lit(0)).alias("last_filing"))


@query("x_alias_index", "SELECT p_brand || p_name AS alias, min(p_type) AS company FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def alias_index(t: Tables) -> DataFrame:
    """Aliases that mean one company; clashing ones are dropped."""
    return t.part.groupBy(F.concat("p_brand", "p_name").alias("alias")).agg(F.count_distinct("p_type").alias("n"), F.min("p_type").alias("company")).where("n = 1").drop("n")


@query("x_alias_family", "SELECT alias, min(k) AS family FROM (SELECT p_brand || p_name AS alias, p_partkey % 3 AS k FROM part) GROUP BY alias HAVING count(DISTINCT k) = 1")
def alias_family(t: Tables) -> DataFrame:
    return t.part.groupBy(F.concat("p_brand", "p_name").alias("alias")).agg(F.count_distinct(F.col("p_partkey") % 3).alias("n"), F.min(F.col("p_partkey") % 3).alias("family")).where("n = 1").drop("n")


@query("x_company_keys", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'customer ' || substr(c_name, 10) END AS primary_key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'customer ' || substr(c_name, 10) || ' abc' END AS raw_key FROM customer")
def company_keys(t: Tables) -> DataFrame:
    """Key without a trailing acronym, and the raw one; placeholders have none."""
    named = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit(" (ABC)"))).otherwise("Self-employed")
    real = ~F.lower(named).isin("self-employed", "freelance", "n/a")
    bare = F.regexp_replace(named, r"\s*\([A-Z]{2,6}\)$", "")
    raw = F.trim(F.regexp_replace(F.lower(named), "[^a-z0-9]+", " "))
    return t.customer.select("c_custkey", F.when(real, text.company_key(bare)).alias("primary_key"), F.when(real, raw).alias("raw_key"))


@query("x_near_name", "SELECT p_name, n.name FROM (SELECT DISTINCT p_name FROM part) p, (VALUES ('red ring'), ('small widget')) n(name) WHERE p_name <> n.name AND (split_part(p_name, ' ', 1) = split_part(n.name, ' ', 1) AND length(split_part(n.name, ' ', 1)) >= 3)")
def near_name(t: Tables) -> DataFrame:
    """Not counted, but the same first word of three letters or more: an equi-join on that word."""
    wanted = t.spark.createDataFrame([("red ring",), ("small widget",)], "name string").withColumn("first", F.substring_index("name", " ", 1)).where(F.length("first") >= 3)
    names = t.part.select("p_name").distinct().withColumn("first", F.substring_index("p_name", " ", 1))
    return names.join(wanted, "first").where("p_name <> name").select("p_name", "name")


@query("x_explain", "SELECT name, n, why FROM (SELECT p_name AS name, count(*) AS n, CASE WHEN p_name = 'red ring' THEN 'same' ELSE 'near' END AS why FROM part WHERE starts_with(p_name, 'red ') GROUP BY 1) ORDER BY why = 'same' DESC, n DESC, name LIMIT 10")
def explain(t: Tables) -> DataFrame:
    named = t.part.where(F.col("p_name").startswith("red ")).groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n"))
    why = named.withColumn("why", F.when(F.col("name") == "red ring", "same").otherwise("near"))
    return why.orderBy((F.col("why") == "same").desc(), F.col("n").desc(), "name").limit(10)


@query("x_places_from_text", ORACLE_SQL["d_parse_location"])
def places_from_text(t: Tables) -> DataFrame:
    """A labelled location line of a text, read as places."""
    labelled = F.concat(F.lit("About us\nLocation: "), F.coalesce("location", F.lit("")), F.lit("\nApply"))
    line = F.regexp_extract(labelled, r"(?im)^[ \t]*locations?[ \t]*:[ \t]*(\S.*)$", 1)
    return ads(t).select("job_id", F.explode(facts.parse_location(line)).alias("p")).select("job_id", "p.*")


@query("x_place_address", "SELECT c_custkey, 'City' || CAST(c_custkey % 9 AS STRING) || ', ' || n_name AS text, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey")
def place_address(t: Tables) -> DataFrame:
    city = F.concat(F.lit("City"), (F.col("c_custkey") % 9).cast("string"))
    out = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select("c_custkey", F.concat_ws(", ", city, F.lit(None).cast("string"), "n_name").alias("text"), F.col("n_name").alias("country"))


@query("x_excludes_us", "SELECT doc_id, regexp_matches(text, '(?i)(not|un)(able)? (available|open) (to|in) (the )?(us|u\\.s\\.|united states)|outside (of )?the (us|united states) only') AS excludes FROM documents")
def excludes_us(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike(r"(?i)(not|un)(able)? (available|open) (to|in) (the )?(us|u\.s\.|united states)|outside (of )?the (us|united states) only").alias("excludes"))


def islands(rows: DataFrame, by: str, start: str, end: str, gap: int) -> DataFrame:
    """``run`` number of mentions that follow each other within ``gap`` characters."""
    w = Window.partitionBy(by).orderBy(start)
    fresh = (F.col(start) - F.lag(end).over(w) > gap) | F.lag(end).over(w).isNull()
    return rows.withColumn("__f", fresh.cast("int")).withColumn("run", F.sum("__f").over(w)).drop("__f")


@query("x_credential_runs", "WITH m AS (SELECT l_orderkey, l_linenumber * 10 + l_partkey % 9 AS s FROM lineitem), f AS (SELECT *, coalesce(s - lag(s + 3) OVER (PARTITION BY l_orderkey ORDER BY s) > 8, TRUE) AS fresh FROM m), r AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY l_orderkey ORDER BY s) AS run FROM f) SELECT l_orderkey, CAST(run AS BIGINT) AS run, count(*) AS mentions FROM r GROUP BY 1, 2")
def credential_runs(t: Tables) -> DataFrame:
    m = t.lineitem.select("l_orderkey", (F.col("l_linenumber") * 10 + F.col("l_partkey") % 9).alias("s")).withColumn("e", F.col("s") + 3)
    return islands(m, "l_orderkey", "s", "e", 8).groupBy("l_orderkey", "run").agg(F.count("*").alias("mentions"))


@query("x_verbatim", "SELECT item_id, CASE WHEN instr(text, substr(text, 3, 10)) > 0 AND item_id % 2 = 0 THEN substr(text, 3, 10) END AS evidence FROM benchmark")
def verbatim(t: Tables) -> DataFrame:
    """Evidence stays only if the text has it word for word."""
    evidence = F.when(F.col("item_id") % 2 == 0, F.substr("text", F.lit(3), F.lit(10))).otherwise(F.concat(F.substr("text", F.lit(3), F.lit(10)), F.lit("#")))
    return t.benchmark.select("item_id", F.when(F.instr(F.col("text"), evidence) > 0, evidence).alias("evidence"))


@query("x_drop_overlaps")
def drop_overlaps(t: Tables) -> DataFrame:
    """Longest mentions first; a fold over the mentions of one text keeps what overlaps none kept."""
    words = F.filter(F.transform(F.split("text", " "), lambda w, i: F.struct((-F.length(w)).alias("m"), (i * 6).alias("s"), (i * 6 + F.length(w)).alias("e"))), lambda m: m["m"] < 0)
    none = F.array().cast("array<struct<m:int,s:int,e:int>>")
    kept = F.aggregate(F.array_sort(words), none, lambda out, m: F.when(F.exists(out, lambda k: (m["s"] < k["e"]) & (k["s"] < m["e"])), out).otherwise(F.concat(out, F.array(m))))
    return t.benchmark.select("item_id", F.explode(kept).alias("k")).select("item_id", F.col("k.s").alias("start"), F.col("k.e").alias("end"))


@query("x_durations", "SELECT doc_id, regexp_extract_all(text, '[0-9]+ (?:years?|months?|weeks?|days?)') AS durations FROM documents")
def durations(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+ (?:years?|months?|weeks?|days?)"), F.lit(0)).alias("durations"))


@query("x_jobs_named", "SELECT item_id, p_type FROM (SELECT item_id, p_type, row_number() OVER (PARTITION BY item_id ORDER BY p_type) AS n FROM (SELECT item_id, text || ' standard promo' AS text FROM benchmark), (SELECT DISTINCT p_type FROM part) WHERE contains(lower(text), lower(p_type))) WHERE n <= 10")
def jobs_named(t: Tables) -> DataFrame:
    """Titles named in a text: its word n-grams join the titles, ten a text."""
    words = F.regexp_extract_all(F.lower(F.concat("text", F.lit(" standard promo"))), F.lit("[a-z]+"), F.lit(0))
    grams = t.benchmark.select("item_id", F.explode(F.array_distinct(words)).alias("key"))
    titles = t.part.select("p_type").distinct().withColumn("key", F.lower("p_type"))
    found = grams.join(titles, "key")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("p_type"))).where("n <= 10").select("item_id", "p_type")


@query("x_backup_scope", "SELECT 'orders' AS model, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def backup_scope(t: Tables) -> DataFrame:
    """What one owner has, along the foreign keys."""
    owner = t.customer.where("c_nationkey = 3")
    own_orders = t.orders.join(owner, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    own_lines = t.lineitem.join(own_orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return own_orders.agg(F.count("*").alias("n")).select(F.lit("orders").alias("model"), "n").unionAll(own_lines.agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("model"), "n"))
