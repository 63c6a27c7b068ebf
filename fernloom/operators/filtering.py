"""Filter operators over postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernloom.functions import filters as f
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query

NOW = "1999-06-01 00:00:00"


def _ids(frame: DataFrame) -> DataFrame:
    return frame.select("job_id")


def _filter(name: str, spec: dict, where: str, include_unknown=()) -> None:
    """A query that applies one compiled filter to open postings, and its SQL."""

    @query(name, f"{JOBS} SELECT job_id FROM jobs WHERE status = 'open' AND ({where})")
    def build(t: Tables) -> DataFrame:
        return _ids(jobs(t).where(f.compile_filter(spec, include_unknown)))


_filter("f_status", {}, "TRUE")
_filter("f_levels", {"levels": ["senior", "manager"]}, "level IN ('senior', 'manager') OR level IS NULL", ["levels"])
_filter("f_work_models", {"work_models": ["remote", "hybrid"]}, "work_model IN ('remote', 'hybrid')")
_filter("f_employment", {"employment_types": ["contract"]}, "employment_type = 'contract' OR employment_type IS NULL", ["employment_types"])
_filter("f_max_years", {"max_years": 5}, "coalesce(years_min, years_max) <= 5")
_filter("f_posted_within", {"posted_within": ("30d", NOW)}, f"posted_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR posted_at IS NULL", ["posted_within"])
_filter("f_min_pay", {"min_pay": 200000}, "(currency = 'USD' AND coalesce(annual_max, annual_min) >= 200000) OR currency IS NULL OR currency <> 'USD'", ["min_pay"])
_filter("f_countries", {"countries": ["NATION_3", "NATION_17"]}, "country IN ('NATION_3', 'NATION_17')")
_filter("f_remote_regions", {"remote_regions": ["US"]}, "work_model = 'remote' AND list_has_any(remote_regions, ['US', 'WORLDWIDE'])")
_filter("f_skills", {"skills": ["skill1", "skill9"]}, "list_has_any(skills, ['skill1', 'skill9'])")
_filter("f_ex_skills", {"exclude_skills": ["skill1"]}, "NOT coalesce(list_has_any(skills, ['skill1']), FALSE)")
_filter("f_sources", {"sources": ["s3"]}, "list_has_any(source_ids, ['s3'])")
_filter("f_companies", {"companies": ["customer 000000001", "customer 000000007"], "exclude_companies": ["customer 000000007"]}, "company_key = 'customer 000000001'")
_filter("f_company_facts", {"industries": ["BUILDING", "MACHINERY"]}, "industry IN ('BUILDING', 'MACHINERY')")
_filter("f_clearance_citizen", {"exclude_clearance": True, "exclude_citizen_only": True}, "NOT coalesce(clearance_required, FALSE) AND NOT coalesce(us_citizen_only, FALSE)")
_filter("f_role_type", {"role_type": "manager"}, r"coalesce(level = 'manager', FALSE) OR regexp_matches(title, '(?i)\b(manager|director|head|chief|vp)\b')")
_filter("f_title_exclude", {"exclude_title": ["data engineer"]}, "title <> 'Senior Data Engineer'")
_filter("f_job_functions", {"job_functions": ["software engineer", "nurse"]}, "title IN ('Junior Software Engineer', 'Registered Nurse II')")
_filter(
    "f_compile",
    {"levels": ["senior", "mid"], "work_models": ["remote"], "min_pay": 100000, "exclude_skills": ["skill3"], "role_type": "ic"},
    r"""(level IN ('senior', 'mid') OR level IS NULL) AND work_model = 'remote' AND currency = 'USD' AND coalesce(annual_max, annual_min) >= 100000
        AND NOT coalesce(list_has_any(skills, ['skill3']), FALSE) AND NOT regexp_matches(title, '(?i)\b(manager|director|head|chief|vp)\b')""",
    ["levels"],
)


@query("f_sql_where", f"""{JOBS} SELECT job_id FROM jobs WHERE status = 'open' AND (currency IS NULL OR (currency = 'USD' AND coalesce(annual_max, annual_min) >= 150000))
  AND NOT contains(lower(title), 'manager') AND coalesce(years_min, years_max) <= 6""")
def live_where(t: Tables) -> DataFrame:
    """The live variant: another currency is not unknown, excluded titles are substrings."""
    pay = F.col("currency").isNull() | ((F.col("currency") == "USD") & (F.coalesce("annual_max", "annual_min") >= 150000))
    return _ids(jobs(t).where(f.status() & pay & ~F.lower("title").contains("manager") & (F.coalesce("years_min", "years_max") <= 6)))


_LIKELY = "SELECT company_key AS ck, count(*) >= 10 AND count_if(status = 'open') >= 3 AS likely FROM jobs GROUP BY company_key"


def likely_companies(postings: DataFrame) -> DataFrame:
    """Companies with a filing history long and recent enough to be likely sponsors."""
    return postings.groupBy(F.col("company_key").alias("ck")).agg(((F.count("*") >= 10) & (F.count_if(F.col("status") == "open") >= 3)).alias("likely"))


@query("f_h1b", f"{JOBS} SELECT job_id FROM jobs JOIN ({_LIKELY}) ON company_key = ck WHERE status = 'open' AND coalesce(sponsorship, '') <> 'no' AND (coalesce(sponsorship, '') = 'yes' OR likely)")
def sponsor_filter(t: Tables) -> DataFrame:
    base = jobs(t)
    return _ids(base.join(likely_companies(base), F.col("company_key") == F.col("ck"), "left").where(f.status() & f.sponsors(F.col("likely"))))


@query("f_h1b_likely_mask", f"""{JOBS} SELECT c_custkey AS company_id, coalesce(CASE WHEN c_acctbal < 0 THEN c_acctbal < -500 END, likely, FALSE) AS likely
  FROM customer LEFT JOIN ({_LIKELY}) ON lower(replace(c_name, '#', ' ')) = ck""")
def likely_mask(t: Tables) -> DataFrame:
    """A company's stored fact first (here: known for negative balances), else its history, else not likely."""
    stored = F.when(F.col("c_acctbal") < 0, F.col("c_acctbal") < -500)
    own = t.customer.join(likely_companies(jobs(t)), F.lower(F.replace("c_name", F.lit("#"), F.lit(" "))) == F.col("ck"), "left")
    return own.select(F.col("c_custkey").alias("company_id"), F.coalesce(stored, "likely", F.lit(False)).alias("likely"))


@query("f_places", f"{JOBS} SELECT job_id FROM jobs WHERE list_has_any([country, area, country || '|' || area], ['NATION_3', 'NATION_4|' || (SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_4')])")
def places_filter(t: Tables) -> DataFrame:
    tags = F.array("country", "area", F.concat_ws("|", "country", "area"))
    home = t.nation.where("n_name = 'NATION_4'").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.array(F.lit("NATION_3"), F.concat_ws("|", "n_name", "r_name")).alias("wanted"))
    return _ids(jobs(t).crossJoin(F.broadcast(home)).where(F.arrays_overlap(tags, "wanted")))  # one row


@query("f_place_match", f"{JOBS} SELECT job_id FROM jobs WHERE country IN ('NATION_1', 'NATION_11') AND area = 'AMERICA'")
def place_match(t: Tables) -> DataFrame:
    """City and region must stand in one segment of the location text."""
    location = F.concat(F.lit("Elsewhere, NOWHERE; "), F.col("country"), F.lit(", "), F.col("area"))
    return _ids(jobs(t).where(F.exists(F.split(location, r"[;|]"), lambda s: s.rlike(r"(^|\W)NATION_1{1,2}(\W|$)") & s.rlike(r"(^|\W)AMERICA(\W|$)"))))


@query("f_states_in", "SELECT n_nationkey, list_sort(list_distinct(list_filter([CASE WHEN n_name = 'NATION_3' THEN 'N3' END, CASE WHEN n_name LIKE '%_1%' THEN 'N1' END, CASE WHEN n_name LIKE '%2' THEN 'X2' END], lambda x: x IS NOT NULL))) AS codes FROM nation")
def states_in(t: Tables) -> DataFrame:
    rules = {"^NATION_3$": "N3", ".1": "N1", "2$": "X2"}
    codes = F.array_compact(F.array(*[F.when(F.col("n_name").rlike(rx), code) for rx, code in rules.items()]))
    return t.nation.select("n_nationkey", F.array_sort(F.array_distinct(codes)).alias("codes"))


@query("f_words_exact_symbols", f"{JOBS} SELECT job_id FROM jobs WHERE instr(lower(title), 'c++') > 0")
def exact_symbols(t: Tables) -> DataFrame:
    return _ids(jobs(t).where(F.instr(F.lower("title"), "c++") > 0))


@query("f_restrict_ids", f"{JOBS} SELECT job_id FROM jobs WHERE job_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def restrict_ids(t: Tables) -> DataFrame:
    wanted = t.lineitem.where("l_quantity >= 50").select(F.col("l_orderkey").alias("job_id"))
    return _ids(jobs(t).join(wanted, "job_id", "left_semi"))


@query("f_hidden_boards", f"{JOBS} SELECT job_id FROM jobs WHERE (ats, board) NOT IN (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END, 'b' || CAST(s_suppkey % 50 AS STRING) FROM supplier WHERE s_acctbal < 0)")
def hidden_boards(t: Tables) -> DataFrame:
    ats = F.when(F.col("s_suppkey") % 3 == 0, "greenhouse").when(F.col("s_suppkey") % 3 == 1, "lever").otherwise("ashby")
    hidden = t.supplier.where("s_acctbal < 0").select(ats.alias("ats"), F.concat(F.lit("b"), (F.col("s_suppkey") % 50).cast("string")).alias("board"))
    return _ids(jobs(t).join(hidden, ["ats", "board"], "left_anti"))


@query("f_feed_remote", f"{JOBS} SELECT job_id, list_has_any(remote_regions, ['US', 'WORLDWIDE', 'NA']) AS open_to_us FROM jobs WHERE work_model = 'remote' AND (remote_regions IS NULL OR list_has_any(remote_regions, ['US', 'WORLDWIDE', 'NA']))")
def feed_remote(t: Tables) -> DataFrame:
    opens = F.arrays_overlap("remote_regions", F.array(F.lit("US"), F.lit("WORLDWIDE"), F.lit("NA")))
    return jobs(t).where((F.col("work_model") == "remote") & (F.col("remote_regions").isNull() | opens)).select("job_id", opens.alias("open_to_us"))


@query("f_pay_meets", f"{JOBS} SELECT job_id, CASE WHEN currency = 'USD' THEN coalesce(annual_max, annual_min) END >= 120000 AS meets FROM jobs")
def pay_meets(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", (f.pay_top() >= 120000).alias("meets"))


@query("f_contacts_list", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00') AND contains(lower(c_name), '7') AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 5")
def contacts_list(t: Tables) -> DataFrame:
    found = t.customer.where(F.lower("c_name").contains("00") & F.lower("c_name").contains("7") & (F.col("c_mktsegment") == "BUILDING"))
    return found.orderBy(F.col("c_acctbal").desc(), "c_custkey").offset(5).limit(25).select("c_custkey", "c_name")


@query("f_jobs_where", f"{JOBS} SELECT job_id FROM jobs WHERE status = 'open' AND (contains(lower(title), 'nurse') OR contains(lower(company), '00012') OR contains(lower(country), 'china'))")
def jobs_where(t: Tables) -> DataFrame:
    any_text = F.lower("title").contains("nurse") | F.lower("company").contains("00012") | F.lower("country").contains("china")
    return _ids(jobs(t).where(f.status() & any_text))


@query("f_board_view", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'failing' WHEN s_nationkey % 5 = 0 THEN 'followed' WHEN s_nationkey % 5 = 1 THEN 'hidden' ELSE 'directory' END AS view FROM supplier WHERE s_acctbal < 0 OR s_nationkey % 5 = 0")
def board_view(t: Tables) -> DataFrame:
    view = F.when(F.col("s_acctbal") < 0, "failing").when(F.col("s_nationkey") % 5 == 0, "followed").when(F.col("s_nationkey") % 5 == 1, "hidden").otherwise("directory")
    return t.supplier.select("s_suppkey", view.alias("view")).where(F.col("view").isin("failing", "followed"))


@query("f_validate_schema", """SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice < 1000 THEN 'price below 1000' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'priority not allowed' END,
  CASE WHEN NOT regexp_matches(o_orderstatus, '^[FO]$') THEN 'status pattern' END) AS error FROM orders""")
def validate_schema(t: Tables) -> DataFrame:
    """Range, enum and pattern checks as one error text; empty where a row is valid."""
    checks = [
        F.when(F.col("o_totalprice") < 1000, "price below 1000"),
        F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "priority not allowed"),
        F.when(~F.col("o_orderstatus").rlike("^[FO]$"), "status pattern"),
    ]
    return t.orders.select("o_orderkey", F.concat_ws(";", *checks).alias("error"))
