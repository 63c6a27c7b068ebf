"""Board and feed payloads to postings.

Each mapper takes a JSON or XML text column and gives one struct of the same shape
(``POSTING``).  A payload that does not parse, or states no id where the source gives one,
gives null, so rejects are a filter away.  A payload is parsed once, whatever is read of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTING = ["external_id", "title", "company", "location", "url", "posted_at", "pay_min", "pay_max", "currency", "text"]


def posting(**known: Column) -> Column:
    """A posting with the facts a source states; the rest is unknown."""
    kinds = {"posted_at": "timestamp", "pay_min": "double", "pay_max": "double"}
    return F.struct(*[known.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in POSTING])


def once(parsed: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of a value that is worked out once: a lambda's argument is a value, not an expression to be repeated."""
    return F.get(F.transform(F.array(parsed), build), F.lit(0))


def _stated(external_id: Column, **known: Column) -> Column:
    """A posting, null without an id."""
    return F.when(external_id.isNotNull(), posting(external_id=external_id, **known))


def _ms(c: Column) -> Column:
    return F.timestamp_millis(c.cast("long"))


def _iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def greenhouse(payload: Column) -> Column:
    def build(j: Column) -> Column:
        pay = F.get(j["pay_input_ranges"], F.lit(0))
        return _stated(external_id=j["id"], title=j["title"], company=j["company_name"], location=j["location"]["name"], url=j["absolute_url"], posted_at=_iso(j["updated_at"]), pay_min=pay["min_cents"] / 100, pay_max=pay["max_cents"] / 100, currency=pay["currency_type"], text=j["content"])

    return once(F.from_json(payload, "id long, title string, company_name string, location struct<name:string>, absolute_url string, updated_at string, content string, pay_input_ranges array<struct<min_cents:long,max_cents:long,currency_type:string>>"), build)


def lever(payload: Column) -> Column:
    def build(j: Column) -> Column:
        body = F.concat_ws("\n", j["descriptionPlain"], F.array_join(F.transform(j["lists"], lambda x: F.concat_ws("\n", x["text"], x["content"])), "\n"))
        return _stated(external_id=j["id"], title=j["text"], location=j["categories"]["location"], url=j["hostedUrl"], posted_at=_ms(j["createdAt"]), pay_min=j["salaryRange"]["min"], pay_max=j["salaryRange"]["max"], currency=j["salaryRange"]["currency"], text=body)

    return once(F.from_json(payload, "id string, text string, categories struct<location:string,team:string>, hostedUrl string, createdAt long, salaryRange struct<min:double,max:double,currency:string>, lists array<struct<text:string,content:string>>, descriptionPlain string"), build)


def ashby(payload: Column) -> Column:
    def build(j: Column) -> Column:
        places = F.array_join(F.concat(F.array(j["location"]), F.coalesce(F.transform(j["secondaryLocations"], lambda x: x["location"]), F.array().cast("array<string>"))), "; ")
        tier = F.get(j["compensation"]["tiers"], F.lit(0))
        return _stated(external_id=j["id"], title=j["title"], location=places, url=j["jobUrl"], posted_at=_iso(j["publishedAt"]), pay_min=tier["min"], pay_max=tier["max"], currency=tier["currency"], text=j["descriptionPlain"])

    return once(F.from_json(payload, "id string, title string, location string, secondaryLocations array<struct<location:string>>, jobUrl string, publishedAt string, compensation struct<tiers:array<struct<min:double,max:double,currency:string>>>, descriptionPlain string"), build)


def workable(payload: Column) -> Column:
    def build(j: Column) -> Column:
        return _stated(external_id=j["shortcode"], title=j["title"], location=F.concat_ws(", ", j["city"], j["country"]), url=j["url"], posted_at=_iso(j["published_on"]), text=j["description"])

    return once(F.from_json(payload, "shortcode string, title string, city string, country string, url string, published_on string, description string"), build)


def recruitee(payload: Column) -> Column:
    def build(j: Column) -> Column:
        return _stated(external_id=j["id"], title=j["title"], company=j["company_name"], location=j["location"], url=j["careers_url"], posted_at=_iso(F.replace(j["published_at"], F.lit(" UTC"), F.lit(""))), pay_min=j["salary"]["min"], pay_max=j["salary"]["max"], currency=j["salary"]["currency"], text=j["description"])

    return once(F.from_json(payload, "id long, title string, company_name string, location string, careers_url string, published_at string, salary struct<min:double,max:double,currency:string>, description string"), build)


def gem(payload: Column) -> Column:
    def build(j: Column) -> Column:
        return _stated(external_id=j["id"], title=j["title"], location=j["location"]["name"], url=j["absolute_url"], posted_at=_iso(j["first_published_at"]), text=j["content_plain"])

    return once(F.from_json(payload, "id string, title string, location struct<name:string>, absolute_url string, first_published_at string, content_plain string"), build)


def personio(payload: Column) -> Column:
    """One XML position; its descriptions are joined."""
    def build(j: Column) -> Column:
        body = F.array_join(F.transform(j["jobDescriptions"]["jobDescription"], lambda d: F.concat_ws("\n", d["name"], d["value"])), "\n")
        return _stated(external_id=j["id"], title=j["name"], location=j["office"], posted_at=_iso(j["createdAt"]), text=body)

    return once(F.from_xml(payload, "id string, name string, office string, createdAt string, jobDescriptions struct<jobDescription:array<struct<name:string,value:string>>>"), build)


def teamtailor(payload: Column) -> Column:
    """One RSS item."""
    def build(j: Column) -> Column:
        return _stated(external_id=j["guid"], title=j["title"], url=j["link"], location=j["location"], posted_at=F.try_to_timestamp(F.substr(j["pubDate"], F.lit(6), F.lit(20)), F.lit("dd MMM yyyy HH:mm:ss")), text=j["description"])

    return once(F.from_xml(payload, "guid string, title string, link string, pubDate string, description string, location string"), build)


def remoteok(payload: Column) -> Column:
    """An array element; the legal notice has no id."""
    def build(j: Column) -> Column:
        return F.when(j["id"].isNotNull(), posting(external_id=j["id"], title=j["position"], company=j["company"], location=j["location"], url=j["url"], posted_at=F.timestamp_seconds(j["epoch"]), pay_min=F.nullif(j["salary_min"], F.lit(0.0)), pay_max=F.nullif(j["salary_max"], F.lit(0.0)), text=j["description"]))

    return once(F.from_json(payload, "id string, position string, company string, location string, url string, epoch long, salary_min double, salary_max double, description string"), build)


def remotive(payload: Column) -> Column:
    def build(j: Column) -> Column:
        return _stated(external_id=j["id"], title=j["title"], company=j["company_name"], location=j["candidate_required_location"], url=j["url"], posted_at=_iso(j["publication_date"]), text=j["description"])

    return once(F.from_json(payload, "id long, title string, company_name string, candidate_required_location string, url string, publication_date string, description string"), build)


def themuse(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """``(page, page_count, p)`` of paged answers; complete when the last page is in."""
    j = F.from_json(F.col(payload), "page int, page_count int, results array<struct<id:long,name:string,company:struct<name:string>,locations:array<struct<name:string>>,publication_date:string,refs:struct<landing_page:string>,contents:string>>")
    rows = pages.select(j.alias("j")).select("j.page", "j.page_count", F.explode("j.results").alias("r"))
    return rows.select("page", "page_count", posting(external_id=F.col("r.id"), title=F.col("r.name"), company=F.col("r.company.name"), location=F.array_join(F.col("r.locations.name"), "; "), url=F.col("r.refs.landing_page"), posted_at=_iso(F.col("r.publication_date")), text=F.col("r.contents")).alias("p"))


def usajobs(pages: DataFrame, now: str, payload: str = "payload") -> DataFrame:
    """Postings of a search answer that have not expired."""
    item = "struct<MatchedObjectId:string,MatchedObjectDescriptor:struct<PositionTitle:string,OrganizationName:string,PositionURI:string,PositionLocationDisplay:string,PublicationStartDate:string,ApplicationCloseDate:string,PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string>>>>"
    j = F.from_json(F.col(payload), f"SearchResult struct<SearchResultItems:array<{item}>>")
    rows = pages.select(F.explode(j["SearchResult"]["SearchResultItems"]).alias("i")).select("i.MatchedObjectId", "i.MatchedObjectDescriptor.*")
    pay = F.get("PositionRemuneration", F.lit(0))
    live = rows.where(_iso(F.col("ApplicationCloseDate")) >= F.to_timestamp(F.lit(now)))
    return live.select(posting(external_id=F.col("MatchedObjectId"), title=F.col("PositionTitle"), company=F.col("OrganizationName"), location=F.col("PositionLocationDisplay"), url=F.col("PositionURI"), posted_at=_iso(F.col("PublicationStartDate")), pay_min=pay["MinimumRange"].try_cast("double"), pay_max=pay["MaximumRange"].try_cast("double"), currency=F.lit("USD")).alias("p"))


def github_json(payload: Column) -> Column:
    """A listing row; hidden and inactive ones are null."""
    def build(j: Column) -> Column:
        return F.when(j["active"] & j["is_visible"], posting(external_id=j["id"], title=j["title"], company=j["company_name"], location=F.array_join(j["locations"], "; "), url=j["url"], posted_at=F.timestamp_seconds(j["date_posted"])))

    return once(F.from_json(payload, "id string, title string, company_name string, locations array<string>, url string, date_posted long, active boolean, is_visible boolean"), build)


def markdown_table(files: DataFrame, text: str = "text") -> DataFrame:
    """Rows of a Markdown table under a Company | Role | Location | Link header."""
    lines = files.select(F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s\-:|]+\|$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.select("pos", cells.alias("c")).where(~F.lower(F.get("c", F.lit(0))).isin("company"))
    link = F.regexp_extract(F.get("c", F.lit(3)), r"\((https?://[^)\s]+)\)", 1)
    return rows.select("pos", posting(company=F.regexp_replace(F.get("c", F.lit(0)), r"\[([^\]]*)\]\([^)]*\)|\*\*", "$1"), title=F.get("c", F.lit(1)), location=F.get("c", F.lit(2)), url=link).alias("p"))


def hn_comment(text: Column) -> Column:
    """Company | Role | Place in the first line of a comment."""
    parts = F.transform(F.split(F.substring_index(text, "\n", 1), r"\|"), lambda x: F.trim(x))
    return F.when(F.size(parts) >= 2, posting(company=F.get(parts, F.lit(0)), title=F.get(parts, F.lit(1)), location=F.get(parts, F.lit(2)), text=text))


def jsonld(payload: Column) -> Column:
    def build(j: Column) -> Column:
        a = j["jobLocation"]["address"]
        return F.when(j["@type"] == "JobPosting", posting(external_id=j["identifier"]["value"], title=j["title"], company=j["hiringOrganization"]["name"], location=F.concat_ws(", ", a["addressLocality"], a["addressRegion"], a["addressCountry"]), url=j["url"], posted_at=_iso(j["datePosted"]), pay_min=j["baseSalary"]["value"]["minValue"], pay_max=j["baseSalary"]["value"]["maxValue"], currency=j["baseSalary"]["currency"], text=j["description"]))

    return once(F.from_json(payload, "`@type` string, title string, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>, url string, datePosted string, baseSalary struct<currency:string,value:struct<minValue:double,maxValue:double>>, description string, identifier struct<value:string>"), build)


def html_jsonld(html: Column) -> Column:
    """JSON-LD blocks of a page."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))


#: Keys that tell a payload's format.
FORMATS = [("absolute_url", "greenhouse"), ("hostedUrl", "lever"), ("jobUrl", "ashby"), ("shortcode", "workable"), ("careers_url", "recruitee"), ("@type", "jsonld")]
MAPPERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable, "recruitee": recruitee, "jsonld": jsonld}


def detect(payload: Column) -> Column:
    """Format of a JSON payload by its keys; null for none known or broken JSON."""
    keys = F.json_object_keys(payload)
    out = F.when(F.lit(False), "")
    for key, name in FORMATS:
        out = out.when(F.array_contains(keys, key), name)
    return out


def any_board(payload: Column) -> Column:
    kind = detect(payload)
    out = F.when(F.lit(False), posting())
    for name, mapper in MAPPERS.items():
        out = out.when(kind == name, mapper(payload))
    return out


def merge_by_id(rows: DataFrame) -> DataFrame:
    """One row per external id with all its locations, first seen first (``ord`` orders the input)."""
    best = rows.groupBy("external_id").agg(F.min_by("title", "ord").alias("title"), F.array_sort(F.collect_list(F.struct("ord", "location"))).alias("l"))
    return best.select("external_id", "title", F.array_join(F.array_distinct(F.transform("l", lambda x: x["location"])), "; ").alias("location"))
