"""Text, URL and language operators."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions import ranking, text, urls
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query


def _steps(expr: str, *steps: tuple[str, str]) -> str:
    """The oracle's nested replacements."""
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


@query("t_normalize", "SELECT doc_id, trim(" + _steps("text", ("[  -  　]", " "), ("[​﻿]", ""), ("[‐-―]", "-"), ("[‘’]", chr(39) * 2), ("[“”]", '"'), ("[ \\t]+", " ")) + ", ' ') AS text FROM documents")
def normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize(F.col("text")).alias("text"))


def _pairs(expr: str) -> str:
    for k, v in text.PAIRS.items():
        expr = f"replace({expr}, '{k}', '{v}')"
    return expr


def _fold(expr: str) -> str:
    return _pairs(f"translate({expr}, '{text.MARKED}', '{text.PLAIN}')")


@query("t_fold_accents", f"SELECT doc_id, {_fold('text')} AS text FROM documents")
def fold_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.fold_accents(F.col("text")).alias("text"))


@query("t_key_of", f"SELECT doc_id, trim(regexp_replace(replace(lower({_fold('text')}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def key_of(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.dictionary_key(F.col("text")).alias("key"))


@query("t_fold_place", f"SELECT doc_id, trim(regexp_replace(lower({_fold('text')}), '[^a-z0-9]+', ' ', 'g')) AS place FROM documents")
def fold_place(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.place_key(F.col("text")).alias("place"))


_SYMBOLS = [(r"c\+\+", "cplusplus"), (r"c#", "csharp"), (r"(^|[^a-z0-9])\.net", r"\1dotnet"), (r"([a-z]+)\.js", r"\1js"), (r"401\(k\)", "401k"), (r"r&d", "randd")]
_SPECIAL = _steps("lower(title)", *_SYMBOLS)


def _token_sql(expr: str) -> str:
    """The oracle's tokens of a text."""
    return f"regexp_extract_all({_fold(_steps(f'lower({expr})', *_SYMBOLS))}, '[a-z0-9]+')"


_QUERY_STOP = "[" + ", ".join(f"'{w}'" for w in text.QUERY_STOP_WORDS) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query("t_rewrite_special", f"{JOBS} SELECT job_id, {_SPECIAL} AS title FROM jobs")
def rewrite_special(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", text.special_tokens(F.col("title")).alias("title"))


@query("t_tokens", f"{JOBS} SELECT job_id, regexp_extract_all({_SPECIAL}, '[a-z0-9]+') AS tokens FROM jobs")
def tokens(t: Tables) -> DataFrame:
    return jobs(t).select("job_id", text.tokens(F.col("title")).alias("tokens"))


@query("t_parse_query", f"""WITH w AS (SELECT item_id, {_token_sql('substr(text, 1, 500)')} AS w FROM benchmark), d AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS f FROM w),
  r AS (SELECT item_id, f, list_filter(f, lambda x: NOT list_contains({_QUERY_STOP}, x)) AS rest FROM d) SELECT item_id, (CASE WHEN len(rest) > 0 THEN rest ELSE f END)[1:12] AS terms FROM r""")
def parse_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.query_terms(F.col("text")).alias("terms"))


@query("t_match_words", "SELECT doc_id, len(list_intersect(w, ['that', 'shall', 'with'])) AS hits FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE list_has_all(w, ['that', 'with'])")
def match_words(t: Tables) -> DataFrame:
    """All terms must stand in the text; hits counts those of a wider list."""
    w = t.documents.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    wanted = F.array(F.lit("that"), F.lit("shall"), F.lit("with"))
    return w.where(F.array_contains("w", "that") & F.array_contains("w", "with")).select("doc_id", F.size(F.array_intersect("w", wanted)).cast("long").alias("hits"))


@query("t_fts_query_server", """WITH p AS (SELECT item_id, regexp_extract_all('"' || substr(text, 1, 20) || '" c++ ' || substr(text, 30, 40), '"[^"]+"|[^\\s"]+')[1:20] AS match FROM benchmark)
  SELECT item_id, match, list_filter(match, lambda x: regexp_matches(x, '[+#.()]')) AS exact FROM p""")
def fts_query(t: Tables) -> DataFrame:
    """Quoted phrases stay whole, symbol words are kept exactly, at most 20 tokens."""
    asked = F.concat(F.lit('"'), F.substr("text", F.lit(1), F.lit(20)), F.lit('" c++ '), F.substr("text", F.lit(30), F.lit(40)))
    parts = F.slice(F.regexp_extract_all(asked, F.lit(r'"[^"]+"|[^\s"]+'), F.lit(0)), 1, 20)
    return t.benchmark.select("item_id", parts.alias("match"), F.filter(parts, lambda x: x.rlike(r"[+#.()]")).alias("exact"))


@query("t_snippet", "SELECT doc_id, substr(text, CAST(greatest(1, instr(lower(text), 'apache') - 100) AS BIGINT), 400) AS snippet FROM documents WHERE instr(lower(text), 'apache') > 0")
def snippet(t: Tables) -> DataFrame:
    return t.documents.where(F.instr(F.lower("text"), "apache") > 0).select("doc_id", text.snippet(F.col("text"), "apache").alias("snippet"))


@query("t_skill_key", f"{JOBS} SELECT DISTINCT title, trim(regexp_replace({_SPECIAL}, '[^a-z0-9]+', ' ', 'g')) AS key FROM jobs")
def skill_key(t: Tables) -> DataFrame:
    return jobs(t).select("title", text.place_key(text.special_tokens(F.col("title"))).alias("key")).distinct()


#: A few region and country words.
REGIONS = {"FRANCE": "FR", "GERMANY": "DE", "UNITED STATES": "US", "CHINA": "CN"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a key in a constant table, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


#: A place text per nation, for Spark and for the oracle: names, codes and texts that name no country.
_TEXT = "CASE n_nationkey % 7 WHEN 0 THEN 'FRANCE' WHEN 1 THEN 'Germany' WHEN 2 THEN 'UNITED STATES' WHEN 3 THEN 'CHINA' WHEN 4 THEN substr(lower(n_name), 1, 2) WHEN 5 THEN n_name END"
_CASE = "CASE {0} WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED STATES' THEN 'US' WHEN 'CHINA' THEN 'CN' END"


@query("t_region_key", f"SELECT n_nationkey, {_CASE.format('t')} AS code FROM (SELECT n_nationkey, {_TEXT} AS t FROM nation)")
def region_key(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", lookup(REGIONS, F.expr(_TEXT)).alias("code"))


def country_of_text(place: Column) -> Column:
    """Code of a country's name in any case, or a code of two letters."""
    return F.coalesce(lookup(REGIONS, F.upper(place)), F.when(F.length(place) == 2, F.upper(place)))


@query("t_country_text", f"SELECT n_nationkey, coalesce({_CASE.format('upper(t)')}, CASE WHEN length(t) = 2 THEN upper(t) END) AS code FROM (SELECT n_nationkey, {_TEXT} AS t FROM nation)")
def country_text(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", country_of_text(F.expr(_TEXT)).alias("code"))


@query("t_parse_place_query", f"{JOBS} SELECT DISTINCT country || ', ' || area AS text, country AS city, area AS region FROM jobs")
def parse_place(t: Tables) -> DataFrame:
    raw = jobs(t).select(F.concat_ws(", ", "country", "area").alias("text")).distinct()
    parts = F.split("text", r"\s*,\s*")
    return raw.select("text", F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).alias("region"))


_CK = _steps("lower(@)", (r"\([^)]*\)", " "), ("&", " and "), (r"\b([a-z])\.", r"\1"), ("[^a-z0-9]+", " "), ("^ *the ", ""), ("^ +| +$", ""), (f"(?: (?:{text.LEGAL}))+$", ""))


@query("t_company_key", "SELECT s_suppkey, " + _CK.replace("@", "'The ' || s_name || ' & Sons (NY) Co. Inc.'") + " AS key FROM supplier")
def company_key(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.company_key(F.concat(F.lit("The "), "s_name", F.lit(" & Sons (NY) Co. Inc."))).alias("key"))


@query("t_company_core", "SELECT s_suppkey, string_split(" + _CK.replace("@", "s_name || ' Holdings LLC'") + ", ' ') AS core FROM supplier")
def company_core(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.split(text.company_key(F.concat("s_name", F.lit(" Holdings LLC"))), " ").alias("core"))


@query("t_split_dba", "SELECT p_partkey, [p_name, p_type] AS names FROM part")
def split_dba(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.split_dba(F.concat("p_name", F.lit(" d/b/a "), "p_type")).alias("names"))


@query("t_junk_trade", "SELECT p_partkey, regexp_matches(p_name, '^(?:small|n/?a|none|same|[^a-zA-Z]*)( |$)') AS junk FROM part")
def junk_trade(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_name").rlike("^(?:small|n/?a|none|same|[^a-zA-Z]*)( |$)").alias("junk"))


@query("t_norm_company", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def norm_company(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.regexp_replace(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-"), "^-|-$", "").alias("slug"))


@query("t_norm_title", f"{JOBS} SELECT DISTINCT title, trim(" + _steps("lower(title)", (r"\([^)]*\)", " "), (r"\b(?:19|20)[0-9]{2}\b", " "), (r"\b(?:spring|summer|fall|autumn|winter)\b", " "), ("[^a-z0-9+#]+", " ")) + ") AS key FROM jobs")
def norm_title(t: Tables) -> DataFrame:
    return jobs(t).select("title", text.title_key(F.col("title")).alias("key")).distinct()


_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1))"
_PATH = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


@query("t_canonical_url", rf"""SELECT page_id, 'https://' || {_HOST} || regexp_replace({_PATH}, '/+$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|source|gclid|fbclid|trk)=.*'))) AS k FROM pages)""")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("url"))


@query("t_norm_job_url", f"SELECT page_id, {_HOST} || regexp_replace({_PATH}, '/+$', '') AS url FROM pages")
def norm_job_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.concat(urls.host(F.col("url")), F.regexp_replace(urls.path(F.col("url")), "/+$", "")).alias("url"))


@query("t_url_identity", rf"SELECT page_id, regexp_replace({_HOST}, '^(?:www|[a-z]{{2}})\.', '') || lower(regexp_replace({_PATH}, '/+$', '')) AS identity FROM pages")
def url_identity(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.identity(F.col("url")).alias("identity"))


_BODY = _steps("html", (r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""), (r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|nav|title|body|head|html)\b[^>]*>", "\n"), ("<[^>]+>", ""))


def _entities(expr: str) -> str:
    for k, v in text.ENTITIES.items():
        expr = f"replace({expr}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return expr


@query("t_html_to_text", "SELECT page_id, " + _steps(_entities(_BODY), (r"[ \t]*\n\s*", "\n"), (r"^\s+|\s+$", "")) + " AS text FROM pages")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query("t_entities", f"SELECT page_id, {_entities('html')} AS html FROM pages")
def entities(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.decode_entities(F.col("html")).alias("html"))


def unescape_all(column: Column) -> Column:
    """Every HTML entity, numeric ones too, in Arrow batches (the rest have native forms)."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else html.unescape(x)), "string")(column)


_CUT = "[Ll]icensed"


@query("t_cut_other_jobs", "WITH l AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '[Ll]icensed')), TRUE) AS cut_pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) SELECT doc_id, array_to_string(CASE WHEN cut_pos > 0 THEN ls[1:cut_pos - 1] ELSE ls END, chr(10)) AS text FROM l")
def cut_other_jobs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.cut_at(F.col("text"), _CUT).alias("text"))


@query("t_drop_other_roles", """WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  f AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-M]') THEN 0 WHEN regexp_matches(line, '^The .*\\.$') THEN 1 END AS flag FROM l),
  s AS (SELECT *, coalesce(last_value(flag IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS off FROM f)
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (off = 0), '') AS text FROM s GROUP BY doc_id""")
def drop_other_roles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.drop_block(F.col("text"), r"^The .*\.$", r"^[A-M]").alias("text"))


@query("t_evidence_snippet", "SELECT doc_id, trim(substr(text, 1, 120)) AS quote FROM documents WHERE length(text) > 240")
def evidence_snippet(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") > 240).select("doc_id", F.trim(F.substr("text", F.lit(1), F.lit(120))).alias("quote"))


@query("t_analyze_text", """WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), h AS (SELECT *, CASE WHEN length(line) < 20 THEN line END AS heading FROM l)
  SELECT doc_id, CAST(pos AS INT) AS pos, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section, len(regexp_extract_all(line, '[^.!?]+')) AS sentences FROM h""")
def analyze_text(t: Tables) -> DataFrame:
    """Lines with the section heading above them and their number of sentences."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    section = F.last(F.when(F.length("line") < 20, F.col("line")), ignorenulls=True).over(w)
    return lines.select("doc_id", "pos", section.alias("section"), F.size(F.regexp_extract_all("line", F.lit("[^.!?]+"), F.lit(0))).cast("long").alias("sentences"))


@query("t_language", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 5 THEN NULL WHEN len(list_filter(w, lambda x: list_contains(['the', 'of', 'and', 'a', 'to', 'in', 'it', 'that', 'for', 'on'], x)))::DOUBLE / len(w) >= 0.15 THEN 'en' ELSE 'other' END AS lang FROM w")
def language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.language_guess(F.col("text")).alias("lang"))


@query("t_quote_around", "SELECT doc_id, substr(text, CAST(greatest(1, instr(text, ',') - 80) AS BIGINT), 160) AS quote FROM documents WHERE instr(text, ',') > 0")
def quote_around(t: Tables) -> DataFrame:
    at = F.instr("text", ",")
    return t.documents.where(at > 0).select("doc_id", F.substr("text", F.greatest(F.lit(1), at - 80), F.lit(160)).alias("quote"))


@query("t_injection", "SELECT doc_id, regexp_matches(text, '(?i)(ignore|disregard) (all|previous|the above)|as an? (ai|automated)') AS injection FROM documents")
def injection(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike("(?i)(ignore|disregard) (all|previous|the above)|as an? (ai|automated)").alias("injection"))


_FW = "CASE WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:[sx]|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END"


@query("t_fold_word", f"SELECT DISTINCT w, {_FW} AS folded FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def fold_word(t: Tables) -> DataFrame:
    """Over the distinct vocabulary, so each word is folded once."""
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return words.select("w", text.fold_word(F.col("w")).alias("folded"))


#: Title words that mean another.
TITLE_WORDS = {"developer": "engineer", "developers": "engineer", "rn": "nurse", "dev": "engineer"}


@query("t_title_words", f"{JOBS}, w AS (SELECT DISTINCT title, regexp_extract_all(lower(title), '[a-z]+') AS ws FROM jobs) SELECT title, list_transform(ws, lambda w: CASE WHEN w IN ('developer', 'developers', 'dev') THEN 'engineer' WHEN w = 'rn' THEN 'nurse' ELSE {_FW} END) AS words FROM w")
def title_words(t: Tables) -> DataFrame:
    found = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))
    return jobs(t).select("title").distinct().select("title", F.transform(found, lambda w: F.coalesce(lookup(TITLE_WORDS, w), text.fold_word(w))).alias("words"))


@query("t_looks_garbled", "SELECT doc_id, regexp_matches(text, '[ÃÂâ][\u0080-¿]|�') AS garbled FROM documents")
def looks_garbled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike("[ÃÂâ][\u0080-¿]|�").alias("garbled"))


def _repair(s: str | None) -> str | None:
    if s is None or not any(c in s for c in "ÃÂâ"):
        return s
    try:
        return s.encode("cp1252").decode("utf-8")
    except UnicodeError:
        return s


def _pages_of(function, kind: str):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            yield column.map(function)

    run.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


@query("x_fix_mojibake")
def fix_mojibake(t: Tables) -> DataFrame:
    """UTF-8 read as cp1252 is read again; Spark has no cp1252, so this is an Arrow UDF."""
    return t.documents.select("doc_id", _pages_of(_repair, "string")(F.col("text")).alias("text"))


@query("t_email_like", r"SELECT doc_id, regexp_matches(w, '^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$') AS email FROM (SELECT doc_id, regexp_extract(text, '\S+@\S+', 0) AS w FROM documents)")
def email_like(t: Tables) -> DataFrame:
    w = F.regexp_extract("text", r"\S+@\S+", 0)
    return t.documents.select("doc_id", w.rlike(r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$").alias("email"))


@query("t_find_contacts", r"SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS emails, regexp_extract_all(text, '\+?[0-9][0-9 ().-]{7,}[0-9]') AS phones, regexp_extract_all(text, 'https?://[^\s]+') AS links FROM documents")
def find_contacts(t: Tables) -> DataFrame:
    every = lambda rx: F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    return t.documents.select("doc_id", every(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("emails"), every(r"\+?[0-9][0-9 ().-]{7,}[0-9]").alias("phones"), every(r"https?://[^\s]+").alias("links"))


_FOLD_SQL = "CASE WHEN regexp_matches(w, 'ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:[sx]|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END"


@query("t_similarity", f"""WITH c AS (SELECT item_id, list_filter(list_distinct(list_transform({_token_sql('text')}, lambda w: {_FOLD_SQL})), lambda x: NOT list_contains({_STOP}, x)) AS c FROM benchmark)
  SELECT a.item_id, CASE WHEN len(list_distinct(list_concat(a.c, b.c))) > 0 THEN round(len(list_intersect(a.c, b.c))::DOUBLE / len(list_distinct(list_concat(a.c, b.c))), 6) ELSE 0 END AS similarity FROM c a JOIN c b ON b.item_id = a.item_id + 1""")
def similarity(t: Tables) -> DataFrame:
    """Neighbouring benchmark items by the Jaccard share of their content words."""
    a = t.benchmark.select("item_id", F.col("text").alias("a"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(text.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


#: FNV-1a of a supplier's name (ASCII) for the oracle.
FNV_SQL = "list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(s_name, ''), lambda c: CAST(ord(c) AS UBIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"


@query("t_stable_id", f"SELECT s_suppkey, 's_' || ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // CAST(pow(36, k) AS BIGINT) % 36 + 1 AS BIGINT), 1)), ''), '0') AS id FROM (SELECT s_suppkey, CAST({FNV_SQL} AS BIGINT) AS h FROM supplier)")
def stable_id(t: Tables) -> DataFrame:
    """FNV-1a of the parts in base 36."""
    return t.supplier.select("s_suppkey", F.concat(F.lit("s_"), base36(ranking.fnv1a32(F.col("s_name")))).alias("id"))


@query("t_fingerprint", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def fingerprint(t: Tables) -> DataFrame:
    """Length and sum of a vector (the reference's key for its cache)."""
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query("t_canonical_entity", "SELECT p_partkey, trim(regexp_replace(trim(regexp_replace(lower(p_name || ', Inc. LLC'), '[^a-z0-9]+', ' ', 'g')), '(?: (?:inc|llc|ltd))+$', '')) AS value FROM part")
def canonical_entity(t: Tables) -> DataFrame:
    plain = F.trim(F.regexp_replace(F.lower(F.concat("p_name", F.lit(", Inc. LLC"))), "[^a-z0-9]+", " "))
    return t.part.select("p_partkey", F.trim(F.regexp_replace(plain, "(?: (?:inc|llc|ltd))+$", "")).alias("value"))


@query("t_job_terms", "WITH w AS (SELECT item_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM benchmark)) SELECT item_id, term, CAST(min(pos) - 1 AS INT) AS pos FROM w WHERE term IN ('that', 'the', 'thing', 'reer') GROUP BY 1, 2")
def job_terms(t: Tables) -> DataFrame:
    """Dictionary terms in the order of first appearance."""
    terms = t.spark.createDataFrame([("that",), ("the",), ("thing",), ("reer",)], "term string")
    found = t.benchmark.select("item_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "term"))
    return found.join(F.broadcast(terms), "term").groupBy("item_id", "term").agg(F.min("pos").alias("pos"))  # a constant dictionary


@query("t_keyword_gaps", "SELECT p_partkey, w AS term, CASE WHEN w IN ('red', 'blue') THEN 'covered' WHEN w IN ('small', 'widget') THEN 'in_profile_not_resume' ELSE 'not_in_profile' END AS state FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)")
def keyword_gaps(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("red", "covered"), ("blue", "covered"), ("small", "in_profile_not_resume"), ("widget", "in_profile_not_resume")], "term string, state string")
    out = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")).join(F.broadcast(known), "term", "left")  # a constant table
    return out.select("p_partkey", "term", F.coalesce("state", F.lit("not_in_profile")).alias("state"))


#: Patterns of the facts a text may mention.
FACTS = {"year": r"\b(?:19|20)[0-9]{2}\b", "number": r"\b[0-9]+(?:\.[0-9]+)?\b", "name": r"[A-Z][a-z]+ [A-Z][a-z]+"}


@query("t_resume_fact_scan", "SELECT doc_id, kind, s FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{v}')) AS s FROM documents" for k, v in FACTS.items()) + ")")
def fact_scan(t: Tables) -> DataFrame:
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("text", F.lit(rx), F.lit(0)), _kinded(k)) for k, rx in FACTS.items()]))
    return t.documents.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", "f.s")


def _kinded(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))


@query("t_truth_gate", "WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text || ' Since ' || CAST(1990 + doc_id % 15 AS STRING) || '.', '\\b(?:19|20)[0-9]{2}\\b')) AS fact FROM documents) SELECT doc_id, fact FROM f WHERE fact NOT IN (SELECT DISTINCT CAST(year(o_orderdate) AS STRING) FROM orders)")
def truth_gate(t: Tables) -> DataFrame:
    """Facts of a draft that no fact of the profile supports."""
    draft = F.concat("text", F.lit(" Since "), (F.col("doc_id") % 15 + 1990).cast("string"), F.lit("."))
    facts = t.documents.select("doc_id", F.explode(F.regexp_extract_all(draft, F.lit(FACTS["year"]), F.lit(0))).alias("fact")).distinct()
    profile = t.orders.select(F.year("o_orderdate").cast("string").alias("fact")).distinct()
    return facts.join(profile, "fact", "left_anti").select("doc_id", "fact")


def strip_marks(s: str | None) -> str | None:
    return None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

