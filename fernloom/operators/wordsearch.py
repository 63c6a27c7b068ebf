"""Word searches over stored indexes of the tables: all terms, phrases, prefixes, word ranks, updates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fernloom.functions import ranking, text
from fernloom.operators.wordindex import WordIndex
from fernloom.plans.postings import JOBS, jobs
from fernloom.registry import Tables, query
from fernloom.scratch import materialize, scratch_root

WORDS = "regexp_extract_all(lower({}), '[a-z]+')"


def plain_words(c: str) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def stored(t: Tables, kind: str, tables: list[str], docs: Callable[[], DataFrame], fields: list[str]) -> WordIndex:
    """The index of a kind over these tables: opened if these very files (names, sizes, times) are indexed, else built."""
    spark, seen = t.spark, [kind]
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
        for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    at = f"{scratch_root(spark)}/fernloom/words-{hashlib.sha256('|'.join(sorted(seen)).encode()).hexdigest()[:32]}"
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/manifest-000001")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return WordIndex(spark, at)
    return WordIndex.build(spark, docs(), fields, at)


def document_index(t: Tables) -> WordIndex:
    """Words of ``documents``."""
    return stored(t, "documents", ["documents"], lambda: t.documents.select(F.col("doc_id").alias("id"), plain_words("text").alias("text")), ["text"])


def folded(words: Column) -> Column:
    return F.transform(words, text.fold_word)


def job_index(t: Tables) -> WordIndex:
    """Words of the postings: title, title with inflections folded, company, and all else that is searched."""

    def docs() -> DataFrame:
        title = text.tokens(F.col("title"))
        rest = text.tokens(F.concat_ws(" ", "country", "area", "industry"))
        return jobs(t).select(F.col("job_id").alias("id"), title.alias("title"), folded(title).alias("stem"), text.tokens(F.col("company")).alias("company"), rest.alias("rest"))

    return stored(t, "jobs", ["orders", "customer", "nation", "region"], docs, ["title", "stem", "company", "rest"])


@query("t_fts_rids", "WITH i AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term, doc_id FROM documents) SELECT doc_id FROM i WHERE term IN ('apache', 'license') GROUP BY doc_id HAVING count(*) = 2")
def fts_rids(t: Tables) -> DataFrame:
    asked = t.spark.sql("SELECT 1 AS query_id, array('apache', 'license') AS terms")
    return document_index(t).all_of(asked).select(F.col("id").alias("doc_id"))


@query("t_search_batch", f"""WITH q AS (SELECT DISTINCT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
  d AS (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS term FROM documents)
  SELECT item_id, doc_id FROM q JOIN d USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING count(*) = n""")
def search_batch(t: Tables) -> DataFrame:
    """A batch of searches in one job: the documents that hold every word of each item."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), plain_words("text").alias("terms"))
    return document_index(t).all_of(asked).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("t_phrase_search", f"""WITH q AS (SELECT item_id, ({WORDS.format('text')})[1:3] AS p FROM benchmark), d AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)),
  n AS (SELECT doc_id, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM d WINDOW o AS (PARTITION BY doc_id ORDER BY i))
  SELECT item_id, doc_id, count(*) AS times FROM q JOIN n ON a = p[1] AND b = p[2] AND c = p[3] GROUP BY item_id, doc_id""")
def phrase_search(t: Tables) -> DataFrame:
    """Documents with the first three words of each item one after another, and how often."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.slice(plain_words("text"), 1, 3).alias("terms")).where("size(terms) = 3")
    return document_index(t).phrase(asked).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "times")


@query("t_prefix_search", f"""WITH q AS (SELECT item_id, substr(({WORDS.format('text')})[2], 1, 4) AS p FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS term FROM documents)
  SELECT item_id, count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms FROM q JOIN d ON starts_with(term, p) WHERE p <> '' GROUP BY item_id""")
def prefix_search(t: Tables) -> DataFrame:
    """Documents with a word that begins as each item's second word does, and the words it stands for."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.substring(F.get(plain_words("text"), 1), 1, 4).alias("prefix"))
    index = document_index(t)
    docs = index.prefix(asked).groupBy("query_id").agg(F.count("*").alias("docs"))
    terms = index.expand(asked).groupBy("query_id").agg(F.count("*").alias("terms"))
    return docs.join(terms, "query_id").select(F.col("query_id").alias("item_id"), "docs", "terms")


@query("t_index_update", f"""WITH now AS (SELECT d.doc_id, {WORDS.format("CASE WHEN quality = 0 THEN 'revised license ' || lang || ' license' ELSE text END")} AS w FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(toxic, 0) = 0)
  SELECT doc_id, term, CAST(len(w) AS INTEGER) AS words, count(*) AS times FROM (SELECT doc_id, w, unnest(w) AS term FROM now) WHERE term IN ('apache', 'license', 'revised', 'fr') GROUP BY doc_id, term, w""")
def index_update(t: Tables) -> DataFrame:
    """An index that lost the documents labelled toxic and got new texts for those of low quality, then was compacted."""
    own = t.documents.select(F.col("doc_id").alias("id"), "lang", plain_words("text").alias("text"))
    index = WordIndex.build(t.spark, own.select("id", "text"), ["text"])
    labels = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    index.update(deleted=labels.where("toxic = 1").select("id"))
    poor = own.join(labels.where("quality = 0 AND toxic = 0"), "id").select("id", F.concat(F.lit("revised license "), "lang", F.lit(" license")).alias("words"))
    index.update(changed=poor.select("id", plain_words("words").alias("text")))
    index.compact()
    asked = t.spark.createDataFrame([("apache",), ("license",), ("revised",), ("fr",)], "term string")
    found = index.postings(asked)
    return found.select(F.col("id").alias("doc_id"), "term", F.col("len").alias("words"), F.size("positions").cast("long").alias("times"))


@query("w_bm25", """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z]+') AS tokens FROM documents), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_len FROM d),
  h AS (SELECT id, len(tokens) AS l, term, count(*) AS tf FROM (SELECT id, tokens, unnest(tokens) AS term FROM d) WHERE term IN ('that', 'heention', 'license') GROUP BY id, tokens, term), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
  SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) AS score FROM h JOIN f USING (term), s GROUP BY id""")
def bm25_query(t: Tables) -> DataFrame:
    asked = t.spark.sql("SELECT 1 AS query_id, array('that', 'heention', 'license') AS terms")
    return document_index(t).bm25(asked, "text").select("id", F.round("score", 6).alias("score"))


def word_ranked(index: WordIndex, queries: DataFrame, rows: DataFrame, k: int = 40) -> DataFrame:
    """``(query_id, id, key, place)``: rows that hold every term, by exact and folded title words, phrase, share of the title, company words, day.

    ``rows`` has ``id`` and ``day`` of the rows that may be shown.
    """
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms"))
    each = asked.select("query_id", F.size("terms").alias("k"), F.explode("terms").alias("term")).withColumn("stem", text.fold_word(F.col("term")))
    columns = ["id", "field", "len"]
    plain = index.postings(each, [f for f in index.manifest["fields"] if f != "stem"]).select("term", *columns)
    bent = index.postings(each.select(F.col("stem").alias("term")), ["stem"]).select(F.col("term").alias("stem"), *columns)
    # rows that may be shown and hold the term of the query that the fewest hold; the other terms are looked up for these alone
    numbers = [df.groupBy(c).agg(F.count("*").alias(f"n_{c}")) for df, c in ((plain, "term"), (bent, "stem"))]
    least = F.min(F.struct((F.coalesce("n_term", F.lit(0)) + F.coalesce("n_stem", F.lit(0))).alias("n"), "term", "stem")).alias("least")
    rare = each.join(numbers[0], "term", "left").join(numbers[1], "stem", "left").groupBy("query_id").agg(least).select("query_id", "least.term", "least.stem")
    some = rare.join(plain, "term").select("query_id", "id").unionByName(rare.join(bent, "stem").select("query_id", "id")).distinct().join(rows.select("id", "day"), "id")
    sought = materialize(some.join(F.broadcast(each), "query_id"), "sought", keep=True)
    found = sought.join(plain, ["id", "term"]).drop("stem").unionByName(sought.join(bent, ["id", "stem"]).drop("stem")).repartition("query_id", "id")
    held = lambda *f: F.max(F.col("field").isin(*f).cast("int"))
    terms = found.groupBy("query_id", "id", "k", "day", "term").agg(held("title").alias("exact"), held("stem").alias("folded"), held("company").alias("company"), F.max(F.when(F.col("field").isin("title", "stem"), F.col("len"))).alias("words"))
    whole = terms.groupBy("query_id", "id", "k", "day").agg(F.count("*").alias("all"), *[F.sum(c).alias(c) for c in ("exact", "folded", "company")], F.max("words").alias("words"))
    phrases = index.phrase(asked.where("size(terms) > 1"), ["title"]).select("query_id", "id", F.lit(1).alias("phrase"))
    both = whole.where(F.col("all") == F.col("k")).join(phrases, ["query_id", "id"], "left")
    exact, fold = F.least(F.lit(15), "exact"), F.least(F.lit(15), "folded")
    title = F.greatest(F.coalesce("words", F.lit(1)), F.col("k"))
    cover = F.least(F.lit(31), F.floor(F.least(F.greatest(fold, exact), F.col("k")) / title * 31 + 0.5))
    key = ((((exact * 16 + fold) * 2 + F.coalesce("phrase", F.lit(0))) * 32 + cover) * 16 + F.least(F.lit(15), "company")) * 32768 + F.col("day")
    placed = both.select("query_id", "id", key.cast("long").alias("key"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("key").desc(), "id"))
    return placed.withColumn("place", place).where(F.col("place") <= k)


_JOB_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_FOLD = "CASE WHEN regexp_matches(x, 'ies$') THEN regexp_replace(x, 'ies$', 'y') WHEN regexp_matches(x, '([sx]|ch|sh)es$') THEN regexp_replace(x, 'es$', '') WHEN regexp_matches(x, '[^s]s$') THEN regexp_replace(x, 's$', '') ELSE x END"
_FOLDED = "list_transform({}, lambda x: " + _FOLD + ")"
#: Titles of the view hold one symbol word.
_TITLE = _JOB_WORDS.format("replace(title, 'C++', 'cplusplus')")


@query("w_key_words", f"""{JOBS}, q AS (SELECT n_nationkey AS query_id, list_concat(['engineers', 'engineer'][n_nationkey % 2 + 1:n_nationkey % 2 + 1], {_JOB_WORDS.format('n_name')}) AS terms FROM nation),
  f AS (SELECT job_id, {_TITLE} AS title, {_FOLDED.format(_TITLE)} AS stem, {_JOB_WORDS.format('company')} AS company, {_JOB_WORDS.format("country || ' ' || area || ' ' || industry")} AS rest,
    CASE WHEN posted_at IS NULL THEN 0 ELSE date_diff('day', DATE '2000-01-01', CAST(posted_at AS DATE)) + 1 END AS day FROM jobs WHERE status = 'open'),
  h AS (SELECT query_id, job_id, day, len(terms) AS k, len(list_intersect(title, terms)) AS exact, len(list_filter(terms, lambda x: list_contains(stem, {_FOLD}))) AS fold, len(title) AS words, len(list_intersect(company, terms)) AS company,
    contains(' ' || array_to_string(title, ' ') || ' ', ' ' || array_to_string(terms, ' ') || ' ') AND len(terms) > 1 AS phrase FROM q, f WHERE len(list_filter(terms, lambda x: list_contains(list_concat(title, company, rest), x) OR list_contains(stem, {_FOLD}))) = len(terms)),
  s AS (SELECT query_id, job_id, ((((least(15, exact) * 16 + least(15, fold)) * 2 + CAST(phrase AS INT)) * 32 + least(31, floor(least(greatest(exact, fold), k) / greatest(words, k) * 31 + 0.5))) * 16 + least(15, company)) * 32768 + day AS key FROM h)
  SELECT query_id, job_id, CAST(key AS BIGINT) AS key, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, job_id) AS place FROM s) WHERE place <= 40""")
def word_order(t: Tables) -> DataFrame:
    """A batch of word searches: an occupation's word and a country's words for each nation, 40 best open postings each."""
    word = F.when(F.col("n_nationkey") % 2 == 0, "engineers").otherwise("engineer")
    asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.array(word), text.tokens(F.col("n_name"))).alias("terms"))
    rows = jobs(t).where("status = 'open'").select(F.col("job_id").alias("id"), ranking.day_number(F.col("posted_at")).alias("day"))
    return word_ranked(job_index(t), asked, rows).withColumnRenamed("id", "job_id")
