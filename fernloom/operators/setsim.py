"""Set-similarity join: all pairs of two tables whose word sets are alike, without all pairs.

The words are put in one order, the rarest first.  Two sets with a Jaccard share of ``least`` or more
must share a word among the first few of each (their *prefixes*), and their sizes cannot differ
by more than that share; so the join is on prefix words, filtered by size and by the places of the
shared word, and only what remains is compared in full.  A pair is tried once, at its first shared prefix word.

The left table is the smaller one.  Up to ``MOST_WORDS`` words its prefixes go out to all tasks, and each row of the
right table is read where it stands: its words find the left sets by their prefixes, and the sets
are compared at once, so that only pairs that are alike are moved or stored.  Beyond that bound the
right sets are stored once under a number, the join moves words and numbers, and the pairs to be
compared fetch their sets; nothing holds a set as often as it has words.

Defined cases: null and empty sets are like nothing; rows that repeat an id and a set are one; both
tables may be the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernloom.registry import Tables, query
from fernloom.scratch import materialize, temporary


#: Words of all left sets (repeats included) up to which their prefixes are sent to every task; a few dozen MB.
MOST_WORDS = 200_000


def _needed(share: Column, size: Column) -> Column:
    """Least whole number of words that a share of a set is; a hair off, for shares that are no binary fractions."""
    return F.ceil(share * size - 1e-9)


def _tidy(rows: DataFrame) -> DataFrame:
    sets = rows.where("size(words) > 0").select("id", F.array_distinct(F.filter("words", lambda w: w.isNotNull())).alias("words"))
    return sets.withColumn("size", F.size("words")).where("size > 0")


def _stored(sets: DataFrame, label: str, side: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sets under numbers, and the ids of each."""
    kept = materialize(sets.select("id", F.array_sort("words").alias("words"), "size").distinct(), label)
    numbers = materialize(kept.select("words", "size").distinct().withColumn("number", F.monotonically_increasing_id()), f"{label}-sets")
    ids = kept.select(F.col("id").alias(f"{side}_id"), "words").join(numbers.select("words", "number"), "words").select(f"{side}_id", "number")
    return numbers, ids


def _prefixes(sets: DataFrame, order: DataFrame, least: float) -> DataFrame:
    """``(number, size, at, word)`` of the prefix words of each set in the common order."""
    rows = sets.select("number", "size", F.explode("words").alias("word")).join(order, "word")
    ordered = rows.groupBy("number", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    first = F.slice("w", F.lit(1), (F.col("size") - _needed(F.lit(least), F.col("size")) + 1).cast("int"))
    return ordered.select("number", "size", F.posexplode(F.transform(first, lambda x: x["word"])).alias("at", "word"))


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs with their sets and sizes those that are alike, with the words they share."""
    counted = pairs.withColumn("shared", F.size(F.array_intersect("words_a", "words_b")).cast("long"))
    return counted.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).where(F.col("jaccard") >= least - 1e-12)


def _near(least: float) -> Column:
    return (F.col("size_b") >= _needed(F.lit(least), F.col("size_a"))) & (F.col("size_a") >= _needed(F.lit(least), F.col("size_b")))


def _by_sent_prefixes(sets: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``(number, right_id, shared, jaccard)``: the right rows stay where they are, the left prefixes come to them."""
    vocabulary = F.broadcast(sets.select(F.explode("words").alias("word")).distinct())
    known = right.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("seen"))
    order = materialize(vocabulary.join(known, "word", "left").select("word", F.coalesce("seen", F.lit(0)).alias("n")), "order")
    prefixes = _prefixes(sets, order, least)
    whole = sets.join(prefixes.groupBy("number").agg(F.array_agg("word").alias("prefix")), "number").select("number", F.col("words").alias("words_a"), F.col("size").alias("size_a"), "prefix")
    index = materialize(prefixes.select("number", "word").join(whole, "number"), "prefixes")
    rows = right.select(F.col("id").alias("right_id"), F.col("words").alias("words_b"), F.col("size").alias("size_b"), F.explode("words").alias("word"))
    tried = rows.join(F.broadcast(index), "word").where(_near(least))
    alike = _alike(tried, least).where(F.get(F.array_intersect("prefix", "words_b"), F.lit(0)) == F.col("word"))
    return materialize(alike.select("number", "right_id", "shared", "jaccard").distinct(), "like")


def _by_numbers(sets: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """The same by joins of words and numbers."""
    others, ids = _stored(right, "right", "right")
    order = materialize(sets.select("words").unionAll(others.select("words")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "order")
    x, y = (_prefixes(df, order, least).select("word", *[F.col(c).alias(f"{c}_{side}") for c in ("number", "size", "at")]) for df, side in ((sets, "a"), (others, "b")))
    overlap = _needed(F.lit(least / (1 + least)), F.col("size_a") + F.col("size_b"))
    possible = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) >= overlap  # this word and all that follow
    tried = x.join(y, "word").where(_near(least) & possible).select("number_a", "number_b").distinct()
    both = [df.select(F.col("number").alias(f"number_{s}"), F.col("words").alias(f"words_{s}"), F.col("size").alias(f"size_{s}")) for df, s in ((sets, "a"), (others, "b"))]
    alike = materialize(_alike(tried.join(both[0], "number_a").join(both[1], "number_b"), least).select("number_a", "number_b", "shared", "jaccard"), "like")
    return alike.join(ids.withColumnRenamed("number", "number_b"), "number_b").select(F.col("number_a").alias("number"), "right_id", "shared", "jaccard")


def similar_sets(left: DataFrame, right: DataFrame, least: float, most_words: int = MOST_WORDS) -> DataFrame:
    """``(left_id, right_id, shared, jaccard)`` of ``(id, words)`` tables, for all pairs of at least ``least``."""
    if not 0 < least <= 1:
        raise ValueError("the least share is above 0 and at most 1")
    with temporary(left.sparkSession):
        sets, ids = _stored(_tidy(left), "left", "left")
        seen = sets.agg(F.sum("size").alias("words"), F.min("size").alias("least"), F.max("size").alias("most")).first()
        size = F.col("size")
        fit = _tidy(right).where((size >= _needed(F.lit(least), F.lit(seen["least"]))) & (F.lit(seen["most"]) >= _needed(F.lit(least), size)))
        found = (_by_sent_prefixes if (seen["words"] or 0) <= most_words else _by_numbers)(sets, fit, least)
        return materialize(ids.join(found, "number").select("left_id", "right_id", "shared", "jaccard"), "similar", keep=True)


_W = "list_sort(list_distinct(regexp_extract_all(lower({}), '\\w+')))"


@query("t_similarity_join", f"""WITH a AS (SELECT item_id, {_W.format('text')} AS w FROM benchmark),
  l AS (SELECT DISTINCT w FROM (SELECT {_W.format('line')} AS w FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE len(w) > 0),
  p AS (SELECT item_id, l.w, len(list_intersect(a.w, l.w)) AS shared FROM a, l WHERE len(l.w) >= 0.5 * len(a.w) AND len(a.w) >= 0.5 * len(l.w) AND list_has_any(a.w, l.w)),
  o AS (SELECT item_id, p.w, shared, shared::DOUBLE / (len(a.w) + len(p.w) - shared) AS j FROM p JOIN a USING (item_id))
  SELECT item_id, array_to_string(w, ' ') AS line, CAST(shared AS BIGINT) AS shared, round(j, 9) AS jaccard FROM o WHERE j >= 0.5""")
def similarity_join(t: Tables) -> DataFrame:
    """Lines of documents whose words are half those of an item or more."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"\w+"), F.lit(0))
    items = t.benchmark.select(F.col("item_id").alias("id"), words("text").alias("words"))
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(words("line").alias("words"))
    named = lines.select(F.array_join(F.array_sort(F.array_distinct("words")), " ").alias("id"), "words")
    found = similar_sets(items, named, 0.5)
    return found.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("line"), "shared", F.round("jaccard", 9).alias("jaccard")).distinct()
