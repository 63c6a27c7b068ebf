"""Ranked lexical search: all documents for each item, as blocks of a sparse matrix product.

The rows of A are items (term multiplicities), the columns of B are documents (64-bit integer
impacts of their terms), and a score is an entry of A*B.  Documents stay where they are read:
every Arrow batch is one block of B, built by term from the batch's own tokens.  Item rows are
merged with it after Gustavson: one accumulator of the block's documents takes the rows of B of
the item's terms.  Of each block only the entries that can still be among an item's ``k`` best
are kept; what the tasks keep is reduced in two steps of windows.

Items go out in blocks of about ``block_terms`` entries of A, one block on the driver at a time
and one pass over the documents each; the corpus statistics (documents and terms in all,
documents by term) are counted once over every document and stay a table, joined by term.

Defined cases: a null text, or one without a term, is no document (N) and is never found; an
item without a known term gets no rows; item rows that share an id, null among them, are one
item with their terms together; documents that share an id rank apiece, those without an id after
others of their score; ties go by ascending id, then by text; other columns are ignored; empty
tables give an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fernloom.llm.batches import Pooled, bounded_slices, small_batches, strings, token_cutter
from fernloom.scratch import materialize, temporary

#: Entries of A in a block of items, and text bytes in a block of documents.
BLOCK_TERMS, BLOCK_BYTES = 1 << 18, 4 << 20
#: The bytes of terms (ASCII digits and letters, and all bytes of other characters), and A-Z folded.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


_cut = token_cutter(_IN_TERM, _FOLD)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a column of texts, folded, and the row each stands in."""
    lengths, row, data = _cut(texts)
    return strings(lengths, data), row


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, summed up inside the task; the row without a term has the numbers of documents and of terms."""
    pool = Pooled(["term"], ["df"])
    docs = terms = 0

    def out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part["term"].cast(pa.string()), part["df"], none, none], ["term", "df", "docs", "terms"])

    for whole in batches:
        for batch in bounded_slices(whole, 0, BLOCK_BYTES):
            flat, row = terms_of(batch.column(0))
            codes = flat.dictionary_encode()
            pairs = np.unique(codes.indices.to_numpy().astype(np.int64) * max(batch.num_rows, 1) + row) // max(batch.num_rows, 1)
            yield from out(pool.add(pa.table({"term": codes.dictionary, "df": np.bincount(pairs, minlength=len(codes.dictionary)).astype(np.int64)})))
            docs, terms = docs + len(np.unique(row)), terms + len(row)
    yield from out(pool.rest())
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([docs]), pa.array([terms])], ["term", "df", "docs", "terms"])


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, df, docs, terms)`` over all documents; the row with a null term has the totals."""
    found = small_batches(docs).select(text_col).mapInArrow(_counted, "term string, df long, docs long, terms long")
    return found.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "docs", "terms")])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, row = terms_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), flat.cast(pa.string())], ["item_id", "term"])


@dataclass
class ItemBlock:
    """Some rows of A: items, their terms and multiplicities, and what the impacts need."""

    terms: pa.Array
    weights: np.ndarray
    ends: np.ndarray  # of each item's entries
    cols: np.ndarray
    times: np.ndarray
    docs: int
    total_terms: int


def impacts(block: ItemBlock, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block of B by term: ends of the terms' rows, documents, impacts (64-bit integers, divisions rounded down)."""
    flat, row = terms_of(texts)
    n = np.bincount(row, minlength=len(texts)).astype(np.int64)
    m = 100 - 90 + (90 * n * block.docs) // block.total_terms
    code = pc.index_in(flat, value_set=block.terms)
    known = pc.is_valid(code).to_numpy(zero_copy_only=False)
    code = code.drop_null().to_numpy().astype(np.int64)
    cells, tf = np.unique(code * len(texts) + row[known], return_counts=True)
    term, doc = cells // len(texts), cells % len(texts)
    value = block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    return np.searchsorted(term, np.arange(len(block.terms) + 1)), doc, value


def product_rows(block: ItemBlock, ends: np.ndarray, docs: np.ndarray, values: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of A*B one by one: each item's rows of B, times its multiplicities, merged in one accumulator."""
    filled = np.flatnonzero(np.diff(ends))
    has = np.zeros(len(ends) - 1, bool)
    has[filled] = True
    sums = np.zeros(n_docs, np.int64)
    for item in range(len(block.ends) - 1):
        own = slice(block.ends[item], block.ends[item + 1])
        cols, times = block.cols[own], block.times[own]
        use = has[cols]
        if not use.any():
            continue
        sums[:] = 0
        for c, x in zip(cols[use].tolist(), times[use].tolist(), strict=True):
            at = slice(ends[c], ends[c + 1])
            sums[docs[at]] += x * values[at]  # a document stands once in a row
        yield item, sums


def best(scores: np.ndarray, ids: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equals the smallest id, then the smallest tie-breaker."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        may = np.flatnonzero(scores >= least)
    else:
        may = np.arange(len(scores))
    return may[np.lexsort((ties[may], ids[may], -scores[may]))[:k]]


#: Stands for a null id: it comes last among equals.
NO_ID = np.iinfo(np.int64).max


def _searching(shared, k: int):
    """Maps ``(doc_id, tie, text)`` to each item's best rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: ItemBlock = shared.value
        kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in bounded_slices(whole, 2, BLOCK_BYTES):
                ids = pc.fill_null(batch.column(0).cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
                ties = batch.column(1).to_numpy(zero_copy_only=False)
                ends, docs, values = impacts(block, batch.column(2))
                for item, sums in product_rows(block, ends, docs, values, batch.num_rows):
                    old = kept.get(item)
                    floor = old[0][-1] if old is not None and len(old[0]) == k else 1
                    at = np.flatnonzero(sums >= max(floor, 1))
                    if not len(at):
                        continue
                    three = (sums[at], ids[at], ties[at])
                    if old is not None:
                        three = tuple(np.concatenate(x) for x in zip(old, three, strict=True))
                    top = best(*three, k)
                    kept[item] = tuple(x[top] for x in three)
        if kept:
            number = np.concatenate([np.full(len(v[0]), i, np.int32) for i, v in kept.items()])
            scores, ids, ties = (np.concatenate([v[c] for v in kept.values()]) for c in range(3))
            part = np.full(len(number), TaskContext.get().partitionId() % 64, np.int32)
            found = pa.array(ids, mask=ids == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(part), found, pa.array(ties), pa.array(scores)], ["number", "part", "doc_id", "tie", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` highest-scoring documents.

    ``once`` counts an item's repeated terms once; else a term counts as often as it stands there.
    ``docs`` is read once for the statistics and once a block of items.  Ids are integers.
    """
    spark = docs.sparkSession
    kind, own = docs.schema[id_col].dataType, items.schema[item_col].dataType
    texts = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    read = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    schema = f"item_id {own.simpleString()}, rank int, doc_id {kind.simpleString()}, score long"
    with temporary(spark):
        stats = materialize(statistics(docs, text_col), "term-counts")
        totals = stats.where("term IS NULL").first()
        if totals is None or not totals["terms"]:
            return spark.createDataFrame([], schema)
        entries = read.mapInArrow(_item_terms, f"item_id {own.simpleString()}, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))
        weight = F.floor(1000 * F.log((2 * F.lit(totals["docs"]) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
        matrix = entries.join(stats.where("term IS NOT NULL").select("term", weight.alias("weight")), "term")
        matrix = materialize(matrix, "item-terms")
        blocks = -(-matrix.count() // block_terms)
        of_block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
        results = []
        for b in range(blocks):
            rows = matrix.where(of_block == b).toPandas().sort_values(["item_id", "term"], na_position="last", kind="stable").reset_index(drop=True)  # about block_terms rows
            if not len(rows):
                continue
            terms, cols = np.unique(rows["term"].to_numpy(str), return_inverse=True)
            weights = np.zeros(len(terms), np.int64)
            weights[cols] = rows["weight"].to_numpy(np.int64)
            names = rows["item_id"].drop_duplicates()
            ends = np.append(names.index.to_numpy(), len(rows))
            times = np.ones(len(rows), np.int64) if once else rows["times"].to_numpy(np.int64)
            block = spark.sparkContext.broadcast(ItemBlock(pa.array(terms, pa.large_string()), weights, ends, cols.astype(np.int64), times, totals["docs"], totals["terms"]))
            found = texts.mapInArrow(_searching(block, k), "number int, part int, doc_id long, tie long, score long")
            best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie"]
            for by in (["number", "part"], ["number"]):  # first among the tasks of a part, then among the parts
                found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best_first))).where(F.col("rank") <= k)
            numbered = spark.createDataFrame([(None if x != x else int(x), i) for i, x in enumerate(names)], f"item_id {own.simpleString()}, number int")
            results.append(materialize(found.join(numbered, "number").select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score"), "ranked", keep=True))
    out = spark.createDataFrame([], schema)
    for part in results:
        out = out.unionByName(part)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the ten best of all ``documents`` for each ``benchmark`` item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH doc AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
totals AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM doc WHERE len(ts) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM doc) GROUP BY doc_id, n, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term), totals GROUP BY item_id, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
