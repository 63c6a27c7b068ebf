"""Line dedup over levelled sorted runs of line hashes.

A *run* holds ``(h1, h2, n_docs, max_doc)`` of lines, sorted by the 128-bit line hash and
bucketed by it: one sorted file a bucket.  Every batch of documents is merge-anti-joined with
the live runs.  Lines that no run has become a run of level 0; what the batch adds to lines
met before goes to the *updates*, bucketed alike.  When a level holds ``fanout`` runs they are
merged into one run of the next level.  A line so stands in one run only, and joins, merges
and the final count read bucket beside bucket: after a batch's own aggregation nothing is
shuffled again.

Defined cases: a null or empty text is one empty line; lines shorter than ``min_chars`` code
points after stripping are never dropped; a line repeated within a document counts once, and
so do rows that share a doc_id, which fall under one decision; a row without a doc_id neither
counts nor loses lines; columns besides id and text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernloom.llm.batches import small_batches
from fernloom.scratch import materialize, remove, scratch_path, temporary

#: Fixed value: the white space stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_digest(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, None for a line too short to count."""
    if len(line) < min_chars:
        return None
    key = line.strip(BLANKS)
    # bytes.lower() folds A-Z only
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def line_hashes(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and distinct long line: ``(doc_id, h1, h2)``."""
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, h1 long, h2 long"

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch.column(1):
                digests = {line_digest(line, min_chars) for line in (text.as_py() or "").split("\n")}
                digests.discard(None)
                found.extend(digests)
                counts.append(len(digests))
            pairs = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            at = np.repeat(np.arange(batch.num_rows), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "h1", "h2"]
            )

    return own.mapInArrow(explode, schema)


class LineRuns:
    """Levelled sorted runs and updates as bucketed tables in the shared folder; call ``drop`` when done.

    A level is one table whose buckets hold a sorted file per run.
    """

    KEY = ["h1", "h2"]

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, int]] = []  # table and number of runs; an empty name where a level is empty
        self.updates, self.paths = "", {}

    def _append(self, rows: DataFrame, table: str) -> str:
        table = table or f"fernloom_lines_{uuid.uuid4().hex}"
        self.paths.setdefault(table, scratch_path(self.spark, "lines"))
        rows.write.format("parquet").bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).mode("append").option("path", self.paths[table]).saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.paths.pop(table))

    def drop(self) -> None:
        """Remove all tables."""
        for table in list(self.paths):
            self._drop(table)
        self.levels, self.updates = [], ""

    def live(self) -> list[DataFrame]:
        return [self.spark.table(t) for t, n in self.levels if n]

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append(("", 0))
        table, n = self.levels[level]
        self.levels[level] = (self._append(run, table), n + 1)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose line is in no run yet: a merge anti-join per level."""
        for run in self.live():
            batch = batch.join(run.select(*self.KEY), self.KEY, "left_anti")
        return batch

    def add(self, hashes: DataFrame) -> None:
        """Take in one batch of ``(doc_id, h1, h2)``, then merge full levels."""
        batch = hashes.groupBy(*self.KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if self.live():
            batch = materialize_table(self, batch)
            seen = [batch.join(run.select(*self.KEY), self.KEY, "left_semi") for run in self.live()]
            for rows in seen:  # a line is in one run, so in one of these
                self.updates = self._append(rows, self.updates)
        self._push(self.unseen(batch), 0)
        for level in range(64):
            if level >= len(self.levels) or self.levels[level][1] < self.fanout:
                break
            old = self.levels[level][0]
            self._push(merged(self.spark.table(old)), level + 1)
            self.levels[level] = ("", 0)
            self._drop(old)

    def frequent(self, min_docs: int) -> DataFrame:
        """``(h1, h2, max_doc)`` of the lines held by at least ``min_docs`` documents."""
        more = merged(self.spark.table(self.updates)).select(*self.KEY, F.col("n_docs").alias("n2"), F.col("max_doc").alias("m2")) if self.updates else None
        out = None
        for run in self.live():
            if more is not None:
                run = run.join(more, self.KEY, "left").select(*self.KEY, (F.col("n_docs") + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m2").alias("max_doc"))
            run = run.where(F.col("n_docs") >= min_docs).select(*self.KEY, "max_doc")
            out = run if out is None else out.unionAll(run)
        return out


def merged(rows: DataFrame) -> DataFrame:
    """One row per line: counts added, the largest id; bucketed input is merged in place."""
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))


def materialize_table(runs: LineRuns, batch: DataFrame) -> DataFrame:
    """The batch's lines as a bucketed table of their own, read twice and dropped with the runs."""
    return runs.spark.table(runs._append(batch, ""))


def counted_once(hashes: DataFrame, ids: DataFrame) -> DataFrame:
    """``hashes`` of rows with an id, one row per id and line where rows share an id."""
    hashes = hashes.where("doc_id IS NOT NULL")
    repeated = materialize(ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return hashes
    once = hashes.join(repeated, "doc_id", "left_semi").dropDuplicates()
    return hashes.join(repeated, "doc_id", "left_anti").unionByName(once)


GONE_ID, GONE = "gone_id", "gone"


def _free(name: str, taken: list[str]) -> str:
    """``name`` with underscores before it until no column has it (names ignore case)."""
    used = {c.lower() for c in taken}
    while name in used:
        name = f"_{name}"
    return name


DEDUPED = "n_lines long, n_dropped long, text string"


def _cutting(at: int, min_chars: int):
    """Replaces the last column (dropped hashes) by struct(n_lines, n_dropped, text) of the text at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone_counts, texts = [], [], []
            for text, gone in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text, gone = text.as_py() or "", set(gone.as_py() or ())
                lines = text.split("\n")
                kept = [x for x in lines if line_digest(x, min_chars) not in gone] if gone else lines
                counts.append(len(lines))
                gone_counts.append(len(lines) - len(kept))
                texts.append("\n".join(kept) if gone else text)
            out = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(texts, pa.string())], ["n_lines", "n_dropped", "text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], [*batch.schema.names[:-1], "deduped"])

    return run


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` plus struct column ``deduped`` (n_lines, n_dropped, text without the dropped lines).

    The hashes are computed once and written by batch.  Only 16-byte hashes meet in a
    shuffle per line, and each text moves once, beside its list of dropped hashes.
    """
    spark, docs = docs.sparkSession, docs.drop("deduped")  # a column of this name is replaced
    batch_of: Column = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    with temporary(spark):
        found = line_hashes(docs, min_chars, id_col, text_col).withColumn("batch", batch_of)
        hashes = counted_once(materialize(found, "lines", ["batch"]), docs.select(F.col(id_col).alias("doc_id")))
        runs = LineRuns(spark, fanout)
        try:
            for b in range(batches):
                runs.add(hashes.where(F.col("batch") == b).drop("batch"))
            frequent = materialize(runs.frequent(min_docs), "frequent")
        finally:
            runs.drop()
        gone = (
            hashes.drop("batch")
            .join(frequent, ["h1", "h2"])  # two plain exchanges: AQE can split a hot line
            .where(F.col("doc_id") != F.col("max_doc"))
            .groupBy("doc_id")
            .agg(F.collect_set(F.concat(_le_bytes("h1"), _le_bytes("h2"))).alias("gone"))
        )
        gone = materialize(gone.select(F.col("doc_id").alias(GONE_ID), F.col("gone").alias(GONE)), "gone", keep=True)
    # columns of the documents may have any name: these two are renamed until they clash with none
    gone_id, gone_list = _free(GONE_ID, docs.columns), _free(GONE, docs.columns)
    gone = gone.toDF(gone_id, gone_list)
    joined = docs.join(gone, docs[id_col] == gone[gone_id], "left").select(*[docs[c] for c in docs.columns], gone_list)
    schema = T.StructType([*docs.schema.fields, T.StructField("deduped", T.StructType.fromDDL(DEDUPED))])
    return joined.mapInArrow(_cutting(docs.columns.index(text_col), min_chars), schema)


def _le_bytes(name: str) -> Column:
    """A long as 8 little-endian bytes, as the hash function returned them."""
    big = F.unhex(F.lpad(F.hex(F.col(name)), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2(F.encode("deduped.text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, i, list_extract(ls, i) AS line, len(ls) AS n_lines,
         translate(trim(list_extract(ls, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), frequent AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, CAST(max(l.n_lines) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (f.key IS NOT NULL AND l.doc_id <> f.max_doc) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i)
              FILTER (NOT (f.key IS NOT NULL AND l.doc_id <> f.max_doc)), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY l.doc_id
"""
