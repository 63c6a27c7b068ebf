"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

language ID -> line dedup -> SimHash near-dedup -> benchmark decontamination ->
SentencePiece encoding.  Each stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the
last return the columns of ``documents``.

Defined cases: a null or letterless text is rejected by the first stage; extra columns are
dropped; empty tables pass through empty; nulls in other columns are kept, save ``lang``,
which becomes the predicted language, and ``n_chars``, which is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.llm import decontam, langid, linededup, nearcopies, spm
from fernloom.scratch import materialize, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose best language has less of the posterior than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one clear language, go; ``lang`` is the predicted one.

    The model trains on labelled rows whose id is not held out, as in the operator's query.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    judged = langid.with_language(docs.select(COLUMNS), model)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in the one with the largest id; emptied documents go."""
    out = linededup.dedup_lines(docs.select(COLUMNS))
    text = F.col("deduped.text")
    emptied = (F.col("deduped.n_dropped") > 0) & (F.trim(F.translate(text, "\n\t\r\x0b\x0c", "     ")) == "")
    changed = out.where(~emptied).withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more over five-word shingles, the smallest doc_id stays.

    Fingerprints propose pairs by their grid, bands of minima the others; the shingle sets decide.

    Rows that repeat an id are one document; rows without an id stay while any of them
    stands for a group of its own.
    """
    docs = docs.select(COLUMNS)
    with temporary(spark):
        kept = nearcopies.near_copies(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
        kept = materialize(kept, "kept", keep=True)
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or paraphrased, go."""
    return decontam.without_contaminated(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the round trip's and the parity check's outcome."""
    return spm.encode(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded", "parity")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL expresses neither the fingerprints' components nor the latent search nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
