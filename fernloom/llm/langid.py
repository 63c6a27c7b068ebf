"""Language identification by words first, with back-off to shorter character n-grams.

A word is a run of letters and marks that begins with a letter, lower-cased; training and
prediction cut texts with the same pattern.  Training counts words per language over a bounded
sample of labelled documents (about ``sample_docs``, evenly over the languages: the rows whose
hash of id and text falls in their language's share).  The model keeps of each language its
``max_words`` most frequent words and, for n from ``max_n`` down to 1, its ``max_ngrams`` most
frequent character n-grams (words padded with ``^`` and ``$``), so a rare language keeps its own;
each has its log frequency per language.  Labels beyond the ``max_langs`` most frequent ones are not
learned.  So the model's size is bounded by parameters and it can be broadcast.

Prediction: a known word adds its per-language log frequency.  An unseen word adds the
mean log frequency of its known n-grams of the longest n that has any, plus a penalty a
step of back-off.  The score is the winner's share of the softmax of the sums; the fit is
the winner's mean log frequency per word, so it does not grow with the text and is low for
noise and for languages never learned.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and a null fit;
rows with a null language or null text never train; ties go to the alphabetically first
language; an empty training set predicts ``und`` for all; one language predicts it with score
1; extra columns are ignored or passed through; an empty table gives an empty result.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fernloom.llm.batches import bounded_slices, small_batches
from fernloom.scratch import materialize

UNDETERMINED = "und"
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str | None) -> list[str]:
    """The words of a text, lower-cased, in its order."""
    return WORD.findall((text or "").lower())


#: Back-off vectors a worker keeps; beyond it they are worked out anew.
CACHED_WORDS = 100_000


@dataclass
class Table:
    """Terms and their log frequencies per language, one row a term."""

    terms: list[str]
    logs: np.ndarray

    def index(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}


@dataclass
class Model:
    """Bounded tables of log frequencies of words and of n-grams by n."""

    langs: list[str]
    words: Table
    grams: dict[int, Table]
    unseen: np.ndarray
    penalty: float = 0.5


class Scorer:
    """One worker's view of a model: word -> row of a matrix, unseen words added as they come."""

    def __init__(self, model: Model):
        self.model = model
        self.gram_index = {n: t.index() for n, t in model.grams.items()}
        self._reset()

    def _reset(self) -> None:
        self.index = self.model.words.index()
        self.logs = self.model.words.logs

    def _add(self, words: list[str]) -> None:
        """Back-off vectors of unseen words: the mean of their known n-grams of the longest n that has any."""
        out = np.tile(self.model.unseen, (len(words), 1))
        todo = np.arange(len(words))
        padded = [f"^{w}$" for w in words]
        for step, n in enumerate(sorted(self.gram_index, reverse=True)):
            get, logs = self.gram_index[n].get, self.model.grams[n].logs
            counts = [max(0, len(padded[i]) - n + 1) for i in todo]
            rows = np.array([get(padded[i][k : k + n], -1) for i, c in zip(todo, counts, strict=True) for k in range(c)], np.int64)
            owner = np.repeat(np.arange(len(todo)), counts)[rows >= 0]
            rows = rows[rows >= 0]
            known = np.bincount(owner, minlength=len(todo))
            sums = np.stack([np.bincount(owner, logs[rows, x], len(todo)) for x in range(logs.shape[1])], axis=1)
            has = known > 0
            out[todo[has]] = sums[has] / known[has, None] - self.model.penalty * step
            todo = todo[~has]
            if not len(todo):
                break
        self.index.update(zip(words, range(len(self.logs), len(self.logs) + len(words)), strict=True))
        self.logs = np.concatenate([self.logs, out])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        """Language, score and fit of each text."""
        found = [words_of(t) for t in texts]
        if not self.model.langs:
            return [(UNDETERMINED, 0.0, None)] * len(texts)
        if len(self.index) > len(self.model.words.terms) + CACHED_WORDS:
            self._reset()
        new = sorted(set().union(*found) - self.index.keys())
        if new:
            self._add(new)
        out, get = [], self.index.__getitem__
        for words in found:
            if not words:
                out.append((UNDETERMINED, 0.0, None))
                continue
            total = self.logs[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())  # the first of equals
            out.append((self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum()), float(total[best]) / len(words)))
        return out


def sampled(labelled: DataFrame, sample_docs: int, max_langs: int = 256) -> DataFrame:
    """The bounded sample, about ``sample_docs`` rows: of each language the rows whose hash falls in its
    share, so a rare language is taken whole; it stays distributed."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs)
    rows = {r["lang"]: r["n"] for r in sizes.collect()}
    if not rows:
        return labelled
    left, quota = sample_docs, {}
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):  # what small languages leave goes to larger ones
        quota[lang] = min(n, left // (len(rows) - k))
        left -= quota[lang]
    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, int(quota[lang] / n * (1 << 20)))])
    return labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")])


def _cut(n: int):
    return lambda i: F.substr(F.col("p"), i, F.lit(n))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts by language of each batch of ``(text, lang)``."""
    for batch in batches:
        seen: Counter = Counter()
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            own = lang.as_py()
            seen.update((w, own) for w in words_of(text.as_py()))
        w, lang = ([k[i] for k in seen] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(lang, pa.string()), pa.array(seen.values(), pa.int64())], ["w", "lang", "n"])


def train(labelled: DataFrame, sample_docs: int = 8_000, max_words: int = 30_000, max_ngrams: int = 20_000, max_n: int = 5, max_langs: int = 256) -> Model:
    """Fit on ``(doc_id, text, lang)``; counts run in Spark, only the bounded tables reach the driver."""
    rows = sampled(labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang"), sample_docs, max_langs)
    words = small_batches(rows).select("text", "lang").mapInArrow(_counted, "w string, lang string, n long")
    counts = materialize(words.groupBy("w", "lang").agg(F.sum("n").alias("n")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)]

    def table(frame: DataFrame, most: int) -> Table:
        """Log frequencies of each language's most frequent terms, smoothed by half a count."""
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "w"))
        own = frame.withColumn("place", place).where(F.col("place") <= most).select("w").distinct()
        kept = frame.join(own, "w").groupBy("w").agg(F.sum("n").alias("all"), *by_lang).orderBy(F.col("all").desc(), "w").drop("all").toPandas()
        n = kept.drop(columns="w").to_numpy(np.float64)
        return Table(kept["w"].tolist(), np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * max(len(n), 1))).reshape(len(n), len(langs)))

    frequent = table(counts, max_words)
    padded = counts.select(F.concat(F.lit("^"), "w", F.lit("$")).alias("p"), "lang", "n")
    parts = [F.transform(F.sequence(F.lit(1), F.length("p") - n + 1), _cut(n)) for n in range(1, max_n + 1)]
    cut = F.flatten(F.array(*[F.when(F.length("p") >= n, x).otherwise(F.array().cast("array<string>")) for n, x in enumerate(parts, 1)]))
    each = materialize(padded.select(F.explode(cut).alias("w"), "lang", "n").groupBy("w", "lang").agg(F.sum("n").alias("n")), "ngrams")
    grams = {n: table(each.where(F.length("w") == n), max_ngrams) for n in range(max_n, 0, -1)}
    floor = np.array([math.log(0.5 / (totals[x] + 1)) for x in langs])
    return Model(langs, frequent, grams, floor)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``fit``; texts go to the workers once and come back as they were."""
    docs = small_batches(docs).drop("lang_pred", "score", "fit")  # columns of these names are replaced
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for part in bounded_slices(whole, at, 1 << 20):
                langs, scores, fits = zip(*scorer.predict(part.column(at).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())], [*whole.schema.names, "lang_pred", "score", "fit"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """The rows that never train: CRC32 of the id as text, modulo 5, is 0 (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return with_language(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text", "fit")
