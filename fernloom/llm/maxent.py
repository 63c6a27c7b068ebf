"""A hashed maximum-entropy language model with a class-factored softmax.

The probability of a token is P(class | context) * P(unit | class, previous class) * P(word | unit).

* A *word* is a run of non-blank bytes, A-Z lower-cased; every text ends with one end token.
  Words are counted over all training texts; the counts stay a table.
* A *unit* is a word of its own for the most frequent words (at most ``max_words``, so the list
  can be broadcast), and for all others the hash of their last three bytes.  Inside such a unit
  a word counted c times has (c + 1) shares, and one share is left for unknown words.
* A *class* holds the units that stand most tellingly often after the same very frequent word.
* The class softmax sums weights of three hashed features: the previous unit, the unit before it
  (a skip over the previous one) and both together.  The unit softmax inside a class has the log
  frequency and, for the most frequent units, a hashed weight with the previous word's class; its
  normalisers are one small table.

Training takes ``rounds`` gradient steps; the documents are dealt over the rounds, so all of them
are read once.  In a round every task adds up the gradient of its documents, blocks of it are
summed in two shuffles, and the step is scaled by the feature's expected counts.  The model's
arrays are bounded by parameters, whatever the corpus.  Scoring sends documents through sparse
numpy batches (three weight rows a token); counts of words outside the list come by a join.

Defined cases: a null or empty text is one end token; a null id counts as empty text in the
split; rows that repeat train and are scored apiece; without training texts every word is
unknown and both scores fall to the uniform share; other columns are ignored; an empty table
gives an empty result.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernloom.llm.batches import Pooled, bounded_slices, small_batches, strings, token_cutter
from fernloom.scratch import materialize, temporary

#: Bytes inside words (all but six blanks), and A-Z folded.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_cut = token_cutter(_IN_WORD, _FOLD)

BLOCK_BYTES = 4 << 20
#: Tokens whose weight rows are in memory together.
CHUNK = 1 << 15
#: Values of the gradient in one shuffled row.
GRADIENT_BLOCK = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of integers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte lengths, rows and bytes of all tokens of a column; each row's last token is its end, of no bytes."""
    lengths, row, data = _cut(texts)
    at = np.arange(len(lengths)) + row  # every earlier row has an end before
    ends = np.cumsum(np.bincount(row, minlength=len(texts)) + 1) - 1
    all_lengths, all_rows = np.zeros(len(lengths) + len(texts), np.int64), np.empty(len(lengths) + len(texts), np.int64)
    all_lengths[at], all_rows[at], all_rows[ends] = lengths, row, np.arange(len(texts))
    return all_lengths, all_rows, data


def tails(ends: np.ndarray, lengths: np.ndarray, data: np.ndarray, buckets: int) -> np.ndarray:
    """Hash of the last three bytes of tokens that end at ``ends`` in ``data``."""
    code = np.zeros(len(lengths), np.uint64)
    padded = data if len(data) else np.zeros(1, np.uint8)
    for back in (1, 2, 3):
        byte = np.where(lengths >= back, padded[np.clip(ends - back, 0, len(padded) - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        code = code * np.uint64(257) + byte
    return (mix(code) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """Arrays bounded by parameters: units, classes, weights and normalisers."""

    words: pa.Array  # the frequent words: units 0 up
    tail_units: int
    shares: np.ndarray  # of each unit: counts plus one a word, one more in a tail unit
    class_of: np.ndarray  # of each unit, and of a text's start
    log_prior: np.ndarray  # of each class
    log_share: np.ndarray  # of each unit in its class
    weights: np.ndarray  # [3 * buckets, classes]
    pairs: np.ndarray  # weights of (previous class, unit), hashed
    rich: int  # units below it have such weights
    log_z: np.ndarray  # [previous class, class]
    train_tokens: int = 0
    distinct: int = 0

    @property
    def start(self) -> int:
        return len(self.shares)

    @property
    def buckets(self) -> int:
        return len(self.weights) // 3

    def units(self, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The unit of each token."""
        code = pc.index_in(strings(lengths, data), value_set=self.words)
        units = pc.fill_null(code, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = np.flatnonzero(units < 0)
        units[rare] = len(self.words) + tails(np.cumsum(lengths)[rare], lengths[rare], data, self.tail_units)
        return units

    def slots(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Places of the pair weights of previous classes and units."""
        return (mix(before.astype(np.int64) * (1 << 40) + units) % np.uint64(len(self.pairs))).astype(np.int64)

    def features(self, units: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Three feature rows a token, and the class before it."""
        one, two = (np.full(len(units), self.start, np.int64) for _ in range(2))
        one[1:] = np.where(row[1:] == row[:-1], units[:-1], self.start)
        two[2:] = np.where(row[2:] == row[:-2], units[:-2], self.start)
        k = np.uint64(self.buckets)
        each = np.arange(self.start + 1)
        alone = [(mix(x) % k).astype(np.int64) for x in (each, each + (1 << 41))]
        both = (mix(one * (1 << 21) + two + (1 << 62)) % k).astype(np.int64)
        return np.stack([alone[0][one], alone[1][two] + self.buckets, both + 2 * self.buckets]), self.class_of[one]

    def class_shares(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unnormalised shares of every class in each context, and their sums.

        Steps of training bound the weights, so the powers need no shift against overflow.
        """
        shares = self.weights.take(rows[0], axis=0)
        shares += self.weights.take(rows[1], axis=0)
        shares += self.weights.take(rows[2], axis=0)
        shares += self.log_prior.astype(np.float32)
        np.exp(shares, out=shares)
        return shares, shares @ np.ones(shares.shape[1], np.float32)

    def unit_logs(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Log probability of each unit in its class."""
        own = self.log_share[units] - self.log_z[before, self.class_of[units]]
        rich = np.flatnonzero(units < self.rich)
        own[rich] += self.pairs[self.slots(before[rich], units[rich])]
        return own

    def normalise(self) -> None:
        """Work out the normalisers of the unit softmax anew."""
        classes, n = len(self.log_prior), np.arange(self.rich)
        rest = np.bincount(self.class_of[self.rich : -1], np.exp(self.log_share[self.rich :]), classes)
        for before in range(classes):
            own = np.exp(self.log_share[: self.rich] + self.pairs[self.slots(np.full(self.rich, before), n)])
            with np.errstate(divide="ignore"):
                self.log_z[before] = np.log(rest + np.bincount(self.class_of[: self.rich], own, classes))


def held_out(doc_id: Column) -> Column:
    """The rows that never train: CRC32 of the id as text, modulo 7, is 2 (a null id counts as empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pool = Pooled(["word"], ["n"])

    def out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part["word"].cast(pa.binary()), part["n"]], ["word", "n"])

    for whole in batches:
        for batch in bounded_slices(whole, 0, BLOCK_BYTES):
            lengths, _, data = words_of(batch.column(0))
            counts = strings(lengths, data).value_counts()
            yield from out(pool.add(pa.table({"word": counts.field(0), "n": counts.field(1)})))
    yield from out(pool.rest())


def counted(texts: DataFrame) -> DataFrame:
    """``(word binary, n)`` of all tokens; the empty word is the end."""
    return texts.mapInArrow(_counting, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words above the lowest frequency that leaves at most ``most``; frequencies are taken in steps of an eighth of a power of two."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect()  # at most 8 * 63 rows
    least, room = 8 * 64, most
    for r in sizes:
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    return counts.withColumn("frequent", step >= least)


def _tail_shares(tail_units: int):
    """Counts plus one of each word, added by tail unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(tail_units, np.int64)
        for batch in batches:
            words = batch.column(0)
            lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
            np.add.at(sums, tails(np.cumsum(lengths), lengths, data, tail_units), batch.column(1).to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tail_units)), pa.array(sums)], ["tail", "shares"])

    return run


def _following(shared, tops: int):
    """How often each unit follows each of the ``tops`` most frequent units, gathered inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pool = shared.value, Pooled(["pair"], ["n"])
        for whole in batches:
            for batch in bounded_slices(whole, 0, BLOCK_BYTES):
                lengths, row, data = words_of(batch.column(0))
                units = model.units(lengths, data)
                after = np.flatnonzero((row[1:] == row[:-1]) & (units[:-1] < tops)) + 1
                pairs, n = np.unique(units[after] * tops + units[after - 1], return_counts=True)
                yield from pool.add(pa.table({"pair": pairs, "n": n.astype(np.int64)}))
        yield from pool.rest()

    return run


def _classes(texts: DataFrame, model: Model, tops: int) -> np.ndarray:
    """The class of each unit: the frequent word it follows most above chance, or the last class."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    pairs = texts.mapInArrow(_following(shared, tops), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.select((F.col("pair") / tops).cast("long").alias("unit"), (F.col("pair") % tops).cast("int").alias("top"), "n"), "following")
    totals = {r["top"]: r["n"] for r in pairs.groupBy("top").agg(F.sum("n").alias("n")).collect()}
    out = np.full(len(model.shares) + 1, tops, np.int64)
    if not totals:
        return out
    whole = sum(totals.values())
    by_top = [F.coalesce(F.sum(F.when(F.col("top") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in totals]
    told = pairs.groupBy("unit").agg(F.sum("n").alias("all"), *by_top)

    def above(top: int) -> Column:
        chance = F.col("all") * (totals[top] / whole)
        return F.struct(((F.col(f"n{top}") - chance) / F.sqrt(chance + 1)).alias("by"), F.lit(-top).alias("top"))

    told = told.select("unit", (-F.array_max(F.array(*[above(i) for i in totals]))["top"]).alias("class")).toPandas()  # a row a unit
    out[told["unit"].to_numpy()] = told["class"].to_numpy()
    return out


@dataclass
class Gradient:
    """Sums over tokens: observed less expected classes, feature and pair counts, classes after classes."""

    classes: np.ndarray
    seen: np.ndarray
    pairs: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, model: Model, flat: np.ndarray | None = None) -> "Gradient":
        shapes = [model.weights.shape, (len(model.weights),), model.pairs.shape, model.log_z.shape]
        sizes = [math.prod(s) for s in shapes]
        flat = np.zeros(sum(sizes)) if flat is None else flat
        return cls(*[x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes, strict=True)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.classes, self.seen, self.pairs, self.after)])

    def add(self, model: Model, units: np.ndarray, row: np.ndarray) -> None:
        """Add a batch of tokens, a chunk at a time."""
        rows, before = model.features(units, row)
        own = model.class_of[units]
        n_classes, k = self.classes.shape[1], model.buckets
        sums_by_class = np.zeros((3, n_classes, k))
        for start in range(0, len(units), CHUNK):
            part = slice(start, start + CHUNK)
            error, sums = model.class_shares(rows[:, part])
            error *= (-1 / sums)[:, None]
            error[np.arange(len(error)), own[part]] += 1
            by_class = np.ascontiguousarray(error.T, dtype=np.float64)
            for i in range(3):
                local = rows[i, part] - i * k
                for c in range(n_classes):
                    sums_by_class[i, c] += np.bincount(local, by_class[c], k)
        self.classes += sums_by_class.transpose(0, 2, 1).reshape(self.classes.shape)
        self.seen += np.bincount(rows.ravel(), minlength=len(self.seen))
        self.after += np.bincount(before * n_classes + own, minlength=n_classes**2).reshape(n_classes, n_classes)
        rich = np.flatnonzero(units < model.rich)
        self.pairs += np.bincount(model.slots(before[rich], units[rich]), minlength=len(self.pairs))


def _gradients(shared):
    """One gradient a task, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total, used = Gradient.of(model), False
        for whole in batches:
            for batch in bounded_slices(whole, 0, BLOCK_BYTES):
                lengths, row, data = words_of(batch.column(0))
                total.add(model, model.units(lengths, data), row)
                used = used or len(row) > 0
        if used:
            flat = total.flat().astype(np.float32)
            cuts = [flat[a : a + GRADIENT_BLOCK].tobytes() for a in range(0, len(flat), GRADIENT_BLOCK)]
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([part] * len(cuts), pa.int32()), pa.array(cuts, pa.binary())], ["block", "part", "sums"])

    return run


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the same number and part, added up as they come."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for block, part, values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sums[block, part] = sums.get((block, part), 0) + np.frombuffer(values, np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], ["block", "part", "sums"]
        )


def gradient(texts: DataFrame, model: Model) -> Gradient:
    """The gradient over all ``texts``: summed by task, then by (block, part), then by block."""
    schema = "block int, part int, sums binary"
    shared = texts.sparkSession.sparkContext.broadcast(model)
    parts = texts.mapInArrow(_gradients(shared), schema)
    for by in (["block", "part"], ["block"]):
        parts = parts.repartition(*by).mapInArrow(_summing, schema)
        parts = parts.withColumn("part", F.lit(0))
    flat = Gradient.of(model).flat()
    for r in parts.collect():  # the model's size
        flat[r["block"] * GRADIENT_BLOCK : (r["block"] + 1) * GRADIENT_BLOCK] += np.frombuffer(r["sums"], np.float32)
    return Gradient.of(model, flat)


def step(model: Model, grad: Gradient, damping: float = 5.0, largest: float = 1.5) -> None:
    """One gradient step; each weight's is scaled by the count its feature is expected to have."""
    if not grad.after.any():
        return
    prior = np.exp(model.log_prior)
    scaled = grad.classes / (grad.seen[:, None] * prior + damping)
    model.weights += (np.clip(scaled, -1.0, largest) / 3).astype(np.float32)  # three weights meet in a token
    classes = len(prior)
    expected, units = np.zeros(len(model.pairs)), np.arange(model.rich)
    for before in range(classes):
        b = np.full(model.rich, before)
        p = np.exp(model.unit_logs(b, units)) * grad.after[before, model.class_of[: model.rich]]
        expected += np.bincount(model.slots(b, units), p, len(expected))
    model.pairs += np.clip((grad.pairs - expected) / (expected + damping), -1.0, largest)
    model.normalise()


@dataclass
class Trained:
    """A model, its table of counts and its totals."""

    model: Model
    counts: DataFrame  # (word binary, n, frequent)


def train(docs: DataFrame, text_col: str = "text", max_words: int = 1 << 17, tail_units: int = 1 << 12, tops: int = 31, buckets: int = 1 << 12, pair_slots: int = 1 << 18, rich: int = 1 << 12, rounds: int = 4) -> Trained:
    """Fit on all rows of ``docs``; every parameter but ``rounds`` bounds an array of the model."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(text_col).alias("text"))
    with temporary(spark):
        counts = materialize(_frequent(materialize(counted(texts), "counts"), max_words), "word-counts", keep=True)
        totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        own = counts.where("frequent").toPandas()  # at most max_words rows
        own = own.sort_values(["n", "word"], ascending=[False, True])
        words = pa.array([bytes(w) for w in own["word"]], pa.large_binary()).cast(pa.large_string())
        tail = counts.where("NOT frequent").select("word", "n").mapInArrow(_tail_shares(tail_units), "tail long, shares long").groupBy("tail").agg(F.sum("shares").alias("shares")).toPandas()
        shares = np.concatenate([own["n"].to_numpy(np.int64) + 1, np.ones(tail_units, np.int64)])
        shares[len(own) + tail["tail"].to_numpy(np.int64)] += tail["shares"].to_numpy(np.int64)
        model = Model(words, tail_units, shares, np.zeros(len(shares) + 1, np.int64), np.zeros(1), np.zeros(len(shares)), np.zeros((3, 1), np.float32), np.zeros(pair_slots), min(rich, len(own)), np.zeros((1, 1)), totals["n"], totals["v"])
        model.class_of = _classes(texts, model, min(tops, len(own)) or 1)
        used, model.class_of = np.unique(model.class_of, return_inverse=True)  # classes are numbered without gaps
        mass = np.bincount(model.class_of[:-1], shares, len(used))
        with np.errstate(divide="ignore"):
            model.log_prior = np.where(mass > 0, np.log(mass / mass.sum()), -1e9)
        model.log_share = np.log(shares / mass[model.class_of[:-1]])
        model.weights, model.log_z = np.zeros((3 * buckets, len(used)), np.float32), np.zeros((len(used), len(used)))
        model.normalise()
        turn = F.pmod(F.xxhash64(*[c for c in docs.columns if c != text_col], text_col), F.lit(rounds))
        for r in range(rounds):
            step(model, gradient(small_batches(docs).where(turn == r).select(F.col(text_col).alias("text")), model))
    return Trained(model, counts)


SCORED = "n_tokens long, known long, log_counts double, log_model double, rare array<struct<word binary, n long>>"


def token_logs(model: Model, units: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log probability of the class and unit of each token, and of one share in a tail unit."""
    rows, before = model.features(units, row)
    own, out = model.class_of[units], np.empty(len(units))
    for start in range(0, len(units), CHUNK):
        part = slice(start, start + CHUNK)
        shares, sums = model.class_shares(rows[:, part])
        out[part] = np.log(shares[np.arange(len(shares)), own[part]] / sums)
    out += model.unit_logs(before, units)
    return out - np.where(units >= len(model.words), np.log(model.shares[units]), 0.0)


def _scoring(shared, at: int):
    """Replaces the text by what can be scored without the counts of rare words, and those words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        listed = len(model.words)
        for whole in batches:
            for batch in bounded_slices(whole, at, BLOCK_BYTES):
                lengths, row, data = words_of(batch.column(at))
                units, n = model.units(lengths, data), batch.num_rows
                logs = np.bincount(row, token_logs(model, units, row), n)
                known = units < listed
                log_counts = np.bincount(row[known], np.log10(model.shares[units[known]]), n).astype(np.float64)  # whole numbers if nothing is listed
                flat = strings(lengths, data).filter(pa.array(~known)).dictionary_encode()
                size = max(len(flat.dictionary), 1)
                cells, times = np.unique(row[~known] * size + flat.indices.to_numpy().astype(np.int64), return_counts=True)
                ends = np.searchsorted(cells, np.arange(n + 1) * size).astype(np.int32)
                rare = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(cells % size)).cast(pa.string()).cast(pa.binary()), pa.array(times.astype(np.int64))], ["word", "n"])
                made = [pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[known], minlength=n)), pa.array(log_counts, pa.float64()), pa.array(logs / math.log(10), pa.float64()), pa.ListArray.from_arrays(pa.array(ends), rare)]
                names = [x for i, x in enumerate(whole.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i != at], *made], [*names, "n_tokens", "known", "log_counts", "log_model", "rare"])

    return run


def score(docs: DataFrame, trained: Trained, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_tokens``, ``n_known``, ``base_score`` and ``score``.

    Words outside the model's list are counted by document and joined with the table of counts;
    their rows carry a row number that is fixed by writing them.
    """
    spark, model = docs.sparkSession, trained.model
    docs = small_batches(docs.drop("n_tokens", "n_known", "base_score", "score"))
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)
    own = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col], SCORED])
    with temporary(spark):
        part = materialize(docs.mapInArrow(_scoring(shared, at), schema).withColumn("_row", F.monotonically_increasing_id()), "scored", keep=True)
        pairs = part.select("_row", F.explode("rare").alias("w")).select("_row", "w.word", F.col("w.n").alias("times"))
        rare = pairs.join(trained.counts.where("NOT frequent").select("word", F.col("n").alias("c")), "word")
        sums = rare.groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_logs"))
        sums = materialize(sums, "rare-scores", keep=True)
    logs = F.coalesce(F.col("_logs"), F.lit(0.0))
    uniform = F.lit(math.log10(model.train_tokens + model.distinct + 1))
    return part.join(sums, "_row", "left").select(
        *own,
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("log_counts") + logs - F.col("n_tokens") * uniform).alias("base_score"),
        (F.col("log_model") + logs).alias("score"),
    )


def op12_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    trained = train(docs.where(~held_out(F.col("doc_id"))))
    scored = score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), trained)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained.model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
