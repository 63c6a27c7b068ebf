"""Benchmark decontamination by latent semantic retrieval.

Three passes over the whole documents, none of which shuffles a text:

1. document frequencies of the benchmark's words, word by word, summed in Spark;
   function words, frequent in many contexts, are left out, the rest are a text's *terms*
   (a word of no item can neither meet one in a product of vectors nor in a common
   subsequence).  Repeats of one context (the words on both sides), as in copies of a text
   that holds an item, do not make a word frequent, however many rows hold them;
2. a randomised SVD of the TF-IDF passages A (non-overlapping runs of ``passage`` terms,
   unit rows): one pass forms A'A*Omega for a random Omega; its Nystroem form gives the right
   singular vectors and values.  Only features x rank numbers reach the driver.  The leading
   tenth of the directions, shared by languages and topics, are weighted down to one size;
3. every document slides windows of terms (a size for each benchmark item's length) over
   its passages' latent vectors; windows whose cosine with an item reaches ``min_cosine``
   are candidates.  A copy may lie far off in that space, where most passages share its words;
   so windows with one of the item's rarest terms, enough of them that no copy can lack all, are
   candidates too.  A candidate must share enough terms with the item (an upper bound of
   the next test), then its longest common subsequence with the item decides: at least
   ``min_lcs`` of the item's terms for a copy, at least ``min_paraphrase`` and the item's
   answer (terms of its last sentence) for a paraphrase.

Words are runs of letters and digits, case folded; signs beyond ASCII (quotes, dashes, no-break
spaces) part them as ASCII ones do, and each Han or Kana character is a word.

Benchmark items are the stated query set: they go out in blocks of bounded size, against
all documents.  Words meet by 64-bit hashes everywhere but in the SVD, where a word's column is
its place in the benchmark's sorted vocabulary modulo ``features`` (its own column up to that
many words).

Defined cases: null or empty texts match nothing; a null or wordless item, or one without an
item_id, matches nothing; an item with fewer than ``min_terms`` terms is searched as its exact
words; every row is judged by itself, so repeated rows, ids and null ids are rows of their own;
ties between items go to the higher share, then the smaller item id; extra columns are ignored
or passed through (one named ``found`` is replaced); an empty table gives an empty result and an
empty benchmark contaminates nothing.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernloom.llm.batches import small_batches

#: A-Z folded, digits and a-z kept, other ASCII a space, other bytes kept (Latin-1 capitals are folded apart,
#: other scripts' before this table is used).
FOLD = np.array([c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256)], np.uint8)
SENTENCE = re.compile(r"[.!?\n]+")
#: Bytes hashed and terms projected at once.
PIECE_BYTES, CHUNK_TERMS = 1 << 18, 1 << 14

# A word's hash is its polynomial in an odd base modulo 2**64, over random values of the bytes.
_BASE, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(1).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


@dataclass(frozen=True)
class Params:
    features: int = 1 << 13
    rank: int = 96
    passage: int = 32
    block: int = 8
    min_cosine: float = 0.12
    min_lcs: float = 0.75
    min_paraphrase: float = 0.55
    min_answer: float = 0.5
    min_terms: int = 4
    stop_share: float = 0.2
    prior_docs: int = 200
    seed: int = 7


def _hash_piece(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, and how many begin in each of the texts between ``bounds``."""
    folded = FOLD[data]
    if (data == 0xC3).any():
        capital = np.zeros(len(data), bool)
        capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[capital] += 32
    inside, alone = folded != 32, np.zeros(0, np.int64)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead) and data[lead].max() != 0xC3 or (data[lead] == 0xC2).any():
        alone = _other_scripts(data, lead, inside)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True  # a word ends with its text
    edge[alone], edge[alone + 3] = True, True  # a character of an unspaced script is a word
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.nonzero(begin)[0], np.nonzero(end)[0] + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[folded] * _UP[: len(data)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * _DOWN[first] * np.uint64(_MIX)
    return hashes, np.diff(np.searchsorted(first, bounds))


def _other_scripts(data: np.ndarray, lead: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Marks the bytes of spaces, quotes, dashes and other signs beyond ASCII as outside words; where Han and Kana characters begin."""
    lead = lead[lead + 2 < len(data)]
    first, second, third = data[lead], data[lead + 1], data[lead + 2]
    two = (first == 0xC2) & (second != 0xAA) & (second != 0xB5) & (second != 0xBA)
    three = (first == 0xE2) & (second <= 0x81) | (first == 0xE3) & (second == 0x80) | (first == 0xEF) & (second == 0xBC) & (third <= 0x8F)
    inside[lead[two]] = inside[lead[two] + 1] = False
    for k in range(3):
        inside[lead[three] + k] = False
    return lead[(first >= 0xE3) & (first <= 0xE9) & ~three]


def _bytes(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column, and the number of words of each row (null: none)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if (_bytes(column) >= 0xC4).any():  # beyond Latin-1 letters the case is folded by character
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    hashes, counts, row = [np.zeros(0, np.uint64)], np.zeros(len(column), np.int64), 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        at, end = int(offsets[row]), int(offsets[stop])
        if end - at <= PIECE_BYTES:
            found, n = _hash_piece(data[at:end], offsets[row : stop + 1] - at)
            hashes.append(found)
            counts[row:stop] = n
        else:  # one very long text, cut at white space
            while at < end:
                cut = min(end, at + PIECE_BYTES)
                if cut < end and len(spaces := np.nonzero(FOLD[data[at:cut]] == 32)[0]):
                    cut = at + int(spaces[-1]) + 1
                while cut < end and data[cut] & 0xC0 == 0x80:  # never inside a character
                    cut -= 1
                found, n = _hash_piece(data[at:cut], np.array([0, cut - at]))
                hashes.append(found)
                counts[row] += n[0]
                at = cut
        row = stop
    return np.concatenate(hashes), counts


MASK_BITS = 22
MASK_SHIFT = np.uint64(64 - MASK_BITS)


#: Distinct words a benchmark may have, 32 MB of hashes; a larger one is run in parts.
MAX_WORDS = 4_000_000


@dataclass
class Vocabulary:
    """The benchmark's words: sorted hashes, and which cells (the first 22 bits of a hash) hold one, 4 MB whatever their number."""

    words: np.ndarray
    known: np.ndarray

    @staticmethod
    def of(words: np.ndarray) -> "Vocabulary":
        known = np.zeros(1 << MASK_BITS, bool)
        known[words >> MASK_SHIFT] = True
        return Vocabulary(words, known)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the vocabulary's words among ``hashes``, and their places in the vocabulary."""
        at = np.nonzero(self.known[hashes >> MASK_SHIFT])[0]
        own = hashes[at]
        ids = np.minimum(np.searchsorted(self.words, own), max(len(self.words) - 1, 0))
        hit = self.words[ids] == own if len(self.words) else np.zeros(0, bool)
        return at[hit], ids[hit]


def vocabulary(benchmark: DataFrame) -> Vocabulary:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words_of(batch.column(0))[0]).view(np.int64))], ["word"])

    words = benchmark.select("text").mapInArrow(run, "word long").distinct().limit(MAX_WORDS + 1).toPandas()["word"].to_numpy(np.int64)
    if len(words) > MAX_WORDS:
        raise ValueError(f"the benchmark has over {MAX_WORDS} distinct words: run it in parts")
    return Vocabulary.of(np.sort(words.view(np.uint64)))


def terms_of(column: pa.Array, weights: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of a column's terms (the benchmark's words but function words), and their number by row."""
    hashes, counts = words_of(column)
    at, ids = known.find(hashes)
    heavy = weights[ids] > 0
    at, ids = at[heavy], ids[heavy]
    return hashes[at], ids, np.diff(np.searchsorted(at, np.concatenate(([0], np.cumsum(counts)))))


def _runs(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of ``size`` terms that never cross a row, and each run's row."""
    runs = -(-counts // size)
    row = np.repeat(np.arange(len(counts)), runs)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    return (np.cumsum(counts) - counts)[row] + nth * size, row


#: Groups of contexts in which a word's documents are counted.
CONTEXT_BITS = 4


def _contexts(column: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's words of the benchmark begin and end, their places and their context groups; a context is the words on both sides."""
    hashes, counts = words_of(column)
    at, ids = known.find(hashes)
    ends = np.cumsum(counts)
    cuts = np.searchsorted(at, np.concatenate(([0], ends)))
    before, after = hashes[at - 1], hashes[np.minimum(at + 1, len(hashes) - 1)]
    # a text's first word has none before it, its last one none after it
    filled = cuts[1:] > cuts[:-1]
    first, last = cuts[:-1][filled], cuts[1:][filled] - 1
    before[first[at[first] == (ends - counts)[filled]]] = 0
    after[last[at[last] == ends[filled] - 1]] = 0
    mixed = (before * np.uint64(_MIX) ^ after) * np.uint64(_BASE)
    return cuts, ids, (mixed >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)


def count_documents(cuts: np.ndarray, ids: np.ndarray, group: np.ndarray, by_word: np.ndarray, by_context: np.ndarray) -> None:
    """Adds one to each word, and to each word's context group, for every row that holds it; a row's words lie between two ``cuts``."""
    keys, edges = (ids << CONTEXT_BITS) + group, cuts.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:  # indexed sums count a repeated index once
            by_word[ids[a:b]] += 1
            by_context[keys[a:b]] += 1


def spread_frequencies(df: np.ndarray, by_context: np.ndarray) -> np.ndarray:
    """Document frequencies less what stands out in single context groups: copies of one text repeat one context."""
    if not len(df):
        return df
    usual = 4 * np.maximum(np.median(by_context, axis=1, keepdims=True), 1)
    return np.maximum(df - np.maximum(by_context - usual, 0).sum(axis=1), np.minimum(df, 1))


def document_frequencies(docs: DataFrame, known: Vocabulary) -> tuple[int, np.ndarray]:
    """Number of documents, and of those holding each of the benchmark's words in spread contexts (one row a word)."""
    shared, groups, words = docs.sparkSession.sparkContext.broadcast(known), 1 << CONTEXT_BITS, len(known.words)
    names = ["n", *(f"c{i}" for i in range(groups))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_context, n = np.zeros(words, np.int64), np.zeros(words * groups, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, 1024):
                count_documents(*_contexts(batch.column(0).slice(at, 1024), shared.value), by_word, by_context)
        some = np.nonzero(by_word)[0]
        out = np.vstack([np.column_stack([by_word[some], by_context.reshape(words, groups)[some]]), np.full((1, groups + 1), n)])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), *(pa.array(out[:, i]) for i in range(groups + 1))], ["word", *names])

    made = docs.select("text").mapInArrow(run, "word int, " + ", ".join(f"{c} long" for c in names))
    rows = made.groupBy("word").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    n_docs = int(rows.loc[rows.word < 0, "n"].sum())
    rows = rows[rows.word >= 0]
    counted = np.zeros((words, groups + 1))
    counted[rows.word.to_numpy()] = rows[names].to_numpy()
    return n_docs, spread_frequencies(counted[:, 0], counted[:, 1:])


def idf_of(n_docs: int, df: np.ndarray, p: Params) -> np.ndarray:
    """Inverse document frequencies; 0 marks function words."""
    share = df / (n_docs + p.prior_docs)
    return np.where(share > p.stop_share, 0.0, np.log((n_docs + p.prior_docs) / (df + 1.0))).astype(np.float32)


class _Gram:
    """A'A*Omega and A'1 of one task's passages A."""

    ROWS = 64

    def __init__(self, idf: np.ndarray, omega: np.ndarray, p: Params):
        self.idf, self.omega, self.p = idf, omega, p
        self.sums, self.ones, self.passages = np.zeros((p.features, omega.shape[1]), np.float64), np.zeros(p.features), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        starts, _ = _runs(counts, self.p.passage)
        if not len(starts):
            return
        w, ids = self.idf[ids], ids % self.p.features
        ends = np.append(starts[1:], len(ids))
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        w = w / np.sqrt(np.add.reduceat(w * w, starts))[owner]
        self.ones += np.bincount(ids, w, self.p.features)
        self.passages += len(starts)
        for first in range(0, len(starts), self.ROWS):
            last = min(first + self.ROWS, len(starts))
            a, b = int(starts[first]), int(ends[last - 1])
            own, column = np.unique(ids[a:b], return_inverse=True)
            rows = np.bincount((owner[a:b] - first) * len(own) + column, w[a:b], (last - first) * len(own)).reshape(-1, len(own)).astype(np.float32)
            self.sums[own] += rows.T @ (rows @ self.omega[own])


def gram_times(docs: DataFrame, idf: np.ndarray, known: Vocabulary, omega: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, float]:
    """A'A*Omega, the column sums A'1 and the number of passages, over all documents."""
    rank = omega.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((idf, omega, known))
    names = [f"y{i}" for i in range(rank + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, omega, known = shared.value
        gram = _Gram(idf, omega, p)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                gram.add(*terms_of(batch.column(0).slice(at, 1024), idf, known)[1:])
        some = np.nonzero(gram.ones)[0]
        out = np.vstack([np.column_stack([gram.sums, gram.ones])[some], np.full((1, rank + 1), gram.passages)]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), *(pa.array(out[:, i]) for i in range(rank + 1))], ["feature", *names])

    made = docs.select("text").mapInArrow(run, "feature int, " + ", ".join(f"{n} float" for n in names))
    rows = made.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # at most features + 1 rows
    total = float(rows.loc[rows.feature < 0, names[0]].sum())
    rows = rows[rows.feature >= 0]
    out = np.zeros((p.features, rank + 1))
    out[rows.feature.to_numpy()] = rows[names].to_numpy()
    return out[:, :rank], out[:, rank], total


@dataclass
class Space:
    """What a search needs of the corpus: a window's latent vector is the sum of its terms' projection
    rows, weighted by idf, over its norm, less the mean passage's."""

    known: Vocabulary
    idf: np.ndarray
    projection: np.ndarray
    mean: np.ndarray


def latent_space(docs: DataFrame, benchmark: DataFrame, p: Params) -> Space:
    known = vocabulary(benchmark)
    idf = idf_of(*document_frequencies(docs, known), p)
    omega = np.linalg.qr(np.random.default_rng(p.seed).standard_normal((p.features, p.rank)))[0].astype(np.float32)
    return space_of(known, idf, omega, *gram_times(docs, idf, known, omega, p))


def space_of(known, idf, omega, w, sums, passages) -> Space:
    """Right singular vectors over their values from A'A*Omega, by the Nystroem form."""
    if not passages:
        return Space(known, idf, np.zeros_like(omega), np.zeros(omega.shape[1], np.float32))
    shift = 1e-6 * np.linalg.norm(w)
    w = w + shift * omega
    core = omega.T @ w
    lower = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * shift * np.eye(omega.shape[1]))
    vectors, values, _ = np.linalg.svd(np.linalg.solve(lower, w.T).T, full_matrices=False)
    # the leading tenth of the directions, what languages and topics share, get one weight; the others keep theirs
    projection = (vectors / max(float(np.quantile(values, 0.9)), 1e-30) * np.minimum(1, np.quantile(values, 0.9) / np.maximum(values, 1e-30))).astype(np.float32)
    mean = (sums / passages) @ projection
    return Space(known, idf, projection, mean.astype(np.float32))


@dataclass
class Item:
    item_id: int
    terms: np.ndarray  # hashes of the item's terms, in order
    ids: np.ndarray  # their places in the vocabulary
    answer: np.ndarray
    exact: np.ndarray | None = None  # hashes of all words, for an item of very few terms


def read_item(item_id: int, text: str | None, space: Space, p: Params) -> Item | None:
    sentences = [x for x in SENTENCE.split(text or "") if x.strip()]
    column = pa.array([text or "", sentences[-1] if sentences else ""], pa.string())
    words, counts = words_of(column)
    if not counts[0]:
        return None
    terms, ids, by_row = terms_of(column, space.idf, space.known)
    exact = words[: counts[0]] if by_row[0] < p.min_terms else None
    return Item(item_id, terms[: by_row[0]], ids[: by_row[0]], np.unique(terms[by_row[0] :]), exact)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Searcher:
    """One block of items with their latent vectors, against columns of texts."""

    def __init__(self, space: Space, items: list[Item], p: Params):
        self.idf, self.known, self.projection, self.mean, self.p = space.idf, space.known, space.projection, space.mean, p
        self.short = [x for x in items if x.exact is not None]
        self.by_blocks: dict[int, list[Item]] = {}
        for x in items:
            if x.exact is None:
                self.by_blocks.setdefault(-(-len(x.terms) // p.block) + 1, []).append(x)
        self.widest = max(self.by_blocks, default=1)
        self.vectors = {b: np.stack([self._unit(x.ids) for x in own]) for b, own in self.by_blocks.items()}
        self.places = {b: self._places(own) for b, own in self.by_blocks.items()}
        # an LCS of the needed length leaves out at most so many of the item's distinct features
        self.need_kinds = {
            b: np.array([len(np.unique(x.ids % p.features)) - (len(x.terms) - int(np.ceil(p.min_paraphrase * len(x.terms) - 1e-9))) for x in own]) for b, own in self.by_blocks.items()
        }
        self.need = {b: np.array([int(np.ceil(p.min_paraphrase * len(x.terms) - 1e-9)) for x in own]) for b, own in self.by_blocks.items()}
        self.member = self._member([x for own in self.by_blocks.values() for x in own])
        self.rare_places, self.rare_blocks, self.rare_items = self._rare()
        self.is_rare = np.zeros(len(self.idf), bool)
        self.is_rare[self.rare_places] = True

    def _rare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, window sizes and items of words one of which every copy must hold, by place: an LCS of ``min_lcs`` leaves out fewer of the item's terms than these, its rarest."""
        found = [np.zeros((3, 0), np.int64)]
        for blocks, own in self.by_blocks.items():
            for i, x in enumerate(own):
                spare = len(x.terms) - int(np.ceil(self.p.min_lcs * len(x.terms) - 1e-9)) + 1
                some = np.unique(x.ids[np.argsort(-self.idf[x.ids], kind="stable")[:spare]])
                found.append(np.stack([some, np.full(len(some), blocks), np.full(len(some), i)]))
        out = np.concatenate(found, axis=1)
        return tuple(out[:, np.argsort(out[0], kind="stable")])

    def _member(self, items) -> np.ndarray:
        """feature -> 1 for each item that holds it; a last row of zeros for the padding.  Sums over a block fit its type."""
        table = np.zeros((self.p.features + 1, len(items)), np.min_scalar_type(self.p.block))
        for i, x in enumerate(items):
            table[x.ids % self.p.features, i] = 1
        return table

    def _rows(self, ids):
        """The terms' weighted rows of the projection."""
        return self.projection[ids % self.p.features] * self.idf[ids, None]

    def _unit(self, ids):
        v = self._rows(ids).sum(axis=0) / np.sqrt((self.idf[ids] ** 2).sum()) - self.mean
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def _places(self, own):
        """Per item, feature -> 1 + its place among the item's distinct features; 0 for others and the padding."""
        table = np.zeros((len(own), self.p.features + 1), np.int16)
        for i, x in enumerate(own):
            kinds = np.unique(x.ids % self.p.features)
            table[i, kinds] = np.arange(1, len(kinds) + 1)
        return table

    def search(self, column: pa.Array) -> dict[int, dict[int, tuple[float, float, str]]]:
        """row -> item_id -> (share of the item's terms in the LCS, cosine, kind)."""
        found: dict[int, dict[int, tuple]] = {}
        if self.short:
            self._exact(column, found)
        hashes, ids, counts = terms_of(column, self.idf, self.known)
        ends = np.concatenate(([0], np.cumsum(counts)))
        row, margin = 0, self.widest * self.p.block
        while row < len(counts):
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK_TERMS, "right")) - 1)
            a, b = int(ends[row]), int(ends[stop])
            if b - a <= CHUNK_TERMS:
                self._chunk(hashes[a:b], ids[a:b], counts[row:stop], row, found)
            else:  # one very long text: chunks that overlap by the widest window
                for at in range(a, b, CHUNK_TERMS):
                    end = min(b, at + CHUNK_TERMS + margin)
                    self._chunk(hashes[at:end], ids[at:end], np.array([end - at]), row, found)
            row = stop
        return found

    def _exact(self, column, found) -> None:
        hashes, counts = words_of(column)
        owner = np.repeat(np.arange(len(counts)), counts)
        for x in self.short:
            n = len(x.exact)
            at = np.nonzero(hashes[: len(hashes) - n + 1] == x.exact[0])[0] if n <= len(hashes) else []
            for i in at:
                if owner[i] == owner[i + n - 1] and (hashes[i : i + n] == x.exact).all():
                    found.setdefault(int(owner[i]), {})[x.item_id] = (1.0, 1.0, "exact")

    def _chunk(self, hashes, ids, counts, row0, found) -> None:
        p, n = self.p, len(ids)
        starts, rows = _runs(counts, p.block)
        if not len(starts) or not self.by_blocks:
            return
        total = np.zeros((len(starts) + 1, self.projection.shape[1]), np.float32)
        sums, held = self._by_block(ids, starts)
        np.cumsum(sums, axis=0, out=total[1:])
        energy = np.concatenate(([0.0], np.cumsum(np.add.reduceat(self.idf[ids] ** 2, starts), dtype=np.float64)))
        row_end = np.searchsorted(rows, rows, "right")  # past the row's last block
        row_begin = np.searchsorted(rows, rows, "left")
        term_end = np.cumsum(counts)[rows]
        blocks_at = np.arange(len(starts))
        padded = np.append(ids % p.features, np.full((self.widest + 1) * p.block, p.features))
        rare = self._rare_words(ids, starts)
        column = 0
        for blocks, own in self.by_blocks.items():
            first = blocks_at[(blocks_at + blocks <= row_end) | (blocks_at == row_begin)]
            last = np.minimum(first + blocks, row_end[first])
            v = total[last] - total[first]
            v /= np.sqrt(energy[last] - energy[first]).astype(np.float32)[:, None]
            v -= self.mean
            v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
            copy_i, copy_j = self._copies(blocks, *rare, rows, first, len(own))
            width = blocks * p.block
            for j0 in range(0, len(own), 512):
                j1 = min(j0 + 512, len(own))
                near = v @ self.vectors[blocks][j0:j1].T >= p.min_cosine
                here = (copy_j >= j0) & (copy_j < j1)
                near[copy_i[here], copy_j[here] - j0] = True
                i, j = np.nonzero(near & (self._shared(held[:, column + j0 : column + j1], first, last) >= self.need[blocks][j0:j1]))
                j, ok = j + j0, np.zeros(len(i), bool)
                for c in range(0, len(i), 4096):  # a second upper bound of the LCS: distinct features of the item
                    jc = j[c : c + 4096]
                    place = self.places[blocks][jc[:, None], padded[starts[first[i[c : c + 4096]], None] + np.arange(width)]]
                    kinds = np.zeros((len(jc), width + 1), bool)
                    kinds[np.arange(len(jc))[:, None], place] = True
                    ok[c : c + 4096] = kinds[:, 1:].sum(axis=1) >= self.need_kinds[blocks][jc]
                i, j = i[ok], j[ok]
                cosines = np.einsum("ij,ij->i", v[i], self.vectors[blocks][j])
                for k, item, cos in zip(first[i].tolist(), j.tolist(), cosines.tolist(), strict=True):
                    window = hashes[starts[k] : min(int(term_end[k]), int(starts[k]) + width, n)]
                    self._verify(own[item], window, cos, found, row0 + int(rows[k]))
            column += len(own)

    def _by_block(self, ids, starts) -> tuple[np.ndarray, np.ndarray]:
        """Each block's sum of its terms' weighted projection rows, and how many of its terms each item's features hold."""
        sums = np.zeros((len(starts), self.projection.shape[1]), np.float32)
        held = np.zeros((len(starts), self.member.shape[1]), self.member.dtype)
        features, weights = np.append(ids % self.p.features, self.p.features), np.append(self.idf[ids], np.float32(0))
        ends = np.append(starts[1:], len(ids))
        for k in range(self.p.block):  # the k-th terms of all blocks; a shorter block goes on with the padding, of no weight
            at = np.where(starts + k < ends, starts + k, len(ids))
            rows = self.projection.take(features[at], axis=0, mode="clip")
            rows *= weights[at, None]
            sums += rows
            held += self.member.take(features[at], axis=0)
        return sums, held

    @staticmethod
    def _shared(held, first, last) -> np.ndarray:
        """An upper bound of each window's LCS with each item: its terms that are the item's."""
        before = np.zeros((len(held) + 1, held.shape[1]), np.int32)
        np.cumsum(held, axis=0, dtype=np.int32, out=before[1:])
        return before[last] - before[first]

    def _rare_words(self, ids, starts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks, window sizes and items of all occurrences of an item's rare words."""
        at = np.flatnonzero(self.is_rare[ids])
        lo, hi = np.searchsorted(self.rare_places, ids[at], "left"), np.searchsorted(self.rare_places, ids[at], "right")
        times = hi - lo
        entry = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.repeat(np.searchsorted(starts, at, "right") - 1, times), self.rare_blocks[entry], self.rare_items[entry]

    def _copies(self, blocks, block, size, item, rows, first, n_items) -> tuple[np.ndarray, np.ndarray]:
        """Windows (as places in ``first``) and items that share one of the item's rare words: none that holds a copy is missing."""
        block, item = block[size == blocks], item[size == blocks]
        found, window = [np.zeros(0, np.int64)], np.full(len(rows), -1)
        window[first] = np.arange(len(first))
        for back in range(blocks):  # every window over the word's block
            begin = block - back
            spot = window[np.maximum(begin, 0)]
            hit = (begin >= 0) & (spot >= 0) & (rows[np.maximum(begin, 0)] == rows[block])
            found.append(spot[hit] * n_items + item[hit])
        pairs = np.unique(np.concatenate(found))
        return pairs // n_items, pairs % n_items

    def _verify(self, item: Item, window, cosine: float, found, row: int) -> None:
        p = self.p
        share = lcs_length(item.terms.tolist(), window.tolist()) / len(item.terms)
        kind = "copy" if share >= p.min_lcs else "paraphrase" if share >= p.min_paraphrase and self._answered(item, window) else None
        if kind:
            own = found.setdefault(row, {})
            if item.item_id not in own or share > own[item.item_id][0]:
                own[item.item_id] = (share, cosine, kind)

    def _answered(self, item: Item, window) -> bool:
        return not len(item.answer) or np.isin(item.answer, window).mean() >= self.p.min_answer


def find_contamination(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", block_items: int = 4096) -> DataFrame:
    """``(doc_id, item_id, share, cosine, kind)`` of every benchmark item found in a document;
    item_id is null for a document without any, so each row of ``docs`` appears."""
    spark = docs.sparkSession
    own = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    space = latent_space(own, benchmark, params)
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id long, share double, cosine double, kind string"
    out = None
    for items in _item_blocks(benchmark, block_items):
        shared = spark.sparkContext.broadcast((space, [x for i, t in items if (x := read_item(i, t, space, params))]))
        part = own.mapInArrow(_searching(shared, params), schema)
        out = part if out is None else out.unionAll(part)
    return out


def _item_blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size; at least one, if empty."""
    block: list[tuple] = []
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL").orderBy("item_id").toLocalIterator():
        if len(block) == size:
            yield block
            block = []
        block.append((r["item_id"], r["text"]))
    yield block


def _searching(shared, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, params)
        for batch in batches:
            found = searcher.search(batch.column(1))
            at, rows = [], []
            for i in range(batch.num_rows):
                own = [(k, *v) for k, v in found[i].items()] if i in found else [(None, None, None, None)]
                at += [i] * len(own)
                rows += own
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "item_id", "share", "cosine", "kind"],
            )

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text_col: str = "text", block_items: int = 4096) -> DataFrame:
    """``docs`` less the rows that hold a benchmark item; all columns stay, nothing is shuffled."""
    out = judged(docs.withColumnRenamed("found", "found_before") if "found" in docs.columns else docs, benchmark, params, text_col, block_items=block_items)
    out = out.where("found.n_items = 0").drop("found")
    return out.withColumnRenamed("found_before", "found") if "found" in docs.columns else out


FOUND = "struct<n_items:bigint,item_id:bigint,lcs_share:double,cosine:double,kind:string>"
_FOUND = pa.struct([("n_items", pa.int64()), ("item_id", pa.int64()), ("lcs_share", pa.float64()), ("cosine", pa.float64()), ("kind", pa.string())])


def judged(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text_col: str = "text", keep_text: bool = True, block_items: int = 4096) -> DataFrame:
    """``docs`` plus struct ``found``: how many items a row's text holds, and the best of them (null without any).

    Every block of items is one more pass of a task over its own rows; nothing is shuffled.
    """
    docs = small_batches(docs).drop("found")
    space = latent_space(docs.select(F.col(text_col).alias("text")), benchmark, params)
    names, at = docs.columns, docs.columns.index(text_col)

    def judge(shared, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*shared.value, params)
            for batch in batches:
                before = [None] * batch.num_rows if first else batch.column(len(names)).to_pylist()
                hits = searcher.search(batch.column(at))
                rows = [_better(before[i], hits.get(i)) for i in range(batch.num_rows)]
                kept = [c for c in range(len(names)) if c != at or keep_text or not last]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, _FOUND)], [*(names[c] for c in kept), "found"])

        return run

    found = T.StructField("found", T.StructType.fromDDL(FOUND.removeprefix("struct<").removesuffix(">")))
    blocks = _item_blocks(benchmark, block_items)
    items, first = next(blocks), True
    while items is not None:  # one block at a time on the driver
        after = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast((space, [x for i, t in items if (x := read_item(i, t, space, params))]))
        fields = [f for f in docs.schema.fields if f.name != "found" and (f.name != text_col or keep_text or after is not None)]
        docs = docs.mapInArrow(judge(shared, first, after is None), T.StructType([*fields, found]))
        items, first = after, False
    return docs


def _better(before: dict | None, hits: dict | None) -> dict:
    """``found`` of a row after one more block of items."""
    out = before or {"n_items": 0, "item_id": None, "lcs_share": None, "cosine": None, "kind": None}
    for item_id, (share, cosine, kind) in (hits or {}).items():
        out["n_items"] += 1
        if out["item_id"] is None or (share, -item_id) > (out["lcs_share"], -out["item_id"]):
            out |= {"item_id": item_id, "lcs_share": share, "cosine": cosine, "kind": kind}
    return out


def by_document(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), block_items: int = 4096) -> DataFrame:
    """One row per row of ``docs``: whether it is contaminated, its best item and how it was found."""
    out = judged(docs.select("doc_id", "text"), benchmark, params, keep_text=False, block_items=block_items)
    n = F.col("found.n_items")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), "found.item_id", F.round("found.lcs_share", 6).alias("lcs_share"), "found.kind")


def op9_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against all of ``benchmark``: its items, best first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return by_document(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
