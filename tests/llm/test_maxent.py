"""The language model: contract figures and probabilities against plain versions, gradients, held-out gain."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fernloom.llm import maxent
from tests.llm.util import TEXTS, documents

BLANKS = " \t\n\x0b\x0c\r"


def tokens(text):
    """Words of a text, A-Z lowered, and its end."""
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return [*out, ""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def corpus(seed, n=250):
    rng = random.Random(seed)
    kinds = [["the", "cat", "sat", "on", "mats"], ["der", "Hund", "lag", "im", "Garten"]]
    return [" ".join(rng.choice(k) if rng.random() < 0.9 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40))) for k in (rng.choice(kinds) for _ in range(n))]


@pytest.fixture(scope="module")
def small(spark):
    """A model with few listed words, so that most paths are used, and its documents."""
    texts = TEXTS + corpus(3)
    df = documents(spark, texts).repartition(5)
    trained = maxent.train(df.where(~maxent.held_out(df.doc_id)).select("doc_id", "text"), max_words=20, tail_units=16, tops=4, buckets=64, pair_slots=128, rich=8, rounds=3)
    return texts, df, trained


def brute_score(model, counts, text):
    """The text's log10 probability, a token at a time, from the model's arrays."""
    listed = {w: i for i, w in enumerate(model.words.to_pylist())}

    def unit(word):
        if word in listed:
            return listed[word]
        raw = word.encode()
        return len(listed) + int(maxent.tails(np.array([len(raw)]), np.array([len(raw)]), np.frombuffer(raw, np.uint8), model.tail_units)[0])

    one = two = model.start
    total = 0.0
    for word in tokens(text):
        u, k = unit(word), model.buckets
        rows = [int(maxent.mix(np.array([x]))[0]) % k + i * k for i, x in enumerate((one, two + (1 << 41), one * (1 << 21) + two + (1 << 62)))]
        logits = model.log_prior + sum(model.weights[r].astype(np.float64) for r in rows)
        total += logits[model.class_of[u]] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()
        before = model.class_of[one]

        def raw(x, b=before):
            return model.log_share[x] + (model.pairs[model.slots(np.array([b]), np.array([x]))[0]] if x < model.rich else 0.0)

        total += raw(u) - math.log(sum(math.exp(raw(x)) for x in range(len(model.shares)) if model.class_of[x] == model.class_of[u]))
        if u >= len(listed):
            total += math.log((counts[word] + 1) / model.shares[u])
        one, two = u, one
    return total / math.log(10)


def test_contract_figures_and_scores(small):
    texts, df, trained = small
    train = Counter(t for i, x in enumerate(texts) if not held(i) for t in tokens(x))
    n, v = sum(train.values()), len(train)
    assert (trained.model.train_tokens, trained.model.distinct) == (n, v)
    rows = maxent.score(df.select("doc_id", "text"), trained).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(own), sum(train[t] > 0 for t in own))
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        if len(own) < 100:
            assert r.score == pytest.approx(brute_score(trained.model, train, texts[r.doc_id]), rel=1e-4)


def test_probabilities_sum_to_one(small):
    model = small[2].model
    units = np.arange(len(model.shares))
    for one, two in ((0, 3), (model.start, model.start), (5, 1)):
        k = np.uint64(model.buckets)
        ctx = np.array([one]), np.array([two])
        rows = np.stack([(maxent.mix(x) % k).astype(np.int64) + i * model.buckets for i, x in enumerate((ctx[0], ctx[1] + (1 << 41), ctx[0] * (1 << 21) + ctx[1] + (1 << 62)))])
        shares, sums = model.class_shares(rows)
        classes = np.log(shares[0] / sums[0])
        whole = np.exp(classes[model.class_of[units]] + model.unit_logs(np.full(len(units), model.class_of[one]), units)).sum()
        assert whole == pytest.approx(1.0, rel=1e-5)
    # inside a tail unit: a share a count, one a known word, one for the unknown
    shares = defaultdict(lambda: 1)
    for r in small[2].counts.where("NOT frequent").collect():
        shares[int(maxent.tails(np.array([len(r.word)]), np.array([len(r.word)]), np.frombuffer(bytes(r.word), np.uint8), model.tail_units)[0])] += r.n + 1
    assert all(model.shares[len(model.words) + t] == shares[t] for t in range(model.tail_units))


def test_gradient_is_the_derivative_and_is_summed_over_all_rows(small, spark):
    texts, df, trained = small
    model = trained.model
    lengths, row, data = maxent.words_of(pa.array(texts))
    units = model.units(lengths, data)
    want = maxent.Gradient.of(model)
    want.add(model, units, row)
    got = maxent.gradient(df.select("text"), model)
    for a, b in ((got.classes, want.classes), (got.seen, want.seen), (got.pairs, want.pairs), (got.after, want.after)):
        assert np.allclose(a, b, rtol=1e-3, atol=0.05)
    rows, _ = model.features(units, row)

    def likelihood():
        shares, sums = model.class_shares(rows)
        return float(np.log(shares[np.arange(len(units)), model.class_of[units]] / sums).sum(dtype=np.float64))

    busy = int(want.seen[: model.buckets].argmax())
    for c in range(want.classes.shape[1]):
        old = model.weights[busy, c]
        model.weights[busy, c] = old + 0.01
        up = likelihood()
        model.weights[busy, c] = old - 0.01
        down = likelihood()
        model.weights[busy, c] = old
        assert (up - down) / 0.02 == pytest.approx(want.classes[busy, c], rel=0.02, abs=1.5)


def test_context_beats_the_base_on_held_out_texts(small):
    texts, df, trained = small
    rows = [r for r in maxent.score(df.select("doc_id", "text"), trained).collect() if held(r.doc_id) and 5 < r.n_tokens < 100]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) and len(rows) > 20


def test_repeats_null_ids_extra_columns_and_empty_tables(spark, small):
    trained = small[2]
    rows = [(None, "the cat", 1), (None, "the cat", 1), (5, "zzz zzz", 2), (6, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = maxent.score(df, trained)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in out.collect())
    assert got == [("5", 3, 1), ("6", 1, 1), ("None", 3, 3), ("None", 3, 3)]
    assert maxent.score(df.limit(0), trained).count() == 0
    untrained = maxent.train(df.drop("n_tokens").limit(0))
    assert untrained.model.train_tokens == 0
    for r in maxent.score(df, untrained).collect():
        assert r.n_known == 0 and r.base_score == 0.0 and r.score < 0
