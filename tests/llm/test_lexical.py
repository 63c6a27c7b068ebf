"""Ranked search against a plain version: small blocks, ties, repeats, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from fernloom.llm import lexical
from tests.llm.util import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10, once=True):
    """``{item: [(doc, score), ...]}``; ``docs`` and ``items`` are ``(id, text)`` lists."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    pooled = {}
    for i, t in items:
        pooled.setdefault(i, Counter()).update(terms(t))
    out = {}
    for item, want in pooled.items():
        found = []
        for doc, bag in bags:
            n = sum(bag.values())
            score = 0
            for t, times in want.items():
                if bag[t]:
                    m = 100 - 90 + (90 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += (1 if once else times) * w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((doc, score))
        out[item] = sorted(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:k]
    return {i: v for i, v in out.items() if v}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "the", "THE", "straße", "漢字", "x1", "é", "co-op", "don't"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    return [None, "", " -- ", *texts, *texts[:15]]


def test_equals_brute_force(spark):
    texts = corpus(1, 300)
    docs = documents(spark, texts).repartition(7)
    items = [(1, "the alpha, the BETA"), (2, "漢字 straße"), (3, "unheard"), (4, None), (None, "gamma gamma x1"), (5, "é"), (5, "co co")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    for once in (True, False):
        want = brute(list(enumerate(texts)), items, once=once)
        assert got(lexical.ranked(docs, frame, once=once)) == want
        assert got(lexical.ranked(docs, frame, once=once, block_terms=2)) == want  # many blocks of items
    assert {len(v) for v in want.values()} == {10}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, "alpha beta"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, "beta")], "item_id int, text string")
    assert [d for d, _ in got(lexical.ranked(docs, items))[9]] == [1, 1, 2, None]
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert dict(lexical.ranked(docs, items).dtypes) == {"item_id": "int", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_terms_end_with_their_row_and_a_long_text_keeps_all(spark):
    flat, row = lexical.terms_of(pa.array(["ab", "cd", None, "", "E.f", "-"]))
    assert flat.to_pylist() == ["ab", "cd", "e", "f"] and row.tolist() == [0, 1, 4, 4]
    long = "word " * 50_000 + "needle"
    docs = documents(spark, [long, "needle", "word"])
    items = spark.createDataFrame([(1, "needle")], "item_id long, text string")
    assert got(lexical.ranked(docs, items)) == brute([(0, long), (1, "needle"), (2, "word")], [(1, "needle")])


def test_best_breaks_ties_by_id():
    scores, ids = np.array([5, 7, 5, 5, 1]), np.array([4, 9, 2, 3, 1])
    assert lexical.best(scores, ids, np.zeros(5, int), 3).tolist() == [1, 2, 3]
