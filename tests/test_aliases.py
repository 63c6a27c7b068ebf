"""Alias scans against plain ones: overlaps, lines, rules of aliases, dictionaries in several parts."""

import random

import pytest

from fernloom.operators import aliases


def plain(text, rows):
    """The rules, a word at a time."""
    out, before = [], 0
    for number, line in enumerate((text or "").split("\n")):
        words = aliases.WORD.findall(line)
        lower = [w.lower() for w in words]
        i = 0
        while i < len(words):
            fit = []
            for alias, id_, raw, needs in rows:
                own = aliases.WORD.findall(alias)
                n = len(own)
                if not n or lower[i : i + n] != [w.lower() for w in own] or (raw and words[i : i + n] != own) or (needs and not set(needs) & set(lower)):
                    continue
                fit.append((-n, id_, alias))
            if fit:
                n, id_, alias = min(fit)
                out.append((before + i, -n, id_, alias, number))
            i += -min(fit)[0] if fit else 1
        before += len(words)
    return out


def case(seed):
    rng = random.Random(seed)
    words = ["go", "Go", "data", "C++", "c", "é", "漢", "x"]
    rows = list({(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), f"s{rng.randrange(30)}", rng.random() < 0.3, tuple(rng.sample(["x", "data"], 1)) if rng.random() < 0.3 else None) for _ in range(25)})
    texts = [None, "", "go", *["".join(rng.choice([*words, "\n", ", "]) + " " for _ in range(rng.randrange(40))) for _ in range(60)]]
    return [(a, i, r, list(n) if n else None) for a, i, r, n in rows], texts


@pytest.mark.parametrize("most", [1000, 6])
def test_equals_a_plain_scan(spark, most):
    rows, texts = case(most)
    dictionary = spark.createDataFrame(rows, "alias string, id string, raw boolean, needs array<string>")
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id long, text string, line string")
    got = {r.id: [(m.pos, m.len, m.id, m.alias, m.line) for m in r.matches] for r in aliases.scan(df, "text", dictionary, most).collect()}
    assert got == {i: plain(t, rows) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_empty_dictionary_and_words_without_letters(spark):
    df = spark.createDataFrame([("a b",)], "text string")
    for rows in ([], [("--", "x"), (None, "y"), ("a", None)]):
        assert aliases.scan(df, "text", spark.createDataFrame(rows, "alias string, id string")).first().matches == []
    assert aliases.scan(df.limit(0), "text", spark.createDataFrame([("a", "x")], "alias string, id string")).count() == 0
