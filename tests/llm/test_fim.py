"""Fill-in-middle against a plain version; chunks of every small size; odd texts."""

import hashlib
import random
import re

import pytest

from fernloom.llm import fim
from tests.llm.util import documents

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["<P> is here already, as it may be", " \t lead", "trail \n", "\x0b", "a", "é ü漢字 x 🤖  y\n\nz", "one two three four five six seven"]


def brute(doc_id, text):
    """``(n, form, prefix chars, middle chars, output)`` of one document."""
    text = text or ""
    sha = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, fim.CHUNK])
def test_equals_brute_force_for_every_chunk_size(spark, chunk):
    rng = random.Random(chunk)
    texts = ODD + [None, ""] + ["".join(rng.choice(["a", "b", " ", "\n", "é", "漢", " ", "\t"]) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    df = documents(spark, texts)
    df = df.union(df.limit(20))  # rows that repeat id and text
    out = fim.fill_in_middle(df, chunk=chunk).withColumn("back", fim.restored("output", "form")).collect()
    assert len(out) == len(texts) + 20
    for r in out:
        assert (r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_a_long_text_and_rows_that_share_an_id(spark):
    long = "wordé \n" * 60_000
    rows = [(1, long), (1, long), (1, long + "tail"), (None, long), (None, "short one"), (2, " " * 100_000), (3, "x" * 100_000)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), chunk=1 << 12).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == sorted((str(i), *brute(i, t)) for i, t in rows)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c", "mine", 1)], "doc_id long, text string, form string, n long")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "n", "output", "form", "n_tokens", "prefix_chars", "middle_chars"] and out.first().n == 1
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, chunk=0)
