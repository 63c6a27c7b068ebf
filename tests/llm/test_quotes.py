import random

import duckdb
import pandas as pd
import pytest

from fernloom.llm import quotes
from tests.llm.util import oracle, rows_of

SCHEMA = "conv_id long, turn long, role string, text string, ord string, position string"


def table(rows):
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    return pdf.astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})


def both(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = quotes.reply_order(df).toPandas()
    ints = {c: "Int64" for c in got.columns if c not in ("role", "text")}
    return rows_of(got.astype(ints)), oracle(quotes.OP1_SQL, conversations=table(rows))


def test_nested_quotes_make_branches(spark):
    rows = [
        (1, 0, "user", "First question\nwith two lines"),
        (1, 1, "assistant", "An answer"),
        (1, 2, "user", "> an  ANSWER\nthanks"),
        (1, 3, "assistant", "On Monday, x wrote:\n> > first question\n> An answer\nlate reply"),
        (1, 4, "user", "> First question\n> with two lines\nback to the start"),
        (1, 5, "user", "goes on"),
        (2, 0, "user", "> An answer\nfrom elsewhere"),
    ]
    got, want = both(spark, rows)
    assert got == want
    out = {(r.conv_id, r.turn): r for r in quotes.reply_order(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert out[1, 3].text == "late reply" and out[1, 3].depth == 2 and out[1, 3].quoted_turn == 1
    assert [t for _, t in sorted((out[1, t].position, t) for t in range(6))] == [0, 1, 2, 3, 4, 5]
    assert out[1, 4].quoted_turn == 0 and out[1, 5].branch == 4
    assert out[2, 0].n_linked == 1 and out[2, 0].quoted_turn is None


def test_parts_of_a_message_are_linked_by_votes(spark):
    long = "first paragraph\nits second line\n\nsecond paragraph\nof two lines\n\nthird one"
    rows = [
        (1, 0, "user", long),
        (1, 1, "assistant", "its second line\nin another message"),
        (1, 2, "user", "> first paragraph\n> its second line\n>\n> second paragraph\n> of two lines\ntwo of three paragraphs"),
        (1, 3, "user", "> second paragraph\n> OF two lines\n> and a line no one wrote\naltered"),
        (1, 4, "user", "> its second line\n> in another\na line and a half"),
        (1, 5, "user", "> never said\n> by anyone\nunknown"),
        (1, 6, "user", "> its second line\n> third one\ntie"),
        (2, 0, "user", "> second paragraph\n> nothing else\nelsewhere parts are not voted"),
    ]
    got, want = both(spark, rows)
    assert got == want
    out = {(r.conv_id, r.turn): r.quoted_turn for r in quotes.reply_order(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert [out[1, t] for t in range(2, 7)] == [0, 0, 1, None, 1] and out[2, 0] is None


def test_the_own_thread_comes_before_other_conversations(spark):
    rows = [
        (0, 0, "user", "line one\nline two"),
        (1, 0, "user", "line one\nline two\nline three"),
        (1, 1, "assistant", "something else"),
        (1, 2, "user", "and more"),
        (1, 3, "user", "> line one\n> line two\nI mean this"),
        (2, 0, "user", "unrelated"),
        (2, 1, "user", "> line one\n> line two\nfrom another conversation"),
    ]
    got, want = both(spark, rows)
    assert got == want
    out = {(r.conv_id, r.turn): (r.quoted_turn, r.n_linked) for r in quotes.reply_order(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert out[1, 3] == (0, 1) and out[2, 1] == (None, 1)


def test_quoted_threads_match_sql(spark, sf):
    want = duckdb.connect().execute(quotes.QUOTED_THREADS_SQL.replace("FROM conversations", f"FROM '{sf}/conversations.parquet'").replace("JOIN conversations", f"JOIN '{sf}/conversations.parquet'")).fetchdf()
    got = quotes.quoted_threads(spark, sf).toPandas()
    ints = {c: "Int64" for c in got.columns if c not in ("role", "text")}
    assert rows_of(got.astype(ints)) == rows_of(want.astype(ints))
    assert (got.n_quotes > 0).sum() > 10 and (got.n_linked > 0).sum() > 10 and (got.quoted_turn < got.turn - 1).any()  # the smallest table holds few threads


def test_random_threads_match_sql(spark):
    rng, rows = random.Random(5), []
    for conv in range(40):
        own = []
        for turn in range(rng.randint(1, 14)):
            text = f"message {rng.randint(0, 9)} of {conv % 7}"
            for _ in range(rng.choice([0, 0, 1, 2])):
                if own:
                    mark = ">" * rng.randint(1, 3) + rng.choice(["", " "])
                    text = f"{mark}{rng.choice(own)}\n{text}"
                    if rng.random() < 0.4:  # a second line of the same passage, from anywhere
                        text = f"{mark}{rng.choice(own)}\n{text}"
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
            own.append(text.split("\n")[-1])
    got, want = both(spark, rows)
    assert got == want
    positions = {}
    for r in got:
        positions.setdefault(r[1], []).append(r[5])
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())


@pytest.mark.parametrize("span", [2, 3])
def test_ranges_of_turns_do_not_matter(spark, monkeypatch, span):
    rows = [(0, t, "user", f"m{t}" if t % 3 else f"> m{max(t - 5, 1)}\nm{t}") for t in range(20)]
    whole, _ = both(spark, rows)
    monkeypatch.setattr(quotes, "SPAN", span)
    assert both(spark, rows)[0] == whole


def test_nulls_repeats_and_empty(spark):
    rows = [
        (None, 0, "user", "a"),
        (3, None, "user", "> a\nb"),
        (3, 0, None, None),
        (3, 0, "user", "twice"),
        (3, 0, "user", "twice"),
        (3, 1, "user", ">\n> twice"),
        (3, 2, "user", "> " + "long " * 5000),
        (None, None, None, None),
    ]
    got, want = both(spark, rows)
    assert got == want
    empty = spark.createDataFrame([], SCHEMA)
    assert quotes.reply_order(empty).count() == 0
    assert quotes.chat(quotes.reply_order(empty)).count() == 0


def test_chat_rows_are_bounded(spark):
    df = spark.createDataFrame([(1, t, "user", f"m{t}", "", "") for t in range(10)], SCHEMA)
    parts = quotes.chat(quotes.reply_order(df), messages_per_row=4).orderBy("part").collect()
    assert [p.chat.count("<|user|>") for p in parts] == [4, 4, 2]
