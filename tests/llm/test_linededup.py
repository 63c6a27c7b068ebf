import hashlib

import pandas as pd
import pytest

from fernloom.llm import linededup
from tests.llm.util import TEXTS, documents, oracle


def brute(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = lambda x: len(holders.get(key(x), ())) >= min_docs and max(holders[key(x)]) != doc
        kept = [x for x in lines if not gone(x)]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (7, 2)])
def test_against_brute_force(spark, batches, fanout):
    texts = [*TEXTS, *(f"line {i % 3} that many documents hold\nown line number {i} of this one\n\tLINE {i % 3} that many documents hold " for i in range(12))]
    out = linededup.dedup_lines(documents(spark, texts), batches=batches, fanout=fanout)
    assert out.columns == [*documents(spark, []).columns, "deduped"]
    got = {r.doc_id: tuple(r.deduped) for r in out.collect()}
    assert got == brute(list(enumerate(texts)))
    want = oracle(linededup.OP10_SQL, documents=pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="string")}))
    digest = {(d, hashlib.sha256(t.encode()).hexdigest(), g, n) for d, (n, g, t) in got.items()}
    assert digest == set(want)


def test_runs_compact_and_anti_join(spark):
    runs = linededup.LineRuns(spark, fanout=2, buckets=3)
    for b in range(5):
        batch = linededup.line_hashes(documents(spark, [f"a line shared by all the batches\nline of batch {b} and long enough"], b))
        assert runs.unseen(batch).count() == (2 if b == 0 else 1)
        runs.add(batch)
    assert [n for _, n in runs.levels] == [1, 0, 1]
    assert sum(r.count() for r in runs.live()) == 6  # every line stands in one run
    assert spark.table(runs.updates).count() == 4
    assert [(r.max_doc,) for r in runs.frequent(3).collect()] == [(4,)]
    runs.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("fernloom_lines_")]


def test_runs_are_merged_and_joined_without_an_exchange(spark):
    runs = linededup.LineRuns(spark, fanout=4, buckets=3)
    for b in range(3):
        runs.add(linededup.line_hashes(documents(spark, [f"line {i} of a few batches, long enough" for i in range(b, b + 9)], 10 * b)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (linededup.merged(spark.table(runs.updates)), runs.frequent(2)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        runs.drop()


def test_null_ids_repeats_clashing_names_and_empty(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(None, line), (1, line), (1, line), (2, "short"), (2, None)], "doc_id long, text string")
    out = sorted(((r.doc_id, r.deduped.n_dropped, r.deduped.text) for r in linededup.dedup_lines(df).collect()), key=repr)
    assert out == sorted([(None, 0, line), (1, 0, line), (1, 0, line), (2, 0, "short"), (2, 0, "")], key=repr)
    more = df.unionAll(spark.createDataFrame([(3, line), (4, line)], "doc_id long, text string")).withColumn("GONE", df.doc_id).withColumn("gone_id", df.doc_id).withColumn("batch", df.text)
    got = linededup.dedup_lines(more)
    assert got.columns == ["doc_id", "text", "GONE", "gone_id", "batch", "deduped"]
    out = sorted(((r.doc_id, r.deduped.n_dropped) for r in got.collect()), key=repr)
    assert out == sorted([(None, 0), (1, 1), (1, 1), (2, 0), (2, 0), (3, 1), (4, 0)], key=repr)
    assert linededup.dedup_lines(df.limit(0)).count() == 0
