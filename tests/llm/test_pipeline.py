import corpus_pipeline as cp
from fernloom.llm import queries
from tests.llm.test_nearcopies import brute_roots


def test_stages_on_small_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), name)
        steps[name] = docs
    assert all(steps[n].columns == cp.COLUMNS for n, _ in cp.STAGES[:-1])
    lines = {r.doc_id: r.text for r in steps["line_dedup"].collect()}
    assert all(len(t) == n for t, n in ((r.text, r.n_chars) for r in steps["line_dedup"].collect()))
    assert {r.doc_id for r in steps["simhash_near_dedup"].collect()} == set(brute_roots(lines)[0].values())
    last = steps["sentencepiece_encoding"].collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in steps["benchmark_decontamination"].collect()}
    assert all(r.parity and r.n_tokens == len(r.ids) for r in last)
    assert sorted(r.doc_id for r in cp.run(spark, sf).collect()) == sorted(r.doc_id for r in last)


def test_registered_queries():
    assert {q.split("_")[0] for q in queries.QUERIES if q != "quoted_threads"} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece_encoding"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, deduped string, fp long, label string"


def odd(spark):
    """Nulls, empties, repeats, a very long text and columns whose names clash."""
    line = "a sentence that several documents hold word for word"
    rows = [
        (1, None, None, None, None), (2, "", "en", None, 0), (3, "12 34", None, "s", 5), (4, line, "en", "s", None), (5, line, "en", None, 1), (6, line + "\nand an own line of this document", "fr", "s", 1),
        (6, line + "\nand an own line of this document", "fr", "s", 1), (7, "word " * 30_000, "en", "s", 1), (None, "a document that has no id at all but has words", "en", "s", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "x", 1, "y") for r in rows], SCHEMA)


def test_stages_on_odd_rows(spark, sf):
    docs, seen = odd(spark), {}
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), name)
        seen[name] = sorted((r.doc_id for r in docs.collect()), key=repr)
    assert seen["language_id"] == [4, 5, 6, 6, 7, None]
    assert seen["line_dedup"] == [6, 6, 7, None]  # the line stays in the largest id; 4 and 5 held nothing else
    assert seen["simhash_near_dedup"] == seen["benchmark_decontamination"] == seen["sentencepiece_encoding"] == [6, 6, 7, None]


def test_each_stage_alone_on_odd_and_empty_tables(spark, sf):
    for name, stage in cp.STAGES:
        assert stage(spark, odd(spark).limit(0), sf).count() == 0, name
        out = stage(spark, odd(spark), sf)
        assert out.count() <= 9 and (name == "sentencepiece_encoding" or out.columns == cp.COLUMNS), name
