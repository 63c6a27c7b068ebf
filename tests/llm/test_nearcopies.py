import random

import corpus_pipeline as cp
from fernloom.llm import nearcopies as nc


def brute_roots(texts):
    """Components over all pairs whose five-word shingle sets have a similarity of 0.8 or more, and those pairs."""
    sets = {}
    for i, t in texts.items():
        words = (t or "").lower().split()
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    up, pairs = {i: i for i in texts}, []

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                pairs.append((a, b))
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, pairs


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randint(0, 9999)}"
    return " ".join(words)


def near_texts(seed=3):
    """Originals with copies on both sides of 0.8, one group around a boilerplate, short and wordless texts."""
    rng = random.Random(seed)
    texts = [None, "", " ", "one", "two words", "Two  words", "a b c d e", "a b c d e f"]
    shared = " ".join(f"licence{i}" for i in range(40))
    for n in (30, 60, 150, 400):
        for _ in range(6):
            words = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
            texts.append(" ".join(words))
            texts += [edited(rng, words, max(1, n * k // 200)) for k in (1, 2, 3, 4, 5, 6, 8)]
    texts += [f"{shared} " + " ".join(f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(2, 40))) for _ in range(30)]
    return dict(enumerate(texts, 1))


def test_near_copies_against_brute_force(spark):
    texts = near_texts()
    want, pairs = brute_roots(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()}
    assert len(pairs) > 100 and got == want


def test_stage_keeps_one_of_each_group(spark, sf):
    texts = near_texts(4)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.simhash_near_dedup(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_roots(texts)[0].values()))


def test_cells_in_chunks_that_meet_pairwise(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    texts = {i: edited(rng, words, rng.randint(1, 8)) for i in range(60)}
    want = brute_roots(texts)[0]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen = []
    real = nc.materialize
    monkeypatch.setattr(nc, "materialize", lambda df, label, *a, **k: seen.append((label, out := real(df, label, *a, **k))) or out)
    for chunk in (1 << 20, 2_000):
        monkeypatch.setattr(nc, "CHUNK", chunk)
        seen.clear()
        assert {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()} == want
    assert dict(seen)["flagged"].where("part > 0").count() > 0


def test_groups_across_batches():
    import pyarrow as pa

    from fernloom.llm.batches import groups

    rng = random.Random(1)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 3), i) for i in range(120))
    for size in (1, 2, 3, 7, 500):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part]) for i in range(3)], ["a", "b", "c"]) for part in cut]
        got = [[tuple(r.values()) for r in g.to_pylist()] for g in groups(iter(batches), 2)]
        assert [r for g in got for r in g] == rows
        assert len(got) == len({r[:2] for r in rows}) and all(len({r[:2] for r in g}) == 1 for g in got)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "other words stand here alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in nc.near_copies(df).collect()), key=repr) == sorted([(None, 7), (None, 7), (7, 7), (7, 7), (None, None)], key=repr)
    assert nc.near_copies(df.limit(0)).count() == 0
