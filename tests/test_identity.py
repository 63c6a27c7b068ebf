"""Closures, set-similarity and top-k joins against plain versions."""

import random

import numpy as np
import pytest

from fernloom.operators import identity, setsim, topk


def plain_root(start, up):
    seen, x = [], start
    while x in up and up[x] is not None and up[x] != x and x not in seen:
        seen.append(x)
        x = up[x]
    if x in seen:
        return min(seen[seen.index(x) :]), None
    return x, len(seen)


@pytest.mark.parametrize("seed", [1, 2])
def test_roots_of_chains_and_circles(spark, seed):
    rng = random.Random(seed)
    up = {i: rng.choice([None, i, i - 1, i - 1, i - 1, rng.randrange(-5, 200)]) for i in range(120)}
    up |= {i: i - 1 for i in range(200, 330)} | {199: 199}  # a long chain
    up |= {400: 402, 401: 400, 402: 401, 403: 402, 3: 404}  # a circle with a tail, and a row that is not there
    rows = [*up.items(), (5, up[5]), (None, 7)]
    got = {r.id: (r.root, r.hops) for r in identity.roots(spark.createDataFrame(rows, "id long, up long"), "id", "up").collect()}
    assert got == {i: plain_root(i, up) for i in up}


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in list(root)}


def test_components_of_paths_hubs_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(140)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in identity.components(df).collect()}
    assert got == plain_components([(a, b) for a, b in edges if a != b])


def test_identities_by_shared_keys(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (5, "b", "y"), (6, "b", "y"), (6, "b", "y")]
    got = {r.id: (r.identity, r.members) for r in identity.identities(spark.createDataFrame(rows, "id long, p string, m string"), "id", ["p", "m"]).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 2), 6: (5, 2)}
    assert identity.identities(spark.createDataFrame([], "id long, p string"), "id", ["p"]).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    words = [f"w{i}" for i in range(25)]
    make = lambda n: [(i, rng.choice([None, [], [rng.choice(words) for _ in range(rng.randint(1, 12))], ["w1"], ["w1", "w2"]])) for i in range(n)]
    left, right = make(80), make(90)
    right += left[:10]
    schema = "id long, words array<string>"
    want = {}
    for i, a in left:
        for j, b in right:
            if a and b:
                x, y = set(a), set(b)
                if len(x & y) >= least * len(x | y) - 1e-12 and x & y:
                    want[i, j] = (len(x & y), len(x & y) / len(x | y))
    rows = setsim.similar_sets(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), least).collect()
    # two different sets may share an id on the right: the plain version keeps the last of them
    got = {}
    for r in rows:
        got.setdefault((r.left_id, r.right_id), set()).add((r.shared, round(r.jaccard, 9)))
    assert set(got) == set(want) and all((n, round(j, 9)) in got[k] for k, (n, j) in want.items())


@pytest.mark.parametrize("most_words", [0, setsim.MOST_WORDS])
def test_similar_sets_by_either_way(spark, most_words):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    make = lambda n: [(i, [rng.choice(words[: rng.choice([6, 40])]) for _ in range(rng.randint(0, 15))]) for i in range(n)]
    left, right, schema = [*make(60), (60, None), (61, ["w1", None])], [*make(120), (120, None)], "id long, words array<string>"
    right = [*right, *[(i + 1000, w) for i, w in right], right[3]]
    sets = lambda rows: [(i, set(w or []) - {None}) for i, w in rows]
    want = {(i, j, len(x & y)) for i, x in sets(left) for j, y in sets(right) if x & y and len(x & y) >= 0.5 * len(x | y)}
    rows = setsim.similar_sets(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.5, most_words).collect()
    assert sorted((r.left_id, r.right_id, r.shared) for r in rows) == sorted(want)
    none = spark.createDataFrame([], schema)
    assert setsim.similar_sets(none, spark.createDataFrame(right, schema), 0.5, most_words).count() == 0
    assert setsim.similar_sets(spark.createDataFrame(left, schema), none, 0.5, most_words).count() == 0


def shuffled_bytes(spark):
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("given, times", [({}, 1), ({"most_words": 0}, 8)])
def test_long_sets_are_not_moved_with_each_word(spark, given, times):
    """What the join moves grows with the words, not with the square of a set's size."""
    rng = random.Random(6)
    text = [" ".join(f"{rng.randrange(10**9):09d}" for _ in range(600)) for _ in range(30)]
    rows = spark.createDataFrame([(i, x.split()) for i, x in enumerate(text)], "id long, words array<string>")
    before = shuffled_bytes(spark)
    assert setsim.similar_sets(rows.limit(2), rows, 0.5, **given).count() == 2
    assert shuffled_bytes(spark) - before < times * sum(map(len, text))


@pytest.mark.parametrize("block", [4, 2048])
def test_nearest_equals_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    vectors = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(200)]
    vectors += [(500, vectors[3][1]), (499, vectors[3][1]), (600, [0.0] * 8)]
    odd = [(700, None), (701, [1.0] * 7), (702, [float("nan")] * 8), (None, [1.0] * 8)]
    asked = [(i, v) for i, v in vectors[:30]] + [(500, vectors[3][1])]
    schema = "array<float>"
    got = {}
    out = topk.nearest(spark.createDataFrame(vectors + odd, f"id long, vector {schema}").repartition(5), spark.createDataFrame(asked, f"profile_id int, vector {schema}"), 5, block)
    for r in sorted(out.collect(), key=lambda r: r.place):
        got.setdefault(r.profile_id, []).append((r.id, r.score))
    matrix = np.array([v for _, v in vectors])
    norms = np.linalg.norm(matrix, axis=1)
    for p, v in asked:
        v = np.array(v)
        scores = np.round(np.divide(matrix @ v, norms * np.linalg.norm(v), out=np.zeros(len(norms)), where=norms > 0), 9)
        want = sorted(((i, s) for (i, _), s in zip(vectors, scores, strict=True)), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in got[p]] == [i for i, _ in want] and [s for _, s in got[p]] == pytest.approx([s for _, s in want])
    assert topk.nearest(out.selectExpr("CAST(1 AS long) id", "array(1f) vector").limit(0), out.selectExpr("1 profile_id", "array(1f) vector")).count() == 0
