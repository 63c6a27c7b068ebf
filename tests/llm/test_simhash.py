import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fernloom.llm import simhash
from tests.llm.util import TEXTS, documents


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    ids, up = sorted(fps), {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB É\t\n\x0b\x1c x漢", max_size=60))
def test_fingerprint_is_the_contract(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_long_text_fingerprint_is_chunked(monkeypatch):
    rng = random.Random(1)
    text = " ".join(str(rng.randint(0, 999)) for _ in range(3000))
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 97)
    assert simhash.fingerprint(text) == want == brute_fingerprint(text)


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**64, 2000, np.uint64), rng.integers(0, 2**64, 2000, np.uint64)
    manhattan = np.bitwise_count(simhash._embed(a) ^ simhash._embed(b))
    by_hand = [sum(abs(bin(int(x) >> s & 3).count("1") - bin(int(y) >> s & 3).count("1")) for s in range(0, 64, 2)) for x, y in zip(a, b, strict=True)]
    assert manhattan.tolist() == by_hand
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    native = [r.e for r in df.select(simhash.embed(df.fp).alias("e")).collect()]
    assert native == simhash._embed(a).view(np.int64).tolist()


def clouds(seed, centres=30, each=12, flips=3):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def components_of(spark, fps, **options):
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    points = spark.createDataFrame([(x,) for x in set(signed)], "fp long")
    found = simhash.connected_components(simhash.links(points, **options)).collect()
    up = {r.node: r.root for r in found}
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(up.get(x, x), set()).add(i)
    return sorted(sorted(g) for g in groups.values())


def brute_groups(fps):
    groups = {}
    for i, root in brute_components(dict(enumerate(fps))).items():
        groups.setdefault(root, set()).add(i)
    return sorted(sorted(g) for g in groups.values())


def test_links_keep_every_component(spark):
    fps = clouds(1)
    want = brute_groups(fps)
    assert components_of(spark, fps) == want
    assert components_of(spark, fps, bands=8) == want


def test_hot_cells_are_split_without_loss(spark):
    fps = clouds(2, centres=2, each=150, flips=4)  # dense clouds fill their cells
    want = brute_groups(fps)
    assert components_of(spark, fps, cell_rows=16) == want
    assert components_of(spark, fps, cell_rows=100_000) == want


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 400)) for _ in range(120)) for _ in range(12)]
    texts = [*TEXTS, *base, *base[:3], *(b.replace("alpha", "Alpha", 1) for b in base), *(b.rsplit(" ", 1)[0] for b in base)]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents(spark, texts, 5)).collect()}
    fps = {i + 5: brute_fingerprint(t) for i, t in enumerate(texts)}
    roots = brute_components(fps)
    assert got == {i: (fps[i], roots[i]) for i in fps}


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "other words stand here alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.n_copies) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert out == sorted([(None, 7, 4), (None, 7, 4), (7, 7, 4), (7, 7, 4), (None, None, 1)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
