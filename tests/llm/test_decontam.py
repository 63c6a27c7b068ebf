import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fernloom.llm import decontam as dc
from tests.llm.util import documents

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(1500)]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.35 else rng.choice(VOCAB) for _ in range(n))


def brute_words(text):
    return "".join(c.lower() if c.isalnum() and (ord(c) < 128 or c.lower() != c) else c if ord(c) > 127 else " " for c in text or "").split()


def test_words_follow_spaces_case_and_rows():
    texts = ["The, cat", "the cat", None, "", "É é", "thecat", "x" * 5, "a.b"]
    hashes, counts = dc.words_of(pa.array(texts))
    assert counts.tolist() == [2, 2, 0, 0, 2, 1, 1, 2]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[4] == hashes[5] and len(set(hashes.tolist())) == 7
    sliced, n = dc.words_of(pa.array(texts).slice(1, 1))
    assert sliced.tolist() == hashes[2:4].tolist() and n.tolist() == [2]


def test_long_texts_are_cut_at_spaces(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, 400), prose(rng, 3), prose(rng, 900), ""]
    want = dc.words_of(pa.array(texts))
    monkeypatch.setattr(dc, "PIECE_BYTES", 300)
    got = dc.words_of(pa.array(texts))
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist() == [len(brute_words(t)) for t in texts]


def test_lcs_against_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert dc.lcs_length(a, b) == table[-1][-1]


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    items = [(i, ". ".join(prose(rng, rng.randint(8, 20)) for _ in range(2)) + ".") for i in range(25)]
    docs, planted = [], {}
    for d in range(n):
        text = prose(rng, rng.randint(5, 400))
        if d % 8 == 0:
            i = rng.randrange(25)
            words = items[i][1].split()
            if d % 16 == 0:  # a paraphrase: every sixth word replaced
                words = [rng.choice(VOCAB) if k % 6 == 5 and k < len(words) - 4 else w for k, w in enumerate(words)]
            own = text.split()
            at = rng.randint(0, len(own))
            text = " ".join(own[:at] + words + own[at:]).upper()
            planted[d] = i
        docs.append(text)
    return items, docs, planted


@pytest.fixture(scope="module")
def found(spark):
    items, docs, planted = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = dc.by_document(documents(spark, docs), bench).collect()
    return items, docs, planted, {r.doc_id: r for r in out}


def test_planted_items_are_found_and_nothing_else(found):
    _, docs, planted, out = found
    assert set(out) == set(range(len(docs)))
    assert {d: r.item_id for d, r in out.items() if r.contaminated} == planted


def function_words(docs, items):
    """The benchmark's words in over a fifth of the documents (200 more are supposed), counted plainly."""
    held = Counter(w for t in docs for w in set(brute_words(t)))
    return {w for _, t in items for w in brute_words(t) if held[w] / (len(docs) + 200) > 0.2}


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_against_brute_force(found):
    """On plain words, without hashes, latent space or bounds: every window against every item, by a plain LCS."""
    items, docs, _, out = found
    known = {w for _, t in items for w in brute_words(t)} - function_words(docs, items)
    read = [(i, [w for w in brute_words(t) if w in known], set(brute_words([x for x in re.split(r"[.!?\n]+", t) if x.strip()][-1])) & known) for i, t in items]
    for d in range(0, len(docs), 4):
        terms, best = [w for w in brute_words(docs[d]) if w in known], {}
        for i, own, answer in read:
            width = (-(-len(own) // 8) + 1) * 8
            for at in range(0, max(1, len(terms)), 8):
                window = terms[at : at + width]
                if len(set(own) & set(window)) < 0.3 * len(set(own)):
                    continue  # fewer common words than any share asked for
                share = brute_lcs(own, window) / len(own)
                if share >= 0.75 or share >= 0.55 and len(answer & set(window)) >= 0.5 * len(answer):
                    best[i] = max(best.get(i, 0), share)
        top = max(best, key=lambda i: (best[i], -i), default=None)
        assert (out[d].n_items, out[d].item_id) == (len(best), top)
        assert top is None or abs(out[d].lcs_share - best[top]) < 1e-6


def test_a_rare_word_that_shares_a_column_with_a_function_word_stays_a_term(spark):
    items, docs, planted = corpus(seed=5, n=120)
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = dc.Params(features=64)
    space = dc.latent_space(documents(spark, docs).select("text"), bench, few)
    stopped = dc.words_of(pa.array([" ".join(sorted(function_words(docs, items)))]))[0]
    assert len(stopped) > 3 and sorted(space.known.words[space.idf == 0].tolist()) == sorted(stopped.tolist())
    out = dc.by_document(documents(spark, docs), bench, few).collect()
    assert {r.doc_id: r.item_id for r in out if r.contaminated}.items() <= planted.items()


def test_rows_that_share_an_id_are_judged_alone(spark):
    rows = [(1, "tiny item here"), (1, "nothing of it"), (None, "tiny item here"), (None, "x"), (1, "tiny item here")]
    bench = spark.createDataFrame([(7, "Tiny item here"), (None, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, found string")
    out = sorted(((r.doc_id, r.contaminated, r.item_id) for r in dc.by_document(docs, bench).collect()), key=repr)
    assert out == sorted([(1, True, 7), (1, False, None), (None, True, 7), (None, False, None), (1, True, 7)], key=repr)
    kept = dc.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "nothing of it", "old"), (None, "x", "old")], key=repr)


def test_latent_space_is_close_to_the_exact_svd():
    rng = np.random.default_rng(0)
    low = rng.standard_normal((600, 6)) @ rng.standard_normal((6, 64)) + 0.01 * rng.standard_normal((600, 64))
    omega = np.linalg.qr(rng.standard_normal((64, 12)))[0]
    space = dc.space_of(None, np.ones(64, np.float32), omega.astype(np.float32), low.T @ (low @ omega), low.sum(0), 600)
    exact = np.linalg.svd(low, full_matrices=False)[2][:6]
    basis = np.linalg.qr(space.projection[:, :6].astype(np.float64))[0]
    assert np.linalg.norm(exact @ basis) ** 2 > 5.99


def test_gram_product_is_exact():
    rng = np.random.default_rng(3)
    p = dc.Params(features=50, rank=7, passage=5)
    idf = rng.random(80).astype(np.float32) + 0.1
    counts = rng.integers(0, 23, 400)
    ids = rng.integers(0, 80, counts.sum())
    omega = rng.standard_normal((50, 7)).astype(np.float32)
    gram = dc._Gram(idf, omega, p)
    cut = np.concatenate(([0], np.cumsum(counts)))
    for a, b in ((0, 150), (150, 400)):
        gram.add(ids[cut[a] : cut[b]], counts[a:b])
    rows = []
    for d in range(400):
        own = ids[cut[d] : cut[d + 1]]
        for at in range(0, len(own), 5):
            row = np.zeros(50)
            norm = np.sqrt((idf[own[at : at + 5]] ** 2).sum())
            for i in own[at : at + 5]:
                row[i % 50] += idf[i] / norm
            rows.append(row)
    matrix = np.array(rows)
    assert gram.passages == len(rows) and np.allclose(gram.ones, matrix.sum(axis=0), rtol=1e-4)
    assert np.allclose(gram.sums, matrix.T @ (matrix @ omega), rtol=1e-3, atol=1e-3)


def test_small_cases(spark):
    docs = documents(spark, [None, "", "tiny item here", "a tiny item here now", "other", "tiny item here"])
    bench = spark.createDataFrame([(1, "Tiny item here"), (2, None), (3, ""), (None, "other")], "item_id long, text string")
    out = {r.doc_id: r.item_id for r in dc.by_document(docs, bench).collect()}
    assert out == {0: None, 1: None, 2: 1, 3: 1, 4: None, 5: 1}
    kept = dc.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]
    none = bench.limit(0)
    assert dc.without_contaminated(docs, none).count() == 6
    assert {r.contaminated for r in dc.by_document(docs, none).collect()} == {False}
    assert dc.find_contamination(docs.limit(0), bench).count() == 0


def test_item_blocks_change_nothing(spark):
    items, docs, planted = corpus(seed=6, n=60)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = dc.by_document(documents(spark, docs), bench).collect()
    parts = dc.by_document(documents(spark, docs), bench, block_items=7).collect()
    assert sorted(whole) == sorted(parts)
    assert sorted(r.doc_id for r in dc.without_contaminated(documents(spark, docs), bench, block_items=7).collect()) == [d for d in range(60) if d not in planted]


def test_edited_item_in_a_copy_group_of_a_third_of_the_rows(spark):
    """Words of an item that a third of the rows hold still count: edited copies are found in the group and elsewhere."""
    rng = random.Random(11)
    items, docs, planted = corpus(seed=8, n=300)
    words = items[3][1].split()
    edited = [rng.choice(VOCAB) if k % 9 == 4 and k < len(words) - 4 else w for k, w in enumerate(words)]
    hot = " ".join([prose(rng, 40), *edited, prose(rng, 40)])
    other = [rng.choice(VOCAB) if k % 9 == 7 and k < len(words) - 4 else w for k, w in enumerate(words)]
    apart = " ".join([prose(rng, 60), *other, prose(rng, 25)])
    texts = [*docs, *[hot] * 160, apart]
    want = {**planted, **dict.fromkeys(range(300, 461), 3)}
    out = dc.by_document(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in out if r.contaminated} == want


def test_edits_within_a_hot_group_do_not_hide_its_item(spark):
    """The same where each row of the group has edits of its own, so no two rows are equal."""
    items, docs, planted = corpus(seed=8, n=300)
    words, rng, hot = items[3][1].split(), random.Random(12), []
    for _ in range(160):
        off = rng.randrange(9)
        hot.append(" ".join([rng.choice(VOCAB) if k % 9 == off and k < len(words) - 4 else w for k, w in enumerate(words)]))
    texts = [*docs, *(f"{prose(rng, 40)} {t} {prose(rng, 40)}" for t in hot)]
    out = dc.by_document(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: r.item_id for r in out if r.contaminated}
    assert {d: i for d, i in got.items() if d < 300} == planted
    assert sum(got.get(d) == 3 for d in range(300, 460)) >= 150  # the latent search is approximate: 156 when written


def test_a_copy_in_a_table_of_its_own_words_is_found(spark):
    """Most rows share the item's words, so its latent direction is the mean; an edited copy is found all the same."""
    item = "Which harbour did the northern fleet leave before sunrise while guard number twelve counted lanterns"
    words = item.split()
    pattern = [f"northern fleet harbour before number {i} guard counted leave lanterns sunrise" for i in range(300)]
    edited = words[:]
    edited[4], edited[5], edited[11] = edited[5], edited[4], "soldier"
    docs = [*pattern, " ".join(edited), item]
    out = {r.doc_id: r for r in dc.by_document(documents(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out[300].contaminated and out[301].contaminated and out[300].lcs_share >= 0.75
    assert not any(out[d].contaminated for d in range(300))


def test_unspaced_scripts_capitals_and_signs(spark):
    chinese = "北方舰队在日出之前离开了哪一个港口并且数了多少盏灯笼"
    russian = "какая северная эскадра вышла из гавани перед рассветом считая фонари на стене"
    greek = "ποιος στόλος έφυγε από το λιμάνι πριν από την αυγή μετρώντας φανάρια"
    english = "which lantern did the keeper's mate carry over the harbour wall that winter night"
    items = spark.createDataFrame(list(enumerate([chinese, russian, greek, english])), "item_id long, text string")
    rng = random.Random(2)
    docs = [
        f"昨天我们看见了很多东西然后{chinese}最后大家都回家了", prose(rng, 20) + " " + russian.upper() + " " + prose(rng, 20), f"{greek.upper()} {prose(rng, 5)}",
        "which “lantern” did the keeper’s\u00a0mate carry — over the harbour\u2009wall, that winter night", "昨天我们看见了很多东西", prose(rng, 60),
    ]
    out = {r.doc_id: r.item_id for r in dc.by_document(documents(spark, docs), items).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None}


def test_no_copy_is_lost_at_any_cosine(spark):
    """With the latent candidates off, the exact ones find every copy that the rule names; paraphrases need the latent ones."""
    items, docs, planted = corpus(seed=9, n=200)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kinds = lambda p: {r.doc_id: (r.item_id, r.lcs_share) for r in dc.by_document(documents(spark, docs), bench, p).collect() if r.kind == "copy"}
    assert kinds(dc.Params(min_cosine=2.0)) == kinds(dc.Params(min_cosine=-1.0)) != {}


def plain_space(items):
    """A space of the items' words, all of one weight, with random directions."""
    known = dc.Vocabulary.of(np.unique(dc.words_of(pa.array(items))[0]))
    rng = np.random.default_rng(1)
    return dc.Space(known, np.ones(len(known.words), np.float32), rng.standard_normal((dc.Params.features, 8)).astype(np.float32), np.zeros(8, np.float32))


def test_terms_are_looked_up_a_few_times_however_many_lengths_items_have(monkeypatch):
    """The work for a text's terms does not grow with the number of window sizes (it did: twice a size)."""
    rng = random.Random(14)
    common = VOCAB[:40]
    texts = [" ".join(w for k in range(n // 2) for w in (rng.choice(common), f"own{n}x{k}")) for n in range(8, 208, 8)]
    space = plain_space(texts)
    space.idf[~np.isin(space.known.words, dc.words_of(pa.array([" ".join(common)]))[0])] = 3
    searcher = dc.Searcher(space, [dc.read_item(i, t, space, dc.Params()) for i, t in enumerate(texts)], dc.Params())
    assert len(searcher.by_blocks) >= 20
    docs, looked, searchsorted = pa.array([*(" ".join(rng.choice(common) for _ in range(400)) for _ in range(20)), *texts]), [0], np.searchsorted

    def counting(a, v, *rest, **named):
        looked[0] += np.size(v) if len(a) > 1 else 0
        return searchsorted(a, v, *rest, **named)

    monkeypatch.setattr(np, "searchsorted", counting)
    found = searcher.search(docs)
    terms = int(dc.terms_of(docs, space.idf, space.known)[2].sum())
    assert all(20 + i in found and i in found[20 + i] for i in range(len(texts)))
    assert looked[0] < 10 * terms


def test_the_bound_of_a_window_counts_no_terms_of_other_rows():
    rng = random.Random(15)
    item = prose(rng, 40)
    space = plain_space([item])
    searcher = dc.Searcher(space, [dc.read_item(0, item, space, dc.Params())], dc.Params())
    words = item.split()
    docs = [" ".join(words[:13]), " ".join(words[13:]), item, "", " ".join(words[5:]), words[0]]
    _, ids, counts = dc.terms_of(pa.array(docs), space.idf, space.known)
    starts, rows = dc._runs(counts, 8)
    _, held = searcher._by_block(ids, starts)
    first = np.searchsorted(rows, np.unique(rows))
    got = searcher._shared(held, first, np.searchsorted(rows, np.unique(rows), "right"))[:, 0]
    assert got.tolist() == [13, 27, 40, 35, 1]
    assert {k: set(v) for k, v in searcher.search(pa.array(docs)).items()} == {1: {0}, 2: {0}, 4: {0}}


def test_documents_are_counted_once_a_row():
    rng = random.Random(16)
    texts = [None, "", "b", *(" ".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 30))) for _ in range(60)), "", "a b a b a"]
    known = dc.Vocabulary.of(np.unique(dc.words_of(pa.array(["a b c"]))[0]))
    groups = 1 << dc.CONTEXT_BITS
    by_word, by_context = np.zeros(3, np.int64), np.zeros(3 * groups, np.int64)
    dc.count_documents(*dc._contexts(pa.array(texts), known), by_word, by_context)
    place = {w: int(np.searchsorted(known.words, dc.words_of(pa.array([w]))[0][0])) for w in "abc"}
    hashed = {w: int(dc.words_of(pa.array([w]))[0][0]) for w in "abcxyz"} | {None: 0}

    def group(before, after):
        return ((hashed[before] * dc._MIX % 2**64 ^ hashed[after]) * dc._BASE % 2**64) >> (64 - dc.CONTEXT_BITS)

    want_word, want_context = Counter(), Counter()
    for t in texts:
        own = [None, *(t or "").split(), None]
        held = {(place[w], group(own[k], own[k + 2])) for k, w in enumerate(own[1:-1]) if w in "abc"}
        want_context.update(held)
        want_word.update({w for w, _ in held})
    assert by_word.tolist() == [want_word[i] for i in range(3)]
    assert by_context.tolist() == [want_context[divmod(i, groups)] for i in range(3 * groups)]
