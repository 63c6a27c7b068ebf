import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fernloom.llm import langid
from tests.llm.util import documents

SOUNDS = {"xa": "ka li mo tu re".split(), "yb": "sch und ber ach zt".split(), "zc": "eau que ion ent oir".split()}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def labelled(spark, rng, n=120):
    return spark.createDataFrame([(i, sentence(rng, l := list(SOUNDS)[i % 3]), l) for i in range(n)], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    model = langid.train(labelled(spark, rng))
    scorer = langid.Scorer(model)
    texts = [(lang, sentence(rng, lang, rng.randint(1, 12))) for lang in SOUNDS for _ in range(60)]
    out = scorer.predict([t for _, t in texts])
    assert sum(a == b[0] for (a, _), b in zip(texts, out, strict=True)) >= 0.97 * len(texts)
    assert all(0 <= s <= 1 for _, s, _ in out)


def brute_words(text):
    """Runs of letters and marks from the first letter on, by the Unicode categories."""
    out, own = [], ""
    for c in f"{text or ''} ".lower():
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and own):
            own += c
        elif own:
            out.append(own)
            own = ""
    return out


def brute_model(rows, max_words, max_ngrams, max_n):
    langs = sorted({lang for _, lang in rows})
    words = Counter((w, lang) for t, lang in rows for w in brute_words(t))

    def table(counts, most):
        kept = set()
        for lang in langs:  # of each language its most frequent ones
            own = {w: n for (w, x), n in counts.items() if x == lang}
            kept |= set(sorted(own, key=lambda w: (-own[w], w.encode()))[:most])
        sums = [sum(counts[w, lang] for w in kept) for lang in langs]
        return {w: [math.log((counts[w, lang] + 0.5) / (s + 0.5 * len(kept))) for lang, s in zip(langs, sums, strict=True)] for w in kept}

    grams = {}
    for n in range(1, max_n + 1):
        own = Counter()
        for (w, lang), k in words.items():
            p = f"^{w}$"
            for i in range(len(p) - n + 1):
                own[p[i : i + n], lang] += k
        grams[n] = table(own, max_ngrams)
    spoken = Counter()
    for (_, lang), n in words.items():
        spoken[lang] += n
    return langs, table(words, max_words), grams, [math.log(0.5 / (spoken[x] + 1)) for x in langs]


def brute_predict(model, text):
    langs, words, grams, unseen = model
    found = brute_words(text)
    if not found:
        return "und", 0.0, None
    total = [0.0] * len(langs)
    for w in found:
        v = words.get(w)
        if v is None:
            p, v = f"^{w}$", unseen
            for step, n in enumerate(sorted(grams, reverse=True)):
                known = [grams[n][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in grams[n]]
                if known:
                    v = [sum(x) / len(known) - 0.5 * step for x in zip(*known, strict=True)]
                    break
        total = [a + b for a, b in zip(total, v, strict=True)]
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    return langs[best], 1 / sum(math.exp(x - total[best]) for x in total), total[best] / len(found)


ODD = ["½ ²", "①② 12", "e\u0301t\u00e9 cafe\u0301", "\u0301 \u0300", "हिन्दी में", "İstanbul ǅ ﬁ", "don't l’eau x", "русский текст", "ka_li 3mo", None, "", " \n"]


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(sentence(rng, l := list(SOUNDS)[i % 3], 12) + " " + rng.choice([x for x in ODD if x]), l) for i in range(60)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    for limits in ((40, 60, 5), (30_000, 20_000, 3)):
        model = langid.train(df, 8_000, *limits)
        brute = brute_model(rows, *limits)
        texts = [*ODD, *(sentence(rng, lang, rng.randint(1, 6)) for lang in SOUNDS for _ in range(20)), *(t for t, _ in rows[:20])]
        for text, got in zip(texts, langid.Scorer(model).predict(texts), strict=True):
            want = brute_predict(brute, text)
            assert got[0] == want[0] and math.isclose(got[1], want[1], rel_tol=1e-9) and (got[2] == want[2] or math.isclose(got[2], want[2], rel_tol=1e-9)), text


def test_texts_without_a_letter_are_undetermined(spark):
    model = langid.train(labelled(spark, random.Random(6), 30))
    assert {x[:2] for x in langid.Scorer(model).predict(["½ ²", "①②", "\u0301", "12 !", "_", None])} == {("und", 0.0)}
    assert langid.words_of("Cafe\u0301 हिन्दी") == ["cafe\u0301", "हिन्दी"]


def test_words_first_then_shorter_ngrams():
    logs = lambda *rows: np.array(rows)
    model = langid.Model(["a", "b"], langid.Table(["cat"], logs([-1.0, -9.0])), {2: langid.Table(["^d", "do"], logs([-3.0, -2.0], [-5.0, -2.0])), 1: langid.Table(["z"], logs([-7.0, -1.0]))}, np.array([-20.0, -20.0]))
    scorer = langid.Scorer(model)
    scorer._add(["dog", "zz", "??"])
    rows = {w: scorer.logs[i].tolist() for w, i in scorer.index.items()}
    assert rows["cat"] == [-1.0, -9.0] and rows["dog"] == [-4.0, -2.0]
    assert rows["zz"] == [-7.5, -1.5] and rows["??"] == [-20.0, -20.0]
    assert [x[0] for x in scorer.predict(["cat", "dog", "zz", "zz cat", None, "", "12 !"])] == ["a", "b", "b", "a", "und", "und", "und"]


def test_small_cache_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    model = langid.train(labelled(spark, rng, 30))
    texts = [sentence(rng, lang, 5) for lang in SOUNDS for _ in range(30)]
    want = langid.Scorer(model).predict(texts)
    monkeypatch.setattr(langid, "CACHED_WORDS", 3)
    small = langid.Scorer(model)
    assert [small.predict([t])[0] for t in texts] == want


def test_tables_are_bounded_and_sample_is_a_share(spark):
    model = langid.train(labelled(spark, random.Random(3)), max_words=10, max_ngrams=7)
    assert 10 <= len(model.words.terms) <= 3 * 10 and all(len(t.terms) <= 3 * 7 for t in model.grams.values())  # three languages
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") < 20, "rare").otherwise("usual").alias("lang"))
    got = {r.lang: r["count"] for r in langid.sampled(rows, 200).groupBy("lang").count().collect()}
    assert got["rare"] == 20 and 140 < got["usual"] < 220  # a rare language is taken whole
    assert langid.sampled(rows, 5000).count() == 2000


def test_columns_held_out_nulls_and_empty(spark):
    rng = random.Random(4)
    train = labelled(spark, rng, 30).unionByName(spark.createDataFrame([(None, None, "xa"), (5, "text", None)], "doc_id long, text string, lang string"))
    model = langid.train(train)
    assert model.langs == sorted(SOUNDS)
    docs = documents(spark, [None, "", "123", sentence(rng, "xa"), "x " * 50_000])
    out = langid.with_language(docs.drop("score"), model)
    assert out.columns == [*docs.drop("score").columns, "lang_pred", "score", "fit"]
    assert [r.lang_pred for r in out.orderBy("doc_id").collect()][:4] == ["und", "und", "und", "xa"]
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.with_language(docs.drop("score"), nothing).collect()} == {"und"}
    assert langid.with_language(docs.drop("score").limit(0), model).count() == 0
    ids = spark.range(50).select(F.col("id"), langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)


def test_a_rare_language_keeps_its_words_and_labels_are_bounded(spark):
    rows = [(i, "alpha beta gamma delta epsilon zeta eta theta", "en") for i in range(40)]
    rows += [(100 + i, "uno dos tres cuatro", "es") for i in range(2)]
    rows += [(200 + i, f"noise{i}", f"junk{i:03d}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, max_words=4, max_langs=2)
    assert model.langs == ["en", "es"] and {"uno", "dos", "tres", "cuatro"} <= set(model.words.terms) and len(model.words.terms) == 8
    out = {r.doc_id: r.lang_pred for r in langid.with_language(df.drop("lang"), model).collect()}
    assert out[0] == "en" and out[100] == "es"
