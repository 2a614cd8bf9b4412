import itertools
import random

import numpy as np

from fieldspark.llm import langid

VOCABULARY = {"en": "the and of with that from have this which would".split(), "de": "der und nicht eine werden auch über für schön straße".split(), "ru": "и не что это быть весь свой который год".split()}


def texts(rng, n):
    out = []
    for k in range(n):
        lang = rng.choice(sorted(VOCABULARY))
        out.append((k, " ".join(rng.choices(VOCABULARY[lang], k=rng.randint(1, 60))) + ", 12.", lang))
    return out


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    lengths = np.array([4, 0, 1, 6, 3])
    scores = rng.normal(size=(lengths.sum(), 3)) * 3
    got = langid.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        cost = lambda p: sum(s[k, l] for k, l in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(cost, itertools.product(range(3), repeat=n)))
        assert abs(cost(got[at : at + n]) - best) < 1e-9
        at += n


def test_accuracy_spans_and_odd_texts(spark):
    rng = random.Random(3)
    train = spark.createDataFrame(texts(rng, 300) + [(900, "x", None), (901, None, "en"), (None, "the and of", "en")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["de", "en", "ru"]
    mixed = " ".join(VOCABULARY["en"] * 3 + VOCABULARY["ru"] * 3)
    odd = [(1000, None), (1001, ""), (1002, "12 ½ ² !"), (1003, mixed), (1004, "что " * 200_000), (None, "the and"), (1005, "DIE STRASSE und NICHT"), (1005, "DIE STRASSE und NICHT")]
    test = texts(rng, 200)
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in test] + [(k, t, "clash") for k, t in odd], "doc_id long, text string, lang string").repartition(3)
    out = langid.predict(docs, model).collect()
    assert len(out) == len(test) + len(odd)
    by = {r.doc_id: r.language for r in out}
    assert sum(by[k].lang == lang for k, _, lang in test) >= 0.97 * len(test)
    assert [by[k].lang for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0 and by[1000].spans == []
    assert [(s.start, s.n_words, s.lang) for s in by[1003].spans] == [(0, 30, "en"), (30, 27, "ru")]
    assert by[1004].lang == "ru" and by[1005].lang == "de" and by[None].lang == "en"
    assert all(0 <= r.language.score <= 1 for r in out)


def test_scripts_narrow_the_candidates(spark):
    model = langid.fit(spark.createDataFrame(texts(random.Random(1), 100), "doc_id long, text string, lang string"))
    scores = model.word_scores(["the", "слово", "中文"])
    ru = model.langs.index("ru")
    assert scores[0].argmax() != ru and scores[1].argmax() == ru and scores[1, 0] < -1000
    assert (scores[2] > -1000).all()  # a script of none leaves all


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert langid.predict(none, model).count() == 0
    assert langid.predict(spark.createDataFrame([(1, "the")], "doc_id long, text string"), model).first().language.lang == "und"
