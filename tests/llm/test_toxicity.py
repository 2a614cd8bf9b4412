import itertools
import random

import numpy as np

from fieldspark.llm import toxicity

CLEAN = "the garden is a quiet place and people walk there often with their dogs reading books about history music science travel".split()
BAD = ["idiot", "moron", "stupid", "worthless"]


def corpus(n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(CLEAN, k=rng.randint(5, 80))
        bad = k % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return docs, labels


def test_decode_is_the_cheapest_reading():
    rng = np.random.default_rng(0)
    cost = rng.uniform(0.1, 6, size=(28, 28, 28)).tolist()
    for token in ("1d10t", "st00pid", "i.d.i.o.t", "w0rrrrd", "a1", "a b c d"):
        options = [*toxicity._options(token), [(" ", 0.0)]]

        def total(path):
            x = y = 0
            out = 0.0
            for reading, channel in path:
                out += channel
                for s in toxicity.fold(reading):
                    out += cost[x][y][s]
                    x, y = y, s
            return out

        best = min(itertools.product(*options), key=total)
        assert toxicity.decode(token, cost) == "".join(r for r, _ in best).strip()


def test_letters_beyond_latin_1_are_letters():
    a, o = 1, toxicity.OTHER
    assert list(toxicity.fold("aé ß1")) == [a, 5, 0, o, 0]
    assert list(toxicity.fold("śŻ łΩ я中’…")) == [19, 26, 0, o, o, 0, o, o, 0, 0]
    assert set(toxicity.fold("Привет")) == {o} and len(toxicity.fold("привет мир")) == 10


def test_scores_restored_texts(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(1, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    assert set(BAD) <= set(model.odds) and not set(CLEAN) & set(model.odds)
    hidden = ["you 1d10t", "what an i d i o t you are", "so stuuuupid really", "m0r0n", "w.o.r.t.h.l.e.s.s work", "ST0PID idiot"]
    fine = ["a quiet place", "room 101 at 10:30", "well-known garden.", "see https://example.org/a1b2", None, "", "aaaa", "x" * 300_000 + " 1a" * 1000]
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(hidden + fine)] + [(None, "moron"), (0, hidden[0])], "doc_id long, text string").withColumnRenamed("text", "body")
    got = toxicity.score(odd, model, text_col="body", out="s").collect()
    by = {r.doc_id: r.s for r in got}
    assert len(got) == len(hidden + fine) + 2 and all(0 <= r.s <= 1 for r in got)
    assert all(by[k] >= 0.3 for k in range(len(hidden))) and by[None] >= 0.3
    assert all(by[k] < 0.3 for k in range(len(hidden), len(hidden + fine)))
    truth, scores = dict(labels), {r.doc_id: r.score for r in toxicity.score(frame, model, out="score").collect()}
    held = [k for k in truth if k % 4 == 0]
    assert sum((scores[k] >= 0.3) == truth[k] for k in held) >= 0.98 * len(held)
    restored = {r.doc_id: r.restored for r in toxicity.restored(odd.filter("doc_id < 2"), model, text_col="body").collect()}
    assert restored == {0: "you idiot", 1: "what an idiot you are"}


HIDDEN = ["!diot", "|oser", "+rash", "1d107", "c l o w n", "c  l  o  w  n", "i, d, i, o, t", "i.d-i_o t", "iiddiioott", "a s s", "s. c. u. m", "+idiot", "|trash"]


def test_hidden_forms_reach_the_decoder():
    """A model of the plain words reads each form; what holds no hidden word stays."""
    plain = "idiot loser trash clown ass scum garden quiet place people bookkeeper important room".split()
    counts = sum(np.bincount((x[:-2] * 28 + x[1:-1]) * 28 + x[2:], minlength=28**3) for w in plain for x in [np.frombuffer(b"\0" + toxicity.fold(f" {w} ") + b"\0", np.uint8).astype(int)])
    tri = counts.reshape(28, 28, 28)
    restore = toxicity.Restorer(-np.log((tri + 0.02) / (tri.sum(axis=2, keepdims=True) + 0.56)))
    got = {x: set(restore(f"you {x} there", both=True).split()) & set(plain) for x in HIDDEN}
    assert [x for x in HIDDEN if not got[x]] == []
    for text in ("bookkeeper", "room 5", "10:30", "1 2 3 4", "a != b", "!!", "1010", "wow!! A,!!", "a$$$"):
        assert restore(text, both=True) == text


def test_words_of_few_toxic_texts_count(spark):
    """Of 300 toxic texts among 7,000: words of 4 and 5, each under 2 %, and a word that clean texts have too."""
    rng = random.Random(5)
    docs = []
    for k in range(7000):
        words = rng.choices(CLEAN, k=12)
        if k < 280:
            words += rng.sample(BAD, 2)
        elif k < 285:
            words.append("maldito")
        elif k < 289:
            words.append("cretino")
        elif k < 300:
            words.append("moron")
        if k < 20 or k >= 6940:
            words.append("shabby")
        docs.append((k, " ".join(words), int(k < 300)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(frame, frame)
    assert {"maldito", "cretino", "shabby", *BAD} <= set(model.odds) and not set(CLEAN) & set(model.odds)
    odd = spark.createDataFrame([(0, "eres un maldito"), (1, "un cretino"), (2, "the garden")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(odd, model).collect()}
    assert got[0] >= 0.3 and got[1] >= 0.3 and got[2] < 0.3


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(none, labels)
    assert toxicity.score(none, model).count() == 0
    one = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    assert toxicity.score(one, toxicity.fit(one, labels)).first().toxicity < 0.01
