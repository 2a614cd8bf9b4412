import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import mixing


def slow_targets(sizes):
    """Source -> target, by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        for s in over or free:
            out[s] = 2.0 * sizes[s] if over else weight[s] * share
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over or free
    return out


def corpus(n=4000):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 9, 40])) + rng.choice(["", " \n", "\x0bé"]), rng.choice(["hot"] * 5 + ["a", "b", "Z", "é", None, "tiny" if k % 50 == 0 else "c"])) for k in range(n)]
    return rows + [(None, None, None), (None, "x y", "a"), (5, "x " * 30000, "b"), (7, "same", "c"), (7, "same", "c")]


def test_targets_and_words_taken(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Size", F.lit("clash")).repartition(5)
    mixed = mixing.mix(docs, block=32, fan=4, shards=6)
    assert mixed.columns[:4] == ["doc_id", "text", "source", "Size"] and mixed.columns[4:] == ["_size", "source_size", "target", "taken", "draws"]
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert r._size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 2 * r._size
        assert r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < 6 for d in r.draws)
        sizes[r.source] = sizes.get(r.source, 0) + r._size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    want = slow_targets(sizes)
    assert all(target[s] == pytest.approx(want[s]) for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(2), block=32, fan=4, shards=6).select("doc_id", "text", "taken").collect()
    assert sorted(map(tuple, again), key=str) == sorted(((r.doc_id, r.text, r.taken) for r in out), key=str)


def test_appearances_hold_the_words_drawn(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block=16)
    rows = mixing.appearances(docs, mixed)
    assert rows.columns == docs.columns
    words = mixing.n_words(F.col("text"))
    assert rows.agg(F.sum(words)).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    wholes: dict = {}  # id 5 has two texts
    for r in docs.collect():
        wholes.setdefault(r.doc_id, []).append(r.text or "")
    for part in rows.filter(words > 0).collect():
        assert any(whole.startswith(part.text) for whole in wholes[part.doc_id])


def test_tree_splits_every_quota_exactly():
    quotas = np.array([1000, 0, 7, 333])
    out = mixing.split_quotas(quotas, 5)
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all()
    assert out.sum(axis=0).max() - out.sum(axis=0).min() <= 3
    assert (out == mixing.split_quotas(quotas, 5)).all() and (out != mixing.split_quotas(quotas, 5, seed=1)).any()
    many = np.array([mixing.split_quotas(np.array([6, 4]), 2, seed=k)[0, 0] for k in range(2000)])
    assert many.mean() == pytest.approx(3, abs=0.1)  # hypergeometric: 5 draws of which 6 in 10 are the first source's
    assert many.var() == pytest.approx(5 * 0.6 * 0.4 * 5 / 9, abs=0.08)


def slow_shards(quotas, shards):
    """The shard of each draw of each source, one by one."""
    return [[k for k, n in enumerate(shares) for _ in range(n)] for shares in mixing.split_quotas(quotas, shards).tolist()]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_hold_what_the_tree_says(spark, shards):
    """Of each source, each shard has the next run of block draws, as many as its quota; so shards are even."""
    rng = random.Random(3)
    rows = [(k, f"w{k} x y", rng.choice("aaab")) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, block=8, fan=16, shards=shards).collect()
    sums, runs = {}, {}
    for r in out:
        for d in r.draws:
            sums[d.shard] = sums.get(d.shard, 0) + d.words
            runs.setdefault((r.source, d["pass"]), []).append(d.shard)
    assert set(sums) == set(range(shards))
    assert max(sums.values()) < 1.5 * sum(sums.values()) / shards
    for (source, turn), found in runs.items():  # a later pass goes on in the shards after those of the one before
        assert turn == 0 or min(found) >= max(runs[source, 0])


@pytest.mark.parametrize("shards", [1, 5, 700, 3000])
def test_cells_say_each_draws_shard(shards):
    quotas = np.array([1000, 0, 7, 333, 40000])
    cells = {(turn, cell): (width, shard, bounds) for turn, width, cell, shard, bounds in mixing.tree_cells([0, 1, 2, 3, 4], quotas, shards)}
    widths = {turn: width for (turn, _), (width, _, _) in cells.items()}
    for turn, want in enumerate(slow_shards(quotas, shards)):
        got = []
        for draw in range(len(want)):
            _, shard, bounds = cells[turn, draw // widths[turn]]
            got.append(shard + sum(b <= draw for b in bounds))
        assert got == want
    assert max(len(bounds) for _, _, bounds in cells.values()) <= 3 * mixing.CELL + 60


def test_a_hundred_thousand_shards(spark, monkeypatch):
    rows = [(k, "w " * (k % 7), "abc"[k % 3]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = lambda shards: {r.doc_id: (r.taken, r.draws) for r in mixing.mix(docs, block=1, fan=64, shards=shards).collect()}
    out = mixed(100_000)
    shards = [d.shard for _, draws in out.values() for d in draws]
    assert len(out) == 3000 and all(0 <= s < 100_000 for s in shards) and len(set(shards)) > 1000
    monkeypatch.setattr(mixing, "FEW_BYTES", 0)  # nothing is broadcast
    assert mixed(100_000) == out
    assert {k: taken for k, (taken, _) in mixed(3).items()} == {k: taken for k, (taken, _) in out.items()}


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mix(blank).collect()] == [(0, 0.0)] * 2
