import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import ann, topk


def table(spark, seed=0, n=900, d=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]  # many copies
    x[200:230] = x[200] + 1e-7 * rng.normal(size=(30, d))
    rows = [(k, v) for k, v in enumerate(x.astype(np.float32).astype(float).tolist())]
    odd = [(n, None), (n + 20, [0.0] * d), (n + 21, [float("nan")] * d), (n + 22, [None] + [1.0] * (d - 1)), (n + 23, [float("inf")] * d), (n + 24, []), (None, [1.0] * d), (7, rows[7][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    return frame.withColumn("V", F.lit(1)).withColumn("rep", F.lit(2)), [(k, np.array(v)) for k, v in rows]


def brute(rows, score, top=20):
    x = np.stack([v for _, v in rows])
    out = {}
    for k, v in rows:
        if k % 20 == 0:
            s = score(x, v)
            order = sorted((-s[i], rows[i][0]) for i in range(len(rows)) if rows[i][0] != k)[:top]
            out[k] = [(i, -t) for t, i in order]
    return out


def lists(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        have = out.setdefault(r.query_id, [])
        have.append((r.vec_id, r.score))
        assert r.rank == len(have)
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_topk_equals_brute_force(spark, block):
    frame, rows = table(spark)
    rows.append((920, np.zeros(24)))  # takes part here
    want = brute(rows, lambda x, v: np.floor(64 * x).astype(int) @ np.floor(64 * v).astype(int))
    assert lists(topk.search(frame, F.col("id") % 20 == 0, block=block)) == want


def test_ann_recall_and_exact_scores(spark):
    frame, rows = table(spark, d=32)
    x = dict(rows)
    want = brute(rows, lambda m, v: m @ v)
    got = lists(ann.search(frame, F.col("id") % 20 == 0, block=100))
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for k, found in got.items():
        assert len(found) == 20 and k not in [i for i, _ in found]
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
        for i, s in found:
            assert s == pytest.approx(float(x[k] @ x[i]), abs=1e-12)
    copies = [i for i in range(100, 160)]
    assert [i for i, _ in got[100]] == copies[1:21] and [i for i, _ in got[140]] == copies[:20]


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_buckets_nearest_to_a_row(hashes):
    x = np.random.default_rng(4).normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signed = ann.signed_axes(x, 1, hashes, 0)
    width = signed[0].shape[1]
    loss = np.zeros((40, 1))
    for s in signed:
        loss = (loss[:, :, None] + ((s.max(axis=1, keepdims=True) - s) ** 2)[:, None, :]).reshape(40, -1)
    for probes in (1, 3, width**hashes // 9 + 1, width**hashes):
        got = ann.nearest_buckets(signed, probes)
        assert got.shape == (40, probes) and all(len(set(g)) == probes for g in got.tolist())
        want = np.sort(loss, axis=1)[:, :probes]
        if probes <= 3 or probes == width**hashes:
            assert np.sort(np.take_along_axis(loss, got, axis=1), axis=1) == pytest.approx(want)


@pytest.mark.parametrize("hashes,block", [(1, 50), (2, 7), (3, 1000)])
def test_all_buckets_are_exact(spark, hashes, block):
    """Copies in one cell, cells of many blocks, and probes of every bucket: what is found is what brute force finds."""
    frame, rows = table(spark, n=300, d=5)
    found = lists(ann.search(frame, F.col("id") % 20 == 0, tables=2, hashes=hashes, part=1.0, block=block))
    want = brute(rows, lambda m, v: m @ v)
    assert {k: [i for i, _ in v] for k, v in found.items() if k not in (100, 120, 140, 200, 220)} == {k: [i for i, _ in v] for k, v in want.items() if k not in (100, 120, 140, 200, 220)}
    assert set(found) == set(want)


def test_the_part_probed_falls_as_rows_grow():
    parts = [ann.part_probed(n) for n in (0, 10, 10_000, 10**6, 10**9)]
    assert parts[0] == 1.0 and parts == sorted(parts, reverse=True) and parts[-1] < 0.004


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(20 * k, rng.normal(size=8).tolist()) for k in range(9)] + [(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for found in (lists(ann.search(frame, F.col("id") % 20 == 0)), lists(topk.search(frame, F.col("id") % 20 == 0))):
        assert len(found) == 9 and all(len(v) == 8 for v in found.values())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.search(frame, F.col("id") % 20 == 0).count() == topk.search(frame, F.col("id") % 20 == 0).count() == 0


def clusters(seed=5, n=3000, d=12):
    """Vectors in tight clusters far apart; one in three is in the first."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 5
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 12, n))
    return centres[of] + 0.05 * rng.normal(size=(n, d))


@pytest.mark.parametrize("outlines", [topk.OUTLINES, 0])
def test_topk_on_clusters_equals_brute_force(spark, monkeypatch, outlines):
    monkeypatch.setattr(topk, "OUTLINES", outlines)  # 0: norms alone
    rows = list(enumerate(clusters()))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in rows], "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows, lambda x, v: np.floor(64 * x).astype(int) @ np.floor(64 * v).astype(int))
    assert lists(topk.search(frame, F.col("id") % 20 == 0, block=128)) == want


def test_outlines_reject_blocks_and_never_one_that_counts():
    x = np.floor(64 * clusters())
    blocks = np.array_split(x[np.lexsort(x.T[::-1])], 40)
    import pyarrow as pa

    centres = [b.mean(axis=0) for b in blocks]
    table = pa.table({"dim": [12] * 40, "cell": range(40), "part": [0] * 40, "norm": [np.linalg.norm(b, axis=1).max() for b in blocks], "radius": [np.linalg.norm(b - c, axis=1).max() for b, c in zip(blocks, centres)], "centre": [c.tolist() for c in centres]})
    queries = x[::50]
    scores = queries @ x.T
    least = np.sort(scores, axis=1)[:, -21]
    for full in (True, False):
        outlines = topk.Outlines(table if full else table.drop_columns(["centre"]), full)
        sent = set(zip(*(a.tolist() for a in outlines.blocks(12, queries, None, 2)))) | set(zip(*(a.tolist() for a in outlines.blocks(12, queries, least, 2))))
        for q in range(len(queries)):
            for b, block in enumerate(blocks):
                assert (q, b) in sent or (queries[q] @ block.T).max() < least[q]
        assert not full or len(sent) < 0.5 * len(queries) * 40


def test_empty_vectors_meet_each_other(spark):
    frame = spark.createDataFrame([(20, []), (40, []), (7, []), (60, [1.0]), (8, [2.0])], "vec_id long, embedding array<double>")
    got = lists(topk.search(frame, F.col("id") % 20 == 0))
    assert got == {20: [(7, 0), (40, 0)], 40: [(7, 0), (20, 0)], 60: [(8, 64 * 128)]}


@pytest.mark.parametrize("scale", [3, 40_000])
def test_bounds_never_drop_a_member(scale):
    rng = np.random.default_rng(1)
    cands = np.floor(scale * rng.standard_cauchy(size=(3000, 16)).clip(-400, 400))
    queries = np.floor(scale * rng.standard_cauchy(size=(50, 16)).clip(-400, 400))
    index = topk.ImpactIndex(cands)
    possible = index.possible(queries, 21)
    scores = queries @ cands.T
    members = scores >= np.partition(scores, 3000 - 21, axis=1)[:, 3000 - 21, None]
    assert (possible >= members).all() and possible.sum() <= 4 * 21 * 50
    assert possible.sum() > members.sum()  # it stopped on proof, before the last level
