import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldspark.llm import simhash


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    low = {}
    for (k, _), l in zip(rows, label):
        if k is not None:
            low[l] = min(k, low.get(l, k))
    return sorted(((k, fp, low.get(l)) for (k, _), fp, l in zip(rows, fps, label)), key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "ß", " x"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one two"), (5, "ONE\x0btwo three"), (5, "ONE\x0btwo three"), (None, "one two"), (None, None)]
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        for copy in range(rng.randint(1, 5)):
            w = list(words)
            for _ in range(copy):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("key_bytes", [2, 3, 5])
def test_components_equal_brute_force(spark, key_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("FP", F.lit("x"))
    out = simhash.near_duplicates(docs, key_bytes=key_bytes).collect()
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in out), key=str) == slow_components(rows)


def test_blocks_of_a_large_posting_lose_no_link(spark):
    rng = random.Random(3)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 120:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(20)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.link_edges(frame, block=16)).collect()}
    assert len({stars.get(f, f) for f in fps}) == 1


def test_position_sets_that_miss_pairs_are_refused():
    with pytest.raises(ValueError):
        simhash.position_sets(3, 4)


def test_one_row_of_each_component_stays(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, uid int").write.parquet(str(tmp_path / "d"))
    kept = simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == ["doc_id", "text", "uid"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in slow_components(rows)})


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_splits_may_change_between_the_readings(spark, tmp_path, few):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(5000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    rows = [(k, texts[k % 200], k % 3 or None, {"a": k}) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, m map<string,int>").repartition(12).write.parquet(str(tmp_path / "d"))
    docs, key = spark.read.parquet(str(tmp_path / "d")), "spark.sql.leafNodeDefaultParallelism"
    try:
        spark.conf.set(key, "2")
        kept = simhash.drop_near_duplicates(docs, few=few)
        spark.conf.set(key, "24")
        assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == list(range(200))
    finally:
        spark.conf.unset(key)


def test_rows_equal_in_every_column_are_one(spark, tmp_path):
    rows = [(1, "one two three", "x")] * 5 + [(1, "one two three", None), (None, None, None), (None, None, None), (None, "four", None), (None, "four", None), (7, "", "x"), (8, "", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = simhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, "one two three"), (7, ""), (None, "four")], key=str)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_fingerprints_equal_brute_force(spark, hot):
    rows = corpus() + [(5000 + k, "the same text in many rows") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.near_duplicates(docs, hot=hot).collect()
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in out), key=str) == slow_components(rows)


@pytest.mark.parametrize("few", [0, 1, 10])
def test_spread_join_keeps_every_row(spark, few):
    rows = spark.createDataFrame([(k, k % 3 if k % 2 else 9) for k in range(200)], "k long, key long")
    table = spark.createDataFrame([(9, "a", 100), (0, "b", 33), (1, "c", 34), (2, "d", 33)], "key long, v string, n long")
    out = simhash.spread_join(rows, table, "key", hot=33, few=few).collect()
    want = {9: "a", 0: "b", 1: "c", 2: "d"}
    assert sorted(r.k for r in out) == list(range(200)) and all(r.v == want[r.key] for r in out)


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_portions_change_no_fingerprint(size):
    for _, text in corpus():
        signed = simhash.fingerprint((text or "").encode(), size=size)
        assert signed % 2**64 == slow_fingerprint(text)


def test_very_long_text(spark):
    text = "some words again " * 200_000
    docs = spark.createDataFrame([(1, text), (2, text + "end"), (3, "else")], "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[1].fingerprint % 2**64 == slow_fingerprint("some words again some words again some words again") and got[1].component_id == got[2].component_id == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0
