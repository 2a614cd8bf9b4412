import base64
import random
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldspark.llm import bpe

ROOT = Path(__file__).resolve().parents[2]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(1)
    alphabet = "aabbeehllooo  \n\t.,'0123éßжд中文🙂́\x00\x1c\x85\xa0 sStTrd"
    out = [None, "", " ", "\n\n  a", "a" * 5000, "<|endoftext|>", "don't we'll 12345 ...!!", "x " * 3000]
    out += ["".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(300)]
    return out + ["the quick brown fox"] * 3


def test_ids_and_round_trip(spark):
    rows = [(k, t, 1) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int").withColumnRenamed("IDS", "other").repartition(3)
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) == REFERENCE.encode_ordinary(r.text or "")
        assert bytes(r.bytes).decode() == (r.text or "")


def test_replay_waits_for_lower_ranks():
    # "ab" merges late, but "abc" has a lower rank than "ab": it must be made before the second "ab"
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"bc": 500, b"cab": 350}
    for text in (b"abcab", b"abab", b"ababcab", b"cabcab"):
        parts = [bytes([b]) for b in text]
        while True:
            options = [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
            if not options:
                break
            _, k = min(options)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        ids, counts = bpe.replay([text, b"", text], bpe.Merges(ranks))
        assert ids.tolist() == [ranks[p] for p in parts] * 2 and counts.tolist() == [len(parts), 0, len(parts)]


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        bpe.replay([b"az"], bpe.Merges({b"a": 0, b"aa": 1}))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).agg(F.count("*")).first()[0] == 0


def test_small_bounds_change_no_id():
    """Replays of few bytes, windows within pieces, and forgotten pieces."""
    rng = random.Random(3)
    for size, known in ((2, (3, 9)), (5, (50, 100)), (16, (4, 1000))):
        encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, replay_bytes=size, stride=3, known=known)
        for alphabet in ("ab", "the", "aehtnoisr", "é中a", " ", "\n ", "=-", "0123456789"):
            texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3)] + [None, ""]
            assert [x.tolist() for x in encoder.encode(texts)] == [REFERENCE.encode_ordinary(t or "") for t in texts]


def test_memory_is_bounded_within_one_text():
    """6 MB of distinct words, and one piece of 2 MB: the peak stays under 12 bytes a byte of text and 230 MB."""
    code = """
import random, resource, sys, public_tokenizers
from fieldspark.llm import bpe
path = public_tokenizers.path("byte_bpe_50k.tiktoken")
encoder = bpe.Encoder(bpe.read_ranks(path), public_tokenizers.PATTERN)
rng = random.Random(1)
letters = "abcdefghijklmnopqrst"
text = " ".join("".join(rng.choices(letters, k=9)) for _ in range(600_000)) + " " + "ab" * 1_000_000
(ids,) = encoder.encode([text])
assert encoder.spelling.bytes_of(ids).decode() == text
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, len(text) / 1e6)
"""
    peak, size = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT, timeout=600).stdout.split())
    assert peak < 230 + 12 * size


def test_decode_of_ids_that_are_none(spark):
    rows = [(1, [464, 262]), (2, [464, None]), (3, [464, 60000]), (4, [-1]), (5, None), (6, []), (6, [])]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = sorted((r.doc_id, r.bytes and bytes(r.bytes)) for r in bpe.decode(docs, PATH).collect())
    tokens = {v: k for k, v in RANKS.items()}
    assert got == [(1, tokens[464] + tokens[262]), (2, None), (3, None), (4, None), (5, b""), (6, b""), (6, b"")]


def test_round_trip_in_one_worker(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string").repartition(2)
    for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect():
        assert list(r.coded.ids) == REFERENCE.encode_ordinary(r.text or "") and bytes(r.coded.bytes).decode() == (r.text or "")
