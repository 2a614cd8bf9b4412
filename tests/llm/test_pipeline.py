import base64
import random

import public_tokenizers
import pytest
import tiktoken
from test_mixing import slow_targets
from test_simhash import slow_components

import corpus_pipeline

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TOKENIZER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = {"en": "the of garden walking people quietly reading about history while evening light fell over river and".split(), "de": "der und nicht über schöne straße gegen abend ging langsam durch wald nach haus wieder".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, home = random.Random(9), tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for k in range(400):
        lang = rng.choice(["en", "de"])
        words = rng.choices(WORDS[lang], k=rng.randint(40, 120))
        toxic = k % 4 == 1 and k < 300
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "1d10t"]))
        docs.append((k, " ".join(words), lang, rng.choice(["a", "b", "b", "b", "c", None]), 0, "extra"))
        labels.append((k, 0, int(toxic)))
    docs += [(1000 + k, docs[k][1], docs[k][2], docs[k][3], 0, None) for k in range(0, 40, 2)]  # copies
    docs += [(2000, None, None, None, None, None), (2001, "", "en", "a", 0, None), (2002, "12 34 !", "en", "a", 0, None), (None, docs[2][1], None, "b", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home), docs


def test_stages_in_order(spark, corpus):
    home, docs = corpus
    toxic = {k for k in range(400) if k % 4 == 1 and k < 300}
    frame, kept = spark.read.parquet(f"{home}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, home)
        if name != "bpe":
            assert out.columns == frame.columns
            out.write.parquet(f"{home}/{name}")
            out = spark.read.parquet(f"{home}/{name}")
        kept[name] = out.collect()
        frame = out
    first = [r.doc_id for r in kept["toxicity"]]
    assert sorted(first, key=str) == sorted((d[0] for d in docs if d[0] not in toxic), key=str)
    second = [(r.doc_id, r.text) for r in kept["language"]]
    assert len(second) == len(first) - 3 and not {2000, 2001, 2002} & {k for k, _ in second}
    third = kept["near_duplicates"]
    assert sorted(r.doc_id for r in third) == sorted({c for _, _, c in slow_components(second)})
    sizes = {}
    for r in third:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = {}
    whole = {r.doc_id: r.text for r in third}
    for r in kept["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert taken == {s: pytest.approx(t, abs=1) for s, t in slow_targets(sizes).items()}
    want = sorted((r.doc_id, TOKENIZER.encode_ordinary(r.text)) for r in kept["mixing"])
    assert sorted((r.doc_id, list(r.ids)) for r in kept["bpe"]) == want


def test_run_gives_the_rows_of_the_last_stage(spark, corpus):
    home, _ = corpus
    out = corpus_pipeline.run(spark, home)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    again = corpus_pipeline.run(spark, home)
    rows = sorted((r.doc_id, list(r.ids)) for r in out.collect())
    assert rows and rows == sorted((r.doc_id, list(r.ids)) for r in again.collect())


def test_hard_rows_through_all_stages(spark, corpus, tmp_path):
    """Nulls, repeated rows, clashing names and a very long text; and then no rows at all."""
    home, docs = corpus
    long_text = " ".join(WORDS["en"] * 4000)
    rows = docs + [(3000, long_text, "en", "a", 0, None), (3000, long_text, "en", "a", 0, None), (None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, size string"
    for name, part in (("hard", rows), ("none", [])):
        spark.createDataFrame(part, names).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{home}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == bool(part)
        for r in out:
            if r.doc_id == 3000:
                whole = TOKENIZER.encode_ordinary(long_text)
                assert list(r.ids) == whole[: r.n_tokens] or r.n_tokens == len(whole)
        assert len({r.doc_id for r in out if r.doc_id == 3000}) <= 1


def test_only_the_table_that_the_result_reads_remains(spark, corpus):
    home, _ = corpus
    out = corpus_pipeline.run(spark, home)
    read = {f.rsplit("/", 2)[0] for f in out.inputFiles()}
    assert len(read) == 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(read.pop())
    left = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    assert [x.getPath().getName() for x in left] == ["3-mixing"] and out.count()
