"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word is a run of letters. Its score in a language is the log-probability of its character n-grams (one to four, word
ends included) under that language's hashed n-gram counts. A word's script, found from its first letter, leaves only the
languages that write at least one word in a hundred in it. Viterbi with a fixed switching penalty then labels the words
of a whole text; equal labels in a row are spans. The language of most letters is the text's.

The classifier is fitted on at most ``max_rows`` labelled texts, chosen by hash. Their n-grams are counted on executors;
the driver gets ``2**BITS`` numbers for each language and broadcasts them. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bound_batches, give_back, runs

BITS = 16
LONGEST = 4
#: Words whose n-grams are held at once.
CHUNK = 20_000
#: Bytes of text whose words are labelled together.
RUN_BYTES = 1 << 22
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").finditer
#: First code points of blocks and the script from there on; fixed values of Unicode.
RANGES = [(0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x900, 6), (0x980, 7), (0xE00, 8), (0x10A0, 9), (0x1100, 10), (0x1200, 7), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x2E80, 11), (0x3040, 12), (0x3100, 11), (0x3130, 10), (0x3190, 11), (0xAC00, 10), (0xD7B0, 7), (0xF900, 11), (0xFB50, 5), (0xFE70, 5), (0xFF00, 0), (0x10000, 7), (0x20000, 11)]
SCRIPTS = 13
_STARTS = np.array([a for a, _ in RANGES], np.uint32)
_SCRIPT = np.array([b for _, b in RANGES])


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of lower-case words, and each word's script."""
    padded = f" {' '.join(words)} "
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    gap = codes == 32
    owner = np.cumsum(gap) - 1
    starts = np.flatnonzero(gap)[:-1] + 1
    scripts = _SCRIPT[np.searchsorted(_STARTS, codes[starts], "right") - 1]
    inner = np.concatenate([[0], np.cumsum(gap)])
    buckets, owners = [], []
    state = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        state = (state[:m] + codes[n - 1 :].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        # white space only at either end of the n-gram, and not alone
        ok = inner[n - 1 : n - 1 + m] - inner[1 : 1 + m] <= 0 if n > 2 else np.ones(m, bool)
        if n == 1:
            ok = ~gap
        elif n == 2:
            ok = ~(gap[:m] & gap[1:])
        where = np.flatnonzero(ok)
        buckets.append((state[where] >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[where])
    return np.concatenate(buckets), np.concatenate(owners), scripts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            have = counts.setdefault(lang, np.zeros((1 << BITS) + SCRIPTS, np.int64))
            words = [m[0] for m in WORDS((text or "").lower())]
            for k in range(0, len(words), CHUNK):
                buckets, _, scripts = word_grams(words[k : k + CHUNK])
                have += np.bincount(np.concatenate([buckets, scripts + (1 << BITS)]), minlength=len(have))
    for lang, have in counts.items():
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(have[at])], names=["lang", "feature", "n"])


class Model:
    """Languages in code-point order, their n-gram log-probabilities (bucket, language) and the scripts they use."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        if not langs:
            return
        grams, scripts = counts[:, : 1 << BITS].astype(float), counts[:, 1 << BITS :]
        smooth = grams + 0.1
        table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.table = np.ascontiguousarray((table - table.max(axis=0)).T.astype(np.float32))
        used = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        used |= ~used.any(axis=0)
        self.script_cost = np.where(used, 0.0, -1e4).T.astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        return np.concatenate([self._scores(words[k : k + CHUNK]) for k in range(0, len(words), CHUNK)])

    def _scores(self, words: list[str]) -> np.ndarray:
        buckets, owner, scripts = word_grams(words)
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(words)))
        return np.add.reduceat(self.table[buckets[order]], starts, axis=0) + self.script_cost[scripts]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; scores: (words, labels) of sequences of the given lengths, one after another.

    All sequences advance together, the longest first, so that a step is an operation on arrays. Ties keep the label,
    and otherwise go to the first label.
    """
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    came = np.empty(scores.shape, np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences with more than t words
    own = np.arange(scores.shape[1], dtype=np.int16)
    best = np.zeros((len(lengths), scores.shape[1]), np.float64)
    last = np.empty(len(lengths), np.int64)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        d = best[:n]
        if t:
            top = d.argmax(axis=1)
            switch = d[np.arange(n), top][:, None] - penalty
            stay = d >= switch
            came[at] = np.where(stay, own, top[:, None])
            d = np.where(stay, d, switch)
            d -= d.max(axis=1, keepdims=True)
        best[:n] = d + scores[at]
    label = np.empty(len(scores), np.int16)
    last = best.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        label[at] = last[:n]
        if t:
            last[:n] = came[at, last[:n]]
    return label


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("lang", T.StringType())])
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def label_run(texts: list[str], model: Model, penalty: float) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans of each text."""
    index: dict[str, int] = {}
    number = index.setdefault
    words = [np.fromiter((number(m[0], len(index)) for m in WORDS(t.lower())), np.int32) for t in texts]
    at, lengths = np.concatenate(words), np.array(list(map(len, words)), np.int64)
    del words
    langs, scores, spans = [], [], []
    if not len(at):
        return ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    unique = list(index)
    labels = viterbi(model.word_scores(unique)[at], lengths, penalty)
    weight = np.array(list(map(len, unique)))[at]
    begin = 0
    for n in lengths.tolist():
        if not n:
            langs.append("und")
            scores.append(0.0)
            spans.append([])
            continue
        own = labels[begin : begin + n]
        letters = np.bincount(own, weights=weight[begin : begin + n], minlength=len(model.langs))
        top = int(letters.argmax())
        langs.append(model.langs[top])
        scores.append(float(letters[top] / letters.sum()))
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), n]
        spans.append([{"start": a, "n_words": b - a, "lang": model.langs[own[a]]} for a, b in zip(cuts, cuts[1:])])
        begin += n
    return langs, scores, spans


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000) -> Model:
    """A model of the languages of labelled rows; rows of null language or text are left out.

    max_rows: how many ids at most are used, the first by hash; all of them in a smaller table.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("id")).orderBy(F.xxhash64("id"), "id").limit(max_rows).distinct()
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    few = F.broadcast(ids)  # max_rows ids at most
    rows = rows.join(few, rows.id.eqNullSafe(few.id), "left_semi").select("lang", "text")
    found = rows.mapInArrow(_count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((len(langs), (1 << BITS) + SCRIPTS), np.int64)
    row = {lang: k for k, lang in enumerate(langs)}
    counts[[row[x] for x in names], found["feature"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language", penalty: float = 8.0) -> DataFrame:
    """docs and a column ``out`` struct<lang, score, spans>.

    lang: a language of the model, or 'und' for null and for texts without a letter (score 0, no spans). score: the part
    of the text's letters in words labelled so. spans: array<struct<start, n_words, lang>>, by word. A model without
    languages gives 'und'. Ties go to the first language in code-point order. Rows and other columns stay as they are; a column
    that was called ``out`` is replaced. Long texts are read whole; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def language(texts: pa.Array) -> pa.Array:
        parts: tuple[list, list, list] = ([], [], [])
        for part in runs(texts, RUN_BYTES):
            run = [x.as_py() or "" for x in part]
            found = label_run(run, shared.value, penalty) if shared.value.langs else (["und"] * len(run), [0.0] * len(run), [[] for _ in run])
            for have, new in zip(parts, found):
                have += new
        give_back()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.float64()), pa.array(parts[2], kind)], names=["lang", "score", "spans"])

    language.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(language, RESULT)(F.col(text_col).cast("string")))
