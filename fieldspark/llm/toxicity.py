"""Toxicity scores of texts restored by a noisy-channel decoder.

Writers hide words by leetspeak ('1d10t'), separators and spacing ('i d i o t', 'i.d.i.o.t') and repetition
('idiooot', 'iiddiioott'). Tokens that show one of these are decoded (see TRIGGER): their characters form a lattice of what each may
stand for, with the channel's cost for each reading, and Viterbi finds the reading of least cost under the channel and a character
trigram model. The model is counted over all texts. Other tokens stay. Not decoded are tokens without a letter ('1010'),
those of one letter with less than two digits ('$@a$'), single characters more than three separators apart or with others
than spaces and . _ * - , ; : / between them, spaced words of two characters, and words cut into longer pieces ('id iot').
A mark before a letter ('+rash', '+idiot') may be a letter or none; both readings are scored.

The restored text's distinct words are scored: each word by the largest log-odds of itself and its prefixes among
features that are significantly more frequent in toxic texts, a text by a logistic curve over the sum and the largest of
these. Features come from at most ``max_rows`` labelled texts, counted on executors; at most ``max_features`` numbers and
``max_rows`` scores reach the driver, and 28**3 counts of the language model. Texts are not dealt out: each step is a
pass over the table with broadcasts of bounded size.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import bound_batches, cut, give_back

#: What a character may stand for besides itself; fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SYMBOLS = 28  # a gap, a to z, other letters
GAP, OTHER = 0, 27
#: Costs in nats of the channel's readings.
COST = {"leet": 1.0, "inner": 7.0, "lead": 7.0, "digit": 4.0, "mark": 0.5, "gap": 3.0, "drop": 1.0, "vowel": 2.5, "repeat": 1.5, "single": 0.2}
#: Most distinct decoded tokens that a worker keeps.
KEPT = 20_000

_FOLD = bytearray(256)
for _c in range(256):
    _base = unicodedata.normalize("NFKD", chr(_c).lower())[0]
    _FOLD[_c] = ord(_base) - 96 if "a" <= _base <= "z" and chr(_c).isalpha() else OTHER if chr(_c).isalpha() else GAP
_FOLD = bytes(_FOLD)
_BEYOND = re.compile(r"[^\x00-\xff]")
_L, _X, _E = r"[^\W\d_]", r"[0-9@$!|+€£¡]", r"(?:[^\W_]|[@$!])"
_S = r"[\s._*\-,;:/]{1,3}"
#: Single characters with up to three separators between them.
SPACED = rf"{_E}(?:{_S}{_E}(?![^\W_])){{2,}}"
#: Where a token needs decoding: single characters with separators between them; or a letter next to what may stand for
#: one or hide it; or what may stand for letters next to each other; or a letter three times, or every letter twice.
#: In all but the first case the token is all that adjoins.
TRIGGER = re.compile(rf"(?P<spaced>(?<![^\W_]){SPACED})|{_L}(?:[0-9@$]|[!|+€£¡._*\-]{_L})|[0-9@$!|+€£]{_L}|({_L})\2\2|(?<![^\W\d_])(?:({_L})\3){{3,}}(?!{_L})")
SEPARATORS = frozenset(" ._*-")
JOINED = frozenset(LEET) | frozenset("._*-")
DOUBLED = re.compile(rf"[\W\d_]*(?:({_L})\1){{3,}}[\W\d_]*")
LEADS = "!|+€£"
WORDS = regex.compile(r"\p{L}+").findall


@lru_cache(1 << 16)
def _latin(c: str) -> str:
    """The Latin-1 character that stands for a lower-case one beyond: a to z without accents, another letter or no letter."""
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return "?" if not c.isalpha() else base if "a" <= base <= "z" else "\xdf"


def fold(text: str) -> bytes:
    """A symbol for each character: 0 for what is no letter, 1 to 26 for a to z with or without accents, else 27."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_FOLD)
    except UnicodeEncodeError:
        return _BEYOND.sub(lambda m: _latin(m[0]), low).encode("latin-1").translate(_FOLD)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for x in batch.column(0):
            text = x.as_py() or ""
            for k in range(0, len(text), 1 << 20):
                s = np.frombuffer(b"\0" + fold(text[max(0, k - 1) : k + (1 << 20)]) + b"\0", np.uint8).astype(np.int32)
                counts += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs in nats of a symbol after two others, shape (28, 28, 28), from counts over every text of docs."""
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


def _options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each position the readings (letters or nothing) and their channel costs."""
    low, out, k = token.lower(), [], 0
    spaced = len(low) > 4 and low[1] in SEPARATORS and low[3] in SEPARATORS or re.fullmatch(SPACED, low) is not None
    doubled = DOUBLED.fullmatch(low) is not None
    while k < len(low):
        c, end = low[k], k + 1
        while end < len(low) and low[end] == c:
            end += 1
        run = end - k
        if c.isalpha():
            if run >= 3 or doubled:
                out.append([(c, COST["single"]), (c + c, COST["repeat"])])
            else:
                out.append([(c * run, 0.0)])
        elif c in LEET:
            # As itself it breaks the word: likely at the end if it is a mark, less so if a digit, least within.
            edge = COST["mark" if c in "!|+" else "digit"] if end == len(low) else COST["lead" if k == 0 else "inner"]
            readings = [(x * n, COST["leet"]) for x in LEET[c] for n in {1, min(run, 2)}]
            out.append([*readings, (" ", edge)])
        else:
            hidden = [(x, COST["vowel"]) for x in "aeiou"] if c == "*" and run == 1 and not spaced else []
            out.append([("", COST["drop"] * (not spaced)), (" ", COST["gap"] * (1 + spaced)), *hidden])
        k = end
    return out


def decode(token: str, cost: list[list[list[float]]]) -> str:
    """The reading of least cost of a token; ' ' in it stands for a break between words."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(GAP, GAP): (0.0, ())}
    for options in [*_options(token), [(" ", 0.0)]]:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (total, path) in states.items():
            for reading, channel in options:
                x, y, now = a, b, total + channel
                for s in fold(reading):
                    now += cost[x][y][s]
                    x, y = y, s
                have = new.get((x, y))
                if have is None or now < have[0]:
                    new[x, y] = (now, (path, reading))
        states = new
    _, path = min(states.values(), key=lambda v: v[0])
    parts = []
    while path:
        path, reading = path
        parts.append(reading)
    return "".join(reversed(parts)).strip()


class Restorer:
    """Restores texts under one language model; keeps what it has decoded of short tokens."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = cost.tolist(), {}

    def _decoded(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            out = decode(token, self.cost)
            if len(token) <= 64:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[token] = out
        return out

    def __call__(self, text: str | None, both: bool = False) -> str:
        """text with suspect tokens replaced by their least costly reading; '' for null. With both, tokens that a mark
        leads ('!diot', '+idiot') follow after the text, read as if the mark stood for nothing."""
        text = text or ""
        parts, at, bare = [], 0, []
        for match in TRIGGER.finditer(text):
            a, b = match.span()
            if a < at:
                continue
            if not match["spaced"]:
                while a > at and (text[a - 1].isalpha() or text[a - 1] in JOINED):
                    a -= 1
                while b < len(text) and (text[b].isalpha() or text[b] in JOINED):
                    b += 1
            token = text[a:b]
            letters = sum(map(str.isalpha, token))
            if letters > 1 or letters and len(set(token)) > 3 and sum(map(str.isalnum, token)) > 2:
                parts += [text[at:a], self._decoded(token)]
                at = b
                if both and token[0] in LEADS:
                    bare += [" ", self._decoded(token.lstrip(LEADS))]
        return "".join([*parts, text[at:], *bare])


PREFIXES = (3, 4, 5, 6)


def features(word: str) -> list[str]:
    """A word and its proper prefixes, the latter with a mark."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(WORDS(text.lower())) for f in features(w)}


def families(rows: list) -> dict[str, float]:
    """The log-odds of features (feature, n1, odds) without prefixes that one word or a longer prefix accounts for."""
    most: dict[str, float] = {}  # of what a prefix starts, the largest count
    for r in rows:
        stem, share = r.feature.rstrip("*"), 0.95 if r.feature.endswith("*") else 0.8
        for n in PREFIXES:
            if len(stem) > n or len(stem) == n and share == 0.8:
                key = stem[:n] + "*"
                most[key] = max(most.get(key, 0.0), r.n1 / share)
    return {r.feature: r.odds for r in rows if not r.feature.endswith("*") or r.n1 > most.get(r.feature, 0.0)}


class Weights:
    """Log-odds of features; a word's weight is the largest among its features', and 0 at least."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.starts = odds, {f.rstrip("*")[: PREFIXES[0]] for f in odds}

    def evidence(self, text: str) -> tuple[float, float]:
        """The sum of the weights of a text's distinct words, damped, and the largest."""
        starts, odds, n = self.starts, self.odds, PREFIXES[0]
        able = {w for w in set(WORDS(text.lower())) if w[:n] in starts}
        each = [max([0.0, *(odds.get(f, 0.0) for f in features(w))]) for w in able]
        return math.log1p(sum(each)), max(each, default=0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a small ridge, on columns with a leading 1."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, cost: np.ndarray, odds: dict[str, float], curve: np.ndarray):
        self.cost, self.odds, self.curve = cost, odds, curve

    def scorer(self) -> Callable[[str | None], float]:
        restore, weights = Restorer(self.cost), Weights(self.odds)
        a, b, c = self.curve.tolist()

        def score(text: str | None) -> float:
            total, most = weights.evidence(restore(text, both=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * most))))

        return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 5_000, significance: float = 24.0) -> Model:
    """The language model over all docs, and weights from the labelled ones.

    labels: (id_col, label_col 0 or 1); rows with nulls are left out, an id's repeated labels count as their largest.
    max_rows: how many labelled ids at most are used, the first by hash. significance: the least log-likelihood ratio of
    a feature that is used; no part of all toxic texts is asked for, which words of a language with few could not reach.
    Without labels of both kinds every text scores the share of toxic labels (0 without any).
    """
    bound_batches(docs.sparkSession)
    cost = language_model(docs, text_col)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    few = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_rows))  # max_rows rows at most
    # Written once: the passes over the sample then read it, not all of docs.
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few, "id").select("y", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(cost)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            ys, names = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [*text_features(restore(text.as_py(), both=True)), ""]
                ys += [y] * len(found)
                names += found
                if len(ys) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(names)], names=["y", "feature"])
                    ys, names = [], []
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(names, pa.string())], names=["y", "feature"])
            give_back()

    counts = rows.mapInArrow(seen, "y int, feature string").groupBy("feature").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    counts = cut(counts.filter("feature = '' or n1 >= 3"))
    totals = counts.filter("feature = ''").first()
    n1, n0 = (totals.n1, totals.n0) if totals else (0, 0)
    if not n1 or not n0:
        rate = n1 / (n1 + n0) if n1 + n0 else 0.0
        return Model(cost, {}, np.array([math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), 0.0, 0.0]))
    part = lambda n, share: F.when(n > 0, n * F.log(n / ((F.col("n1") + F.col("n0")) * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("n1"), n1 / (n1 + n0)) + part(F.col("n0"), n0 / (n1 + n0)))
    lift = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    best = counts.filter("feature <> ''").select("feature", "n1", ratio.alias("ratio"), lift.alias("odds")).filter((F.col("ratio") >= significance) & (F.col("odds") > 1.5))
    odds = families(best.orderBy(F.desc("ratio"), "feature").limit(max_features).collect())
    given = docs.sparkSession.sparkContext.broadcast(odds)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, weights = Restorer(shared.value), Weights(given.value)
        for batch in batches:
            found = [weights.evidence(restore(x.as_py(), both=True)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], pa.float64())], names=["y", "total", "most"])

    points = rows.mapInArrow(evidence, "y int, total double, most double").toArrow()
    y, total, most = (points[c].to_numpy().astype(float) for c in ("y", "total", "most"))
    order = np.lexsort((most, total, y))  # the same fit whatever the order of the rows
    return Model(cost, odds, _logistic(np.column_stack([np.ones(len(y)), total, most])[order], y[order]))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs and a double column ``out`` between 0 and 1; null and empty texts get the score of no evidence.
    Rows and other columns stay as they are; a column that was called ``out`` is replaced. Long texts are read whole; an
    empty table gives no rows."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Callable[[str | None], float]] = []  # a task's, with what it has decoded

    def scores(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(shared.value.scorer())
        out = pa.array([made[0](x.as_py()) for x in texts], pa.float64())
        give_back()
        return out

    scores.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(scores, T.DoubleType())(F.col(text_col).cast("string")))


def restored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "restored") -> DataFrame:
    """docs and a string column ``out``: the text with suspect tokens decoded; '' for null. A column of
    that name is replaced. Long texts are read whole; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.cost)
    made: list[Restorer] = []

    def restore(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Restorer(shared.value))
        out = pa.array([made[0](x.as_py()) for x in texts], pa.string())
        give_back()
        return out

    restore.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(restore, T.StringType())(F.col(text_col).cast("string")))
