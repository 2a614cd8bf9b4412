"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A hash rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform, padded to a power of
two) and assigns each to the nearest signed axis. A table concatenates ``hashes`` of them, so it has (2d) ** hashes
buckets; a query looks into the buckets whose axes, taken together, are nearest to it. How many hashes and how many of the
buckets follows from the number of rows: the part of the buckets falls as rows grow, since the nearest rows get nearer.

Buckets are dealt out in cells, runs of neighbouring buckets of about ``block`` rows; a query travels once to each cell with
the list of its buckets there. Within a cell, candidates are sorted by bucket, each bucket's rows meet the queries that
look into it, and what can't beat a query's best so far is dropped at once. Only the best of each query leave the
task, scored by the inner product of the original vectors.

A cell with more than ``block`` candidates or queries is cut into blocks that meet pair by pair, so that nothing is
dropped and no group is unbounded. The table of cell sizes has at most tables x CELLS rows for each length of vectors,
whatever the input, and is broadcast. A query that finds fewer than ``top`` rows looks into every bucket of one table, which is
exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .vectors import Best, distinct_vectors, finite, groups, matrix, top_lists

ROUNDS = 3
#: Cells of a table, at most.
CELLS = 1 << 16
#: Rows beyond which tables have three hashes instead of two.
THREE_HASHES = 1 << 24
#: Scores that wait until those that can't be among a query's best are dropped.
WAITING = 1 << 20


def padded(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def part_probed(rows: int) -> float:
    """The part of a table's buckets that a query looks into: a tenth at 10,000 rows, halved for each tenfold."""
    return min(1.0, 0.1 * (10_000 / max(rows, 1)) ** 0.3)


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Rows of x under the table's pseudo-rotation, padded with zeros to a power of two."""
    d = padded(x.shape[1])
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng([seed, table, d])
    for _ in range(ROUNDS):
        y = y * rng.choice([-1.0, 1.0], d)
        h = 1
        while h < d:
            z = y.reshape(len(y), -1, 2, h)
            y = np.concatenate([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), d)
            h *= 2
        y = y / np.sqrt(d)
    return y


def signed_axes(unit: np.ndarray, table: int, hashes: int, seed: int) -> list[np.ndarray]:
    """The components of each row along the signed axes of each hash of the table: 2k for axis k, 2k + 1 for its negative."""
    out = []
    for h in range(hashes):
        y = rotated(unit, table * 8 + h, seed)
        out.append(np.stack([y, -y], axis=2).reshape(len(y), -1))
    return out


def nearest_buckets(signed: list[np.ndarray], probes: int) -> np.ndarray:
    """The numbers of the ``probes`` buckets of each row whose axes, taken together, are nearest to it.

    Of each hash, only the axes that can be in so many nearest ones, or the nearer half, are tried.
    """
    n, width = signed[0].shape
    width_of = width if probes > (width // 2) ** len(signed) else max(2, width // 2)
    loss, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    for s in signed:
        order = np.argsort(-s, axis=1, kind="stable")[:, :width_of]
        own = np.take_along_axis(s, order, axis=1)
        lost = (own[:, :1] - own) ** 2
        loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
        code = (code[:, :, None] * width + order[:, None, :]).reshape(n, -1)
        if loss.shape[1] > probes:  # what is beyond the nearest so far stays so, whatever the next hash adds
            near = np.argpartition(loss, probes - 1, axis=1)[:, :probes]
            loss, code = np.take_along_axis(loss, near, axis=1), np.take_along_axis(code, near, axis=1)
    return code


def _postings(tables: int, hashes: int, part: float, cells: int, seed: int):
    names = ["dim", "t", "cell", "role", "rep", "v", "buckets", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            for d in np.unique(lengths):
                rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
                for a in range(0, rows.num_rows, 2048):
                    yield from one(rows.slice(a, 2048), int(d))

    def one(rows: pa.RecordBatch, d: int) -> Iterator[pa.RecordBatch]:
        x = matrix(rows.column("v")).astype(float)
        unit = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component: squares can't overflow
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        buckets = (2 * padded(d)) ** hashes
        probes = max(1, math.ceil(part * buckets))
        wide = max(1, -(-buckets // cells))  # buckets of a cell
        asks = np.flatnonzero(rows.column("q").to_numpy(zero_copy_only=False))
        for t in range(tables):
            signed = signed_axes(unit, t, hashes, seed)
            own = np.zeros(len(x), np.int64)
            for s in signed:
                own = own * s.shape[1] + s.argmax(axis=1)
            yield batch(rows, d, t, 0, np.arange(len(x)), own // wide, own, np.arange(len(x) + 1))
            step = max(1, (1 << 21) // min(buckets, probes * 2 * padded(d)))
            for a in range(0, len(asks), step):
                some = asks[a : a + step]
                near = np.sort(nearest_buckets([s[some] for s in signed], probes), axis=1)
                cell = near // wide
                new = np.concatenate([np.ones((len(some), 1), bool), cell[:, 1:] != cell[:, :-1]], axis=1)
                starts = np.flatnonzero(new.ravel())
                yield batch(rows, d, t, 1, some[starts // near.shape[1]], cell.ravel()[starts], near.ravel(), np.append(starts, near.size))

    def batch(rows, d, t, role, at, cell, buckets, ends):
        n, at = len(at), pa.array(at)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(buckets.astype(np.int32)))
        ids = rows.column("ids")
        same = lambda k: pa.array(np.full(n, k, np.int32))
        return pa.RecordBatch.from_arrays([same(d), same(t), pa.array(cell.astype(np.int32)), same(role), rows.column("rep").take(at), rows.column("v").take(at), lists, pa.nulls(n, ids.type) if role else ids.take(at)], names=names)

    return run


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    s = np.zeros(len(a))
    for k in range(a.shape[1]):
        s += a[:, k] * b[:, k]
    return s


class Nearest:
    """The best candidates of each of n queries so far: (query, candidate, score), and the least score that may still join."""

    def __init__(self, n: int, keep: int, margin: float):
        self.keep, self.margin, self.parts, self.size = keep, margin, [], 0
        self.least = np.full(n, -np.inf)

    def add(self, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((q, c, s))
        self.size += len(q)
        if self.size > WAITING:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What may be among the best; rounding in scores can't hide a member."""
        q, c, s = map(np.concatenate, zip(*self.parts)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((-s, q))
        q, c, s = q[order], c[order], s[order]
        start = np.searchsorted(q, np.arange(len(self.least)))
        ends = np.append(start[1:], len(q))
        full = np.flatnonzero(ends - start >= self.keep)
        self.least[full] = s[start[full] + self.keep - 1] - self.margin
        stay = s >= self.least[q]
        self.parts, self.size = [(q[stay], c[stay], s[stay])], 0
        return self.parts[0]


def _rerank(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(keep, pa.float64())
        for group in groups(batches, 5):
            role = group["role"].to_numpy()
            n = int((role == 0).sum())  # sorted: candidates first
            if not 0 < n < len(role):
                continue
            lists = group["buckets"].combine_chunks()
            at, buckets = lists.offsets.to_numpy(), lists.values.to_numpy()
            own = buckets[at[:n]]
            order = own.argsort(kind="stable")
            own = own[order]
            cands, queries = matrix(group["v"].slice(0, n)).astype(float)[order], matrix(group["v"].slice(n)).astype(float)
            asked, by = buckets[at[n] : at[-1]], np.repeat(np.arange(len(queries)), np.diff(at[n:]))
            turn = asked.argsort(kind="stable")
            asked, by = asked[turn], by[turn]
            nearest = Nearest(len(queries), keep, 1e-12 * np.abs(cands).max() * np.abs(queries).max() * cands.shape[1])
            held = np.unique(own)
            a, b = np.searchsorted(own, held), np.searchsorted(own, held, side="right")
            i, j = np.searchsorted(asked, held), np.searchsorted(asked, held, side="right")
            for k in np.flatnonzero(j > i).tolist():
                for m in range(i[k], j[k], 1024):
                    who = by[m : min(m + 1024, j[k])]
                    s = queries[who] @ cands[a[k] : b[k]].T
                    x, y = np.nonzero(s >= nearest.least[who, None])
                    nearest.add(who[x], y + a[k], s[x, y])
            q, c, _ = nearest.settle()
            ids = group["ids"].slice(0, n).combine_chunks()
            starts, flat, reps = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), group["rep"].slice(n).to_numpy()
            for k in range(0, len(q), 100_000):
                some_q, some_c = q[k : k + 100_000], c[k : k + 100_000]
                exact, row = dot(queries[some_q], cands[some_c]), order[some_c]
                many = starts[row + 1] - starts[row]
                each = np.repeat(starts[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
                yield from found.add(np.repeat(reps[some_q], many), flat[each], np.repeat(exact, many))
        yield from found.flush()

    return run


def _search(reps: DataFrame, kind: str, top: int, tables: int, hashes: int, part: float, cells: int, block: int, seed: int) -> DataFrame:
    """(rep, id, score): hits of the reps with q, from all reps."""
    posted = reps.select("rep", "v", "ids", "q").mapInArrow(_postings(tables, hashes, part, cells, seed), f"dim int, t int, cell int, role int, rep long, v {kind}, buckets array<int>, ids array<long>")
    sizes = posted.groupBy("dim", "t", "cell").agg(F.sum(1 - F.col("role")).alias("cands"), F.sum("role").alias("asks"))
    sizes = sizes.filter("cands > 0 and asks > 0").withColumns({c: F.ceil(F.col(c) / block).cast("int") for c in ("cands", "asks")})
    posted = posted.join(F.broadcast(sizes), ["dim", "t", "cell"])  # tables x cells rows for each dimension d
    asks = F.col("role") == 1
    own = F.pmod(F.xxhash64("rep"), F.when(asks, F.col("asks")).otherwise(F.col("cands"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(asks, F.col("cands")).otherwise(F.col("asks")) - 1))
    posted = posted.select("dim", "t", "cell", "role", "rep", "v", "buckets", "ids", own.alias("own"), other.alias("other"))
    pair = [F.when(asks, F.col("other")).otherwise(F.col("own")).alias("i"), F.when(asks, F.col("own")).otherwise(F.col("other")).alias("j")]
    posted = posted.select("dim", "t", "cell", *pair, "role", "rep", "v", "buckets", "ids")
    keys = ["dim", "t", "cell", "i", "j"]
    return posted.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(_rerank(top + 1), "rep long, id long, score double")


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, tables: int = 4, hashes: int | None = None, part: float | None = None, block: int = 16384, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of largest inner product found for each query, but its own.

    is_query: a Column over column ``id``. Nearness is the inner product in double precision; ties go to the smaller id.
    For vectors of unit length, as the tables suppose, it is the cosine; others are scaled for hashing and ranked as they
    are. Rows of null id and vectors that are null, empty, zero, or hold null or non-finite components take no part.
    Vectors of different length never meet. Rows of one id are one row, if their vectors are equal; none of an id's rows
    is a neighbour of that id. A query gets all other rows where there are no more than ``top``. An empty table gives no
    rows. hashes: a table's, else two or, beyond THREE_HASHES rows, three; part: the part of a table's buckets that a
    query looks into, else by the number of rows.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vec_col] == "array<float>" else "array<double>"
    v = F.col(vec_col).cast(kind)
    rows = vectors.filter(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    reps, queries = distinct_vectors(rows, is_query, top)
    n = reps.count()
    hashes, part = hashes or (2 if n <= THREE_HASHES else 3), part or part_probed(n)
    hits = cut(_search(reps, kind, top, tables, hashes, part, min(CELLS, -(-n // block) or 1), block, seed))
    asked = reps.filter("q").join(hits.groupBy("rep").agg(F.countDistinct("id").alias("n")), "rep", "left")
    short = cut(asked.filter(F.coalesce("n", F.lit(0)) <= top).select("rep"))
    if not short.isEmpty():
        again = reps.join(short.withColumn("short", F.lit(True)), "rep", "left").select("rep", "v", "ids", F.coalesce("short", F.lit(False)).alias("q"))
        hits = hits.unionByName(_search(again, kind, top, 1, 1, 1.0, min(CELLS, -(-n // block) or 1), block, seed))
    return top_lists(hits, queries, top)
