"""Exact top-k search by an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). An index block holds the postings of up to ``block`` candidates in segments of
equal quantised impact: the level of a posting is the power of two above its magnitude. A block of queries processes the
segments of a level together, the highest level first, and adds their contributions to the scores. What the remaining
levels can still add to a pair is bounded by the product of the query's norm and that of the candidate's remaining
postings. A query block stops only when these bounds prove that few candidates can be in its lists, and scores these
exactly; at the last level the bounds are zero.

Neighbouring candidates share a block: candidates are dealt out by the nearest signed axes of two pseudo-rotations, and what
is too large for one block to several. Of each block its centre, radius and largest norm are known. A query first goes
to the ``lead`` blocks whose centres promise most; the least score of its list there then goes with it to every other block
that may beat it, by the lesser of the product of norms and the centre's score plus the radius. Other blocks are rejected
before anything is sent, and within a block what can't beat that score is dropped. Where vectors lie anyhow, as random ones
do, bounds reject no block and each query meets every block in a task of its own. Only each query's best leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .ann import signed_axes
from .common import cut
from .vectors import Best, distinct_vectors, finite, groups, matrix, members, top_lists

#: Bytes of the blocks' centres, which go to all tasks; beyond them only norms do.
OUTLINES = 64 << 20


class ImpactIndex:
    """Segments of one block of candidates by descending impact, and the norms of what follows each."""

    def __init__(self, cands: np.ndarray):
        self.cands, self.largest = cands, np.abs(cands).max(initial=0)
        size = np.abs(cands)
        level = np.frexp(size)[1] * (size > 0)  # magnitudes of level n: from 2**(n-1) to below 2**n; 0: no posting
        self.segments, self.rest = [], []
        for n in sorted(set(np.unique(level).tolist()) - {0}, reverse=True):
            held = level == n
            rows = np.flatnonzero(held.any(axis=1))
            rows = slice(None) if 2 * len(rows) > len(cands) else rows
            self.segments.append((rows, np.where(held[rows], cands[rows], 0)))
            lower = np.where(level < n, cands, 0)
            self.rest.append(np.sqrt(np.einsum("ij,ij->i", lower, lower)) * (1 + 1e-9))
        self.norm = np.sqrt(np.einsum("ij,ij->i", cands, cands))

    def possible(self, queries: np.ndarray, keep: int, least: np.ndarray | None = None) -> np.ndarray:
        """Which candidates may be among each query's ``keep`` best, if that takes a score of ``least``: a mask that holds all of these."""
        n = len(self.cands)
        floor = np.full(len(queries), -np.inf) if least is None else least
        if n <= keep and least is None:
            return np.ones((len(queries), n), bool)
        exact = self.largest * np.abs(queries).max(initial=0) * queries.shape[1] < 2**24
        kind = np.float32 if exact else np.float64  # sums of integers are exact in either
        scores, q = np.zeros((len(queries), n), kind), queries.astype(kind)
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None] * (1 + 1e-6)
        for k, (rows, postings) in enumerate(self.segments):
            scores[:, rows] += q @ postings.astype(kind).T
            # Bounds far above the scores themselves prove nothing, so they are not drawn up.
            if k < len(self.segments) - 1 and np.median(self.rest[k]) <= 0.25 * np.median(self.norm):
                slack = (norms * self.rest[k]).astype(kind) + kind(1e-3)
                able = scores + slack >= np.maximum(_kth(scores - slack, keep), floor)[:, None]
                if able.sum() <= 4 * keep * len(queries):
                    return able
        return scores >= np.maximum(_kth(scores, keep), floor)[:, None]


def _kth(scores: np.ndarray, keep: int) -> np.ndarray:
    """Each row's score of that rank, -inf where there are fewer; scores are reordered."""
    n = scores.shape[1]
    if n <= keep:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, n - keep, axis=1)[:, n - keep]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows."""
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def _cells():
    """The run of neighbouring buckets, of ``cells`` of them, that a vector of integers is in."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array, cells: pa.Array) -> pa.Array:
        x, out = vectors, np.zeros(len(vectors), np.int32)
        lengths, most = np.diff(vectors.offsets.to_numpy()), cells.to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == d)
            v = matrix(x.take(pa.array(rows)))
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            for a in range(0, len(rows), 2048):
                one, two = signed_axes(v[a : a + 2048], 0, 2, 0)
                code = one.argmax(axis=1) * two.shape[1] + two.argmax(axis=1)
                out[rows[a : a + 2048]] = code * most[rows[a : a + 2048]] // (one.shape[1] * two.shape[1])
        return pa.array(out)

    return cell


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, 3):
        x = matrix(group["v"])
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1)).max() if x.size else 0.0
        norm = np.sqrt((x**2).sum(axis=1)).max() if x.size else 0.0
        keys = [group[c][0].as_py() for c in ("dim", "cell", "part")]
        yield pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in keys], pa.array([norm]), pa.array([radius]), pa.array([centre.tolist()], pa.list_(pa.float64()))], names=["dim", "cell", "part", "norm", "radius", "centre"])


class Outlines:
    """Cell, part, norm, radius and centre (or none) of the blocks of each length of vectors."""

    def __init__(self, table: pa.Table, centres: bool):
        self.of = {}
        dims = table["dim"].to_numpy()
        for d in np.unique(dims):
            rows = table.filter(pa.array(dims == d))
            cell, part, norm, radius = (rows[c].to_numpy() for c in ("cell", "part", "norm", "radius"))
            self.of[int(d)] = cell, part, norm, radius, matrix(rows["centre"]) if centres else None

    def blocks(self, d: int, queries: np.ndarray, least: np.ndarray | None, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and of the blocks that each goes to: the ``lead`` most promising ones, or, with a least score,
        all others that may hold one as high."""
        _, _, norm, radius, centre = self.of[d]
        size = np.sqrt((queries**2).sum(axis=1))[:, None]
        most, blur = size * norm, 1e-9 * size * norm + 1e-3
        promise = most if centre is None else queries @ centre.T
        if centre is not None:
            most = np.minimum(most, promise + size * radius)
        first = np.argsort(-promise, axis=1, kind="stable")[:, :lead]
        to = np.zeros(most.shape, bool)
        np.put_along_axis(to, first, True, axis=1)
        return np.nonzero(to if least is None else ~to & (most + blur >= least[:, None]))


def _aim(outlines, lead: int, rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dim").to_numpy()
            for d in np.unique(lengths).tolist():
                rows = batch.take(pa.array(np.flatnonzero(lengths == d)))
                cell, part = outlines.value.of[d][:2]
                step = max(1, (1 << 20) // len(cell))
                for a in range(0, rows.num_rows, step):
                    some = rows.slice(a, step)
                    least = some.column("least").to_numpy(zero_copy_only=False)
                    q, b = outlines.value.blocks(d, matrix(some.column("v")), least if rest else None, lead)
                    for k in range(0, len(q), 4096):
                        at, to = pa.array(q[k : k + 4096]), b[k : k + 4096]
                        n = len(to)
                        fixed = lambda x: pa.array(np.full(n, x, np.int32))  # noqa: E731,B023
                        yield pa.RecordBatch.from_arrays([fixed(d), pa.array(cell[to]), pa.array(part[to]), fixed(1), some.column("rep").take(at), some.column("v").take(at), pa.nulls(n, pa.list_(pa.int64())), some.column("least").take(at)], names=["dim", "cell", "part", "role", "rep", "v", "ids", "least"])

    return run


def _score(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(keep, pa.int64())
        for group in groups(batches, 3):
            role = group["role"].to_numpy()
            n = int((role == 0).sum())  # sorted: candidates first
            if not 0 < n < len(role):
                continue
            cands, queries = matrix(group["v"].slice(0, n)), matrix(group["v"].slice(n))
            ids, reps = group["ids"].slice(0, n).combine_chunks(), group["rep"].slice(n).to_numpy()
            index, least = ImpactIndex(cands), group["least"].slice(n).to_numpy()
            for a in range(0, len(queries), 256):
                q = queries[a : a + 256]
                for rows in members(index.possible(q, keep, least[a : a + 256]), cands, q, ids, reps[a : a + 256], keep, exact):
                    yield from found.add(*rows)
        yield from found.flush()

    return run


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", top: int = 20, scale: int = 64, block: int = 4096, lead: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of highest integer inner product of each query, but its own.

    is_query: a Column over column ``id``. Ties go to the smaller id. Rows of null id and vectors that are null or hold null
    or non-finite components take no part; vectors of different length never meet, and empty ones score 0. Rows of one id
    are one row if their vectors are equal; none of an id's rows is a neighbour of that id. A query gets all other rows where
    there are no more than ``top``. Sums must stay below 2**53. Other columns are ignored, whatever their names; an empty
    table gives no rows. lead: blocks that a query goes to first.
    """
    v = F.col(vec_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & finite(v)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    reps, queries = distinct_vectors(rows, is_query, top)
    both = reps.withColumn("dim", F.size("v"))
    sizes = both.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("cells"), F.count_if("q").alias("asks"))
    both = both.join(F.broadcast(sizes.filter("asks > 0")), "dim")  # a row for each length that vectors have
    both = both.select("dim", _cells()("v", "cells").alias("cell"), "rep", "v", "ids", "q")
    parts = both.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row for each block of rows at most
    cands = both.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    keys, posted = ["dim", "cell", "part"], ["dim", "cell", "part", "role", "rep", "v", "ids", "least"]
    cands = cut(cands.select(*keys, F.lit(0).alias("role"), "rep", "v", "ids", F.lit(None).cast("double").alias("least"), "q"))
    lines = cut(cands.select(*keys, "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_outlines, "dim int, cell int, part int, norm double, radius double, centre array<double>"))
    few = (lines.agg(F.sum(8 * (F.size("centre") + 4))).first()[0] or 0) <= OUTLINES
    if lines.isEmpty():
        return top_lists(reps.select("rep", F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")).limit(0), queries, top)
    shared = lines.sparkSession.sparkContext.broadcast(Outlines((lines if few else lines.drop("centre")).toArrow(), few))
    asks = cands.filter("q").select("dim", "rep", "v")
    posting = "dim int, cell int, part int, role int, rep long, v array<double>, ids array<long>, least double"

    def hits_of(asked: DataFrame, rest: bool) -> DataFrame:
        aimed = asked.mapInArrow(_aim(shared, lead, rest), posting)
        return cut(cands.select(*posted).unionByName(aimed).repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(_score(top + 1), "rep long, id long, score long"))

    first = hits_of(asks.withColumn("least", F.lit(float("-inf"))), False)
    order = F.sort_array(F.collect_list("score"), asc=False)  # lead * (top + 1) at most
    once = first.groupBy("rep", "id").agg(F.max("score").alias("score"))
    least = once.groupBy("rep").agg(F.coalesce(F.get(order, F.lit(top)).cast("double"), F.lit(float("-inf"))).alias("least"))
    others = hits_of(asks.join(least, "rep", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), True)
    return top_lists(first.unionByName(others), queries, top)
