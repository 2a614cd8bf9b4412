"""What the two vector searches share: one row for each distinct vector, groups of sorted rows, and top lists.

A search runs over distinct vectors. Of a vector's ids only the ``top`` + 1 smallest can be in a list of ``top`` once the
query's own id is left out, so copies beyond these are dropped before anything is joined, without loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

SALTS = 16


def finite(vec: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def distinct_vectors(rows: DataFrame, is_query: Column, top: int) -> tuple[DataFrame, DataFrame]:
    """From rows (id, v): reps (rep, v, ids, q) and queries (id, rep).

    reps: a row for each distinct v, with its top + 1 smallest ids and whether any of its ids is a query. A hot vector's
    ids are cut down on each side of the shuffle, and by salt before they meet.
    """
    rows = cut(rows.groupBy("id", "v").agg(F.lit(1).alias("one")).drop("one"))
    n = rows.count()
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["v", "salt"], ["v"]):
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
        salted = salted.withColumn("rank", rank).filter(F.col("rank") <= top + 1).drop("rank")
    asked = rows.filter(is_query)
    seen = asked.select("v").distinct().withColumn("q", F.lit(True))
    reps = salted.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(seen, "v", "left")
    reps = cut(reps.select("v", "ids", F.coalesce("q", F.lit(False)).alias("q")), 64 * n)  # rows are longer than most
    reps = reps.withColumn("rep", F.monotonically_increasing_id())  # read from the checkpoint, so always the same
    return reps, cut(asked.join(reps.select("v", "rep"), "v").select("id", "rep"), n)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of equal values in the first n_keys columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        if held and (keys[:, 0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of doubles, all of one length."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


class Best:
    """Collects (query, id, score) and keeps each query's best ``keep``, ties to the smaller id, in bounded space."""

    def __init__(self, keep: int, kind, limit: int = 500_000):
        self.keep, self.kind, self.limit = keep, kind, limit
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((query, ids, score))
        self.size += len(query)
        if self.size > self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        query, ids, score = best(*map(np.concatenate, zip(*self.parts)), self.keep)
        self.parts, self.size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(score, self.kind)], names=["rep", "id", "score"])


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``keep`` rows of highest score, ties to the smaller id; rows of equal query and id count once."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1]))[: len(query)]
    query, ids, score = query[new], ids[new], score[new]
    place = np.arange(len(query))
    start = np.maximum.accumulate(np.where(np.append(True, query[1:] != query[:-1])[: len(query)], place, 0))
    few = place - start < keep
    return query[few], ids[few], score[few]


def members(possible: np.ndarray, cands: np.ndarray, queries: np.ndarray, ids: pa.ListArray, reps: np.ndarray, keep: int, score: Callable) -> Iterator[tuple]:
    """(query, id, score) rows of the possible members (a mask by query and candidate), rescored in bounded pieces."""
    starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    q, c = np.nonzero(possible)
    for k in range(0, len(q), 100_000):
        i, j = q[k : k + 100_000], c[k : k + 100_000]
        s = score(queries[i], cands[j])
        n = starts[j + 1] - starts[j]
        at = np.repeat(starts[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        yield best(np.repeat(reps[i], n), flat[at], np.repeat(s, n), keep)


def top_lists(hits: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from hits (rep, id, score), which hold each rep's best top + 1, and (id, rep)."""
    once = hits.groupBy("rep", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "id"))
    kept = once.withColumn("rank", rank).filter(F.col("rank") <= top + 1)
    lists = kept.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("vec_id"), "score"))).alias("hits"))
    each = queries.join(lists, "rep").select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("hits", lambda x: x["vec_id"] != F.col("id")), 1, top)).alias("place", "hit"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), "hit.vec_id", "hit.score")
