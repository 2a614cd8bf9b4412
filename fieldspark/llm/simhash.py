"""SimHash near-duplicate detection by a byte-position inverted index with count filtering.

A text's fingerprint has 64 bits. Two fingerprints that differ in at most three bits share at least five of
their eight bytes at the same positions, so they share all bytes of some key out of a family of position sets that
every five positions contain. The index maps (position set, bytes) to distinct fingerprints. Within a posting the
shared positional bytes of each pair are tallied, pairs below the guaranteed minimum are dropped, the rest verified by
Hamming distance. Tasks emit a spanning forest of the verified links, never the links themselves; components follow by
alternating large-star and small-star rounds over these edges.

Copies collapse to one fingerprint before anything is joined. A posting of more than ``block`` fingerprints is cut
into blocks, and each pair of blocks is a task's group of its own, so that no group is unbounded and no link is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bound_batches, cut, fresh, give_back

SEED = 42
#: Bytes of a text whose words are held at once.
PORTION = 1 << 18
#: Tasks that a node's edges are dealt to.
SALTS = 8
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def position_sets(key_bytes: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``key_bytes`` byte positions, at least one of which lies in any ``shared`` of the eight positions."""
    groups = {2: 4, 3: 2}.get(key_bytes, 1)
    width = 8 // groups
    family = [c for g in range(groups) for c in combinations(range(g * width, (g + 1) * width), key_bytes)]
    if not all(any(set(s) <= set(five) for s in family) for five in combinations(range(8), shared)):
        raise ValueError(f"{key_bytes} bytes a key cannot find every pair that shares {shared} bytes")
    return family


def portions(text: bytes, size: int = PORTION) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut at white space; a longer word is not cut."""
    a = 0
    while len(text) - a > size:
        space = SPACE.search(text, a + size)
        if space is None:
            break
        yield text[a : space.start()]
        a = space.start()
    yield text[a:]


def fingerprint(text: bytes | None, shingle: int = 3, size: int = PORTION) -> int:
    """Signed 64-bit SimHash of ASCII-lower-cased words between ASCII white space; 0 for null or no words. Only the words of a
    portion of the text are held at a time."""
    ones, n, words, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for part in portions(text or b"", size):
        words += part.lower().split()
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        lengths = list(map(len, words))
        starts = [0, *accumulate(k + 1 for k in lengths)]
        hashes = [digest(joined[a : starts[k + shingle - 1] + lengths[k + shingle - 1]], SEED) for k, a in enumerate(starts[: len(words) - shingle + 1])]
        ones += _ones(hashes)
        n += len(hashes)
        words = words[len(words) - shingle + 1 :]
    if not n:
        if not words:
            return 0
        ones, n = _ones([digest(b" ".join(words), SEED)]), 1
    return int(np.packbits((2 * ones > n).astype(np.uint8)).view(">i8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """In how many hashes each bit is 1."""
    return np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    out = pa.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts.cast(pa.large_binary())], pa.int64())
    give_back()
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs and a column ``out`` of signed 64-bit fingerprints; one of that name is replaced."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text_col).cast("string")))


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that connect what the links within max_bits connect."""
    fps = np.unique(fps)
    left, right = [], []
    for a in range(0, len(fps), 256):
        diff = fps[a : a + 256, None] ^ fps[None, :]
        tally = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=2)
        i, j = np.nonzero(tally >= 8 - max_bits)
        ok = (np.bitwise_count(diff[i, j].view(np.uint64)) <= max_bits) & (i + a < j)
        left.append(i[ok] + a)
        right.append(j[ok])
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fps))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols)]
            if not len(cols[0]):
                continue
            change = np.zeros(len(cols[0]) - 1, bool)
            for c in cols[:4]:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            carry = [c[cuts[-1] :] for c in cols]
            yield from emit(cols[4], cuts)
        if carry is not None:
            yield from emit(carry[4], [0, len(carry[4])])

    def emit(fps, cuts):
        pairs = [_forest(fps[a:b], max_bits) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
        if pairs:
            u, v = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def link_edges(fps: DataFrame, max_bits: int = 3, key_bytes: int = 3, block: int = 1024) -> DataFrame:
    """Edges (u, v) whose components are those of all links between the distinct fingerprints of column ``fp``.

    key_bytes: bytes an index key holds (2, 3 or 5). More bytes make postings shorter and the index longer; at 3 a
    posting of unrelated fingerprints holds about one in 16 million.
    """
    keys = []
    for k, positions in enumerate(position_sets(key_bytes, 8 - max_bits)):
        mask = int.from_bytes(bytes(255 * (p in positions) for p in range(8)), "big", signed=True)
        keys.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bytes")))
    index = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.bytes")
    shared = index.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    posted = index.join(shared, ["k", "bytes"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    posted = posted.select("k", "bytes", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    posted = posted.select("k", "bytes", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1"), "fp")
    dealt = posted.repartition("k", "bytes", "b0", "b1").sortWithinPartitions("k", "bytes", "b0", "b1")
    return dealt.mapInArrow(_links(max_bits), "u long, v long")


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) with the m of each u; the edges of a u, of which a large component's root has many, are dealt to SALTS tasks."""
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return edges.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v) but the roots: root is the smallest node of the component."""
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, state = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e1 = _with_least(both.filter("v > u"), low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        joined = _with_least(e1, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(joined.select("x.u", "x.v").filter("u <> v").distinct(), 4 * n)  # two rows for each edge, twice
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, state = now[0], now


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: int = 1 << 14, few: int = 1_000_000) -> DataFrame:
    """rows joined by key to a checkpointed table with a row for each key and the number ``n`` of rows that have it.

    Keys of more than ``hot`` rows, of which there is one for each ``hot`` rows at most, are broadcast, so their rows stay where
    they are and no task gets them all; others meet by a shuffle. Beyond ``few`` hot keys these are shuffled too.
    """
    large = table.filter(F.col("n") > hot).drop("n")
    if not 0 < large.count() <= few:
        return rows.join(table.drop("n"), key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rest.join(table.filter(F.col("n") <= hot).drop("n"), key).unionByName(rows.join(F.broadcast(large), key))


def _rooted(fps: DataFrame, first: str, max_bits: int, key_bytes: int) -> DataFrame:
    """fps (fp, n, first), a checkpoint, with the least ``first`` of each component in its place."""
    rows = fps.count()
    stars = components(link_edges(fps.select("fp"), max_bits, key_bytes))
    rooted = fps.join(stars, fps.fp == stars.node, "left").select("fp", F.col("n").alias("copies"), first, F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, rows)
    lows = cut(rooted.groupBy("root").agg(F.min(first).alias(first), F.count("*").alias("n")), rows)
    return cut(spread_join(rooted.drop(first), lows, "root").select("fp", F.col("copies").alias("n"), first), rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, key_bytes: int = 3, hot: int = 1 << 14) -> DataFrame:
    """One row for each row of docs: (id_col, fingerprint long, component_id).

    component_id is the smallest id that links reach, the row's own included. Null and empty texts have the
    fingerprint 0, which links like any other; long texts are read whole. Null ids take part but are never a component's id,
    unless it has no other. Repeated rows give repeated results. Other columns of docs are ignored, whatever their names; an
    empty table gives no rows. hot: fingerprints of more rows are not shuffled row by row.
    """
    rows = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), out="fp").select("id", "fp"))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), rows.count())
    found = spread_join(rows, _rooted(fps, "component_id", max_bits, key_bytes), "fp", hot)
    return found.select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls and their places included."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c for c, (_, kind) in zip(cols, docs.dtypes)]
    return F.xxhash64(*plain, *[c.isNull() for c in cols])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = 1_000_000) -> DataFrame:
    """docs without all but one row of each component: the row of the smallest id stays (a null id only where the component
    has no other; of rows that share the id, one by hash). Columns stay as they are, whatever their names.

    docs is read twice, and a row is known by its id and a hash of all its columns, so it does not matter how files are split
    for either reading, nor in which order. Rows that are equal in every column are one row. Null and empty texts are
    near-duplicates of each other; long texts are read whole; an empty table gives no rows. Only (id, hash, fingerprint) is
    dealt out. The ids and hashes of dropped rows are broadcast if there are no more than ``few``, and joined otherwise.
    """
    id_, h, n = fresh(docs, "id", "hash", "n")
    own, hashed = F.col(f"`{id_col}`"), _row_hash(docs)
    rows = docs.select(own.alias("id"), hashed.alias("h"), F.col(f"`{text_col}`").alias("text"))
    rows = cut(with_fingerprint(rows, out="fp").select("id", "h", "fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    count = rows.count()
    fps = cut(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), count)
    kept = _rooted(fps, "first", 3, 3).select("first.id", "first.h").distinct()
    keys = rows.groupBy("id", "h").agg(F.count("*").alias(n))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    dropped = cut(keys.join(kept, same(keys, kept), "left_anti").select(F.col("id").alias(id_), F.col("h").alias(h)), count)
    repeated = cut(keys.filter(F.col(n) > 1).join(kept, same(keys, kept), "left_semi").select(F.col("id").alias(id_), F.col("h").alias(h)), count)
    marked = lambda keys: (F.broadcast(keys) if keys.count() <= few else keys)
    match = lambda keys: own.eqNullSafe(keys[id_]) & (hashed == keys[h])
    left = docs.join(marked(dropped), match(dropped), "left_anti")
    if repeated.isEmpty():
        return left
    repeated = marked(repeated)
    whole = F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(n)
    once = left.join(repeated, match(repeated), "left_semi").groupBy(own.alias(id_), hashed.alias(h)).agg(whole).select(f"{n}.*")
    return left.join(repeated, match(repeated), "left_anti").unionByName(once)
