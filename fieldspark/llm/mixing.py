"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes, sums, targets, permutations and cuts are DataFrame expressions; no Python runs on executors.

1. Every document has a size in words. A source's target is its share of ``total`` times all words, by weight; a target
   stops at ``most`` times its source's words and the excess is shared again among the others by weight.
2. A hash of the row permutes each source's documents; equal ranges of it are the source's blocks, of about ``block``
   documents each. A pass over a source draws its blocks in order; passes follow each other until the target is drawn,
   to the word. The last document drawn is drawn in part, so each source's words are its target, rounded.
3. The source's number of block draws is its quota. The tree splits the vector of all quotas recursively between the two
   halves of the output shards by a multivariate hypergeometric draw, so each shard's quotas are distributed as in a
   uniform shuffle of all block draws, yet no row moves. A shard takes the next disjoint run of each source's draws.
4. Within a shard, rows are ordered by hash.

Only (source, size, hash) is dealt out and summed: what a row contributes follows from its hash and a few numbers of its
source, so texts never move. The tree sees one number for each source and shard; the number of shards is bounded by that of
sources unless the caller gives it. What the tree says is a table of cells: a cell is a run of a source's draws with the
first shard there and where the next ones begin, about CELL of them, so a document finds its shard by one equality join and
a look at CELL numbers, however many shards there are. A source's blocks are summed in two levels, so no window holds
more than a block's documents, ``fan`` blocks, or a source's groups of ``fan`` blocks; the windows over sources and the
tree's quotas hold a row for each source. Tables are broadcast if their bytes, which are counted, are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, fresh

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Shards that begin in a cell, about.
CELL = 64
#: Numbers that the tree may hold, unless the caller asks for more shards.
TREE = 1 << 22
#: Rows of a table of sources that one file holds; windows over them run in one task as it is.
SOURCES = 1 << 18
#: Bytes of a table that is broadcast, at most.
FEW_BYTES = 32 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(turn, source, n_docs, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn. Water-filling in closed form: in ascending order of
    cap by weight, a source is capped while its cap is within its share of what the capped ones before it leave. The
    windows run over sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = per.withColumn("turn", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rank = W.orderBy(F.col("cap") / F.col("weight"), "turn")
    before, every = rank.rowsBetween(W.unboundedPreceding, -1), rank.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(total) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("share", share).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("share"))
    level = F.max(F.when(~F.col("capped"), F.col("share"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)
    return per.select("turn", "source", "n_docs", "source_size", target.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 0) -> np.ndarray:
    """(source, shard) block draws: quotas split down a tree whose nodes halve their shards."""
    out = np.zeros((len(quotas), shards), np.int64)
    nodes = [(0, shards, np.asarray(quotas, np.int64))]
    while nodes:
        a, b, have = nodes.pop()
        whole = int(have.sum())
        if b - a == 1 or not whole:
            out[:, a] = have
            continue
        mid = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(have, whole * (mid - a) // (b - a), method="marginals")
        nodes += [(a, mid, left), (mid, b, have - left)]
    return out


def tree_cells(turns: list[int], quotas: np.ndarray, shards: int, seed: int = 0) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(turn, width, cell, shard, bounds) from the splitting tree: a source's draws of numbers from cell * width to below
    (cell + 1) * width go to the shard, plus one for each of bounds that is not above the draw's number."""
    for turn, quota, shares in zip(turns, quotas.tolist(), split_quotas(quotas, shards, seed)):
        ends = shares.cumsum()[:-1]
        width = max(1, math.ceil(quota * CELL / shards))
        starts = np.arange(0, quota, width)
        first, beyond = np.searchsorted(ends, starts, side="right"), np.searchsorted(ends, starts + width, side="left")
        for cell, (a, b) in enumerate(zip(first.tolist(), beyond.tolist())):
            yield turn, width, cell, a, ends[a:b].tolist()


def cut_points(slim: DataFrame, per: DataFrame, fan: int) -> DataFrame:
    """(turn, b, h, each): the block, the hash and the words a row of that hash gives, at which a source's last pass ends."""
    rows = slim.join(_small(per), slim.source.eqNullSafe(per.source)).select("turn", "size", "h", "rest", F.expr("h div width").alias("b"))
    blocks = cut(rows.groupBy("turn", "b").agg(F.sum("size").alias("words")).withColumn("g", F.expr(f"b div {fan}")))
    groups = blocks.groupBy("turn", "g").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(W.partitionBy("turn").orderBy("g")) - F.col("words")
    inner = F.sum("words").over(W.partitionBy("turn", "g").orderBy("b")) - F.col("words")
    start = blocks.join(groups.select("turn", "g", upto.alias("base")), ["turn", "g"]).withColumn("start", F.col("base") + inner)
    last = start.join(per.select("turn", "rest"), "turn").filter("start < rest and rest <= start + words")
    last = cut(last.select("turn", "b", (F.col("rest") - F.col("start")).alias("rest")), SOURCES)
    within = rows.drop("rest").join(_small(last), ["turn", "b"]).groupBy("turn", "b", "rest", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    done = F.sum("words").over(W.partitionBy("turn").orderBy("h")) - F.col("words")
    end = within.withColumn("done", done).filter("done < rest and rest <= done + words")
    return cut(end.select("turn", "b", "h", F.expr("(rest - done) div n").alias("each")), SOURCES)


def _up_to(numbers: Column, most: Column) -> Column:
    return F.filter(numbers, lambda x: x <= most)


def _small(df: DataFrame) -> DataFrame:
    """df, a checkpointed table, marked for broadcast if its rows, texts and arrays have few bytes."""
    kinds = dict(df.dtypes)
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kinds[c] == "string" else F.greatest(F.size(c), F.lit(0)) * 8 if kinds[c].startswith("array") else F.lit(0) for c in df.columns]
    held = df.agg(F.sum(sum(sizes, F.lit(16 * len(sizes) + 32)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= FEW_BYTES else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, shards: int | None = None, shard_words: int = 1 << 23, block: int = 256, fan: int = 512, seed: int = 0) -> DataFrame:
    """docs with columns size, source_size, target, taken and draws, each with underscores before it where docs has its name.

    draws: array<struct<pass, shard, words, place>>, a document's appearances in the mix (none, one or two): the output
    shard, the number of its words that are taken (all but for one document of each source) and its place within the
    shard. taken: the sum of words, at most ``most`` (2) times size. Null and empty texts have size 0 and are never
    drawn; very long ones are drawn whole but for a source's last. shards: how many, else one for each shard_words, as
    far as the tree's TREE numbers go. Null sources are a source of their own. Equal rows tie: where a
    source's last words fall on several, each gives an equal part, rounded down. Reruns return the same rows. An empty
    table gives no rows.
    """
    if not 0 < most <= 2:
        raise ValueError("a document is drawn in two passes at most")
    size, h, source_size, target, taken, draws, pre, source_key, key, cell = fresh(docs, "size", "hash", "source_size", "target", "taken", "draws", "param", "source_key", "key", "cell")
    source = F.col(source_col).cast("string")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), source, F.col(text_col)), 2)
    slim = cut(docs.select(source.alias("source"), n_words(F.col(text_col)).alias("size"), hashed.alias("h")))
    per = source_targets(slim, weights, total, most)
    blocks = F.ceil(F.col("n_docs") / block)
    whole = F.expr("case when source_size > 0 then cast(round(target) as bigint) div source_size else 0 end")
    per = per.withColumn("blocks", blocks).withColumn("width", F.expr(f"{2**62} div blocks + 1")).withColumn("passes", whole)
    per = cut(per.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size")), SOURCES)
    per = per.join(cut_points(slim, per, fan), "turn", "left")
    per = cut(per.withColumn("quota", F.col("passes") * F.col("blocks") + F.coalesce(F.col("b") + 1, F.lit(0))), SOURCES)
    quotas = per.select("turn", "quota", "target").orderBy("turn").collect()  # a row for each source
    most_shards = max(1, TREE // max(1, len(quotas)))
    shards = shards or min(most_shards, max(1, math.ceil(sum(r.target for r in quotas) / shard_words)))
    found = tree_cells([r.turn for r in quotas], np.array([r.quota for r in quotas], np.int64), shards, seed)
    cells = cut(docs.sparkSession.createDataFrame(found, "turn int, width long, cell long, shard int, bounds array<long>"), 16 * SOURCES)
    widths = cells.groupBy("turn").agg(F.first("width").alias("cell_width"))
    fields = F.struct("turn", "source", "source_size", "target", "blocks", "width", "passes", "h", "each", "cell_width")
    per = cut(per.join(widths, "turn", "left").select("source", fields.alias(pre)), SOURCES)
    rows = docs.withColumn(size, n_words(F.col(text_col))).withColumn(h, hashed)
    rows = rows.join(_small(per.withColumnRenamed("source", source_key)), source.eqNullSafe(F.col(source_key)), "left").drop(source_key)
    part = F.when(F.col(h) < F.col(f"{pre}.h"), F.col(size)).when(F.col(h) == F.col(f"{pre}.h"), F.col(f"{pre}.each")).otherwise(F.lit(0))
    cells, passes = _small(cells.drop("width")), []
    for k in range(2):
        words = F.when(F.col(f"{pre}.passes") > k, F.col(size)).when(F.col(f"{pre}.passes") == k, F.least(part, F.col(size))).otherwise(F.lit(0)).cast("long")
        draw = F.expr(f"{k} * {pre}.blocks + {h} div {pre}.width")
        at = cells.select(F.struct("turn", "cell").alias(key), F.struct("shard", "bounds").alias(f"{cell}{k}"))
        asked = F.when(words > 0, F.struct(F.col(f"{pre}.turn").alias("turn"), F.expr(f"({k} * {pre}.blocks + {h} div {pre}.width) div {pre}.cell_width").alias("cell")))
        rows = rows.join(at, asked == F.col(key), "left").drop(key)
        shard = F.col(f"{cell}{k}.shard") + F.size(_up_to(F.col(f"{cell}{k}.bounds"), draw))
        passes.append(F.struct(F.lit(k).alias("pass"), shard.alias("shard"), words.alias("words"), F.xxhash64(F.lit(seed + 1 + k), h).alias("place")))
    rows = rows.withColumn(draws, F.filter(F.array(*passes), lambda x: x["words"] > 0))
    added = F.aggregate(draws, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return rows.select(*docs.columns, size, F.col(f"{pre}.source_size").alias(source_size), F.col(f"{pre}.target").alias(target), added.alias(taken), draws)


def appearances(docs: DataFrame, mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself, in the columns of docs: a row for each draw, by shard and in the order of its place there.

    A shard is four runs of places, each in one partition, so that partitions stay even.

    A document drawn in part keeps the words drawn, counted from its start, and what stands before and between them.
    """
    size, shard, place, x = fresh(mixed, "size", "shard", "place", "x")
    had, draws = mixed.columns[-5], mixed.columns[-1]
    rows = mixed.select(*docs.columns, F.col(had).alias(size), F.explode(draws).alias(x))
    start = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col(f"{x}.words") == F.col(size), F.col(text_col)).otherwise(F.array_join(F.slice(start, 1, F.col(f"{x}.words").cast("int")), ""))
    return rows.withColumn(text_col, text).withColumn(shard, F.col(f"{x}.shard")).withColumn(place, F.col(f"{x}.place")).repartition(shard, F.shiftrightunsigned(place, 62)).sortWithinPartitions(shard, place).select(*docs.columns)
