"""Exact k nearest neighbours by grid cells, and by descending a tree of counted cells where the grid does not do.

Points and queries have coordinates in a Euclidean space (the plane of longitude and latitude, or the unit sphere in three
dimensions). Of points at one place only the k smallest can be neighbours, so the others are dropped first.

Grid: cubes of an edge h that the density of points suggests. Whatever is within h of a query is in its cube or a
neighbouring one, so a query whose k-th neighbour there is within h is done. Cubes are counted before; a query next to one
of more than a few dozen times k points does not join it.

Tree: the other queries, in sparse or crowded places, descend from the whole space to cells that are split until they
hold few points. At each level the counts and corners of a query's cells bound the distance of its k-th neighbour, and the
cells beyond it are dropped. Cells are quartered along each axis, so the levels are the logarithm of the points to base 16
or 64, and more only where points crowd.

Every step is an equi-join; the root's few cells are the only table that meets all queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.checkpoints import cut

#: What rounding can hide between two distances, in the space.
BLUR = 1e-7


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def knn_join(queries: DataFrame, points: DataFrame, key: Sequence[str], point: str, space: Callable[[str], Sequence[Column]], distance: Callable[[], Column], k: int, extent: float, digits: int = 9, crowd: int = 32, few: int = 100_000) -> DataFrame:
    """Columns of queries and points, distance and rank (from 1) of each query's k nearest points.

    space: finite coordinates of a side's rows ('q' or 'p'), in which neighbours are sought; distance: of a joined row, growing
    with the Euclidean one; ties, after rounding to ``digits``, go to the smaller ``point``. key tells queries apart.
    extent: coordinates are within half of it on either side of zero. All points count where there are fewer than k.
    Counts run at once; the result is read from checkpoints.
    """
    dims = len(space("p"))
    axes = [f"__c{d}" for d in range(dims)]
    placed = lambda rows, side: rows.withColumns(dict(zip(axes, space(side))))
    place = W.partitionBy(*[f"{a}p" for a in axes]).orderBy(point)
    points = placed(points, "p").withColumnsRenamed({a: f"{a}p" for a in axes})
    points = cut(points.withColumn("__same", F.row_number().over(place)).filter(F.col("__same") <= k).drop("__same"))
    rest = placed(queries, "q")
    known = points.agg(F.count("*").alias("n"), *[(F.max(f"{a}p") - F.min(f"{a}p")).alias(a) for a in axes]).first()
    k = min(k, known.n)
    if not k:
        return rest.drop(*axes).crossJoin(points.drop(*[f"{a}p" for a in axes])).select("*", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    spans = sorted(known[a] for a in axes)[-2:]
    area = math.prod(spans) * (math.pi if dims == 3 else 1.0)
    wanted = (k + 4.0 * math.sqrt(k) + 4.0) / math.pi  # so that seldom a circle of radius h has fewer than k points
    h = min(max(math.sqrt(area * wanted / known.n), extent / 2.0**20), extent / 4.0)
    most = crowd * (k + 4)

    cubes = [F.floor(F.col(f"{a}p") / h).alias(f"__k{d}") for d, a in enumerate(axes)]
    names = [f"__k{d}" for d in range(dims)]
    held = points.select("*", *cubes)
    around = F.array(*[F.struct(*[(F.floor(F.col(a) / h) + o).alias(c) for c, a, o in zip(names, axes, shift)]) for shift in product((-1, 0, 1), repeat=dims)])
    asked = rest.withColumn("__k", F.explode(around)).select(*rest.columns, *[F.col(f"__k.{c}").alias(c) for c in names])
    crowded = cut(held.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n"))
    n_crowded = crowded.count()
    if n_crowded:
        crowded = F.broadcast(crowded) if n_crowded <= few else crowded
        asked = asked.join(asked.join(crowded, names, "left_semi").select(*key).distinct(), list(key), "left_anti")
    pairs = asked.join(held, names)
    near = F.sqrt(sum(((F.col(a) - F.col(f"{a}p")) * (F.col(a) - F.col(f"{a}p")) for a in axes), F.lit(0.0)))
    ranked = _ranked(pairs.withColumn("__near", near), key, point, distance, k, digits)
    sure = F.count_if(F.col("__near") <= h * (1 - 1e-9) - BLUR).over(W.partitionBy(*key)) >= k
    spare = ["__near", *axes, *[f"{a}p" for a in axes], *names]
    found = cut(ranked.withColumn("__sure", sure).filter("__sure").drop("__sure", *spare))
    rest = cut(rest.join(found.select(*key).distinct(), list(key), "left_anti"))
    if rest.isEmpty():
        return found
    pairs = _descend(rest, points, axes, list(key), k, extent, most, known.n)
    return found.unionByName(_ranked(pairs, key, point, distance, k, digits).drop(*spare))


def _ranked(pairs: DataFrame, key: Sequence[str], point: str, distance: Callable[[], Column], k: int, digits: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.round("distance", digits), point))
    return pairs.withColumn("distance", distance()).withColumn("rank", rank).filter(F.col("rank") <= k)


def _descend(queries: DataFrame, points: DataFrame, axes: list[str], key: list[str], k: int, extent: float, most: int, n: int) -> DataFrame:
    """queries joined to the points of the cells that may hold one of the k nearest."""
    deepest = math.ceil(math.log(max(n, 2), 4)) + 6
    cell, fine = [f"__t{d}" for d in range(len(axes))], [f"__f{d}" for d in range(len(axes))]
    edge = lambda level: F.lit(extent) / F.pow(F.lit(4.0), level)
    at = lambda level: [F.expr(f"shiftright({f}, 2 * ({deepest} - {level}))").alias(c) for f, c in zip(fine, cell)]
    points = points.select("*", *[F.floor(F.col(f"{a}p") / (extent / 4.0**deepest)).cast("long").alias(f) for a, f in zip(axes, fine)])
    smallest = cut(points.groupBy(*fine).agg(F.count("*").alias("__n")))
    levels = smallest.select(*fine, "__n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("__level"))
    levels = levels.select(*fine, "__n", "__level", *at("__level"))
    split = (F.col("__n") > most) & (F.col("__level") < deepest)
    tree = cut(levels.groupBy("__level", *cell).agg(F.sum("__n").alias("__n")).withColumn("__split", split))
    depth = tree.filter("__split").agg(F.max("__level")).first()[0]
    depth = -1 if depth is None else depth
    leaves = levels.drop("__n").filter(F.col("__level") <= depth + 1).join(tree.filter("NOT __split").drop("__n", "__split"), ["__level", *cell])
    leaves = leaves.groupBy(*fine).agg(F.min("__level").alias("__level"))
    dealt = points.join(leaves, fine).select("*", *at("__level"))

    pairs = queries.select(*key, *axes).crossJoin(F.broadcast(tree.filter("__level = 0")))  # 2 ** dimensions rows at most
    own = W.partitionBy(*key)
    for level in range(depth + 2):
        if level:
            below = tree.filter(F.col("__level") == level).select(*[F.col(c).alias(f"{c}c") for c in cell], F.struct("__level", *cell, "__n", "__split").alias("__child"))
            on = [F.when(F.col("__split"), F.col(c)) == F.expr(f"shiftright({c}c, 2)") for c in cell]
            pairs = pairs.join(below, on, "left")  # a cell that is not split stays itself
            pairs = pairs.select(*key, *axes, *[F.coalesce(F.col(f"__child.{c}"), F.col(c)).alias(c) for c in ("__level", *cell, "__n", "__split")])
        low = [F.col(c) * edge(F.col("__level")) for c in cell]
        high = [(F.col(c) + 1) * edge(F.col("__level")) for c in cell]
        square = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
        near = square([F.greatest(a - F.col(x), F.col(x) - b, F.lit(0.0)) for x, a, b in zip(axes, low, high)])
        far = square([F.greatest(F.abs(a - F.col(x)), F.abs(F.col(x) - b)) for x, a, b in zip(axes, low, high)])
        pairs = pairs.withColumn("__near", near).withColumn("__far", far)
        upto = F.sum("__n").over(own.orderBy("__far").rowsBetween(W.unboundedPreceding, W.currentRow))
        bound = F.min(F.when(F.col("__upto") >= k, F.col("__far"))).over(own)
        pairs = pairs.withColumn("__upto", upto).withColumn("__bound", bound).filter(F.col("__near") <= F.col("__bound") * (1 + 1e-9) + BLUR)
        pairs = pairs.drop("__near", "__far", "__upto", "__bound")
        if level % 6 == 5:
            pairs = cut(pairs)
    # Only cells of the deepest level can be large; their points are dealt to several tasks.
    parts = lambda count: F.ceil(count / most).cast("int")
    sizes = tree.filter(F.col("__n") > most).select("__level", *cell, parts(F.col("__n")).alias("__parts")).filter(F.col("__level") == deepest)
    dealt = dealt.join(sizes, ["__level", *cell], "left").withColumn("__salt", F.pmod(F.xxhash64(*[f"{a}p" for a in axes]), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    pairs = pairs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__split") | (F.col("__n") <= most), 0).otherwise(parts(F.col("__n")) - 1))))
    queries = queries.drop(*axes).withColumnsRenamed({c: f"{c}q" for c in key})
    joined = pairs.drop("__n", "__split").join(dealt, ["__level", *cell, "__salt"]).drop("__level", "__salt", *cell, *fine)
    return joined.join(queries, [F.col(c) == F.col(f"{c}q") for c in key]).drop(*[f"{c}q" for c in key])
