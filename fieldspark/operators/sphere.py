"""Operators on points of the sphere: coordinates, cell areas, nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import finite
from ..functions.constants import AREA_RADIUS
from ..functions.geodesy import great_circle, lon_to_180
from .nearest import knn_join, unit_vector


def wrap_longitude(df: DataFrame, lon_dim: str = "lon", sort_dim: bool = False) -> DataFrame | None:
    """df with lon_dim in [-180, 180), sorted by it if asked; None, with a warning, where there is no such column."""
    if lon_dim not in df.columns:
        print(f"WARNING: no column '{lon_dim}' among {df.columns}")
        return None
    out = df.withColumn(lon_dim, lon_to_180(lon_dim))
    return out.orderBy(lon_dim) if sort_dim else out


def cell_area(lat: DataFrame, lon: DataFrame, compat: bool = True) -> DataFrame:
    """(j, i, area) in square metres, from lat (j, b0, b1) and lon (i, b0, b1) bounds in degrees.

    compat: the width is that of the longitude cell of number j, without the cosine of the latitude; rows j beyond
    the last longitude have none. Otherwise that of cell i, times the cosine of the middle latitude.
    """
    metres = lambda a, b: AREA_RADIUS * F.abs(F.col(b) - F.col(a)) * math.pi / 180.0
    rows = lat.select("j", metres("b0", "b1").alias("dy"), F.cos(F.radians((F.col("b0") + F.col("b1")) / 2)).alias("shrink"))
    wide = lon.select("i", metres("b0", "b1").alias("dx"))
    if compat:
        rows = rows.join(wide.withColumnRenamed("i", "j"), "j", "left")
        return rows.crossJoin(lon.select("i")).select("j", "i", (F.col("dx") * F.col("dy")).alias("area"))
    return rows.crossJoin(wide).select("j", "i", (F.col("dx") * F.col("dy") * F.col("shrink")).alias("area"))


def nearest_neighbors(points: DataFrame, k: int, include_self: bool = True, id_col: str = "ncol") -> DataFrame:
    """(id_col, rank, neighbor_id, neighbor_dist): great-circle distances in radians; rank 0 is the point itself.

    Without include_self, ranks start at 1. Distances that round to the same nine digits tie, to the smaller id. Points
    without a finite place have no neighbours and are none; an id stands for one point.
    """
    points = points.filter(finite("lat") & finite("lon"))
    q = points.select(F.col(id_col).alias("q"), F.col("lat").cast("double").alias("qlat"), F.col("lon").cast("double").alias("qlon"))
    p = points.select(F.col(id_col).alias("p"), F.col("lat").cast("double").alias("plat"), F.col("lon").cast("double").alias("plon"))
    found = knn_join(q, p, ["q"], "p", lambda s: unit_vector(F.col(f"{s}lon"), F.col(f"{s}lat")), lambda: great_circle("qlat", "plat", "qlon", "plon"), k + 1, 4.0)
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.round("distance", 9), "p"))
    others = found.filter("q <> p").withColumn("rank", rank).filter(F.col("rank") <= k)
    out = others.select(F.col("q").alias(id_col), "rank", F.col("p").alias("neighbor_id"), F.greatest("distance", F.lit(0.0)).alias("neighbor_dist"))
    return out.unionByName(q.select(F.col("q").alias(id_col), F.lit(0).alias("rank"), F.col("q").alias("neighbor_id"), F.lit(0.0).alias("neighbor_dist"))) if include_self else out
