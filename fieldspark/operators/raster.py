"""Sampling an unstructured grid at the pixels of a raster."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import finite, present
from ..functions.geodesy import haversine, lon_grid, lon_query, orthographic_inverse, robinson_inverse
from .nearest import knn_join, unit_vector


@dataclass(frozen=True)
class RasterSpec:
    """A raster's projection, limits and size. projection: 'platecarree', 'robinson' (about lon0) or 'orthographic' (about lon0, lat0)."""

    x_min: float
    x_max: float
    y_min: float
    y_max: float
    width: int
    height: int
    projection: str = "platecarree"
    lon0: float = 0.0
    lat0: float = 0.0

    @classmethod
    def of(cls, limits: tuple[float, float, float, float], width: float, height: float, pixel_ratio: float = 1.0, **how) -> RasterSpec:
        """At least ten pixels each way."""
        return cls(*limits, max(int(width * pixel_ratio), 10), max(int(height * pixel_ratio), 10), **how)


def pixels(spark: SparkSession, spec: RasterSpec) -> DataFrame:
    """(iy, ix, x, y, lon, lat), rows from the bottom up; both limits are pixel centres."""
    place = lambda i, n, a, b: F.when(i == n - 1, F.lit(float(b))).otherwise(a + i * ((b - a) / max(n - 1, 1)))
    grid = spark.range(spec.width * spec.height).select((F.expr(f"id div {spec.width}")).cast("int").alias("iy"), (F.col("id") % spec.width).cast("int").alias("ix"))
    grid = grid.withColumn("x", place(F.col("ix"), spec.width, spec.x_min, spec.x_max)).withColumn("y", place(F.col("iy"), spec.height, spec.y_min, spec.y_max))
    if spec.projection == "orthographic":
        lon, lat = orthographic_inverse("x", "y", spec.lon0, spec.lat0)
    elif spec.projection == "robinson":
        lon, lat = robinson_inverse("x", "y", spec.lon0)
    elif spec.projection == "platecarree":
        lon, lat = F.col("x"), F.col("y")
    else:
        print(f"WARNING: no inverse of '{spec.projection}'; x and y are taken as degrees")
        lon, lat = F.col("x"), F.col("y")
    return grid.withColumns({"lon": lon, "lat": lat})


def _flat() -> Column:
    """Degrees between a pixel and a cell in the plane of longitude and latitude."""
    return F.sqrt((F.col("lon") - F.col("glon")) * (F.col("lon") - F.col("glon")) + (F.col("lat") - F.col("glat")) * (F.col("lat") - F.col("glat")))


def nearest_cells(query: DataFrame, grid: DataFrame, k: int, key: list[str], use_spherical: bool = True, polar_threshold: float = 60.0) -> DataFrame:
    """Each query's k nearest grid cells (ncol, glon, glat, value, distance, rank).

    Distances are planar, in degrees and without a seam at 180, but for queries beyond polar_threshold: great-circle degrees.
    """
    polar = F.abs("lat") > polar_threshold if use_spherical else F.lit(False)
    plane = lambda s: [F.col("lon"), F.col("lat")] if s == "q" else [F.col("glon"), F.col("glat")]
    ball = lambda s: unit_vector(*plane(s))
    out = knn_join(query.filter(~polar), grid, key, "ncol", plane, _flat, k, 1024.0)
    if not use_spherical:
        return out
    return out.unionByName(knn_join(query.filter(polar), grid, key, "ncol", ball, lambda: haversine("lon", "lat", "glon", "glat"), k, 4.0))


def spacing(grid: DataFrame, use_spherical: bool = True, polar_threshold: float = 60.0, sample: int | None = None) -> float | None:
    """Three times the median distance from a cell to its nearest other one, over the first cells by number.

    The sample, 20 cells or 100, meets the grid in one pass over it.
    """
    sample = sample or (20 if use_spherical else 100)
    first = grid.orderBy("ncol").limit(sample).select(F.col("ncol").alias("cell"), F.col("glon").alias("lon"), F.col("glat").alias("lat"))
    apart = _flat()
    if use_spherical:
        apart = F.when(F.abs("lat") > polar_threshold, haversine("lon", "lat", "glon", "glat")).otherwise(apart)
    near = grid.crossJoin(F.broadcast(first)).filter(F.col("cell") != F.col("ncol")).groupBy("cell").agg(F.min(apart).alias("distance"))
    found = near.agg(F.median("distance").alias("d")).first().d
    return None if found is None else 3.0 * found


def to_raster(data: DataFrame, query: DataFrame, value: str = "value", key: tuple[str, ...] = ("iy", "ix"), method: str = "nearest", use_spherical: bool = True, polar_threshold: float = 60.0, grid: DataFrame | None = None, mask_value: float | None = None) -> DataFrame:
    """(*key, value): the data at the pixels of query (*key, lon, lat).

    data: (ncol, lon, lat, value), or (ncol, value) with lon and lat in grid. method: 'nearest', or 'linear' for the mean of
    four cells weighted by inverse distance. A pixel further from its nearest cell than three times the grid's spacing, or
    off the globe, is missing; so are cells with missing parts, or of mask_value, before anything is found near them.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"method {method!r} is neither 'nearest' nor 'linear'")
    if "ncol" not in data.columns:
        raise ValueError("the data have no dimension 'ncol'")
    if "lon" not in data.columns or "lat" not in data.columns:
        if grid is None:
            raise ValueError("neither data nor grid has lon and lat")
        data = data.join(grid.select("ncol", "lon", "lat"), "ncol")
    v = present(value)
    if mask_value is not None and not math.isnan(mask_value):
        v = F.when(v != mask_value, v)
    cells = data.select("ncol", lon_grid("lon").alias("glon"), F.col("lat").cast("double").alias("glat"), v.alias("value"))
    cells = cells.filter(finite("glon") & finite("glat") & F.col("value").isNotNull())
    if cells.isEmpty():
        raise ValueError("no grid cell has a place and a value")
    spots = query.select(*key, lon_query("lon").alias("lon"), F.col("lat").cast("double").alias("lat"))
    near = nearest_cells(spots.filter(finite("lon") & finite("lat")), cells, 1 if method == "nearest" else 4, list(key), use_spherical, polar_threshold)
    weight = F.lit(1.0) if method == "nearest" else 1.0 / (F.col("distance") + 1e-10)
    found = near.groupBy(*key).agg((F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"), F.min("distance").alias("d"))
    cut = spacing(cells, use_spherical, polar_threshold)
    if cut is not None:
        found = found.withColumn("value", F.when(F.col("d") <= cut, F.col("value")))
    return query.select(*key).join(found.drop("d"), list(key), "left")
