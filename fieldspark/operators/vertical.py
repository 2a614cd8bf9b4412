"""Vertical interpolation by bracket joins, and layer thickness.

A column's levels become segments with one window over the column; a segment takes the targets that it brackets from a
literal array, so targets are neither joined nor shuffled, and the rows of a column stay in the partition of its window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import INF, finite, present, safe_ln, unfilled
from ..functions.moist import hybrid_pressure

#: Levels of a table that is broadcast, at most.
SHORT = 1000
METHODS = {"linear": 1, "log": 2, "loglog": 3}


def _bracket(levels: DataFrame, by: Sequence[str], targets: Sequence[float], at, out: str, extrapolate: bool, back=lambda y: y, skip: Column | None = None) -> DataFrame:
    """(*by, out, value) for every column and target, from levels (*by, x, y, lev); at: the target's place on the x axis."""
    w = W.partitionBy(*by).orderBy("x", "lev")
    whole = W.partitionBy(*by)
    seg = levels.select(
        *by, "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lag("x").over(w).alias("xp"), F.lag("y").over(w).alias("yp"),
        F.row_number().over(w).alias("rn"), F.count("*").over(whole).alias("n"), (F.bool_or(skip).over(whole) if skip is not None else F.lit(False)).alias("skip"),
    )
    wanted = F.array(*[F.struct(F.lit(float(t)).alias("t"), at(F.lit(float(t))).cast("double").alias("xt")) for t in targets])

    def value(s: Column) -> Column:
        xt = s["xt"]
        slope = (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x"))
        line = slope * (xt - F.col("x")) + F.col("y")
        other = F.when(F.col("y") == F.col("y1"), F.col("y")).otherwise(slope * (xt - F.col("x1")) + F.col("y1"))
        inner = F.when(xt == F.col("x"), F.col("y")).otherwise(F.when(F.isnan(line), other).otherwise(line))  # from the other end, next to an infinity
        last = F.col("x1").isNull()
        hit = F.when((xt >= F.col("x")) & (xt < F.col("x1")) | last & (xt == F.col("x")), inner)
        if extrapolate:
            below = (F.col("rn") == 1) & (F.col("n") > 1) & (xt < F.col("x")) & (F.col("x1") > F.col("x"))
            above = last & (F.col("n") > 1) & (xt > F.col("x")) & (F.col("x") > F.col("xp"))
            hit = F.when(below, (F.col("y1") - F.col("y")) / (F.col("x1") - F.col("x")) * (xt - F.col("x")) + F.col("y"))
            hit = hit.when(above, F.col("y") + (F.col("y") - F.col("yp")) / (F.col("x") - F.col("xp")) * (xt - F.col("x")))
            hit = hit.when((xt >= F.col("x")) & (xt < F.col("x1")) | last & (xt == F.col("x")), inner)
        return F.struct(s["t"].alias("t"), F.when(~F.col("skip"), hit).alias("v"))

    # A segment keeps what it answers; the first also a place for every target.
    kept = F.filter(F.transform(wanted, value), lambda s: s["v"].isNotNull() | (F.col("rn") == 1))
    rows = seg.select(*by, F.inline(kept).alias("t", "v"))
    return rows.groupBy(*by, F.col("t").alias(out)).agg(F.max("v").alias("v")).select(*by, out, back(F.col("v")).alias("value"))


def to_pressure(field: DataFrame, coef: DataFrame, surface: DataFrame, targets: Sequence[float] | float, value: str = "v", by: Sequence[str] = ("col",), lev: str = "lev", interp_type: str = "log", extrapolate: bool = False, p0: float = 1.0e5, a: str = "hyam", b: str = "hybm", ps: str = "ps", time: str = "time", validate: bool = True) -> DataFrame:
    """(*by, plev, value): a field on hybrid levels at pressures in Pa; missing outside the column, unless extrapolated.

    field: (*by, lev, value); coef: (lev, a, b), of whose times, if any, the first counts; surface: (keys, ps), keys being
    those of by. interp_type: 'linear', 'log' or 'loglog', in any case; anything else is 'log'. A column with a missing
    value or pressure, or for the logarithms a pressure of zero or less, is missing altogether. 'loglog' loses the
    sign. Levels of coef and field that do not match are an error, for which the field's levels are read at once, in one
    pass over that column; without validate, levels without coefficients take no part. coef: at most a thousand levels.
    """
    kind = METHODS.get(str(interp_type).lower(), 2)
    targets = [targets] if isinstance(targets, (int, float)) else list(targets)
    if time in coef.columns and time != lev:
        coef = coef.join(coef.agg(F.min(time).alias(time)), time).drop(time)
    given = [r[0] for r in coef.select(lev).limit(SHORT + 1).collect()]
    if len(given) > SHORT:
        raise ValueError(f"more than {SHORT} levels")
    if validate:
        have = {r[0] for r in field.select(lev).distinct().limit(len(given) + 1).collect()}
        if have != set(given) or len(have) != len(given):
            raise ValueError("Hybrid coefficients do not match the field's levels")
    keys = [c for c in by if c in surface.columns]
    if not keys:
        raise ValueError("the surface pressure shares no dimension with the field")
    rows = field.join(F.broadcast(coef), lev).join(surface.select(*keys, ps), keys, "left")  # a coefficient for each level
    p, v = hybrid_pressure(a, b, ps, p0), F.col(value).cast("double")
    rows = rows.withColumn("p", p).withColumn("v", v)
    bad = present("v").isNull() | present("p").isNull()
    bad = bad | F.coalesce(F.col("p") <= 0, F.lit(True)) if kind > 1 else bad
    axis = safe_ln if kind > 1 else lambda c: c
    y = safe_ln(F.abs("v")) if kind == 3 else F.col("v")
    levels = rows.select(*by, F.coalesce(axis(F.col("p")), F.lit(-INF)).alias("x"), y.alias("y"), F.col(lev).alias("lev"), bad.alias("bad"))
    return _bracket(levels, by, targets, axis, "plev", extrapolate, F.exp if kind == 3 else lambda c: c, F.col("bad"))


def to_default_pressure(field: DataFrame, coef: DataFrame, surface: DataFrame, plev_hpa: Sequence[float] | None = None, extrapolate: bool = False, **how) -> DataFrame:
    """to_pressure in the logarithm of pressure, at levels in hPa; by default 28 from 10 to 1000. Results of 1e30 are missing."""
    from ..functions.constants import plev_default

    out = to_pressure(field, coef, surface, [100.0 * p for p in plev_hpa or plev_default], interp_type="log", extrapolate=extrapolate, **how)
    return out.withColumn("value", unfilled("value"))


def to_height(field: DataFrame, heights: Sequence[float] | float, z: DataFrame | None = None, value: str = "v", height: str = "z", by: Sequence[str] = ("col",), lev: str = "lev", out: str = "height", extrapolate: bool = False) -> DataFrame:
    """(*by, out, value): a field at heights, linear in the height of its levels; missing outside unless extrapolated.

    z: (dimensions, lev, height) where the field has no such column; it may lack some of the field's dimensions. Levels of
    missing height take no part. A missing value is missing in the segments that it bounds only.
    """
    heights = [heights] if isinstance(heights, (int, float)) else list(heights)
    if z is not None:
        field = field.join(z, [c for c in z.columns if c in field.columns and c not in (value, height)])
    rows = field.filter(finite(height)).select(*by, F.col(height).cast("double").alias("x"), present(value).alias("y"), F.col(lev).alias("lev"))
    return _bracket(rows, by, heights, lambda c: c, out, extrapolate)


def layer_thickness(surface: DataFrame, levels: DataFrame, ps: str = "ps", lev: str = "lev") -> DataFrame:
    """surface x levels with column dp: the pressure between the levels before and after, cut off at the ground.

    surface: pressures in Pa; levels: a table of at most a thousand pressures in hPa, which ascend with ``lev``. The first level has none.
    An inner level at or below the ground reaches from the level before it to the ground, as the last does. What is not
    positive is missing. Neighbours are found in the table of levels, so the surface is not shuffled.
    """
    if levels.limit(SHORT + 1).count() > SHORT:
        raise ValueError(f"more than {SHORT} levels")
    w = W.orderBy(lev)  # over the table of levels
    p = F.col(lev).cast("double") * 100.0
    table = levels.select(F.col(lev), p.alias("p"), F.lag(p).over(w).alias("before"), F.lead(p).over(w).alias("after"), F.row_number().over(w).alias("k"))
    ground = F.col(ps).cast("double")
    inner = F.when(F.col("p") < ground, F.col("after") - F.col("before")).otherwise(ground - F.col("before"))
    dp = F.when(F.col("k") == 1, None).when(F.col("after").isNull(), ground - F.col("p")).otherwise(inner)
    rows = surface.crossJoin(F.broadcast(table)).withColumn("dp", dp)
    return rows.withColumn("dp", F.when((F.col("dp") > 0) & ~F.isnan("dp"), F.col("dp"))).drop("p", "before", "after", "k")
