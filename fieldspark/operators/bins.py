"""Aggregates of one variable in bins of another.

Rows are cells. A bin is half-open, and cells whose x is missing or not finite are in none. Bins that touch each other
are found by arithmetic or a search in a literal array, without a join; others by a join with the short list of bins.
The aggregate is one partial and one final hash aggregation, whatever the number of bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col, finite, present


@dataclass(frozen=True)
class Bins:
    """Centres and edges [bottom, top) of bins in ascending order."""

    centre: tuple[float, ...]
    bottom: tuple[float, ...]
    top: tuple[float, ...]
    pitch: float | None = None  # of equal bins that touch

    @classmethod
    def manual(cls, low: float, high: float, spacing: float) -> Bins:
        """Equal widths about centres spread evenly from low to high; bins leave gaps or overlap where the spacing doesn't fit."""
        n = round((high - low + spacing) / spacing)
        step = (high - low) / (n - 1) if n > 1 else 0.0
        centre = [low + k * step for k in range(n)]
        if n > 1:
            centre[-1] = float(high)
        half = spacing / 2.0
        return cls(tuple(map(float, centre)), tuple(c - half for c in centre), tuple(c + half for c in centre), float(spacing) if n == 1 or step == spacing else None)

    @classmethod
    def explicit(cls, edges: Sequence[float]) -> Bins:
        pairs = list(zip(edges, edges[1:]))
        return cls(tuple((a + b) / 2.0 for a, b in pairs), tuple(float(a) for a, _ in pairs), tuple(float(b) for _, b in pairs))

    @classmethod
    def log(cls, low: float, spacing: float, percent: float, n: int) -> Bins:
        """The first bin is centred at low; each is wider than the last by so many percent and starts where that ends."""
        width, centre, out = float(spacing), float(low), []
        for _ in range(n):
            out.append((centre, centre - width / 2.0, centre + width / 2.0))
            wider = width * (1.0 + percent / 100.0)
            centre, width = centre + width / 2.0 + wider / 2.0, wider
        return cls(*map(tuple, zip(*out)))

    @classmethod
    def of(cls, mode: str = "manual", bins: Sequence[float] = (), bin_min: float = 0, bin_max: float = 1, bin_spc: float = 1, bin_spc_log: float = 20, nbin_log: int = 2) -> Bins:
        if mode == "manual":
            return cls.manual(bin_min, bin_max, bin_spc)
        if mode == "explicit":
            return cls.explicit(bins)
        if mode == "log":
            return cls.log(bin_min, bin_spc, bin_spc_log, nbin_log)
        raise ValueError(f"bin mode {mode!r} is none of 'manual', 'explicit' and 'log'")

    def table(self, spark: SparkSession) -> DataFrame:
        """(b, bin, bottom, top)."""
        rows = [F.struct(F.lit(k).alias("b"), *[F.lit(v).alias(n) for n, v in zip(("bin", "bottom", "top"), x)]) for k, x in enumerate(zip(self.centre, self.bottom, self.top))]
        return spark.range(1).select(F.inline(F.array(*rows)))

    def touching(self) -> bool:
        return all(a == b for a, b in zip(self.top, self.bottom[1:])) and all(a < b for a, b in zip(self.bottom, self.top))

    def assign(self, rows: DataFrame, x: Column | str, out: str) -> DataFrame:
        """rows that are in a bin, with its number in column ``out``; once for each bin where bins overlap."""
        v = col(x).cast("double")
        bottoms, tops = F.array(*map(F.lit, self.bottom)), F.array(*map(F.lit, self.top))
        rows = rows.filter(finite(v))
        if self.touching():
            rows = rows.filter((v >= self.bottom[0]) & (v < self.top[-1]))  # so in one bin; also cuts the scan
            if not self.pitch:
                return rows.withColumn(out, F.size(F.filter(bottoms, lambda e: e <= v)) - 1)
            guess = F.least(F.greatest(F.floor((v - self.bottom[0]) / self.pitch), F.lit(0)), F.lit(len(self.bottom) - 1)).cast("int")
            # Rounding puts the guess a bin off at most; the edges decide.
            return rows.withColumn(out, F.when(v < F.get(bottoms, guess), guess - 1).when(v >= F.get(tops, guess), guess + 1).otherwise(guess))
        table = self.table(rows.sparkSession).select(F.col("b").alias(out), F.col("bottom").alias("__bottom"), F.col("top").alias("__top"))
        return rows.join(F.broadcast(table), (v >= F.col("__bottom")) & (v < F.col("__top"))).drop("__bottom", "__top")


def _percent(out: DataFrame) -> DataFrame:
    total = F.broadcast(out.agg(F.sum("bin_cnt").alias("__total")))  # one row
    return out.crossJoin(total).withColumn("bin_pct", F.col("bin_cnt") / F.when(F.col("__total") > 0, F.col("__total")) * 100.0).drop("__total")


def bin_by(cells: DataFrame, y: Column | str, x: Column | str, bins: Bins, weight: Column | str | None = None, method: str = "mean", keep_lev: Column | str | None = None, keep_time: Column | str | None = None, time: Column | str | None = None) -> DataFrame:
    """(bin[, lev | time], bin_val, bin_std, bin_cnt, bin_pct); every bin has a row, in order of bins where nothing is kept.

    Without keep_*: method is 'max', 'std' or anything else for the mean, which the weight applies to. A cell whose y is
    missing still adds its weight, and still counts: bin_cnt is the number of x cells. keep_lev goes before keep_time
    and applies if there is more than one level: means by level, weighted ones by (level, ``time``) and then averaged
    over times; bin_cnt is the number of y values. keep_time applies if there is more than one time: (weighted) means by
    time; bin_cnt is the bin's total, repeated; no bin_std. bin_std is the population's. Where a dimension is to be kept, it
    is read at once to see whether it has two values.
    """
    spark = cells.sparkSession
    v = present(y)
    rows = cells.select(v.alias("v"), col(x).cast("double").alias("x"), *([present(weight).alias("w")] if weight is not None else []), *[col(c).alias(n) for c, n in ((keep_lev, "lev"), (keep_time, "t")) if c is not None], *([col(time).alias("time")] if time is not None else []))
    kept = None
    for name, asked in (("lev", keep_lev), ("t", keep_time)):
        if kept is None and asked is not None and rows.select(name).distinct().limit(2).count() > 1:
            kept = name
    table = bins.table(spark).select("b", "bin")
    placed = bins.assign(rows, "x", "b")
    weighted = F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)) / F.nullif(F.sum("w"), F.lit(0.0)) if weight is not None else F.avg("v")
    if kept is None:
        value = {"max": F.max("v"), "std": F.stddev_pop("v")}.get(method, weighted)
        found = placed.groupBy("b").agg(value.alias("bin_val"), F.stddev_pop("v").alias("bin_std"), F.count("*").alias("n"))
        out = table.join(found, "b", "left")
        return _percent(out.select("bin", "bin_val", "bin_std", F.coalesce("n", F.lit(0)).alias("bin_cnt"))).orderBy("bin")
    grid = table.crossJoin(rows.select(kept).filter(F.col(kept).isNotNull()).distinct())
    if kept == "t":
        found = placed.groupBy("b", "t").agg(weighted.alias("bin_val"), F.count("*").alias("m"))
        counts = found.groupBy("b").agg(F.sum("m").alias("n"))
        out = grid.join(found, ["b", "t"], "left").join(counts, "b", "left").withColumn("bin_std", F.lit(None).cast("double"))
    else:
        found = placed.groupBy("b", "lev").agg(F.avg("v").alias("bin_val"), F.stddev_pop("v").alias("bin_std"), F.count("v").alias("n"))
        if weight is not None:
            by_time = placed.groupBy("b", "lev", *(["time"] if time is not None else [])).agg(weighted.alias("m"))
            found = found.drop("bin_val").join(by_time.groupBy("b", "lev").agg(F.avg("m").alias("bin_val")), ["b", "lev"])
        out = grid.join(found, ["b", "lev"], "left")
    name = "lev" if kept == "lev" else "time"
    out = out.withColumnRenamed("t", "time") if kept == "t" else out
    return _percent(out.select("bin", name, "bin_val", "bin_std", F.coalesce("n", F.lit(0)).alias("bin_cnt")))


def bin_fields(vy: DataFrame, vx: DataFrame, y: str, x: str, bins: Bins, wgt: DataFrame | None = None, weight: str | None = None, **how) -> DataFrame:
    """bin_by of variables in tables of their own, joined on the dimensions that they share."""
    values = {y, x, weight}
    on = lambda a, b: [c for c in a.columns if c in b.columns and c not in values]
    cells = vy.join(vx, on(vy, vx))
    if wgt is not None:
        cells = cells.join(wgt, on(cells, wgt))
    return bin_by(cells, y, x, bins, weight=weight, **how)


def bin_by_two(cells: DataFrame, z: str, y: str, x: str, bins_y: Bins, bins_x: Bins) -> DataFrame:
    """(bin_y, bin_x, bin_val, bin_std, bin_cnt): means of z in bins of two variables; bin pairs with cells only."""
    spark = cells.sparkSession
    placed = bins_x.assign(bins_y.assign(cells.select(present(z).alias("v"), col(y).alias("y"), col(x).alias("x")), "y", "by"), "x", "bx")
    found = placed.groupBy("by", "bx").agg(F.avg("v").alias("bin_val"), F.stddev_pop("v").alias("bin_std"), F.count("*").alias("bin_cnt"))
    names = lambda bins, b, n: bins.table(spark).select(F.col("b").alias(b), F.col("bin").alias(n))
    return found.join(names(bins_y, "by", "bin_y"), "by").join(names(bins_x, "bx", "bin_x"), "bx").select("bin_y", "bin_x", "bin_val", "bin_std", "bin_cnt")
