"""Lanczos filter weights, and their application to a series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def weights(spark: SparkSession, window_len: int, fc_lp: float = 0.0, fc_hp: float = 0.0, sigma_factor: float = 1.0) -> DataFrame:
    """(k, w): the weights for offsets -m..m of a low-pass (fc_lp), or band-pass (less fc_hp) filter; not normalised.

    Cut-offs are frequencies in inverse steps. There are window_len weights, or one less if that is even.
    """
    n = (window_len - 1) // 2 + 1
    k = F.col("k").cast("double")
    safe = F.when(k != 0, k)
    wave = lambda f: F.sin(2.0 * math.pi * f * k) / (math.pi * safe)
    sigma = F.pow(F.sin(math.pi * k / n) * n / (math.pi * safe), F.lit(float(sigma_factor)))
    w = F.when(k == 0, 2.0 * (fc_lp - fc_hp)).otherwise((wave(fc_lp) - wave(fc_hp)) * sigma)
    return spark.range(-(n - 1), n).select(F.col("id").alias("k"), w.alias("w"))


def apply(series: DataFrame, w: list[float], value: str, order: str, by: tuple[str, ...] = (), chunk: int = 1_000_000) -> DataFrame:
    """series with column filtered: the weighted sum over a centred window; missing where the window is not whole.

    order: numbers, dates or times without repeats or nulls within a series. Without by, the series is cut at approximate
    quantiles into chunks of about so many rows, each with the rows next to it that its windows reach, so that no task holds
    all of it; its rows are counted for that at once.
    """
    m = len(w) // 2
    if by:
        return _filtered(series, w, value, order, list(by))
    rows = series.withColumn("__at", F.col(order).cast("double") if dict(series.dtypes)[order] not in ("date", "timestamp_ntz") else F.unix_micros(F.col(order).cast("timestamp")).cast("double"))
    n = series.count()
    if n <= chunk or not m:
        return _filtered(series, w, value, order, [])
    parts = -(-n // chunk)
    cuts = sorted(set(rows.agg(F.percentile_approx("__at", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]))
    rows = rows.withColumn("__chunk", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("__at")))).withColumn("__own", F.lit(True))
    ends = lambda asc: F.row_number().over(W.partitionBy("__chunk").orderBy(F.asc(order) if asc else F.desc(order)))
    edges = [rows.withColumn("__k", ends(asc)).filter(F.col("__k") <= m).drop("__k").withColumn("__chunk", F.col("__chunk") + step).withColumn("__own", F.lit(False)) for asc, step in ((True, -1), (False, 1))]
    least, chunks = rows.groupBy("__chunk").count().agg(F.min("count"), F.count("*")).first()
    if least < m or chunks < len(cuts) + 1:  # windows would reach beyond the next chunk
        return _filtered(series, w, value, order, [])
    out = _filtered(rows.unionByName(edges[0]).unionByName(edges[1]), w, value, order, ["__chunk"])
    return out.filter("__own").drop("__at", "__chunk", "__own")


def _filtered(series: DataFrame, w: list[float], value: str, order: str, by: list[str]) -> DataFrame:
    m = len(w) // 2
    window = W.partitionBy(*by).orderBy(order).rowsBetween(-m, m)
    values = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(window)
    total = F.aggregate(F.zip_with(values, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return series.withColumn("filtered", F.when(F.size(values) == len(w), F.nanvl(total, F.lit(None).cast("double"))))
