"""Binned means over a stream: bins are fixed, so the state is a few numbers for each bin (and window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import present
from ..operators.bins import Bins


def bin_stream(cells: DataFrame, y: Column | str, x: Column | str, bins: Bins, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """(bin[, window], bin_val, bin_std, bin_cnt) of a streaming table, for update or complete mode.

    With time and window the means are by window, with a watermark of ``late`` (and so also for append mode). Only bins
    that have cells appear.
    """
    centres = F.array(*map(F.lit, bins.centre))
    keys = [F.get(centres, "b").alias("bin")]
    if window is not None:
        cells = cells.withWatermark(time, late)
        keys.append(F.window(time, window))
    return bins.assign(cells, x, "b").groupBy(*keys).agg(F.avg(present(y)).alias("bin_val"), F.stddev_pop(present(y)).alias("bin_std"), F.count("*").alias("bin_cnt"))
