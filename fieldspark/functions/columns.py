"""Columns that keep IEEE and missing-value rules apart from Spark's ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAN, INF = float("nan"), float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The value as a double; NULL for NaN."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def unfilled(c: Column | str, fill: float = 1e30) -> Column:
    """The value as a double; NULL for one that is the fill value within rounding."""
    x = col(c).cast("double")
    return F.when(F.abs(x - fill) > 1e-5 * abs(fill) + 1e-8, x).otherwise(F.when(F.isnan(x), x))


def finite(c: Column | str) -> Column:
    """Whether a value is there and is neither NaN nor infinite; never NULL."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def ieee_div(n: Column | str, d: Column | str) -> Column:
    """n / d with infinities and NaN where d is zero, instead of an error."""
    n, d = col(n).cast("double"), col(d).cast("double")
    return F.when(d == 0, F.when((n == 0) | F.isnan(n), NAN).when(n > 0, INF).otherwise(-INF)).otherwise(n / F.when(d != 0, d))


def safe_ln(c: Column | str) -> Column:
    """Natural logarithm with -inf at zero and NaN below."""
    x = col(c).cast("double")
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(F.ln(x))
