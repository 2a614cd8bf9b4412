"""Saturation humidity and pressure of hybrid levels as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col, ieee_div


def qsat_buck(ta, pa) -> Column:
    """Saturation specific humidity, kg/kg, of temperature in K and pressure in hPa (Buck 1996). Zero Celsius is 273 K here."""
    c, p = col(ta) - 273.0, col(pa)
    vapour = 6.1121 * (1.0007 + 3.46e-6 * p) * F.exp(ieee_div(17.502 * c, 240.97 + c))
    return 0.62197 * ieee_div(vapour, p - 0.378 * vapour)


def qsat_peters(ta, pa) -> Column:
    """380 / pa * exp(17.27 (ta - 273) / (ta - 36)); the factor supposes Pa."""
    return ieee_div(F.lit(380.0), pa) * F.exp(ieee_div(17.27 * (col(ta) - 273.0), col(ta) - 36.0))


def hybrid_pressure(a, b, ps, p0: float = 1.0e5) -> Column:
    return col(a) * p0 + col(b) * col(ps)


def hpa_to_pa(p) -> Column:
    return col(p) * 100.0
