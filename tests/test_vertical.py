import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import vertical

NAN = float("nan")


def heights(spark, z, v, targets, **how):
    df = spark.createDataFrame([(0, k, float(a), float(b)) for k, (a, b) in enumerate(zip(z, v))], "col int, lev int, z double, v double")
    out = {r.height: r.value for r in vertical.to_height(df, targets, **how).collect()}
    assert sorted(out) == sorted(set(map(float, targets)))
    return [out[float(t)] for t in targets]


UP, VAL = [100, 200, 300, 400, 500], [10, 20, 30, 40, 50]


@pytest.mark.parametrize(
    "z,v,targets,how,want",
    [
        (UP, VAL, UP, {}, VAL),
        (UP, VAL, [150, 250, 350, 450], {}, [15, 25, 35, 45]),
        (UP, VAL, [50, 200, 600], {}, [None, 20, None]),
        (UP[:3], VAL[:3], [0, 400], {"extrapolate": True}, [0, 40]),
        (UP[:3], VAL[:3], [0, 400], {}, [None, None]),
        (UP[::-1], VAL[::-1], [50, 150, 300, 350, 600], {}, [None, 15, 30, 35, None]),
        (UP, [42] * 5, [150, 250, 350], {}, [42] * 3),
        ([0, 1000], [0, 1000], [500], {}, [500]),
        ([100, NAN, 300], [10, 5, 30], [200], {}, [20]),
        (UP, [10, NAN, 30, 40, 50], [100, 150, 250, 350], {}, [10, None, None, 35]),
        ([100], [7], [100, 200], {"extrapolate": True}, [7, None]),
    ],
)
def test_heights(spark, z, v, targets, how, want):
    assert heights(spark, z, v, targets, **how) == want


def test_heights_of_another_table_without_time(spark):
    field = spark.createDataFrame([(t, c, k, 10.0 * (k + 1) + 30 * t) for t in (0, 1) for c in (0, 1) for k in range(3)], "time int, ncol int, plev int, v double")
    z = spark.createDataFrame([(c, k, 100.0 * (k + 1)) for c in (0, 1) for k in range(3)], "ncol int, plev int, z double")
    out = vertical.to_height(field, [150, 250], z=z, by=("time", "ncol"), lev="plev", out="h").collect()
    assert {(r.time, r.ncol, r.h): r.value for r in out} == {(t, c, h): h / 10 + 30 * t for t in (0, 1) for c in (0, 1) for h in (150.0, 250.0)}


def pressures(spark, p, v, targets, cols=1, **how):
    p0 = how.pop("p0", 1.0e5)
    coef = spark.createDataFrame([(k, 0.0, x / p0) for k, x in enumerate(p)], "lev int, hyam double, hybm double")
    field = spark.createDataFrame([(c, k, float(x) * (c + 1)) for c in range(cols) for k, x in enumerate(v)], "col int, lev int, v double")
    surf = spark.createDataFrame([(c, p0) for c in range(cols)], "col int, ps double")
    out = vertical.to_pressure(field, coef, surf, targets, p0=p0, **how).collect()
    return {(r.col, r.plev): r.value for r in out}


P = [100000, 80000, 60000, 40000, 20000]


def test_linear(spark):
    got = pressures(spark, P, [x / 1000 for x in P], [90000, 60000, 5000], cols=2, interp_type="linear")
    assert got == {(0, 90000): pytest.approx(90), (0, 60000): pytest.approx(60), (0, 5000): None, (1, 90000): pytest.approx(180), (1, 60000): pytest.approx(120), (1, 5000): None}


def test_log_and_loglog(spark):
    p = [math.exp(k) for k in (5, 4, 3, 2, 1)]
    assert pressures(spark, p, [5, 4, 3, 2, 1], [math.exp(3.5)], p0=100.0)[0, math.exp(3.5)] == pytest.approx(3.5)
    assert pressures(spark, p, [5, 4, 3, 2, 1], [math.exp(3.5)], p0=100.0, interp_type="unknown")[0, math.exp(3.5)] == pytest.approx(3.5)
    assert pressures(spark, [1, 2, 4], [-1, -4, -16], [3], p0=1.0, interp_type="LogLog")[0, 3] == pytest.approx(9)


def test_scalar_target_and_extrapolation(spark):
    assert pressures(spark, [100000, 80000], [10, 8], 60000, interp_type="linear", extrapolate=True)[0, 60000] == pytest.approx(6)
    assert pressures(spark, P, P, 5000, extrapolate=True)[0, 5000] is not None


@pytest.mark.parametrize("bad", [NAN, None])
def test_a_missing_value_empties_the_column(spark, bad):
    field = [100.0, bad, 60.0, 40.0, 20.0]
    coef = spark.createDataFrame([(k, 0.0, x / 1e5) for k, x in enumerate(P)], "lev int, hyam double, hybm double")
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate(field)], "col int, lev int, v double")
    surf = spark.createDataFrame([(0, 1e5)], "col int, ps double")
    assert [r.value for r in vertical.to_pressure(df, coef, surf, [90000, 50000], interp_type="linear").collect()] == [None, None]


def test_wrong_coefficients(spark):
    coef = spark.createDataFrame([(k, 0.0, 1.0) for k in range(3)], "lev int, hyam double, hybm double")
    df = spark.createDataFrame([(0, k, 1.0) for k in range(5)], "col int, lev int, v double")
    with pytest.raises(ValueError, match="Hybrid coefficients"):
        vertical.to_pressure(df, coef, spark.createDataFrame([(0, 1e5)], "col int, ps double"), [90000])
    with pytest.raises(ValueError):
        vertical.to_pressure(df, coef, spark.createDataFrame([(1e5,)], "ps double"), [90000])


def test_first_time_of_the_coefficients(spark):
    coef = spark.createDataFrame([(t, k, 0.0, x / 1e5 / (t + 1)) for t in (0, 1) for k, x in enumerate(P)], "time int, lev int, hyam double, hybm double")
    df = spark.createDataFrame([(0, k, x / 1000.0) for k, x in enumerate(P)], "col int, lev int, v double")
    surf = spark.createDataFrame([(0, 1e5)], "col int, ps double")
    assert vertical.to_pressure(df, coef, surf, [90000], interp_type="linear").first().value == pytest.approx(90)


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    p, v = np.sort(rng.uniform(1e4, 1e5, 12))[::-1], rng.normal(size=12)
    targets = rng.uniform(5e3, 1.1e5, 20)
    got = pressures(spark, p.tolist(), v.tolist(), targets.tolist())
    want = np.interp(np.log(targets), np.log(p[::-1]), v[::-1], left=np.nan, right=np.nan)
    assert [got[0, t] for t in targets] == [None if np.isnan(w) else pytest.approx(w) for w in want]


def test_layer_thickness(spark):
    levels = spark.createDataFrame([(200.0,), (500.0,), (900.0,), (1000.0,)], "lev double")
    surf = spark.createDataFrame([(0, 101000.0), (1, 80000.0)], "ncol int, ps double")
    got = {(r.ncol, r.lev): r.dp for r in vertical.layer_thickness(surf, levels).collect()}
    assert [got[0, x] for x in (200.0, 500.0, 900.0, 1000.0)] == [None, 70000.0, 50000.0, 1000.0]
    assert [got[1, x] for x in (200.0, 500.0, 900.0, 1000.0)] == [None, 70000.0, 30000.0, None]


def test_default_levels(spark):
    coef = spark.createDataFrame([(k, 0.0, x / 1e5) for k, x in enumerate(P)], "lev int, hyam double, hybm double")
    df = spark.createDataFrame([(0, k, x / 1000.0) for k, x in enumerate(P)], "col int, lev int, v double")
    out = vertical.to_default_pressure(df, coef, spark.createDataFrame([(0, 1e5)], "col int, ps double"))
    assert out.count() == 28 and out.filter(F.col("plev") == 60000).first().value == pytest.approx(60)
