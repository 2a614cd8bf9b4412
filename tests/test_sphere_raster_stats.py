import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldspark.functions import geodesy, moist
from fieldspark.functions.columns import ieee_div, safe_ln
from fieldspark.operators import lanczos, raster, sphere, stats
from fieldspark.plans import catalogue

NAN = float("nan")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("lon,want", [(0, 0), (-90, -90), (90, 90), (360, 0), (270, -90), (-270, 90), (180, -180), (-180, -180), (-1, -1), (-361, -1)])
def test_longitudes(spark, lon, want):
    assert one(spark, geodesy.lon_to_180(F.lit(float(lon)))) == want


@settings(max_examples=15, deadline=None)
@given(st.floats(-2000, 2000))
def test_longitudes_stay_in_range(spark, lon):
    got = one(spark, geodesy.lon_to_180(F.lit(lon)))
    assert got == (lon + 180.0) % 360.0 - 180.0 if lon >= -180 else -180 <= got <= 180


def test_accessor(spark, capsys):
    df = spark.createDataFrame([(270.0, 1), (90.0, 2), (0.0, 3)], "lon double, v int")
    assert [r.v for r in sphere.wrap_longitude(df, sort_dim=True).collect()] == [1, 3, 2]
    assert sphere.wrap_longitude(df, "longitude") is None and "WARNING" in capsys.readouterr().out


def test_radius_and_distances(spark):
    r = lambda lat: one(spark, geodesy.earth_radius(F.lit(float(lat))))
    assert r(0) == pytest.approx(6378137) and r(90) == pytest.approx(6356752.3142) and r(45) == r(-45) and r(0) > r(30) > r(60) > r(90)
    gc = lambda *a: one(spark, geodesy.great_circle(*[F.lit(float(x)) for x in a]))
    assert gc(10, 10, 20, 20) == pytest.approx(0, abs=1e-7) and gc(90, -90, 0, 0) == pytest.approx(math.pi) and gc(0, 0, 0, 90) == pytest.approx(math.pi / 2)
    assert gc(0, 0, 0, 1) == pytest.approx(math.radians(1), rel=1e-5) and gc(10, 50, 20, -70) == pytest.approx(gc(50, 10, -70, 20)) and math.isnan(gc(NAN, 0, 0, 0))
    assert one(spark, geodesy.haversine(*[F.lit(x) for x in (20.0, 10.0, -70.0, 50.0)])) == pytest.approx(math.degrees(gc(10, 50, 20, -70)))
    lon, lat = geodesy.orthographic_inverse(F.lit(0.5), F.lit(0.0), 10.0, 0.0)
    assert one(spark, lon) == pytest.approx(40) and one(spark, lat) == pytest.approx(0)
    assert math.isnan(one(spark, geodesy.orthographic_inverse(F.lit(1.5), F.lit(0.0), 0.0, 0.0)[0]))


def test_robinson(spark):
    at = lambda x, y: tuple(one(spark, c) for c in geodesy.robinson_inverse(F.lit(x), F.lit(y), 10.0))
    assert at(0.0, 0.0) == (10, 0) and at(0.8487 * math.pi, 0.0) == pytest.approx((190, 0))
    assert at(0.8487 * 0.8962 * math.radians(60), -1.3523 * 0.5571) == pytest.approx((70, -45)) and at(0.0, 1.3523)[1] == pytest.approx(90)
    assert all(map(math.isnan, at(0.0, 1.4))) and all(map(math.isnan, at(2.5, 1.3)))


def test_ieee(spark):
    div = lambda n, d: one(spark, ieee_div(F.lit(float(n)), F.lit(float(d))))
    assert div(1, 0) == math.inf and div(-1, 0) == -math.inf and math.isnan(div(0, 0)) and div(1, 4) == 0.25
    assert one(spark, safe_ln(F.lit(0.0))) == -math.inf and math.isnan(one(spark, safe_ln(F.lit(-1.0))))


def test_moisture(spark):
    c = 300 - 273.0
    ew = 6.1121 * (1.0007 + 3.46e-6 * 900) * math.exp(17.502 * c / (240.97 + c))
    assert one(spark, moist.qsat_buck(F.lit(300.0), F.lit(900.0))) == pytest.approx(0.62197 * ew / (900 - 0.378 * ew))
    assert one(spark, moist.qsat_peters(F.lit(300.0), F.lit(90000.0))) == pytest.approx(380 / 90000 * math.exp(17.27 * 27 / 264))


def test_neighbors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 300))), rng.uniform(-180, 360, 300)
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))], "ncol long, lat double, lon double")
    a, b = np.radians(lat), np.radians(lon)
    d = np.arccos(np.clip(np.sin(a)[:, None] * np.sin(a) + np.cos(a)[:, None] * np.cos(a) * np.cos(b[:, None] - b), -1, 1))
    np.fill_diagonal(d, -1)
    got = {(r.ncol, r["rank"]): r.neighbor_id for r in sphere.nearest_neighbors(points, 5).collect()}
    assert got == {(k, r): int(i) for k in range(300) for r, i in enumerate(np.argsort(d[k], kind="stable")[:6])}
    four = spark.createDataFrame([(k, 0.0, x) for k, x in enumerate((0.0, 90.0, 180.0, 270.0))], "ncol long, lat double, lon double")
    assert [r.neighbor_id for r in sphere.nearest_neighbors(four, 1, include_self=False).filter("ncol = 0").collect()] == [1]
    assert sphere.nearest_neighbors(four, 9).count() == 16


def test_areas(spark):
    lat = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 30.0), (2, 30.0, 31.0)], "j int, b0 double, b1 double")
    lon = spark.createDataFrame([(0, 0.0, 5.0), (1, 5.0, 25.0)], "i int, b0 double, b1 double")
    m = 6.37122e6 * math.pi / 180
    old = {(r.j, r.i): r.area for r in sphere.cell_area(lat, lon).collect()}
    assert old[0, 1] == pytest.approx(50 * m * m) and old[1, 0] == pytest.approx(400 * m * m) and old[2, 0] is None
    new = {(r.j, r.i): r.area for r in sphere.cell_area(lat, lon, compat=False).collect()}
    assert new[0, 1] == pytest.approx(200 * m * m * math.cos(math.radians(5)))


def test_raster(spark, capsys):
    cells = [(k, float(lon % 360), float(lat), float(k)) for k, (lat, lon) in enumerate((a, b) for a in sorted(range(-80, 81, 10), key=abs) for b in range(-180, 180, 10))]
    data = spark.createDataFrame(cells + [(9000, NAN, 0.0, 1.0), (9001, 0.0, 0.0, NAN)], "ncol long, lon double, lat double, value double")
    spots = [(0, 14.0, 11.0), (1, -179.0, 52.0), (2, 100.0, 84.0), (3, 178.0, 71.0), (4, NAN, 0.0), (5, 374.0, 11.0)]
    query = spark.createDataFrame(spots, "c int, lon double, lat double")
    near = {r.c: r.value for r in raster.to_raster(data, query, key=("c",)).collect()}
    at = lambda lat, lon: float(next(k for k, x, y, _ in cells if y == lat and (x - lon) % 360 == 0))
    assert near == {0: at(10, 10), 1: at(50, -170), 2: at(80, 100), 3: at(70, 180), 4: None, 5: at(10, 10)}
    idw = {r.c: r.value for r in raster.to_raster(data, query, key=("c",), method="linear").collect()}
    w = [1 / (math.hypot(x - 14, y - 11) + 1e-10) for x, y in ((10, 10), (20, 10), (10, 20), (20, 20))]
    v = [at(10, 10), at(10, 20), at(20, 10), at(20, 20)]
    assert idw[0] == pytest.approx(sum(a * b for a, b in zip(w, v)) / sum(w)) and idw[2] != near[2]
    masked = {r.c: r.value for r in raster.to_raster(data, query, key=("c",), mask_value=at(10, 10)).collect()}
    assert masked[0] == at(10, 20)
    far = raster.to_raster(data.filter("lat > 70"), spark.createDataFrame([(0, 0.0, -50.0)], "c int, lon double, lat double"), key=("c",))
    assert far.first().value is None
    with pytest.raises(ValueError):
        raster.to_raster(data, query, key=("c",), method="cubic")
    with pytest.raises(ValueError):
        raster.to_raster(data.filter("false"), query, key=("c",))
    spec = raster.RasterSpec.of((-180, 180, -90, 90), 5, 40, projection="mollweide")
    assert raster.pixels(spark, spec).count() == 400 and "WARNING" in capsys.readouterr().out


def test_lanczos(spark):
    def numpy_weights(length, lp, hp):
        n = (length - 1) // 2 + 1
        k = np.arange(1, n)
        side = (np.sin(2 * np.pi * lp * k) - np.sin(2 * np.pi * hp * k)) / (np.pi * k) * np.sinc(k / n)
        return [*side[::-1], 2 * (lp - hp), *side]

    for length in (1, 2, 10, 11):
        got = [r.w for r in lanczos.weights(spark, length, 0.1, 0.02).orderBy("k").collect()]
        assert got == pytest.approx(numpy_weights(length, 0.1, 0.02)) and len(got) == (length if length % 2 else length - 1)
    series = spark.createDataFrame([(k, float(k)) for k in range(6)], "t int, v double")
    assert [r.filtered for r in lanczos.apply(series, [0.25, 0.5, 0.25], "v", "t").orderBy("t").collect()] == [None, 1, 2, 3, 4, None]


def test_filter_of_a_long_series_in_chunks(spark):
    w = [0.1, 0.2, 0.4, 0.2, 0.1]
    values = [None if k in (40, 41) else float(k * k % 97) for k in range(500)]
    series = spark.createDataFrame([(3 * k, v) for k, v in enumerate(values)], "t int, v double").repartition(3)
    want = [None if k < 2 or k > 497 or None in values[k - 2 : k + 3] else sum(a * b for a, b in zip(w, values[k - 2 : k + 3])) for k in range(500)]
    for chunk in (1000, 60, 1):  # one window, chunks, and chunks shorter than the window's reach
        out = lanczos.apply(series, w, "v", "t", chunk=chunk)
        assert out.columns == ["t", "v", "filtered"]
        got = [r.filtered for r in out.orderBy("t").collect()]
        assert [g is None for g in got] == [x is None for x in want]
        assert [g for g in got if g is not None] == pytest.approx([x for x in want if x is not None])


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", NAN), ("a", 4.0), ("b", 7.0), ("b", None)], "g string, v double")
    s = stats.summary(df, ["v"]).first()
    assert (s.n, s.avg, s.min, s.max) == (3, 4, 1, 7) and s.std == pytest.approx(math.sqrt(6))
    assert stats.summary_text(df, "v", "x", "m") == "  x            [m]   avg: 4.0000   min: 1.0000   max: 7.0000   shp: (5,)".replace("   avg: 4.0000   min: 1.0000", "   min: 1.0000   avg: 4.0000")
    assert stats.summary_text(df, "v", stat="s", compact=False).count("\n") == 2
    assert {r.g: r.median for r in stats.median(df, "v", ["g"]).collect()} == {"a": 2.5, "b": 7}
    assert all(math.isnan(r.median) for r in stats.median(df, "v", ["g"], skipna=False).collect())


def test_median_of_large_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"odd": rng.normal(size=4001), "even": rng.normal(size=5000), "ties": rng.integers(0, 3, 3000), "one": np.array([7.0]), "two": np.array([1.0, 4.0]), None: rng.uniform(size=100)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("odd", NAN), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for few in (0, 100):
        got = {r.g: r.median for r in stats.median_of_large_groups(df, "v", ["g"], few=few).collect()}
        assert got == {g: float(np.median(x)) for g, x in groups.items()} | {"none": None}
    assert stats.median_of_large_groups(df, "v").first().median == float(np.median(np.concatenate(list(groups.values()))))


def test_t_statistic(spark):
    rows = [(1.0, 2.0, 1.0, 1.0, 4, 4), (1.0, 2.0, 0.0, 0.0, 4, 4), (1.0, 1.0, 0.0, 0.0, 4, 4), (0.0, 0.1, 1.0, 1.0, 4, 4)]
    df = spark.createDataFrame(rows, "d0 double, d1 double, s0 double, s1 double, n0 int, n1 int").withColumn("t_stat", stats.t_stat("d0", "d1", "s0", "s1", "n0", "n1"))
    t = [r.t_stat for r in df.collect()]
    assert t[0] == pytest.approx(math.sqrt(2)) and t[1] == math.inf and math.isnan(t[2])
    assert tuple(stats.significance(df, t_crit=1.0).first()) == (2, 4, 50.0)


def test_t_stat_query_keeps_every_user(spark, tmp_path):
    halves = {1: ([1.0, 2.0], [3.0, 5.0]), 2: ([1.0], [2.0]), 3: ([2.0, 2.0], [1.0]), 4: ([7.0], [7.0])}
    rows = [(u, dt.datetime(2024, 1, 3 + 20 * h, k), v) for u, both in halves.items() for h, vs in enumerate(both) for k, v in enumerate(vs)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.t_stat for r in catalogue.QUERIES["t_stat"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1] == pytest.approx(2.5 / math.sqrt(0.125 + 0.5), abs=1e-6)
    assert got[2] == math.inf and got[3] == -math.inf and math.isnan(got[4])


def test_audit(spark, capsys):
    df = spark.createDataFrame([(1.0,), (NAN,), (math.inf,), (-math.inf,), (None,), (5.0,), (9.0,)], "v double")
    r = stats.validity(df, ["v", "w"], check_range={"v": (1.0, 8.0)}).collect()
    assert [tuple(x)[:6] for x in r] == [("v", 7, 2, 2, 1, 2)] and (r[0].actual_min, r[0].actual_max) == (1, 9) and "WARNING" in capsys.readouterr().out
    assert stats.validity(df, check_nan=False).first().valid == 5
    assert stats.validity(df.filter("false"), ["v"]).first().valid_percentage is None


def test_extent(spark):
    at = lambda *days: spark.createDataFrame([(dt.datetime(2001, 1, 1) + dt.timedelta(days=d), dt.datetime(2001, 1, 1) + dt.timedelta(days=d - 1), dt.datetime(2001, 1, 1) + dt.timedelta(days=d)) for d in days], "time timestamp, b0 timestamp, b1 timestamp")
    head = "    Time span   : "
    assert stats.time_extent_text(at(*range(365))) == head + "365 days  /  11 months"
    assert stats.time_extent_text(at(*range(731))) == head + "731 days  /  24 months  /  2 years"
    assert stats.time_extent_text(at(1, 11), bounds=("b0", "b1")) == head + "11 days  (from time_bnds)"
    assert stats.time_extent_text(at(1), bounds=("b0", "b1")) == head + "1 days  (single period, from time_bnds)"
    assert stats.time_extent_text(at(1)) == head + "single time value, no bounds available"
    assert stats.time_extent_text(at(1).drop("time"), color="\033[91m") == "\033[91m" + head + "no time dimension\033[0m"


def test_neighbors_in_clusters_and_far_away(spark):
    """Crowded places, one place with many points, lonely points, and points without a place."""
    rng = np.random.default_rng(8)
    lat = np.concatenate([40 + rng.normal(0, 1e-3, 1500), -20 + rng.normal(0, 0.5, 300), np.full(400, 10.0), rng.uniform(-80, 80, 40)])
    lon = np.concatenate([100 + rng.normal(0, 1e-3, 1500), 30 + rng.normal(0, 0.5, 300), np.full(400, 10.0), rng.uniform(-180, 180, 40)])
    n = len(lat)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon))] + [(n, None, 1.0), (n + 1, NAN, 1.0), (n + 2, 1.0, math.inf)]
    points = spark.createDataFrame(rows, "ncol long, lat double, lon double").repartition(3)
    a, b = np.radians(lat), np.radians(lon)
    got: dict = {}
    for r in sphere.nearest_neighbors(points, 3, include_self=False).collect():
        got.setdefault(r.ncol, []).append((r["rank"], r.neighbor_id, r.neighbor_dist))
    assert set(got) == set(range(n))
    for k in range(n):
        d = np.arccos(np.clip(np.sin(a[k]) * np.sin(a) + np.cos(a[k]) * np.cos(a) * np.cos(b - b[k]), -1, 1))
        d[k] = 9
        found = sorted(got[k])
        assert [r for r, _, _ in found] == [1, 2, 3]
        assert [x for _, _, x in found] == pytest.approx(np.sort(d)[:3].tolist(), abs=5e-8)
    assert [i for _, i, _ in sorted(got[1801])] == [1800, 1802, 1803]


def test_queries_far_from_all_points(spark):
    rng = np.random.default_rng(9)
    grid = [(k, float(x), float(y), float(k)) for k, (x, y) in enumerate(rng.normal(0, 0.01, (700, 2)) + [170, 50])]
    spots = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-59, 59, (50, 2)) - [100, 0])]
    cells = spark.createDataFrame(grid, "ncol long, glon double, glat double, value double")
    query = spark.createDataFrame(spots, "c long, lon double, lat double")
    got = {}
    for r in raster.nearest_cells(query, cells, 4, ["c"], use_spherical=False).collect():
        got[r.c, r["rank"]] = r.ncol
    for k, x, y in spots:
        order = sorted(grid, key=lambda g: (round(math.hypot(x - g[1], y - g[2]), 9), g[0]))[:4]
        assert [got[k, r] for r in (1, 2, 3, 4)] == [g[0] for g in order]
