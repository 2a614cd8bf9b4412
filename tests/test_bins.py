import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fieldspark.operators.bins import Bins, bin_by, bin_fields
from fieldspark.streaming.bins import bin_stream

NAN = float("nan")
ROWS = [(0.0, 1.0, 2.0), (0.5, 3.0, 1.0), (1.0, NAN, 4.0), (1.4999, 5.0, 1.0), (1.5, 7.0, 1.0), (NAN, 9.0, 1.0), (math.inf, 9.0, 1.0), (-math.inf, 9.0, 1.0), (None, 9.0, 1.0), (99.0, 9.0, 1.0)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def cells(spark):
    return spark.createDataFrame(ROWS, "x double, y double, w double")


def test_bin_tables():
    b = Bins.manual(5, 65, 10)
    assert b.centre == (5, 15, 25, 35, 45, 55, 65) and b.bottom[0] == 0 and b.top[-1] == 70 and b.pitch == 10
    assert Bins.manual(0, 10, 4).pitch is None and len(Bins.manual(5, 60, 10).centre) == 6  # 6.5 rounds to even
    e = Bins.explicit([1, 2, 5])
    assert e.centre == (1.5, 3.5) and e.top == (2, 5)
    g = Bins.log(2, 2, 50, 3)
    assert g.centre == (2, 4.5, 8.25) and g.bottom == (1, 3, 6) and g.top == (3, 6, 10.5)
    with pytest.raises(ValueError):
        Bins.of("other")


def test_scalar_mode(spark):
    out = rows_of(bin_by(cells(spark), "y", "x", Bins.manual(0, 3, 1)))
    assert [r[0] for r in out] == [0, 1, 2, 3]
    assert [r[1] for r in out] == [1.0, 4.0, 7.0, None]
    assert [r[3] for r in out] == [1, 3, 1, 0] and sum(r[4] for r in out) == pytest.approx(100)
    assert out[1][2] == pytest.approx(1.0) and out[3][2] is None


def test_weights_count_even_where_y_is_missing(spark):
    out = rows_of(bin_by(cells(spark), "y", "x", Bins.manual(0, 3, 1), weight="w"))
    assert out[1][1] == pytest.approx((3 * 1 + 5 * 1) / (1 + 4 + 1))
    for method, want in (("max", 5.0), ("std", 1.0), ("anything", 8 / 6)):
        assert rows_of(bin_by(cells(spark), "y", "x", Bins.manual(0, 3, 1), weight="w", method=method))[1][1] == pytest.approx(want)


def test_empty_total_has_no_percentage(spark):
    out = rows_of(bin_by(cells(spark).filter("false"), "y", "x", Bins.manual(0, 1, 1)))
    assert [(r[3], r[4]) for r in out] == [(0, None)] * 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-5, 50, allow_nan=False), min_size=1, max_size=40), st.sampled_from([(0, 9, 1), (0.1, 3.1, 0.3), (0, 10, 4), (0, 48, 13)]))
def test_every_path_agrees_with_the_edges(spark, xs, spec):
    bins = Bins.manual(*spec)
    got = {r[0]: r[3] for r in rows_of(bin_by(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "x", bins))}
    assert got == {c: sum(a <= x < b for x in xs) for c, a, b in zip(bins.centre, bins.bottom, bins.top)}


def test_levels_and_times(spark):
    rows = [(t, lev, c, 0.2 if c < 2 else 1.2, float(10 * lev + t + c), 1.0 + c) for t in (0, 1) for lev in (1, 2) for c in range(4)]
    df = spark.createDataFrame(rows, "time int, lev int, ncol int, x double, y double, w double")
    bins = Bins.manual(0, 2, 1)
    by_lev = {(r.bin, r.lev): r for r in bin_by(df, "y", "x", bins, keep_lev="lev", keep_time="time").collect()}
    assert len(by_lev) == 6 and by_lev[0.0, 1].bin_val == pytest.approx(11) and by_lev[0.0, 1].bin_cnt == 4 and by_lev[2.0, 2].bin_cnt == 0
    weighted = {(r.bin, r.lev): r for r in bin_by(df, "y", "x", bins, weight="w", keep_lev="lev", time="time").collect()}
    assert weighted[0.0, 1].bin_val == pytest.approx(((10 * 1 + 11 * 2) / 3 + (11 * 1 + 12 * 2) / 3) / 2)
    by_time = {(r.bin, r.time): r for r in bin_by(df, "y", "x", bins, weight="w", keep_time="time").collect()}
    assert by_time[0.0, 1].bin_cnt == 8 and by_time[0.0, 1].bin_std is None and by_time[2.0, 0].bin_val is None
    one = bin_by(df.filter("lev = 1"), "y", "x", bins, keep_lev="lev")
    assert "lev" not in one.columns


def test_fields_in_tables_of_their_own(spark):
    df = spark.createDataFrame([(k, 0.1 * k, float(k), 1.0) for k in range(10)], "ncol int, x double, y double, w double")
    apart = bin_fields(df.select("ncol", "y"), df.select("ncol", "x"), "y", "x", Bins.manual(0, 1, 1), wgt=df.select("ncol", "w"), weight="w")
    assert rows_of(apart) == rows_of(bin_by(df, "y", "x", Bins.manual(0, 1, 1), weight="w"))


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(float(k % 10), float(k)) for k in range(100)], "x double, y double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bins = Bins.manual(1, 9, 2)
    q = bin_stream(stream, "y", "x", bins).writeStream.outputMode("complete").format("memory").queryName("binned").start()
    q.processAllAvailable()
    q.stop()
    got = {r.bin: (r.bin_val, r.bin_cnt) for r in spark.table("binned").collect()}
    want = {r.bin: (r.bin_val, r.bin_cnt) for r in bin_by(df, "y", "x", bins).filter(F.col("bin_cnt") > 0).collect()}
    assert got == want
