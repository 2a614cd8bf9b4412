"""The queries over the driver's tables, by name, and their oracles in DuckDB SQL.

The tables hold no fields, so columns of theirs stand in: line items are cells (price by quantity, weighted by discount, on
line numbers as levels and months as times), orders are columns of levels, suppliers are grid cells and customers pixels.
Doubles are rounded on both sides, as sums depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants, geodesy, moist
from ..functions.columns import NAN, unfilled
from ..functions.constants import plev_default
from ..operators import lanczos, raster, sphere, stats, vertical
from ..operators.bins import Bins, bin_by, bin_by_two, bin_fields
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def nudge(digits: int) -> float:
    """Added before rounding on both sides, so that values half-way between two rounded ones don't depend on the order of a sum."""
    return 3e-3 * 10.0**-digits


def expanded(sql: str) -> str:
    """sql with each rnd(x, digits) as the rounding of x nudged."""
    while (a := sql.rfind("rnd(")) >= 0:
        depth, comma, k = 1, 0, a + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            comma = k if sql[k] == "," and depth == 1 else comma
            k += 1
        digits = sql[comma + 1 : k - 1].strip()
        sql = f"{sql[:a]}round(({sql[a + 4 : comma]}) + {nudge(int(digits))!r}, {digits}){sql[k:]}"
    return sql


def query(sql: str, digits: int = 4):
    """Registers a query under its name, with its doubles rounded, and its SQL."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + nudge(digits), digits) for c, t in df.dtypes if t == "double"})

        run.__doc__ = f.__doc__
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, expanded(sql)
        return f

    return put


def values(bins: Bins) -> str:
    return ", ".join(f"({c!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for c, a, b in zip(bins.centre, bins.bottom, bins.top))


def bin_sql(bins: Bins, value: str) -> str:
    return f"""
WITH bins(bin, bottom, top) AS (VALUES {values(bins)}),
agg AS (
  SELECT bin, {value} AS v, stddev_pop(l_extendedprice) AS s, count(l_quantity) AS n
  FROM bins LEFT JOIN lineitem ON l_quantity >= bottom AND l_quantity < top GROUP BY bin)
SELECT rnd(bin, 4) AS bin, rnd(v, 4) AS bin_val, rnd(s, 4) AS bin_std, n AS bin_cnt, rnd(n * 1e2 / sum(n) OVER (), 4) AS bin_pct FROM agg"""


CELLS = ("l_extendedprice", "l_quantity")
EVEN = Bins.manual(5, 65, 10)  # the last is empty
GAPS = Bins.manual(5, 60, 10)
OVERLAPS = Bins.manual(0, 48, 13)
EDGES = Bins.explicit([1, 2, 3, 5, 8, 13, 21, 34])
WIDER = Bins.log(2, 2, 50, 6)
MEAN = "avg(l_extendedprice)"


@query(bin_sql(EVEN, MEAN))
def bin_manual_mean(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EVEN)


@query(bin_sql(EVEN, "sum(l_extendedprice * l_discount) / nullif(sum(l_discount), 0)"))
def bin_weighted_mean(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EVEN, weight="l_discount")


@query(bin_sql(EVEN, "max(l_extendedprice)"))
def bin_max(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EVEN, method="max")


@query(bin_sql(EVEN, "stddev_pop(l_extendedprice)"))
def bin_std(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EVEN, method="std")


@query(bin_sql(GAPS, MEAN))
def bin_manual_gaps(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, GAPS)


@query(bin_sql(OVERLAPS, MEAN))
def bin_manual_overlaps(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, OVERLAPS)


@query(bin_sql(EDGES, MEAN))
def bin_explicit(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EDGES)


@query(bin_sql(WIDER, MEAN))
def bin_log(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, WIDER)


LEV_GRID = f"""
WITH bins(bin, bottom, top) AS (VALUES {values(EVEN)}),
levs AS (SELECT DISTINCT l_linenumber AS lev FROM lineitem),
cells AS (
  SELECT bin, l_linenumber AS lev, month(l_shipdate) AS t, l_discount AS w,
    CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END AS v
  FROM bins JOIN lineitem ON l_quantity >= bottom AND l_quantity < top),
"""
LEV_END = """
SELECT rnd(b.bin, 4) AS bin, l.lev, rnd(v, 4) AS bin_val, rnd(s, 4) AS bin_std, coalesce(n, 0) AS bin_cnt,
  rnd(coalesce(n, 0) * 1e2 / sum(coalesce(n, 0)) OVER (), 4) AS bin_pct
FROM bins b CROSS JOIN levs l LEFT JOIN agg ON agg.bin = b.bin AND agg.lev = l.lev"""


def some_missing(spark, sf) -> DataFrame:
    """Line items whose price is NaN in every tenth order."""
    return table(spark, sf, "lineitem").withColumn("price", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_extendedprice")).otherwise(NAN))


@query(LEV_GRID + "agg AS (SELECT bin, lev, avg(v) AS v, stddev_pop(v) AS s, count(v) AS n FROM cells GROUP BY bin, lev)" + LEV_END)
def bin_keep_lev(spark, sf):
    return bin_by(some_missing(spark, sf), "price", "l_quantity", EVEN, keep_lev="l_linenumber")


@query(
    LEV_GRID + """ratios AS (SELECT bin, lev, t, coalesce(sum(v * w), 0) / nullif(sum(w), 0) AS r FROM cells GROUP BY bin, lev, t),
means AS (SELECT bin, lev, avg(r) AS v FROM ratios GROUP BY bin, lev),
rest AS (SELECT bin, lev, stddev_pop(v) AS s, count(v) AS n FROM cells GROUP BY bin, lev),
agg AS (SELECT m.bin, m.lev, m.v, s, n FROM means m JOIN rest r ON m.bin = r.bin AND m.lev = r.lev)""" + LEV_END
)
def bin_keep_lev_weighted(spark, sf):
    return bin_by(some_missing(spark, sf), "price", "l_quantity", EVEN, weight="l_discount", keep_lev="l_linenumber", time=F.month("l_shipdate"))


@query(f"""
WITH bins(bin, bottom, top) AS (VALUES {values(EVEN)}),
times AS (SELECT DISTINCT month(l_shipdate) AS time FROM lineitem),
cells AS (SELECT bin, month(l_shipdate) AS time, l_extendedprice AS v, l_discount AS w FROM bins JOIN lineitem ON l_quantity >= bottom AND l_quantity < top),
agg AS (SELECT bin, time, coalesce(sum(v * w), 0) / nullif(sum(w), 0) AS v FROM cells GROUP BY bin, time),
total AS (SELECT bin, count(*) AS n FROM cells GROUP BY bin)
SELECT rnd(b.bin, 4) AS bin, CAST(t.time AS INTEGER) AS time, rnd(v, 4) AS bin_val, CAST(NULL AS DOUBLE) AS bin_std, coalesce(n, 0) AS bin_cnt,
  rnd(coalesce(n, 0) * 1e2 / sum(coalesce(n, 0)) OVER (), 4) AS bin_pct
FROM bins b CROSS JOIN times t LEFT JOIN agg ON agg.bin = b.bin AND agg.time = t.time LEFT JOIN total ON total.bin = b.bin""")
def bin_keep_time(spark, sf):
    return bin_by(table(spark, sf, "lineitem"), *CELLS, EVEN, weight="l_discount", keep_time=F.month("l_shipdate"))


@query(f"""
WITH by_(bin, bottom, top) AS (VALUES {values(Bins.manual(1, 7, 2))}), bx(bin, bottom, top) AS (VALUES {values(EVEN)})
SELECT rnd(by_.bin, 4) AS bin_y, rnd(bx.bin, 4) AS bin_x, rnd(avg(l_extendedprice), 4) AS bin_val, rnd(stddev_pop(l_extendedprice), 4) AS bin_std, count(*) AS bin_cnt
FROM lineitem JOIN by_ ON l_linenumber >= by_.bottom AND l_linenumber < by_.top JOIN bx ON l_quantity >= bx.bottom AND l_quantity < bx.top
GROUP BY by_.bin, bx.bin""")
def bin_two_variables(spark, sf):
    return bin_by_two(table(spark, sf, "lineitem"), "l_extendedprice", "l_linenumber", "l_quantity", Bins.manual(1, 7, 2), EVEN)


@query(f"""
WITH bins(bin, bottom, top) AS (VALUES {values(EVEN)}),
y AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem WHERE l_orderkey % 3 <> 0),
x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_orderkey % 5 <> 0),
w AS (SELECT l_linenumber, l_linenumber * 5e-1 AS w FROM lineitem GROUP BY l_linenumber),
cells AS (SELECT v, q, w FROM y JOIN x USING (l_orderkey, l_linenumber) JOIN w USING (l_linenumber)),
agg AS (SELECT bin, sum(v * w) / nullif(sum(w), 0) AS v, stddev_pop(v) AS s, count(q) AS n FROM bins LEFT JOIN cells ON q >= bottom AND q < top GROUP BY bin)
SELECT rnd(bin, 4) AS bin, rnd(v, 4) AS bin_val, rnd(s, 4) AS bin_std, n AS bin_cnt, rnd(n * 1e2 / sum(n) OVER (), 4) AS bin_pct FROM agg""")
def bin_separate_fields(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    vy, vx = lines.filter("l_orderkey % 3 <> 0").drop("l_quantity"), lines.filter("l_orderkey % 5 <> 0").drop("l_extendedprice")
    weights = lines.select("l_linenumber", (F.col("l_linenumber") * 0.5).alias("w")).distinct()
    return bin_fields(vy, vx, *CELLS, EVEN, wgt=weights, weight="w")


PIXELS = "(SELECT c_custkey AS c, ((c_custkey * 97) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 53) % 181 - 90)::DOUBLE AS lat FROM customer)"
GRID = "(SELECT s_suppkey AS ncol, ((s_suppkey * 137) % 360)::DOUBLE AS lon, ((s_suppkey * 71) % 181 - 90)::DOUBLE AS lat, s_acctbal AS value FROM supplier)"
COS = "sin(radians(lat)) * sin(radians({lat})) + cos(radians(lat)) * cos(radians({lat})) * cos(radians({lon} - lon))"


def customers(spark, sf) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("c"), ((c * 97) % 360 - 180).cast("double").alias("lon"), ((c * 53) % 181 - 90).cast("double").alias("lat"))


def suppliers(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("ncol"), ((s * 137) % 360).cast("double").alias("lon"), ((s * 71) % 181 - 90).cast("double").alias("lat"), F.col("s_acctbal").alias("value"))


@query(f"SELECT ncol, rnd(lon - CASE WHEN lon >= 180 THEN 360 ELSE 0 END, 4) AS lon FROM {GRID}")
def lon_wrap(spark, sf):
    return sphere.wrap_longitude(suppliers(spark, sf).select("ncol", "lon"))


@query(f"""
SELECT ncol, rnd(6378137e0 * sqrt(1 - e) / sqrt(1 - e * cos(atan((1 - e) * tan(radians(lat)))) * cos(atan((1 - e) * tan(radians(lat))))), 4) AS radius
FROM {GRID}, (SELECT 1 - (6356752.3142e0 * 6356752.3142e0) / (6378137e0 * 6378137e0) AS e)""")
def earth_radius(spark, sf):
    return suppliers(spark, sf).select("ncol", geodesy.earth_radius("lat").alias("radius"))


@query(f"SELECT c, rnd(acos(greatest(-1, least(1, {COS.format(lat='40e0', lon='-105e0')}))), 7) AS distance FROM {PIXELS}", 7)
def gc_distance(spark, sf):
    return customers(spark, sf).select("c", geodesy.great_circle("lat", F.lit(40.0), "lon", F.lit(-105.0)).alias("distance"))


HAV = "degrees(2 * asin(sqrt(greatest(0, least(1, sin(radians({b} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) ** 2)))))"


@query(f"SELECT c, rnd({HAV.format(a='lat', b='40e0', c='lon', d='-105e0')}, 6) AS distance FROM {PIXELS}", 6)
def haversine(spark, sf):
    return customers(spark, sf).select("c", geodesy.haversine("lon", "lat", F.lit(-105.0), F.lit(40.0)).alias("distance"))


AIR = "(SELECT s_suppkey AS k, 200e0 + (s_suppkey * 7) % 110 AS ta, 100e0 + (s_suppkey * 37) % 900 AS pa FROM supplier)"


def air(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(s.alias("k"), (200.0 + (s * 7) % 110).alias("ta"), (100.0 + (s * 37) % 900).alias("pa"))


@query(f"""
SELECT k, rnd(62.197e-2 * (ew / (pa - 378e-3 * ew)), 9) AS qsat
FROM (SELECT k, pa, 6.1121e0 * (1.0007e0 + 3.46e-6 * pa) * exp(17.502e0 * (ta - 273) / (240.97e0 + ta - 273)) AS ew FROM {AIR})""", 9)
def qsat_buck(spark, sf):
    return air(spark, sf).select("k", moist.qsat_buck("ta", "pa").alias("qsat"))


@query(f"SELECT k, rnd(380e0 / pa * exp(17.27e0 * (ta - 273) / (ta - 36)), 7) AS qsat FROM {AIR}", 7)
def qsat_peters(spark, sf):
    return air(spark, sf).select("k", moist.qsat_peters("ta", "pa").alias("qsat"))


@query("""
SELECT o_orderkey AS col, lev, rnd((0e0 * 100000 + (1 - (lev - 1) / 8e0) * (100000 + o_orderkey % 1000)), 4) AS p
FROM orders CROSS JOIN (SELECT unnest(range(1, 8)) AS lev)""")
def hybrid_pressure(spark, sf):
    surf = table(spark, sf, "orders").select(F.col("o_orderkey").alias("col"), (100000.0 + F.col("o_orderkey") % 1000).alias("ps"))
    return surf.crossJoin(F.broadcast(coefficients(spark))).select("col", "lev", moist.hybrid_pressure("hyam", "hybm", "ps").alias("p"))


@query("""
SELECT j, i, rnd((6.37122e6 * abs(CAST(20e0 AS DOUBLE)) * pi() / 180) * (6.37122e6 * (10e0 + j) * pi() / 180) / 1e6, 2) AS area
FROM (SELECT unnest(range(0, 9)) AS j) CROSS JOIN (SELECT unnest(range(0, 12)) AS i)""", 2)
def cell_area(spark, sf):
    lat = spark.range(9).select(F.col("id").alias("j"), F.lit(-5.0).alias("b0"), (5.0 + F.col("id")).alias("b1"))
    lon = spark.range(12).select(F.col("id").alias("i"), F.lit(0.0).alias("b0"), F.lit(20.0).alias("b1"))
    return sphere.cell_area(lat, lon).select("j", "i", (F.col("area") / 1e6).alias("area"))


@query("""
SELECT j, i, rnd((6.37122e6 * 20e0 * pi() / 180) * (6.37122e6 * (10e0 + j) * pi() / 180) * cos(radians(j / 2e0)) / 1e6, 2) AS area
FROM (SELECT unnest(range(0, 9)) AS j) CROSS JOIN (SELECT unnest(range(0, 12)) AS i)""", 2)
def cell_area_cosine(spark, sf):
    lat = spark.range(9).select(F.col("id").alias("j"), F.lit(-5.0).alias("b0"), (5.0 + F.col("id")).alias("b1"))
    lon = spark.range(12).select(F.col("id").alias("i"), F.lit(0.0).alias("b0"), F.lit(20.0).alias("b1"))
    return sphere.cell_area(lat, lon, compat=False).select("j", "i", (F.col("area") / 1e6).alias("area"))


@query("""
SELECT k, rnd(CASE WHEN k = 0 THEN 2 * (0.1e0 - 0.02e0)
  ELSE (sin(2 * pi() * 0.1e0 * k) - sin(2 * pi() * 0.02e0 * k)) / (pi() * k) * (sin(pi() * k / 6) * 6 / (pi() * k)) END, 9) AS w
FROM (SELECT unnest(range(-5, 6)) AS k)""", 9)
def lanczos_weights(spark, sf):
    return lanczos.weights(spark, 11, 0.1, 0.02)


#: Weights of three neighbours.
THREE = [0.25, 0.5, 0.25]


@query("""
WITH days AS (SELECT user_id % 8 AS k, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT k, epoch(day) / 86400 AS day, CASE WHEN lag(v) OVER w IS NOT NULL AND lead(v) OVER w IS NOT NULL THEN rnd(25e-2 * lag(v) OVER w + 5e-1 * v + 25e-2 * lead(v) OVER w, 4) END AS filtered
FROM days WINDOW w AS (PARTITION BY k ORDER BY day)""")
def filtered_series(spark, sf):
    days = table(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("k"), F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return lanczos.apply(days, THREE, "v", "day", ("k",)).select("k", F.unix_date("day").cast("double").alias("day"), "filtered")


HALVES = """
SELECT user_id, avg(value) FILTER (h = 0) AS d0, avg(value) FILTER (h = 1) AS d1, stddev_pop(value) FILTER (h = 0) AS s0, stddev_pop(value) FILTER (h = 1) AS s1,
  count(*) FILTER (h = 0) AS n0, count(*) FILTER (h = 1) AS n1
FROM (SELECT user_id, CASE WHEN user_id % 41 <> 0 THEN value WHEN day(ts) <= 15 THEN 0e0 ELSE user_id % 3 - 1e0 END AS value, CASE WHEN day(ts) <= 15 THEN 0 ELSE 1 END AS h FROM events) GROUP BY user_id HAVING n0 > 0 AND n1 > 0"""
ERRORS = f"SELECT user_id, s0 * s0 / n0 + s1 * s1 / n1 AS e, d1 - d0 AS d FROM ({HALVES})"
T_SQL = f"SELECT *, CASE WHEN e > 0 THEN d / sqrt(e) WHEN d > 0 THEN 'inf'::DOUBLE WHEN d < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS t FROM ({ERRORS})"


def t_values(spark, sf) -> DataFrame:
    """Statistics of the halves of months; every 41st user has the same value all through each half."""
    h, user = F.dayofmonth("ts") <= 15, F.col("user_id")
    value = F.when(user % 41 != 0, F.col("value")).when(h, 0.0).otherwise(user % 3 - 1.0)
    sides = [f(F.when(on, value)).alias(f"{n}{k}") for k, on in ((0, h), (1, ~h)) for n, f in (("d", F.avg), ("s", F.stddev_pop), ("n", F.count))]
    both = table(spark, sf, "events").groupBy("user_id").agg(*sides).filter("n0 > 0 and n1 > 0")
    return both.select("user_id", stats.t_stat("d0", "d1", "s0", "s1", "n0", "n1").alias("t_stat"))


@query(f"SELECT user_id, rnd(t, 6) AS t_stat FROM ({T_SQL})", 6)
def t_stat(spark, sf):
    return t_values(spark, sf)


@query(f"""
SELECT count(*) FILTER (CASE WHEN e = 0 THEN d <> 0 ELSE abs(t) > 1.96e0 END) AS sig_cnt, count(*) AS n,
  rnd(count(*) FILTER (CASE WHEN e = 0 THEN d <> 0 ELSE abs(t) > 1.96e0 END) * 1e2 / nullif(count(*), 0), 4) AS sig_pct FROM ({T_SQL})""")
def sig_count(spark, sf):
    return stats.significance(t_values(spark, sf))


@query("""
SELECT 'value' AS variable, count(value) AS n, rnd(avg(value), 4) AS avg, rnd(min(value), 4) AS min, rnd(max(value), 4) AS max, rnd(stddev_pop(value), 4) AS std FROM events
UNION ALL SELECT 'user_id', count(user_id), rnd(avg(user_id), 4), rnd(min(user_id), 4), rnd(max(user_id), 4), rnd(stddev_pop(user_id), 4) FROM events""")
def summary_stats(spark, sf):
    return stats.summary(table(spark, sf, "events"), ["value", "user_id"])


@query("""
SELECT '  value        [ms]' || printf('   min: %.4f', min(value)) || printf('   avg: %.4f', avg(value)) || printf('   max: %.4f', max(value)) || printf('   std: %.4f', stddev_pop(value)) || '   shp: (' || count(*) || ',)' AS line
FROM (SELECT CAST(event_id % 8 AS DOUBLE) AS value FROM events WHERE event_id % 16 < 8)""")
def summary_line(spark, sf):
    rows = table(spark, sf, "events").filter("event_id % 16 < 8").select((F.col("event_id") % 8).cast("double").alias("value"))
    return spark.range(1).select(F.lit(stats.summary_text(rows, "value", "value", "ms", stat="naxsh")).alias("line"))


@query("""
SELECT name, rnd(v, 6) AS value FROM (VALUES ('pi', pi()), ('cpd', 1004e0), ('cpv', 1850e0), ('Tf', 273.15e0), ('g', 9.81e0), ('Lv', 2.5104e6), ('Lf', 0.3336e6), ('Ls', 2.844e6), ('Po', 1e5),
  ('Rd', 287.04e0), ('Rv', 461.5e0), ('esf', 611e0), ('eps', 0.622e0), ('deg_to_rad', pi() / 180), ('rad_to_deg', 180 / pi())) x(name, v)""", 6)
def physical_constants(spark, sf):
    names = ("pi", "cpd", "cpv", "Tf", "g", "Lv", "Lf", "Ls", "Po", "Rd", "Rv", "esf", "eps", "deg_to_rad", "rad_to_deg")
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(getattr(constants, n))).alias("value")) for n in names])))


DIRTY = "(SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE WHEN event_id % 83 = 0 THEN NULL ELSE value END AS value FROM events)"


def dirty(spark, sf, *more: str) -> DataFrame:
    e = F.col("event_id")
    bad = F.when(e % 97 == 0, NAN).when(e % 89 == 0, float("inf")).when(e % 83 == 0, F.lit(None).cast("double")).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_type", *more, bad.alias("value"))


@query(f"SELECT event_type, rnd(median(value) FILTER (NOT isnan(value)), 4) AS median FROM {DIRTY} GROUP BY event_type")
def median_skipna(spark, sf):
    return stats.median(dirty(spark, sf), "value", ["event_type"])


@query(f"""
SELECT event_type, user_id % 50 AS k, CASE WHEN count(*) FILTER (value IS NULL OR isnan(value)) > 0 THEN 'nan'::DOUBLE ELSE rnd(median(value), 4) END AS median
FROM {DIRTY.replace("event_type,", "event_type, user_id,")} GROUP BY ALL""")
def median_with_missing(spark, sf):
    rows = dirty(spark, sf, "user_id").withColumn("k", F.col("user_id") % 50)
    return stats.median(rows, "value", ["event_type", "k"], skipna=False)


@query(f"SELECT event_type, rnd(median(value) FILTER (NOT isnan(value)), 4) AS median FROM {DIRTY} GROUP BY event_type")
def median_bracketed(spark, sf):
    return stats.median_of_large_groups(dirty(spark, sf), "value", ["event_type"])


@query(f"""
SELECT 'value' AS variable, count(*) AS total, count(*) FILTER (value IS NULL OR isnan(value)) AS nan_count, count(*) FILTER (isinf(value)) AS inf_count,
  count(*) FILTER (isfinite(value) AND (value < 10 OR value > 400)) AS out_of_range, count(*) FILTER (isfinite(value) AND value BETWEEN 10 AND 400) AS valid,
  rnd(count(*) FILTER (isfinite(value) AND value BETWEEN 10 AND 400) * 1e2 / count(*), 4) AS valid_percentage,
  rnd(min(value) FILTER (isfinite(value)), 4) AS actual_min, rnd(max(value) FILTER (isfinite(value)), 4) AS actual_max FROM {DIRTY}""")
def validity_audit(spark, sf):
    return stats.validity(dirty(spark, sf), ["value"], check_range={"value": (10.0, 400.0)})


@query("""
WITH t AS (SELECT DISTINCT ts FROM events)
SELECT count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  rnd((epoch_us(max(ts)) - epoch_us(min(ts)) + (SELECT epoch_us(ts) FROM t ORDER BY ts LIMIT 1 OFFSET 1) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM t""", 3)
def time_extent(spark, sf):
    out = stats.time_extent(table(spark, sf, "events").select("ts").distinct(), "ts")
    kinds = dict(out.dtypes)
    return out.select("n", *[stats.micros(c, kinds[c]).alias(f"{c}_us") for c in ("first", "last")], "seconds")


@query("""
WITH t AS (SELECT date_trunc('day', ts) AS t FROM events GROUP BY ALL)
SELECT count(*) AS n, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us, rnd((epoch_us(max(t)) - epoch_us(min(t))) / 1e6 + 129600, 3) AS seconds, true AS from_bounds FROM t""", 3)
def time_extent_bounds(spark, sf):
    """Days, each from noon before to the midnight after."""
    days = table(spark, sf, "events").select(F.date_trunc("day", "ts").alias("t")).distinct()
    days = days.select("t", (F.col("t") - F.expr("INTERVAL 12 HOURS")).alias("b0"), (F.col("t") + F.expr("INTERVAL 24 HOURS")).alias("b1"))
    out = stats.time_extent(days, "t", ("b0", "b1"))
    kinds = dict(out.dtypes)
    return out.select("n", *[stats.micros(c, kinds[c]).alias(f"{c}_us") for c in ("first", "last")], "seconds", "from_bounds")


@query("""
WITH lev(lev, p, before, after) AS (SELECT l, l * 100, lag(l * 100) OVER (ORDER BY l), lead(l * 100) OVER (ORDER BY l) FROM (VALUES (200e0), (400e0), (600e0), (800e0), (900e0), (1000e0)) x(l)),
t AS (SELECT c_custkey AS ncol, 70000e0 + (c_custkey * 13) % 40000 AS ps, * FROM customer CROSS JOIN lev),
dp AS (SELECT ncol, ps, lev, CASE WHEN before IS NULL THEN NULL WHEN after IS NULL THEN ps - p WHEN p < ps THEN after - before ELSE ps - before END AS dp FROM t)
SELECT ncol, rnd(ps, 4) AS ps, rnd(lev, 4) AS lev, CASE WHEN dp > 0 THEN rnd(dp, 4) END AS dp FROM dp""")
def layer_thickness(spark, sf):
    surf = table(spark, sf, "customer").select(F.col("c_custkey").alias("ncol"), (70000.0 + (F.col("c_custkey") * 13) % 40000).alias("ps"))
    levels = spark.range(1).select(F.explode(F.array(*map(F.lit, (200.0, 400.0, 600.0, 800.0, 900.0, 1000.0)))).alias("lev"))
    return vertical.layer_thickness(surf, levels)


def coefficients(spark) -> DataFrame:
    return spark.range(1, 8).select(F.col("id").cast("int").alias("lev"), F.lit(0.0).alias("hyam"), (1.0 - (F.col("id") - 1) / 8.0).alias("hybm"))


def columns(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders as columns: (col, lev, v), NaN at one level of every 50th, and (col, ps)."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("lev")).agg(F.max("l_extendedprice").alias("v"))
    lines = lines.withColumn("v", F.when((F.col("col") % 50 == 0) & (F.col("lev") == 3), NAN).otherwise(F.col("v")))
    return lines, lines.select("col", (100000.0 + F.col("col") % 1000).alias("ps")).distinct()


def bracket_sql(x: str, y: str, at: str, back: str, targets: str, skip: str, extrapolate: bool) -> str:
    beyond = "WHEN rn = 1 AND n > 1 AND xt < x THEN (y1 - y) / (x1 - x) * (xt - x) + y WHEN x1 IS NULL AND n > 1 AND xt > x THEN y + (y - yp) / (x - xp) * (xt - x)" if extrapolate else ""
    return f"""
WITH cells AS (SELECT l_orderkey AS col, l_linenumber AS lev, CASE WHEN l_orderkey % 50 = 0 AND l_linenumber = 3 THEN NULL ELSE max(l_extendedprice) END AS v FROM lineitem GROUP BY l_orderkey, l_linenumber),
lev AS (SELECT col, lev, v, (1 - (lev - 1) / 8e0) * (100000 + col % 1000) AS p, lev * 1e2 AS z FROM cells),
seg AS (
  SELECT col, {x} AS x, {y} AS y, lead({x}) OVER w AS x1, lead({y}) OVER w AS y1, lag({x}) OVER w AS xp, lag({y}) OVER w AS yp, row_number() OVER w AS rn,
    count(*) OVER (PARTITION BY col) AS n, bool_or({skip}) OVER (PARTITION BY col) AS skip
  FROM lev WINDOW w AS (PARTITION BY col ORDER BY {x}, lev)),
targets(t) AS (VALUES {targets}),
hits AS (
  SELECT col, t, CASE {beyond} WHEN x1 IS NULL AND xt = x THEN y WHEN xt = x THEN y WHEN xt >= x AND xt < x1 THEN (y1 - y) / (x1 - x) * (xt - x) + y END AS r
  FROM seg CROSS JOIN (SELECT t, {at} AS xt FROM targets) WHERE NOT skip)
SELECT c.col, rnd(c.t, {{digits}}) AS {{name}}, rnd({back}, {{digits}}) AS value
FROM (SELECT DISTINCT col, t FROM cells CROSS JOIN targets) c LEFT JOIN (SELECT col, t, max(r) AS r FROM hits GROUP BY col, t) h ON h.col = c.col AND h.t = c.t"""


P_TARGETS, P_LIST = "(90000e0), (70000e0), (50000e0)", [90000.0, 70000.0, 50000.0]


@query(bracket_sql("p", "v", "t", "r", P_TARGETS, "v IS NULL", False).format(name="plev", digits=4))
def interp_plev_linear(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_pressure(cells, coefficients(spark), surf, P_LIST, interp_type="linear")


@query(bracket_sql("p", "v", "t", "r", P_TARGETS, "v IS NULL", True).format(name="plev", digits=4))
def interp_plev_linear_extrap(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_pressure(cells, coefficients(spark), surf, P_LIST, interp_type="linear", extrapolate=True)


@query(bracket_sql("ln(p)", "v", "ln(t)", "r", P_TARGETS, "v IS NULL", False).format(name="plev", digits=4))
def interp_plev_log(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_pressure(cells, coefficients(spark), surf, P_LIST)


@query(bracket_sql("ln(p)", "v", "ln(t)", "r", P_TARGETS, "v IS NULL", True).format(name="plev", digits=4))
def interp_plev_log_extrap(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_pressure(cells, coefficients(spark), surf, P_LIST, extrapolate=True)


@query(bracket_sql("ln(p)", "ln(abs(v))", "ln(t)", "exp(r)", P_TARGETS, "v IS NULL", False).format(name="plev", digits=4))
def interp_plev_loglog(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_pressure(cells, coefficients(spark), surf, P_LIST, interp_type="loglog")


@query(bracket_sql("ln(p)", "v", "ln(t)", "r", "(100000e0), (85000e0), (50000e0), (25000e0)", "v IS NULL", False).format(name="plev", digits=4))
def interp_default_levels(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_default_pressure(cells, coefficients(spark), surf, [1000, 850, 500, 250])


@query(bracket_sql("ln(p)", "v", "ln(t)", "r", ", ".join(f"({p}00e0)" for p in plev_default), "v IS NULL", False).format(name="plev", digits=4))
def interp_28_levels(spark, sf):
    cells, surf = columns(spark, sf)
    return vertical.to_default_pressure(cells, coefficients(spark), surf)


@query(bracket_sql("p", "v", "t", "r", P_TARGETS, "v IS NULL", False).format(name="plev", digits=4))
def interp_first_time_of_coefficients(spark, sf):
    """Coefficients of later times do not count."""
    cells, surf = columns(spark, sf)
    coef = coefficients(spark)
    later = coef.withColumn("hybm", F.col("hybm") * 0.5).withColumn("time", F.lit(2))
    return vertical.to_pressure(cells, later.unionByName(coef.withColumn("time", F.lit(1))), surf, P_LIST, interp_type="linear")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN rnd(value, 4) END AS value FROM events")
def fill_to_missing(spark, sf):
    value = F.when(F.col("event_id") % 7 == 0, 1e30).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", unfilled(value).alias("value"))


@query("SELECT rnd(unnest([" + ", ".join(map(str, plev_default)) + "]) * 1e2, 2) AS pa", 2)
def default_levels_in_pa(spark, sf):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, plev_default))).alias("hpa")).select(moist.hpa_to_pa(F.col("hpa").cast("double")).alias("pa"))


@query(bracket_sql("z", "v", "t", "r", "(150e0), (250e0), (300e0), (350e0)", "false", False).format(name="height", digits=4))
def interp_height(spark, sf):
    cells, _ = columns(spark, sf)
    return vertical.to_height(cells, [150, 250, 300, 350], z=cells.select("col", "lev", (F.col("lev") * 100.0).alias("z")))


@query(bracket_sql("z", "v", "t", "r", "(50e0), (250e0), (900e0)", "false", True).format(name="height", digits=4))
def interp_height_extrap(spark, sf):
    cells, _ = columns(spark, sf)
    return vertical.to_height(cells.withColumn("z", F.col("lev") * 100.0), [50, 250, 900], extrapolate=True)


@query(f"""
WITH d AS (
  SELECT a.ncol, b.ncol AS p, CASE WHEN a.ncol = b.ncol THEN -1 ELSE acos(greatest(-1, least(1, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))))) END AS d
  FROM {GRID} a CROSS JOIN {GRID} b),
r AS (SELECT *, row_number() OVER (PARTITION BY ncol ORDER BY round(d, 9), p) - 1 AS rank FROM d)
SELECT ncol, CAST(rank AS INTEGER) AS rank, p AS neighbor_id, rnd(greatest(d, 0), 6) AS neighbor_dist FROM r WHERE rank <= 3""", 6)
def knn_sphere(spark, sf):
    return sphere.nearest_neighbors(suppliers(spark, sf), 3)


@query(f"""
WITH d AS (
  SELECT a.ncol, b.ncol AS p, acos(greatest(-1, least(1, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon))))) AS d
  FROM {GRID} a JOIN {GRID} b ON a.ncol <> b.ncol),
r AS (SELECT *, row_number() OVER (PARTITION BY ncol ORDER BY round(d, 9), p) AS rank FROM d)
SELECT ncol, CAST(rank AS INTEGER) AS rank, p AS neighbor_id, rnd(d, 6) AS neighbor_dist FROM r WHERE rank <= 2""", 6)
def knn_sphere_without_self(spark, sf):
    return sphere.nearest_neighbors(suppliers(spark, sf), 2, include_self=False)


def raster_sql(k: int, cells: str) -> str:
    dist = f"CASE WHEN abs(q.lat) > 60 THEN {HAV.format(a='q.lat', b='g.lat', c='q.lon', d='g.glon')} ELSE sqrt((q.lon - g.glon) ** 2 + (q.lat - g.lat) ** 2) END"
    return f"""
WITH g AS (SELECT ncol, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS glon, lat, value FROM {GRID} WHERE {cells}),
d AS (SELECT q.c, g.ncol, g.value, {dist} AS d FROM {PIXELS} q CROSS JOIN g),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(d, 9), ncol) AS rank FROM d),
s AS (SELECT q.ncol AS c, {dist} AS d FROM (SELECT ncol, glon AS lon, lat FROM g ORDER BY ncol LIMIT 20) q CROSS JOIN g),
s2 AS (SELECT c, d, row_number() OVER (PARTITION BY c ORDER BY d) AS rank FROM s),
cut AS (SELECT 3 * median(d) AS cut FROM s2 WHERE rank = 2),
v AS (SELECT c, sum(value / (d + 1e-10)) / sum(1 / (d + 1e-10)) AS v, min(d) AS d FROM r WHERE rank <= {k} GROUP BY c)
SELECT c, CASE WHEN d <= cut THEN rnd(v, 4) END AS value FROM v CROSS JOIN cut"""


@query(raster_sql(1, "true"))
def raster_nearest(spark, sf):
    return raster.to_raster(suppliers(spark, sf), customers(spark, sf), key=("c",))


@query(raster_sql(4, "true"))
def raster_idw(spark, sf):
    return raster.to_raster(suppliers(spark, sf), customers(spark, sf), key=("c",), method="linear")


@query(raster_sql(1, "true").replace(PIXELS, PIXELS.replace("SELECT c_custkey AS c, (", "SELECT c_custkey AS c, CASE WHEN c_custkey % 11 <> 0 THEN 1 END * (")))
def raster_pixels_off_the_globe(spark, sf):
    spots = customers(spark, sf).withColumn("lon", F.when(F.col("c") % 11 != 0, F.col("lon")).when(F.col("c") % 2 == 0, NAN))
    return raster.to_raster(suppliers(spark, sf), spots, key=("c",))


@query(raster_sql(1, "ncol % 7 <> 0"))
def raster_masked(spark, sf):
    cells = suppliers(spark, sf).withColumn("value", F.when(F.col("ncol") % 7 != 0, F.col("value")).otherwise(-999.0))
    return raster.to_raster(cells, customers(spark, sf), key=("c",), mask_value=-999.0)


@query("""
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, rnd(CASE WHEN ix = 23 THEN 180e0 ELSE -180 + ix * (360e0 / 23) END, 4) AS x, rnd(CASE WHEN iy = 11 THEN 90e0 ELSE -90 + iy * (180e0 / 11) END, 4) AS y
FROM (SELECT unnest(range(0, 12)) AS iy) CROSS JOIN (SELECT unnest(range(0, 24)) AS ix)""")
def pixel_grid(spark, sf):
    return raster.pixels(spark, raster.RasterSpec.of((-180, 180, -90, 90), 24, 12)).select("iy", "ix", "x", "y")


def disc_sql(x: str, y: str) -> str:
    return f"""
WITH g AS (SELECT ix, iy, {x} AS x, {y} AS y FROM (SELECT unnest(range(0, 15)) AS iy) CROSS JOIN (SELECT unnest(range(0, 20)) AS ix))"""


@query(
    disc_sql("CASE WHEN ix = 19 THEN 1.1e0 ELSE -1.1e0 + ix * (2.2e0 / 19) END", "CASE WHEN iy = 14 THEN 1.1e0 ELSE -1.1e0 + iy * (2.2e0 / 14) END")
    + """, c AS (SELECT *, sqrt(x * x + y * y) AS r, asin(least(sqrt(x * x + y * y), 1)) AS c FROM g)
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, CASE WHEN r <= 1 THEN rnd(10 + degrees(atan2(x * sin(c), r * cos(radians(40)) * cos(c) - y * sin(radians(40)) * sin(c))), 6) END AS lon,
  CASE WHEN r <= 1 THEN rnd(degrees(asin(cos(c) * sin(radians(40)) + y * sin(c) * cos(radians(40)) / r)), 6) END AS lat FROM c""", 6
)
def pixels_orthographic(spark, sf):
    """Pixels off the globe are missing."""
    out = raster.pixels(spark, raster.RasterSpec.of((-1.1, 1.1, -1.1, 1.1), 20, 15, projection="orthographic", lon0=10.0, lat0=40.0))
    return out.select("iy", "ix", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("lon", "lat")])


@query(
    disc_sql("CASE WHEN ix = 19 THEN 2.7e0 ELSE -2.7e0 + ix * (5.4e0 / 19) END", "CASE WHEN iy = 14 THEN 1.4e0 ELSE -1.4e0 + iy * (2.8e0 / 14) END")
    + ", t(k, len, dist) AS (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(zip(geodesy.ROBINSON_LENGTH, geodesy.ROBINSON_DISTANCE)))
    + """), seg AS (SELECT k, len, dist, lead(len) OVER w AS len1, lead(dist) OVER w AS dist1 FROM t WINDOW w AS (ORDER BY k)),
p AS (
  SELECT iy, ix, x, y, k + (abs(y) / 1.3523e0 - dist) / (dist1 - dist) AS step, len + (abs(y) / 1.3523e0 - dist) / (dist1 - dist) * (len1 - len) AS len
  FROM g LEFT JOIN seg ON abs(y) / 1.3523e0 >= dist AND abs(y) / 1.3523e0 < dist1),
q AS (SELECT *, degrees(x / (0.8487e0 * len)) AS turn FROM p)
SELECT CAST(iy AS INTEGER) AS iy, CAST(ix AS INTEGER) AS ix, CASE WHEN abs(turn) <= 180 THEN rnd(turn - 30, 6) END AS lon, CASE WHEN abs(turn) <= 180 THEN rnd(sign(y) * 5 * step, 6) END AS lat FROM q""", 6
)
def pixels_robinson(spark, sf):
    """Pixels off the map are missing."""
    out = raster.pixels(spark, raster.RasterSpec.of((-2.7, 2.7, -1.4, 1.4), 20, 15, projection="robinson", lon0=-30.0))
    return out.select("iy", "ix", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("lon", "lat")])
