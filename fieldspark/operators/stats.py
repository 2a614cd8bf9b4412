"""Summaries, exact medians, t statistics, validity audits and extents in time; each a single aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import INF, NAN, col, finite, ieee_div, present
from ..sources.checkpoints import cut


def _stacked(one: DataFrame, variables: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows (variable, *fields) from one row with a struct column for each variable."""
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"`{v}`.{f}").alias(f) for f in fields]) for v in variables])))


def summary(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, n, avg, min, max, std): of what is neither missing nor NaN; std is the population's."""
    fields = ("n", "avg", "min", "max", "std")
    stats = lambda x: F.struct(*[f.alias(n) for n, f in zip(fields, (F.count(x), F.avg(x), F.min(x), F.max(x), F.stddev_pop(x)))])
    return _stacked(df.agg(*[stats(present(v)).alias(v) for v in variables]), variables, fields)


def summary_text(df: DataFrame, variable: str, name: str = "(no name)", unit: str = "", fmt: str = "f", stat: str = "naxh", indent: str = "  ", compact: bool = True) -> str:
    """The summary as text: of the letters in stat, n is the minimum, a the mean, x the maximum, s the deviation, h the count of rows."""
    row, total = summary(df, [variable]).first(), df.count()
    number = {"f": "%.4f", "e": "%e", "g": "%g"}.get(fmt, fmt)
    parts = {"h": f"   shp: ({total},)"} | {k: f"   {label}: " + number % (NAN if row[f] is None else row[f]) for k, label, f in (("a", "avg", "avg"), ("n", "min", "min"), ("x", "max", "max"), ("s", "std", "std"))}
    head = f"{indent}{name:{12 if compact else len(name)}} {f'[{unit}]' if unit else ''}"
    found = [parts[c] for c in stat if c in parts]
    return head + "".join(found) if compact else "".join(f"{line}\n" for line in [head, *[indent + x for x in found]])


def median(df: DataFrame, value: str, by: Sequence[str], skipna: bool = True) -> DataFrame:
    """(*by, median): the exact median over all other dimensions; without skipna NaN where a value is missing."""
    out = F.median(present(value))
    if not skipna:
        out = F.when(F.bool_or(present(value).isNull()), NAN).otherwise(out)
    return df.groupBy(*by).agg(out.alias("median"))


def median_of_large_groups(df: DataFrame, value: str, by: Sequence[str] = (), spread: float = 1e-3, few: int = 100_000) -> DataFrame:
    """(*by, median): what median() gives with skipna, for groups whose values would not fit in a task.

    Approximate quantiles on either side of the middle bracket it; values below the bracket are counted, those within it, a
    few thousandths of the group, are counted by value, and the middle ones are picked from these counts. Three map-side
    combined aggregations; brackets are broadcast where there are no more than ``few`` groups.
    """
    keys = [f"__by{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], present(value).alias("x"))
    ends = F.percentile_approx("x", F.array(F.lit(0.5 - spread), F.lit(0.5 + spread)), F.lit(int(4 / spread)))
    groups = rows.groupBy(*keys).agg(F.count("x").alias("n"), ends.alias("ends")).select(*keys, "n", F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high"))
    groups = cut(groups)
    brackets = groups.withColumnsRenamed({k: f"{k}g" for k in keys})
    brackets = F.broadcast(brackets) if groups.count() <= few else brackets
    on = [rows[k].eqNullSafe(F.col(f"{k}g")) for k in keys]
    placed = (rows.join(brackets, on) if keys else rows.crossJoin(brackets)).filter(F.col("x") <= F.col("high"))
    at = F.when(F.col("x") >= F.col("low"), F.col("x"))  # null: below the bracket
    counts = placed.groupBy(*keys, "n", at.alias("at")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy(*keys).orderBy(F.col("at").asc_nulls_first()))
    ranked = counts.withColumn("upto", upto)
    middle = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") / 2.0) + k, F.col("at"))) for k in (0, 1)]
    found = ranked.groupBy(*keys, "n").agg(middle[0].alias("a"), middle[1].alias("b"))
    found = found.withColumnsRenamed({k: f"{k}f" for k in keys}).drop("n")
    same = [groups[k].eqNullSafe(F.col(f"{k}f")) for k in keys]
    out = groups.join(found, same, "left") if keys else groups.crossJoin(found)
    picked = F.when(F.col("n") % 2 == 1, F.col("a")).otherwise((F.col("a") + F.col("b")) / 2)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.when(F.col("n") > 0, picked).alias("median"))


def t_stat(d0, d1, s0, s1, n0, n1) -> Column:
    """Two-sample t statistic of means d, deviations s and sizes n; infinite where the standard error is zero."""
    square = lambda s, n: ieee_div(col(s) * col(s), n)
    return ieee_div(col(d1) - col(d0), F.sqrt(square(s0, n0) + square(s1, n1)))


def significance(df: DataFrame, t: str = "t_stat", t_crit: float = 1.96) -> DataFrame:
    """(sig_cnt, n, sig_pct): rows whose statistic exceeds t_crit; NaN never does, infinities do."""
    x = col(t)
    hit = F.count_if(F.coalesce(~F.isnan(x) & (F.abs(x) > t_crit), F.lit(False)))
    return df.agg(hit.alias("sig_cnt"), F.count("*").alias("n"), (hit * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("sig_pct"))


def validity(df: DataFrame, variables: Sequence[str] | None = None, check_nan: bool = True, check_inf: bool = True, check_range: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """(variable, total, nan_count, inf_count, out_of_range, valid, valid_percentage, actual_min, actual_max).

    Missing counts as NaN. Bounds are inclusive, may be None, and apply to finite values; the actual extremes are those of
    finite values of variables with a range. Unknown variables are left out with a warning; checks that are off count 0.
    """
    ranges = check_range or {}
    asked = list(variables) if variables is not None else [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    known = [v for v in asked if v in df.columns]
    for v in asked:
        if v not in df.columns:
            print(f"WARNING: no variable '{v}'")
    fields = ("total", "nan_count", "inf_count", "out_of_range", "valid", "valid_percentage", "actual_min", "actual_max")

    def audit(v: str) -> Column:
        x, ok = F.col(v).cast("double"), finite(v)
        low, high = ranges.get(v, (None, None))
        out = F.lit(False)
        for on, test in ((low, lambda: x < low), (high, lambda: x > high)):
            out = out | test() if on is not None else out
        zero = F.lit(0).cast("long")
        total = F.count(F.lit(1))
        nan = F.count_if(x.isNull() | F.isnan(x)) if check_nan else zero
        inf = F.count_if(F.coalesce(F.abs(x) == INF, F.lit(False))) if check_inf else zero
        beyond = F.count_if(ok & out) if v in ranges else zero
        valid = total - nan - inf - beyond
        actual = [f(F.when(ok, x)) if v in ranges else F.lit(None).cast("double") for f in (F.min, F.max)]
        return F.struct(*[c.alias(n) for n, c in zip(fields, (total, nan, inf, beyond, valid, valid * 100.0 / F.nullif(total, zero), *actual))]).alias(v)

    if not known:
        return df.sparkSession.createDataFrame([], "variable string, total long, nan_count long, inf_count long, out_of_range long, valid long, valid_percentage double, actual_min double, actual_max double")
    return _stacked(df.agg(*[audit(v) for v in known]), known, fields)


BOUND_NAMES = ("time_bnds", "time_bounds", "time_bnd")


def micros(c: str, kind: str) -> Column:
    """Microseconds since 1970 of a column of type ``kind``; times without a zone are taken as UTC."""
    if kind == "timestamp":
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))


def time_extent(df: DataFrame, time: str = "time", bounds: tuple[str, str] | None = None) -> DataFrame:
    """(n, first, last, seconds, from_bounds) of a table with a row for each time.

    bounds: columns of each period's start and end. With them the span runs from the first start to the last end; without, from
    the first to the last time plus the first step. One time without bounds has no span.
    """
    t = F.col(time)
    known = df.filter(t.isNotNull())
    second = known.select(t.alias("t")).orderBy("t").limit(2).agg(F.max("t").alias("second"))
    ends = [F.min_by(bounds[0], t), F.max_by(bounds[1], t)] if bounds else [F.lit(None).cast("timestamp_ntz")] * 2
    one = known.agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), *[e.alias(n) for e, n in zip(ends, ("start", "end"))]).crossJoin(second)
    kind = dict(df.dtypes)[bounds[0] if bounds else time]
    at = lambda c: micros(c, kind)
    span = at("end") - at("start") if bounds else F.when(F.col("n") > 1, at("last") - at("first") + at("second") - at("first"))
    return one.select("n", "first", "last", (span / 1e6).alias("seconds"), F.lit(bounds is not None).alias("from_bounds"))


def months_of(days: int) -> int:
    """Whole months of the mean Gregorian month in so many days, rounded down."""
    return days * 4800 // 146097


def span_text(days: int) -> str:
    months = months_of(days)
    years = months // 12
    return f"{days} days" + (f"  /  {months} months" if months >= 2 else "") + (f"  /  {years} years" if years >= 2 else "")


def time_extent_text(df: DataFrame, time: str = "time", bounds: tuple[str, str] | None = None, indent: str = "    ", color: str | None = None) -> str:
    """The extent as a line of text; ``color`` is an escape code to put before it, with a reset after."""
    if time not in df.columns or dict(df.dtypes)[time] not in ("timestamp", "timestamp_ntz", "date"):
        said = "no time dimension"
    else:
        row = time_extent(df, time, bounds).first()
        if row.seconds is None:
            said = "single time value, no bounds available"
        else:
            said = span_text(int(row.seconds // 86400))
            if row.from_bounds:
                said += "  (single period, from time_bnds)" if row.n <= 1 else "  (from time_bnds)"
    text = f"{indent}Time span   : {said}"
    return f"{color}{text}\033[0m" if color is not None else text
