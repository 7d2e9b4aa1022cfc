"""Time series per symbol: as-of and interval joins, trailing sums, growth over periods, slopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.dates import add_years
from rankweave.sources.scratch import saved


def asof_join(probes: DataFrame, bars: DataFrame, by: Sequence[str], probe_time: str, bar_time: str, values: Sequence[str], forward: bool = False, not_null: bool = False) -> DataFrame:
    """probes with the values of the last bar at or before probe_time (forward: the first at or after), and its time as bar_time.

    Bars and probes are united and sorted once per key: no row is multiplied by the length of its
    history. Of bars at one time the greatest values count. Without a bar the columns are null. With
    not_null, bars whose first value is null are left out.
    """
    bars = bars.where(F.col(values[0]).isNotNull()) if not_null else bars
    side = [*by, F.col(bar_time).alias("_t"), F.lit(0 if not forward else 1).alias("_side"), F.struct(*values, F.col(bar_time).alias("_bar")).alias("_bar"), F.lit(None).alias("_probe")]
    other = F.struct(*[F.col(c) for c in probes.columns])
    rows = probes.select(*by, F.col(probe_time).alias("_t"), F.lit(1 if not forward else 0).alias("_side"), F.lit(None).alias("_bar"), other.alias("_probe"))
    both = bars.select(*side).unionByName(rows)
    if forward:
        # backwards in time: a frame that ends with the key would be worked out anew for every row
        w = Window.partitionBy(*by).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_bar", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*by).orderBy("_t", "_side", "_bar").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_bar", ignorenulls=True).over(w)
    out = both.withColumn("_found", found).where(F.col("_side") == (1 if not forward else 0))
    return out.select("_probe.*", *[F.col("_found")[v].alias(v) for v in values], F.col("_found")["_bar"].alias(bar_time if bar_time not in probes.columns else f"bar_{bar_time}"))


def interval_aggregate(probes: DataFrame, bars: DataFrame, by: Sequence[str], start: Column, end: Column, bar_time: str, aggs: Sequence[Column], keep: Sequence[str], open_left: bool = False) -> DataFrame:
    """Per probe, aggregates of the bars in [start, end] (open_left: (start, end]); probes without any have nulls.

    start and end are expressions over probes' columns; keep names the columns that identify a probe. A
    probe is sent to the months of its interval, where it meets that month's bars only: what is joined
    follows the intervals, not the length of a history.
    """
    p = probes.select(*keep, start.alias("_from"), end.alias("_to"))
    p = p.withColumn("_month", F.explode(F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))))
    b = bars.withColumns({"_at": F.col(bar_time), "_bar_month": F.trunc(bar_time, "month")})
    inside = (F.col("_at") > F.col("_from") if open_left else F.col("_at") >= F.col("_from")) & (F.col("_at") <= F.col("_to"))
    on = [p[c] == b[c] for c in by] + [F.col("_month") == F.col("_bar_month"), inside]
    return p.join(b, on, "left").groupBy(*[p[c] for c in keep]).agg(*aggs)


def range_extremes(probes: DataFrame, bars: DataFrame, by: Sequence[str], start: str, end: str, bar_time: str, value: str, keep: Sequence[str]) -> DataFrame:
    """Per probe (keep, which identifies it and holds by, start and end) the greatest and least value of the bars in [start, end]: peak and trough; null without any.

    Months of a key's bars are kept as extremes of runs of 1, 2, 4, ... months, each from two of the level below. The whole months
    of an interval are covered by two such runs, which may overlap; its first and last month are looked at bar by bar. So a probe
    becomes at most four rows, however long its interval, and intervals of several lengths share the runs. Bars without a value or a
    key do not count; an interval that ends before it starts has none. Key, start and end may not be null.
    """
    c = F.col
    month = lambda t: F.year(t) * 12 + F.month(t)
    keys = list(by)
    cells = saved(bars.where(F.col(value).isNotNull()).select(*keys, month(bar_time).alias("_m"), c(bar_time).alias("_at"), c(value).cast("double").alias("_hi")).dropna(subset=keys).withColumn("_lo", c("_hi")), "bars")
    months = cells.groupBy(*keys, "_m").agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    spans = saved(months.groupBy(*keys).agg(F.min("_m").alias("_first"), F.max("_m").alias("_last")), "spans")
    longest = spans.agg(F.max(c("_last") - c("_first") + 1)).first()[0] or 1  # one number
    every = spans.select(*keys, F.explode(F.sequence("_first", "_last")).alias("_m"))  # months without bars too, so that each level finds the one below
    runs = every.join(months, [*keys, "_m"], "left")
    w = Window.partitionBy(*keys).orderBy("_m")
    levels = longest.bit_length()
    for k in range(levels):
        half = 1 << k >> 1
        over = lambda x: (c(x), F.lead(x, half).over(w))  # noqa: B023, E731
        below = (c("_hi"), c("_lo")) if k == 0 else (F.greatest(*over(f"_hi{k - 1}")), F.least(*over(f"_lo{k - 1}")))
        runs = runs.withColumns({f"_hi{k}": below[0], f"_lo{k}": below[1]})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_level"), c(f"_hi{k}").alias("_hi"), c(f"_lo{k}").alias("_lo")) for k in range(levels)]))
    runs = runs.select(*keys, "_m", F.lit(None).cast(dict(cells.dtypes)["_at"]).alias("_at"), each.alias("_x")).select(*keys, "_m", "_at", "_x.*").where("_hi is not null")
    table = cells.withColumn("_level", F.lit(-1)).unionByName(runs)
    # the whole months of the interval, within the key's months
    p = probes.select(*keep).distinct().withColumns({"_a": month(start), "_z": month(end)}).join(spans, keys, "left")
    low, high = F.greatest(c("_a") + 1, c("_first")), F.least(c("_z") - 1, c("_last"))
    n = high - low + 1
    level = F.floor(F.log2(F.greatest(n, F.lit(1)) + 0.5)).cast("int")
    piece = lambda lv, m: F.struct(lv.alias("_level"), m.alias("_m"))
    edges = F.array(piece(F.lit(-1), c("_a")), piece(F.lit(-1), c("_z")))
    whole = F.array(piece(level, low), piece(level, high - F.call_function("shiftleft", F.lit(1), level) + 1))
    none = F.array().cast("array<struct<_level:int,_m:int>>")
    pieces = F.when(c(start) <= c(end), F.array_distinct(F.concat(edges, F.when(n > 0, whole).otherwise(none)))).otherwise(none)
    p = p.withColumn("_x", F.explode_outer(pieces)).select(*keep, "_x.*")
    inside = c("_at").isNull() | c("_at").between(c(start), c(end))
    met = p.join(table, [*keys, "_level", "_m"], "left")
    return met.groupBy(*keep).agg(F.max(F.when(inside, c("_hi"))).alias("peak"), F.min(F.when(inside, c("_lo"))).alias("trough"))


def forward_extremes(probes: DataFrame, bars: DataFrame, by: Sequence[str], start: str, years: Sequence[int], bar_time: str, value: str) -> DataFrame:
    """(by, start, _years, _hi, _lo): up to two rows a probe (by, start) and number of years, the greatest and least value of the bars of either part of [start, start + years].

    Time is cut into spans as long as the interval, which then lies in two of them, side by side: what is wanted is the bars from start to its
    span's end, and those from the next span's beginning. Both are running extremes: two sorts, and no row but the bars and the ends of intervals,
    however long they are. Bars without a value or a key do not count.
    """
    c = F.col
    keys = [*by, "_years", "_span"]
    each = F.explode(F.array(*[F.lit(y) for y in years])).alias("_years")
    span = F.floor((F.year("_t") * 12 + F.month("_t")) / (12 * c("_years"))).alias("_span")
    due = F.lit(None).cast("date")
    for y in years:
        due = F.when(c("_years") == y, add_years(c("_start"), y)).otherwise(due)
    cells = bars.where(c(value).isNotNull()).dropna(subset=list(by)).select(*by, c(bar_time).alias("_t"), c(value).cast("double").alias("_v"), each)
    # 29 February may move on to March, but is never in a span's last month; at one day an interval's start comes before the bars, its end after them
    cells = cells.select(*keys[:-1], span, "_t", F.lit(1).alias("_side"), "_v", F.lit(None).cast(dict(probes.dtypes)[start]).alias("_start"))
    edges = probes.select(*by, c(start).alias("_start")).distinct().select("*", each)
    sides = F.explode(F.array(F.struct(c("_start").cast("date").alias("_t"), F.lit(0).alias("_side")), F.struct(due.alias("_t"), F.lit(2).alias("_side")))).alias("_x")
    edges = edges.select(*by, "_years", "_start", sides).select(*by, "_years", "_start", "_x.*").select(*keys[:-1], span, "_t", "_side", F.lit(None).cast("double").alias("_v"), "_start")
    running = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto, onwards = running("_t", "_side"), running(F.desc("_t"), F.desc("_side"))
    met = cells.unionByName(edges).withColumns({f"_{f}_{n}": getattr(F, f)("_v").over(w) for n, w in (("upto", upto), ("onwards", onwards)) for f in ("max", "min")})
    of = lambda f: F.when(c("_side") == 0, c(f"_{f}_onwards")).otherwise(c(f"_{f}_upto"))
    return met.where("_side <> 1").select(*by, c("_start").alias(start), "_years", of("max").alias("_hi"), of("min").alias("_lo"))


def trailing_sum(df: DataFrame, by: Sequence[str], order: str, value: str, out: str, rows: int = 4) -> DataFrame:
    """df with out: the sum of value over the last rows rows; null if one is null or there are fewer."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == rows, F.sum(value).over(w)))


def newest_first(df: DataFrame, by: Sequence[str], order: str, out: str = "age") -> DataFrame:
    """df with out: 0 for the newest row of a key, 1 for the one before, ..."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1)


def newest_n(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    return newest_first(df, by, order, "_age").where(F.col("_age") < n).drop("_age")


def first_of(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first in order."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def cagr(value: Column, age: Column, max_years: int) -> Column:
    """Aggregate: growth a year from the oldest value within max_years to the newest; null unless both are above 0."""
    end = F.max(F.when(age == 0, value))
    years = F.max(F.when(value.isNotNull() & age.between(1, max_years), age))
    start = F.max_by(value, F.when(value.isNotNull() & age.between(1, max_years), age))
    return F.when((end > 0) & (start > 0), F.pow(end / start, 1 / years) - 1)


def average_of_newest(value: Column, age: Column, n: int) -> Column:
    """Aggregate: mean of the non-null values among the newest n."""
    return F.avg(F.when(age < n, value))


def count_above(value: Column, age: Column, n: int, bound: float = 0) -> Column:
    """Aggregate: how many of the newest n are above bound."""
    return F.sum(F.when((age < n) & (value > bound), 1).otherwise(0))


def month_end_bars(bars: DataFrame, by: Sequence[str], time: str, values: Sequence[str], months: int | None = None) -> DataFrame:
    """The last bar of every calendar month, as month (its first day), time and values; with months, the newest so many."""
    last = F.max_by(F.struct(F.col(time), *values), F.struct(F.col(time), *values))
    out = bars.groupBy(*by, F.trunc(time, "month").alias("month")).agg(last.alias("_b")).select(*by, "month", "_b.*")
    return newest_n(out, by, "month", months) if months else out


def momentum(bars: DataFrame, by: Sequence[str], month: str, close: str, out: str = "momentum") -> DataFrame:
    """One row per key with out: close of the month before the newest over close thirteen months before it, less 1; null under 14 months."""
    aged = newest_first(bars, by, month)
    at = lambda k: F.max(F.when(F.col("age") == k, F.col(close)))
    return aged.groupBy(*by).agg(F.when((F.count("*") >= 14) & (at(13) > 0), at(1) / at(13) - 1).alias(out))


def momentum_at(probes: DataFrame, bars: DataFrame, by: Sequence[str], probe_time: str, time: str, close: str, out: str = "momentum") -> DataFrame:
    """probes with out: momentum of the months that have a bar by probe_time. A month's own figure uses closes of months before it only, so it holds from its first bar on."""
    last = F.max_by(F.col(close), F.struct(F.col(time), F.col(close)))
    months = bars.groupBy(*by, F.trunc(time, "month").alias("_m")).agg(F.min(time).alias("_seen"), last.alias("_close"))
    w = Window.partitionBy(*by).orderBy("_m")
    back = lambda k: F.lag("_close", k).over(w)
    value = F.when((F.row_number().over(w) >= 14) & (back(13) > 0), back(1) / back(13) - 1)
    return asof_join(probes, months.select(*by, "_seen", value.alias(out)), by, probe_time, "_seen", [out]).drop("_seen")


def slope_per_year(df: DataFrame, by: Sequence[str], time: str, value: str, least: int, out: str = "slope_pct") -> DataFrame:
    """One row per key: n and out, the least-squares slope of value over years, in percent of the first value; null under least samples."""
    rows = df.where(F.col(value).isNotNull())
    x = F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) / 365.25
    first = F.min_by(value, time)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & (first > 0), F.regr_slope(F.col(value), x) / first * 100).alias(out))


def trend_class(slope: Column, bound: float = 5.0) -> Column:
    return F.when(slope.isNull(), "insufficient_data").when(slope > bound, "improving").when(slope < -bound, "declining").otherwise("stable")


def day_number(date: Column) -> Column:
    """Days numbered so that a month is 32 of them: n months earlier is 32 n less, and where that day is missing no date lies between."""
    return (F.year(date) * 12 + F.month(date)) * 32 + F.day(date)


def trailing_slope(df: DataFrame, by: Sequence[str], time: str, value: str, months: int = 24, least: int = 4, out: str = "slope_pct") -> DataFrame:
    """(by, d, n, out) per key and time of df (one row each): the slope of value over its own trailing window (time - months, time], in per cent of its first value a year.

    One sort a key and a frame by day number; no row meets another by a join. Null values count for nothing; under least values, or from a first one not above 0, the slope is null.
    """
    w = Window.partitionBy(*by).orderBy(day_number(F.col(time))).rangeBetween(-32 * months + 1, 0)
    v, x = F.col(value).cast("double"), F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) / 365.25
    first, n = F.first(v, ignorenulls=True).over(w), F.count(v).over(w)
    slope = F.regr_slope(v, x).over(w)
    return df.select(*by, F.col(time).alias("d"), n.alias("n"), F.when((n >= least) & (first > 0), slope / first * 100).alias(out))


def realised_volatility(bars: DataFrame, by: Sequence[str], time: str, close: str, rows: int = 30, least: int = 5, low: float = 0.08, high: float = 0.80, out: str = "vol") -> DataFrame:
    """bars with out: sample deviation of log returns over the last rows closes, a year's, within [low, high]; low under least closes."""
    w = Window.partitionBy(*by).orderBy(time)
    step = F.when((F.col(close) > 0) & (F.lag(close).over(w) > 0), F.ln(F.col(close) / F.lag(close).over(w)))
    last = w.rowsBetween(-(rows - 2), 0)
    df = bars.withColumns({"_r": step, "_n": F.count("*").over(w.rowsBetween(-(rows - 1), 0))})
    vol = F.stddev_samp("_r").over(last) * F.sqrt(F.lit(252.0))
    return df.withColumn(out, F.when(F.col("_n") < least, low).otherwise(F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), vol)), F.lit(low)))).drop("_r", "_n")


def upsert(old: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union by key where fresh rows win."""
    return old.join(fresh.select(*key).distinct(), list(key), "left_anti").unionByName(fresh)
