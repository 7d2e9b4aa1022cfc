"""What became of names after they were flagged: holding, covered calls, rolled puts, buckets, misses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.dates import add_years
from rankweave.functions.finance import call_premium_pct
from rankweave.functions.stats import floor_quartile, upper_median
from rankweave.operators.ranking import decile
from rankweave.operators.timeseries import asof_join, realised_volatility
from rankweave.plans.backtest import recovery


def hold_outcomes(valued: DataFrame, bars: DataFrame, today: Column, least_years: float = 0.5) -> DataFrame:
    """(d, symbol, price, end_price, years, total_pct, annual_pct) of names bought at or below their median value and held to the last close up to today."""
    flags = valued.where("price > 0 and median > 0 and price <= median").withColumn("_today", today)
    held = asof_join(flags, bars, ["symbol"], "_today", "date", ["close"]).where("close > 0")
    years = F.datediff("_today", "d") / 365.25
    out = held.select("d", "symbol", "price", F.col("close").alias("end_price"), years.alias("years")).where(F.col("years") >= least_years)
    out = out.withColumn("total_pct", (F.col("end_price") - F.col("price")) / F.col("price") * 100)
    return out.withColumn("annual_pct", F.col("total_pct") / F.col("years"))


def call_outcomes(valued: DataFrame, bars: DataFrame, years: int = 2, iv: float = 0.25) -> DataFrame:
    """(d, symbol, price, strike, upside_pct, assigned, capital_pct, premium_pct, total_pct, annual_pct) of names below p25 with a call sold at it.

    The call assigns if the high of the window reaches the strike; else the last close there counts, or
    the entry price without one.
    """
    c = F.col
    flags = valued.where("price > 0 and p25 > 0 and price < p25").select("d", "symbol", "price", c("p25").alias("target"))
    r = recovery(flags, bars, 12 * years, unmatched=True)
    gain = lambda x: (x - c("price")) / c("price") * 100
    out = r.select("d", "symbol", "price", c("target").alias("strike"), gain(c("target")).alias("upside_pct"), c("recovered").alias("assigned"), F.when(c("recovered"), gain(c("target"))).otherwise(gain(c("final"))).alias("capital_pct"))
    out = out.withColumn("premium_pct", call_premium_pct(F.lit(iv), F.lit(float(years)), c("upside_pct")))
    out = out.withColumn("total_pct", c("capital_pct") + c("premium_pct"))
    return out.withColumn("annual_pct", c("total_pct") / years)


def strategy_summary(hold: DataFrame, calls: DataFrame) -> DataFrame:
    """(strategy, n, p25, median, p75 of the yearly return, win_rate, loss_rate, assigned_rate, and for calls the mean upside and premium)."""
    none = F.lit(None).cast("double")
    rows = hold.select(F.lit("hold").alias("strategy"), "annual_pct", "total_pct", F.lit(None).cast("boolean").alias("assigned"), none.alias("upside_pct"), none.alias("premium_pct"))
    rows = rows.unionByName(calls.select(F.lit("covered_call").alias("strategy"), "annual_pct", "total_pct", "assigned", "upside_pct", "premium_pct"))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return rows.groupBy("strategy").agg(
        F.count("*").alias("n"), *[F.percentile("annual_pct", F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))],
        share(F.col("annual_pct") > 0).alias("win_rate"), share(F.col("total_pct") < 0).alias("loss_rate"), F.avg(F.col("assigned").cast("double")).alias("assigned_rate"),
        F.avg("upside_pct").alias("mean_upside_pct"), F.avg("premium_pct").alias("mean_premium_pct"),
    )


def premium_sensitivity(calls: DataFrame, years: int = 2, volatilities: Sequence[float] = (0.15, 0.25, 0.40)) -> DataFrame:
    """(iv, p25, median, p75) of the calls' yearly return if premiums had been those of each volatility."""
    c = F.col
    each = calls.select("capital_pct", "upside_pct", F.explode(F.array(*[F.lit(v) for v in volatilities])).alias("iv"))
    annual = (c("capital_pct") + call_premium_pct(c("iv"), F.lit(float(years)), c("upside_pct"))) / years
    return each.withColumn("_a", annual).groupBy("iv").agg(*[F.percentile("_a", F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))])


def both_strategies(hold: DataFrame, calls: DataFrame) -> DataFrame:
    """The calls whose name and date also qualify for holding."""
    return calls.join(hold.select("d", "symbol"), ["d", "symbol"], "left_semi")


# ---------------------------------------------------------------- rolled puts


def rolling_puts(flags: DataFrame, bars: DataFrame, years: int = 2, cycle: int = 30, downside_pct: float = 5, rate: float = 0.04) -> DataFrame:
    """(d, symbol, total_pct, cycles, assigned, assigned_at) of selling a put downside_pct below the price every cycle days until one assigns.

    flags: d, symbol, price. Cycles are whole ones up to d + years; a cycle is priced at the first bar at
    or after its start, by the realised volatility of the cycle's days of closes before it, and judged at the first bar at or
    after its end. The first cycle without either bar, or the first that assigns, ends the run; after an assignment the
    shares are held to the first bar at or after the window's end. The collateral is the first strike,
    and earns rate; flags without capital are left out.
    """
    c = F.col
    f = flags.where("price > 0").select("d", "symbol", "price", add_years(c("d"), years).alias("_exit"))
    n = F.floor(F.datediff("_exit", "d") / cycle).cast("int")
    grid = f.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), n)))
    grid = grid.withColumns({"_from": F.date_add("d", (c("_k") - 1) * cycle), "_until": F.date_add("d", c("_k") * cycle)})
    vol = realised_volatility(bars, ["symbol"], "date", "close", rows=max(30, cycle) + 1).select("symbol", "date", "close", "vol")
    at = asof_join(grid, bars.select("symbol", c("date").alias("_b0"), c("close").alias("spot")), ["symbol"], "_from", "_b0", ["spot"], forward=True)
    at = asof_join(at.drop("_b0"), vol.select("symbol", c("date").alias("_bv"), "vol"), ["symbol"], "_from", "_bv", ["vol"]).drop("_bv")
    at = asof_join(at, bars.select("symbol", c("date").alias("_b1"), c("close").alias("end")), ["symbol"], "_until", "_b1", ["end"], forward=True).drop("_b1")
    at = asof_join(at, bars.select("symbol", c("date").alias("_bx"), c("close").alias("exit")), ["symbol"], "_exit", "_bx", ["exit"], forward=True).drop("_bx")
    share = 1 - downside_pct / 100
    premium = call_premium_pct(F.coalesce("vol", F.lit(0.08)), F.lit(cycle / 365), F.lit(float(downside_pct))) / 100 * c("spot")
    whole = c("spot").isNotNull() & c("end").isNotNull()
    hit = whole & (c("end") <= c("spot") * share)
    first = at.groupBy("d", "symbol").agg(F.min(F.when(~whole, c("_k"))).alias("_stop"), F.min(F.when(hit, c("_k"))).alias("_hit"))
    rows = at.withColumn("_p", premium).join(first, ["d", "symbol"])
    last = F.least(c("_hit"), c("_stop") - 1, F.lit(1 << 30))
    inside = c("_k") <= last
    assigned = c("_hit").isNotNull() & (c("_stop").isNull() | (c("_hit") < c("_stop")))
    g = rows.groupBy("d", "symbol").agg(
        F.max("price").alias("_price"), F.coalesce(F.sum(F.when(inside, c("_p"))), F.lit(0.0)).alias("_premium"), F.count_if(inside).alias("cycles"), F.max(assigned).alias("assigned"), F.max("_hit").alias("_hit"),
        F.max(F.when(assigned & (c("_k") == c("_hit")), F.coalesce(c("exit") - c("spot") * share, F.lit(0.0)))).alias("_loss"),
    )
    g = f.select("d", "symbol", c("price").alias("_p0")).join(g, ["d", "symbol"], "left")
    capital = c("_p0") * share
    total = F.coalesce("_premium", F.lit(0.0)) + F.coalesce("_loss", F.lit(0.0)) + capital * rate * cycle / 365 * F.coalesce("cycles", F.lit(0))
    return g.select("d", "symbol", (total / capital * 100).alias("total_pct"), F.coalesce("cycles", F.lit(0)).cast("int").alias("cycles"), F.coalesce("assigned", F.lit(False)).alias("assigned"), F.when(c("assigned"), c("_hit")).otherwise(0).cast("int").alias("assigned_at"))


# ---------------------------------------------------------------- buckets


#: Fixed value: names left out of the benchmark.
MEGA_CAPS = ["AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "META", "NVDA", "TSLA"]


def median_benchmark(returns: DataFrame, excluded: Sequence | None = None) -> DataFrame:
    """(d, horizon, bench_pct): the upper median of the returns (d, symbol, horizon, ret_pct) of names that are not excluded."""
    excluded = MEGA_CAPS if excluded is None else excluded
    return returns.where(~F.col("symbol").isin(*excluded)).groupBy("d", "horizon").agg(upper_median("ret_pct").alias("bench_pct"))


def wide_dates(panel: DataFrame, least: int = 50, date: str = "d") -> DataFrame:
    """The rows of dates with at least least rows."""
    enough = panel.groupBy(date).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return panel.join(enough.select(date), date, "left_semi")


def bucket_outcomes(placed: DataFrame, bars: DataFrame, returns: DataFrame, benchmark: DataFrame, months: int = 24) -> DataFrame:
    """placed (d, symbol, bucket, composite, price, p25) with decile (of ranked rows), recovered (null without a target above the price), days, and per horizon ret_<h> and excess_<h> over benchmark.

    returns: d, symbol, horizon, ret_pct (1 and 2 years); benchmark: see median_benchmark.
    """
    c = F.col
    ranked = decile(placed.where("bucket = 'ranked'").select("d", "symbol", "composite"), ["d"], "composite", "symbol").select("d", "symbol", "decile")
    flags = placed.where("round(p25, 8) > round(price, 8)").select("d", "symbol", "price", c("p25").alias("target"))
    back = recovery(flags, bars, months, unmatched=True).select("d", "symbol", "recovered", "days")
    wide = returns.join(benchmark, ["d", "horizon"], "left").groupBy("d", "symbol").agg(*[x for h in (1, 2) for x in (F.max(F.when(c("horizon") == h, c("ret_pct"))).alias(f"ret_{h}"), F.max(F.when(c("horizon") == h, c("ret_pct") - c("bench_pct"))).alias(f"excess_{h}"))])
    out = placed
    for part in (ranked, back, wide):
        out = out.join(part, ["d", "symbol"], "left")
    return out


def bucket_report(outcomes: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Over several groupings of bucket_outcomes in one pass: n, with_target, recovery rate, shares within months, medians of days, returns and excesses; a column outside a grouping is null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    target, back = F.count("recovered"), F.col("recovered")
    share = lambda cond: F.when(target > 0, F.count_if(cond) / target)
    within = [share(back & (F.col("days") <= m * 30.44)).alias(f"within_{m}m") for m in (3, 6, 12, 18, 24)]
    medians = [F.percentile(x, F.lit(0.5)).alias(f"median_{x}") for x in ("ret_1", "ret_2", "excess_1", "excess_2")]
    g = outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return g.agg(F.count("*").alias("n"), target.alias("with_target"), share(back).alias("recovery"), F.percentile(F.when(back, F.col("days")), F.lit(0.5)).alias("median_days"), *within, *medians)


def avoid_causes(outcomes: DataFrame) -> DataFrame:
    """(has_value, n, median_ret_2, median_excess_2) of avoided rows with and without a fair value."""
    rows = outcomes.where("bucket = 'avoid'")
    return rows.groupBy(F.col("p25").isNotNull().alias("has_value")).agg(F.count("*").alias("n"), *[F.percentile(x, F.lit(0.5)).alias(f"median_{x}") for x in ("ret_2", "excess_2")])


def put_report(puts: DataFrame, outcomes: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Over several groupings of rolling_puts beside bucket_outcomes: n, quartiles of the puts' return, medians over holding and over the benchmark, assigned rate, mean cycles."""
    c = F.col
    rows = puts.join(outcomes, ["d", "symbol"]).withColumns({"_over_hold": c("total_pct") - c("ret_2"), "_over_bench": c("total_pct") - (c("ret_2") - c("excess_2"))})
    names = list(dict.fromkeys(x for s in sets for x in s))
    g = rows.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for x in names])
    return g.agg(
        F.count("*").alias("n"), *[F.percentile("total_pct", F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))], F.percentile("ret_2", F.lit(0.5)).alias("hold_median"),
        F.percentile("_over_hold", F.lit(0.5)).alias("over_hold"), F.percentile("_over_bench", F.lit(0.5)).alias("over_benchmark"), F.avg(c("assigned").cast("double")).alias("assigned_rate"), F.avg("cycles").alias("mean_cycles"),
    )


# ---------------------------------------------------------------- misses


def miss_rows(accuracy: DataFrame, history: DataFrame) -> DataFrame:
    """Misses of p25 of accuracy_rows with p25_change and median_change (percent): the first value at or after d + horizon years that is known, in history (symbol, date, p25, median)."""
    c = F.col
    misses = accuracy.where("hit_p25 = false")
    due = F.add_months(c("d"), 12 * c("horizon"))
    known = history.where("p25 is not null").select("symbol", c("date").alias("_at"), c("p25").alias("later_p25"), c("median").alias("later_median"))
    out = asof_join(misses.withColumn("_due", due), known, ["symbol"], "_due", "_at", ["later_p25", "later_median"], forward=True).drop("_due", "_at")
    change = lambda a, b: (c(a) - c(b)) / c(b) * 100
    return out.withColumns({"p25_change": change("later_p25", "p25"), "median_change": change("later_median", "median")})


def describe(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per group: n, mean, p25, median, p75 (elements at floor indices) and the share below 0 of value."""
    g = rows.where(F.col(value).isNotNull()).groupBy(*by)
    return g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), floor_quartile(value, 1).alias("p25"), upper_median(value).alias("median"), floor_quartile(value, 3).alias("p75"), F.avg(F.when(F.col(value) < 0, 1.0).otherwise(0.0)).alias("negative"))


def miss_crosstab(misses: DataFrame) -> DataFrame:
    """(horizon, up, down, flat, fell_more): how the value moved where a miss has one, and how often the price fell more than a falling value."""
    c = F.col
    rows = misses.where("p25_change is not null and ret_pct is not null")
    down = c("p25_change") < 0
    return rows.groupBy("horizon").agg(F.count_if(c("p25_change") > 0).alias("up"), F.count_if(down).alias("down"), F.count_if(c("p25_change") == 0).alias("flat"), F.count_if(down & (c("ret_pct") < c("p25_change"))).alias("fell_more"))
