"""Expiration choice, strike snapping, covered-call and put views, capital plans."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import dates
from rankweave.functions.finance import annualised, cash_put, covered_call, option_value, strike_increment


def select_expirations(rows: DataFrame, today: str = "today", by: str = "symbol", expiration: str = "expiration") -> DataFrame:
    """(by, kind, expiration): the next expiration (weekly), the monthly one after it, and the next January's (yearly).

    Only dates strictly after today count. Monthly: the earliest month with an expiration in its third
    week after the weekly one; the Friday there, else the latest day. Yearly: the same of the earliest
    January after the monthly one, or after the weekly one where there is no monthly.
    """
    rows = rows.select(by, F.col(today).alias("_t"), F.col(expiration).alias("_e")).distinct().where("_e > _t")
    third = rows.withColumn("_m", F.when(dates.in_third_week(F.col("_e")), F.trunc("_e", "month")))
    # a symbol's expirations are few: they stay in one row
    each = third.groupBy(by).agg(F.min("_e").alias("weekly"), F.array_sort(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct("_m", dates.is_friday(F.col("_e")).alias("friday"), F.col("_e").alias("e"))))).alias("_all"))

    def slot(after: str, january: bool) -> Column:
        open_ = F.filter("_all", lambda x: (x["e"] > F.col(after)) & ((F.month(x["e"]) == 1) if january else F.lit(True)))
        month = F.filter(open_, lambda x: x["_m"] == F.get(open_, F.lit(0))["_m"])
        friday = F.filter(month, lambda x: x["friday"])
        return F.coalesce(F.get(friday, F.lit(0))["e"], F.get(month, F.size(month) - 1)["e"])

    all3 = each.withColumn("monthly", slot("weekly", False)).withColumn("_floor", F.coalesce("monthly", "weekly")).withColumn("yearly", slot("_floor", True))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("expiration")) for k in ("weekly", "monthly", "yearly")]))
    return all3.select(by, kinds.alias("_x")).select(by, "_x.*").where("expiration is not null")


def snap_strike(strike: Column, target: Column, above: bool) -> Column:
    """Aggregate: the nearest strike at or above target (else the greatest), or at or below (else the smallest)."""
    if above:
        return F.coalesce(F.min(F.when(strike >= target, strike)), F.max(strike))
    return F.coalesce(F.max(F.when(strike <= target, strike)), F.min(strike))


def options_view(chain: DataFrame, values: DataFrame, by: str = "symbol") -> DataFrame:
    """One row per (by, expiration) of the chain: the covered call snapped to p25 and the put of highest strike eligible, with their returns.

    chain: by, expiration, side, strike, bid, iv, days, volume, open_interest; values: by, spot, p25,
    dividend (a year's, a share). A call needs p25 and its strike above spot and a bid. A put needs spot
    below p25, a strike from 75 % of spot to below it, a bid worth 10 a contract and an implied
    volatility. A snapped strike over 5 % off p25 is marked. What is not eligible is null.
    """
    c = chain.join(values, by)
    key = [by, "expiration"]
    legs = {}
    snapped = c.where("side = 'call' and p25 > spot").groupBy(*key).agg(snap_strike(F.col("strike"), F.col("p25"), True).alias("strike"))
    legs["call"] = c.where("side = 'call'").join(snapped, [*key, "strike"]).where("strike > spot and bid > 0")
    legs["put"] = c.where("side = 'put' and spot < p25 and strike >= 0.75 * spot and strike < spot and bid > 0 and iv > 0 and bid * 100 >= 10")
    out = chain.select(*key).distinct()
    for name, rows in legs.items():
        x = rows.groupBy(*key).agg(F.max(F.struct("strike", "bid", "days", "spot", "p25", "dividend", "volume", "open_interest")).alias("x")).select(*key, "x.*")
        f = [F.col(k) for k in ("spot", "strike", "bid", "days")]
        returns = covered_call(*f, F.col("dividend")) if name == "call" else cash_put(*f)
        told = {"strike": F.col("strike"), "bid": F.col("bid"), "snap_off": F.abs(F.col("strike") - F.col("p25")) / F.col("p25"), "idle": (F.col("volume") == 0) & (F.col("open_interest") == 0), **returns}
        out = out.join(x.select(*key, *[v.alias(k if k.startswith("put_") or k in ("basis", "discount") else f"{name}_{k}") for k, v in told.items()]), key, "left")
    return out.withColumns({f"{n}_snap_warning": F.col(f"{n}_snap_off") > 0.05 for n in legs})


def best_returns(view: DataFrame, days: str = "days", least_days: int = 30, by: str = "symbol") -> DataFrame:
    """Best annualised call and put per symbol among expirations of at least least_days."""
    far = F.col(days) >= least_days
    return view.groupBy(by).agg(F.max(F.when(far, F.col("call_static_annual"))).alias("best_call"), F.max(F.when(far, F.col("put_annual"))).alias("best_put"))


def audit_options(view: DataFrame, values: DataFrame, summary: DataFrame, by: str = "symbol") -> DataFrame:
    """Findings (by, expiration, side, severity, rule) of an options view, of its symbols, and of their best returns.

    values: by, spot; summary: by, best_call, best_put. Findings of a symbol have no expiration and side.
    """
    # fixed values: the rules' names and bounds
    legs = {
        "call": [("CRITICAL", "ITM call survived", "call_strike < spot"), ("WARN", "Zero liquidity contract", "call_idle"), ("INFO", "Short-dated covered call", "call_short_dated"), ("WARN", "Hard snap (>10% off anchor)", "call_snap_off > 0.10")],
        "put": [("CRITICAL", "ITM put survived", "put_strike > spot"), ("CRITICAL", "Put effective cost > spot", "basis > spot"), ("WARN", "Zero liquidity contract", "put_idle"), ("INFO", "Short-dated put", "put_short_dated"), ("WARN", "Hard snap (>10% off anchor)", "put_snap_off > 0.10")],
    }
    whole = [("WARN", "No contracts after filters", "n = 0"), ("WARN", "Single-contract chain", "n = 1")]
    rolled = [("WARN", "Best Call > 50% annualized", "best_call > 0.50"), ("WARN", "Best Put > 30% annualized", "best_put > 0.30")]
    none = F.lit(None)

    def found(rows: DataFrame, expiration: Column, side: Column, rules) -> DataFrame:
        hit = F.array(*[F.when(F.expr(cond), F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"))) for sev, rule, cond in rules])
        return rows.select(by, expiration.cast("date").alias("expiration"), side.cast("string").alias("side"), F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("_f")).select(by, "expiration", "side", "_f.*")

    priced = view.join(values.select(by, "spot"), by)
    n = view.groupBy(by).agg(F.sum(F.col("call_strike").isNotNull().cast("int") + F.col("put_strike").isNotNull().cast("int")).alias("n"))
    out = found(n, none, none, whole).unionByName(found(summary, none, none, rolled))
    for side, rules in legs.items():
        out = out.unionByName(found(priced, F.col("expiration"), F.lit(side), rules))
    return out


def capital_plan(candidates: DataFrame, capital: str = "capital", by: str = "plan_id", top: int | None = None, excluded: str | None = None) -> DataFrame:
    """Contracts per candidate of a plan: an equal share of capital each, then the rest in rank order, one contract a round.

    candidates: by, rank, symbol, strike, premium_per_share, annual, capital. excluded names a boolean
    column: such names stay with no contracts and take no place among the top. Names beyond the top
    disappear. Without capital above 0 nothing is bought. One plan is one small group; plans are spread
    over tasks.
    """
    out = F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(False)
    rows = candidates.withColumn("_out", out)
    w = Window.partitionBy(by)
    if top is not None:
        place = F.count(F.when(~F.col("_out"), 1)).over(w.orderBy("rank", "symbol").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_place", place).where(F.col("_out") | (F.col("_place") <= top)).drop("_place")
        rows = rows if top > 0 else rows.limit(0)
    money = F.when((F.col(capital) > 0) & (F.abs(capital) < float("inf")), F.col(capital)).otherwise(0.0)
    rows = rows.withColumns({"_money": money, "_cost": (F.col("strike") * 100).cast("double"), "_n": F.count(F.when(~F.col("_out"), 1)).over(w)})
    usable = ~F.col("_out") & (F.col("_cost") > 0) & (F.col("_money") > 0)
    rows = rows.withColumn("_base", F.when(usable, F.floor(F.col("_money") / F.col("_n") / F.col("_cost"))).otherwise(0).cast("long"))

    @F.pandas_udf("array<long>")
    def top_up(base: pd.Series, cost: pd.Series, money: pd.Series) -> pd.Series:
        told = []
        for n, costs, left in zip(base, cost, money):
            n, costs = n.tolist(), costs.tolist()
            left -= sum(a * b for a, b in zip(n, costs))
            more = True
            while more:
                more = False
                for k, c in enumerate(costs):
                    if 0 < c <= left:
                        n[k] += 1
                        left -= c
                        more = True
            told.append(n)
        return pd.Series(told)

    # a plan is one row, many of them one batch
    plans = rows.withColumn("_cost", F.when(F.col("_out"), 0.0).otherwise(F.col("_cost"))).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "symbol", "_base", "_cost", "_money", "premium_per_share", "annual"))).alias("_s"))
    field = lambda x: F.transform("_s", lambda s: s[x])
    told = plans.withColumn("_k", top_up(field("_base"), field("_cost"), F.col("_s")[0]["_money"]))
    told = told.select(by, F.explode(F.zip_with("_s", "_k", lambda s, k: F.struct(s.alias("s"), k.alias("contracts")))).alias("_x")).select(by, "_x.s.*", "_x.contracts")
    n = F.col("contracts")
    return told.select(by, "symbol", n, (n * F.col("_cost")).alias("collateral"), (n * F.col("premium_per_share") * 100).cast("double").alias("premium"), F.col("annual").cast("double").alias("annual"))


def plan_totals(plan: DataFrame, by: str = "plan_id") -> DataFrame:
    """Per plan: contracts, collateral, premium, and yield, the yearly return weighted by collateral; null where nothing is allocated."""
    spent = F.sum("collateral")
    return plan.groupBy(by).agg(F.sum("contracts").alias("contracts"), spent.alias("collateral"), F.sum("premium").alias("premium"), F.when(spent > 0, F.sum(F.col("collateral") * F.col("annual")) / spent).alias("yield"))


#: Fixed value: the yearly rate that idle cash earns where none is given.
CASH_RATE = 0.033


def trade_legs(rows: DataFrame, cash_rate: float = CASH_RATE) -> DataFrame:
    """Five trades per row, held to expiry: capital, gains by source, total, roi, annual, assigned.

    rows: spot, days, dividend (a year's, a share), call_strike, call_bid, put_strike, put_bid, and the
    scenario's end price target. A trade whose contract is missing has nulls for all figures. buyWrite
    buys shares net of the premium; coveredCall holds shares at their market value, and its premium and
    cashSecuredPut's strike and premium earn the cash rate; holdCash earns it on the share's price.
    """
    c = F.col
    p, t, end = c("spot"), c("days") / 365, c("target")
    zero, none = F.lit(0.0), F.lit(None).cast("boolean")
    dividend = c("dividend") * t
    called, assigned = end >= c("call_strike"), end < c("put_strike")
    capped = F.when(called, c("call_strike") - p).otherwise(end - p)
    has_call, has_put = c("call_strike").isNotNull() & c("call_bid").isNotNull(), c("put_strike").isNotNull() & c("put_bid").isNotNull()
    cash = lambda amount: amount * cash_rate * t

    def leg(k, name, has, capital, stock, dividends, premium, interest, given):
        told = lambda x: F.when(has, x).cast("double")
        return F.struct(F.lit(k).alias("leg_order"), F.lit(name).alias("leg"), told(capital).alias("capital"), told(stock).alias("stock_gain"), told(dividends).alias("dividend_gain"), told(premium).alias("premium_gain"), told(interest).alias("cash_gain"), F.when(has, given).alias("assigned"))

    always = F.lit(True)
    legs = F.array(
        leg(0, "buyOutright", always, p, end - p, dividend, zero, zero, none),
        leg(1, "buyWrite", has_call, p - c("call_bid"), capped, dividend, c("call_bid"), zero, called),
        leg(2, "coveredCall", has_call, p, capped, dividend, c("call_bid"), cash(c("call_bid")), called),
        leg(3, "cashSecuredPut", has_put, c("put_strike"), F.when(assigned, end - c("put_strike")).otherwise(0.0), zero, c("put_bid"), cash(c("put_strike") + c("put_bid")), assigned),
        leg(4, "holdCash", always, p, zero, zero, zero, cash(p), none),
    )
    out = rows.select(*rows.columns, F.explode(legs).alias("_l")).select(*rows.columns, "_l.*")
    total = c("stock_gain") + c("dividend_gain") + c("premium_gain") + c("cash_gain")
    out = out.withColumn("total", total).withColumn("roi", F.when(c("capital") > 0, c("total") / c("capital")).when(c("capital").isNotNull(), 0.0))
    return out.withColumn("annual", F.when(c("roi").isNotNull(), annualised(c("roi"), c("days"))))


def best_leg(legs: DataFrame, by: list[str]) -> DataFrame:
    """The trade of highest yearly return; of equal ones the first in order."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("annual"), "leg_order")
    return legs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def end_price(scenario: Column, spot: Column, p25: Column, median: Column) -> Column:
    """The price a scenario ends at: p25, flat (spot) or median."""
    return F.when(scenario == "p25", p25).when(scenario == "flat", spot).otherwise(median)


def plan_candidates(ranked: DataFrame, view: DataFrame, kind: str = "monthly") -> DataFrame:
    """Ranked names (bucket = ranked) with a put at the expiration of a kind: symbol, rank, strike, premium_per_share, days, annual, composite, best composite first."""
    puts = view.where((F.col("kind") == kind) & F.col("put_strike").isNotNull())
    rows = ranked.where("bucket = 'ranked'").join(puts.select("symbol", F.col("put_strike").alias("strike"), F.col("put_bid").alias("premium_per_share"), "days", F.col("put_annual").alias("annual")), "symbol")
    return rows.select("d", "symbol", "composite", "strike", "premium_per_share", "days", "annual", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("composite"), "symbol")).alias("rank"))


#: Strikes tried, as shares of spot.
STRIKE_GRID = (0.80, 0.85, 0.90, 0.93, 0.95, 0.97, 0.99, 1.00)


def put_strike_search(rows: DataFrame, grid: Sequence[float] = STRIKE_GRID) -> DataFrame:
    """rows (spot, p25, iv, days) with put_strike, put_premium and time_yield: of the strikes of the grid at most p25 the one of best time value on the strike.

    Time value is the estimated value less what is naively in the money; of equal ones the lowest strike wins, and without any above 0 the columns are null.
    """
    c = F.col

    def tried(g: float) -> Column:
        strike = c("spot") * g
        value = option_value(c("spot"), strike, c("iv"), c("days"), True)
        time = value - F.greatest(F.lit(0.0), strike - c("spot"))
        return F.when((strike <= c("p25")) & (time > 0), F.struct((time / strike).alias("time_yield"), F.lit(-g).alias("_down"), strike.alias("put_strike"), value.alias("put_premium")))

    best = F.array_max(F.array_compact(F.array(*[tried(g) for g in grid])))
    return rows.withColumn("_best", best).withColumns({x: c("_best")[x] for x in ("put_strike", "put_premium", "time_yield")}).drop("_best")


def money_weighted_return(flows: DataFrame, by: str = "account_id", date: str = "date", amount: str = "amount", low: float = -0.99, high: float = 10.0) -> DataFrame:
    """Yearly rate at which an account's dated flows are worth nothing, by bisection; 0 under two flows or without a sign change."""
    c, start = F.col, F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))
    daily = flows.groupBy(by, date).agg(F.sum(amount).alias("a"))
    # at most one flow a date
    g = daily.groupBy(by).agg(F.min(date).alias("_d0"), F.sort_array(F.collect_list(F.struct(date, "a"))).alias("_f"))
    g = g.withColumn("_f", F.filter(F.transform("_f", lambda x: F.struct((F.datediff(x[date], "_d0") / 365.25).alias("y"), x["a"].alias("a"))), lambda x: x["y"].isNotNull() & x["a"].isNotNull() & ~F.isnan(x["a"])))
    value = lambda r: F.aggregate("_f", F.lit(0.0), lambda s, x: s + x["a"] / F.pow(1 + r, x["y"]))
    g = g.withColumns({"_low": value(F.lit(low)), "_high": value(F.lit(high))})
    # the value at the lower end keeps its sign
    half = lambda s: F.transform(F.array((s["a"] + s["b"]) / 2), lambda m: F.when(c("_low") * value(m) > 0, F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b"))))[0]
    found = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, lambda s, _: half(s), lambda s: (s["a"] + s["b"]) / 2)
    return g.select(by, F.when((F.size("_f") >= 2) & (c("_low") * c("_high") < 0), found).otherwise(0.0).alias("rate"))


def liquid_symbols(summary: DataFrame) -> DataFrame:
    """The symbols of a summary of best returns that have both a call and a put."""
    return summary.where("best_call is not null and best_put is not null").select("symbol")


def top_candidates(rows: DataFrame, value: str, n: int, by: str = "d") -> DataFrame:
    """The n rows of largest value at each date with rank, the strike slightly below price, a contract's capital, and the capital's class."""
    w = Window.partitionBy(by).orderBy(F.desc(value), "symbol")
    top = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    step = F.when(F.col("price") < 50, 2.5).when(F.col("price") < 200, 5.0).otherwise(10.0)
    top = top.withColumn("strike", F.floor(F.col("price") * 0.95 / step) * step).withColumn("capital", (F.col("strike") * 100).cast("double"))
    k = F.col("capital")
    return top.withColumn("capital_class", F.when(k < 3000, "<$3k").when(k < 7000, "$3-7k").when(k < 15000, "$7-15k").when(k < 30000, "$15-30k").otherwise("$30k+"))
