"""Prices, ratios, option returns and accruals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.stats import ratio


def pct_off_high(price: Column, high: Column) -> Column:
    return F.when(high > 0, F.greatest(F.lit(0.0), (high - price) / high * 100)).otherwise(0.0)


def pct_above_low(price: Column, low: Column) -> Column:
    return F.when(low > 0, F.greatest(F.lit(0.0), (price - low) / low * 100)).otherwise(0.0)


def roic(ebit: Column, equity: Column, debt: Column, cash: Column, tax: float = 0.21) -> Column:
    return ratio(ebit * (1 - tax), equity + debt - F.coalesce(cash, F.lit(0.0)))


def shares_scale(reported: Column, authoritative: Column, tolerance: float = 0.3) -> Column:
    """1, 1e3, 1e6 or 1e9: what brings reported within tolerance of authoritative, else 1."""
    near = lambda k: F.abs(reported * k / authoritative - 1) <= tolerance
    return F.when(~((reported > 0) & (authoritative > 0)), 1.0).when(near(1.0), 1.0).when(near(1e3), 1e3).when(near(1e6), 1e6).when(near(1e9), 1e9).otherwise(1.0)


def price_inconsistent(price: Column, implied_a: Column, implied_b: Column, bound: float = 0.5) -> Column:
    """Both implied prices deviate from price by more than bound."""
    off = lambda x: F.abs(x / price - 1) > bound
    return F.coalesce((price > 0) & off(implied_a) & off(implied_b), F.lit(False))


def ebitda(operating_income: Column, depreciation: Column) -> Column:
    return operating_income + F.coalesce(depreciation, F.lit(0.0))


def gross_profit(reported: Column, revenue: Column, cost: Column) -> Column:
    return F.coalesce(reported, revenue - cost)


def free_cash_flow(operating: Column, capex: Column) -> Column:
    return operating - F.abs(F.coalesce(capex, F.lit(0.0)))


def total_debt(long_total: Column, noncurrent: Column, current: Column, short: Column) -> Column:
    """The reported total, else its parts; plus short-term borrowing; null when nothing is reported."""
    zero = F.lit(0.0)
    parts = F.when(noncurrent.isNotNull() | current.isNotNull(), F.coalesce(noncurrent, zero) + F.coalesce(current, zero))
    base = F.coalesce(long_total, parts)
    return F.when(base.isNotNull() | short.isNotNull(), F.coalesce(base, zero) + F.coalesce(short, zero))


def strike_increment(price: Column) -> Column:
    return F.when(price < 25, 2.5).when(price < 200, 5.0).otherwise(10.0)


def call_premium_pct(iv: Column, years: Column, upside_pct: Column) -> Column:
    """Estimated premium of a call in percent of spot; 0 where iv or years are not above 0. An upside below 0 counts as 0."""
    upside = F.greatest(F.lit(0.0), upside_pct)
    raw = 100 * iv * F.sqrt(years) * 0.4 * F.greatest(F.lit(0.1), 1 - upside / 60)
    return F.when((years > 0) & (iv > 0), F.greatest(F.lit(0.5), raw)).otherwise(0.0)


def annualised(ret: Column, days: Column) -> Column:
    """A return over days as one a year, without compounding; 0 where days are not above 0."""
    return F.when(days > 0, ret * 365 / days).otherwise(0.0)


#: Days to expiry below which a contract's yearly figures are not repeatable.
SHORT_DATED = 30


def covered_call(spot: Column, strike: Column, bid: Column, days: Column, dividend: Column | None = None) -> dict[str, Column]:
    """Returns of holding a share against a sold call, as shares of spot; dividend is a year's amount a share."""
    income = bid + (dividend if dividend is not None else F.lit(0.0)) * days / 365
    of_spot = lambda x: F.when(spot > 0, x / spot).otherwise(0.0)
    static, assigned = of_spot(income), of_spot(income + strike - spot)
    return {
        "static_return": static, "assigned_return": assigned, "static_annual": annualised(static, days), "assigned_annual": annualised(assigned, days),
        "cost_basis": spot - bid, "cost_discount": of_spot(bid), "short_dated": days < SHORT_DATED,
    }


def cash_put(spot: Column, strike: Column, bid: Column, days: Column) -> dict[str, Column]:
    """Returns of a put sold against cash: on the strike, and the discount of its basis to spot."""
    kept = F.when(strike > 0, bid / strike).otherwise(0.0)
    return {"put_return": kept, "put_annual": annualised(kept, days), "basis": strike - bid, "discount": F.when(spot > 0, (spot - (strike - bid)) / spot).otherwise(0.0), "short_dated": days < SHORT_DATED}


def option_value(spot: Column, strike: Column, iv: Column, days: Column, is_put: bool, rate: float = 0.04, dividend: float = 0.02) -> Column:
    """Estimated value of an option a share: what carrying it in the money is worth, plus time value by its distance from spot; intrinsic at expiry."""
    years = days / 365
    k, s = strike * F.exp(-rate * years), spot * F.exp(-dividend * years)
    carried = F.greatest(F.lit(0.0), (k - s) if is_put else (s - k))
    time_value = call_premium_pct(iv, years, F.abs((strike - spot) / spot * 100)) / 100 * spot
    return F.when(days <= 0, F.greatest(F.lit(0.0), (strike - spot) if is_put else (spot - strike))).otherwise(carried + time_value)


def intrinsic(spot: Column, strike: Column, kind: Column) -> Column:
    """What an option is in the money a share; null without a spot."""
    return F.when(spot.isNull(), None).when(kind.contains("put"), F.greatest(F.lit(0.0), strike - spot)).otherwise(F.greatest(F.lit(0.0), spot - strike))


def simple_interest(amount: Column, pct: Column, start: Column, end: Column) -> Column:
    return amount * (1 + pct / 100 * F.greatest(F.lit(0), F.datediff(end, start)) / 365)


def daily_compound(amount: Column, rate: Column, days: Column) -> Column:
    return amount * F.pow(1 + rate / 365, F.greatest(F.lit(0), days))


def cumulative_yield(rate: Column, years: Column) -> Column:
    return F.pow(1 + rate, years) - 1


def _change_class(start: Column, end: Column, tolerance_pct: float, down: str, same: str, up: str) -> Column:
    pct = (end - start) / start * 100
    return F.when(pct < -tolerance_pct, down).when(pct <= tolerance_pct, same).otherwise(up)


def non_recovery_class(entry: Column, final: Column, tolerance_pct: float = 5) -> Column:
    """What a name that did not come back has done from entry to the last price: lost, stable or partial-gain."""
    return F.when(~(entry > 0), "stable").otherwise(_change_class(entry, final, tolerance_pct, "lost", "stable", "partial-gain"))


def fv_direction(entry: Column, exit_: Column, tolerance_pct: float = 5) -> Column:
    """How a fair value moved: declining, flat or improving; no value to start from is flat, none at the end is declining."""
    return (
        F.when(~F.coalesce(entry > 0, F.lit(False)), "flat")
        .when(~F.coalesce(exit_ > 0, F.lit(False)), "declining")
        .otherwise(_change_class(entry, exit_, tolerance_pct, "declining", "flat", "improving"))
    )


def premium_yield_pct(premium: Column, collateral: Column, entry: Column, expiration: Column) -> Column:
    """A position's premium in percent of its collateral a year, over the contract's life from entry; null without life or collateral."""
    life = F.datediff(expiration, entry)
    return F.when((life > 0) & (collateral > 0), premium / collateral * 365 / life * 100)
