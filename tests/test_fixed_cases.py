"""Fixed inputs with known results: options, trades, plans, positions, directions, removals, quarters, and back-test parts against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import finance, stats
from rankweave.operators import fair_value, fundamentals, membership, options, portfolio, ranking
from rankweave.operators import reference_data as ref
from rankweave.plans import backtest as bt
from rankweave.plans import outcomes

D = dt.date.fromisoformat


def row(spark, **values):
    """A table of one row; a value is (type, value) or a float."""
    kinds = {k: (v[0] if isinstance(v, tuple) else "double") for k, v in values.items()}
    return spark.createDataFrame([tuple(v[1] if isinstance(v, tuple) else v for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))


# ---- options


def test_call_premium(spark):
    cases = [((0.25, 2.0, 0.0), 100 * 0.25 * math.sqrt(2) * 0.4), ((0.25, 2.0, -20.0), 100 * 0.25 * math.sqrt(2) * 0.4), ((0.25, 2.0, 30.0), 100 * 0.25 * math.sqrt(2) * 0.2), ((0.25, 2.0, 500.0), 100 * 0.25 * math.sqrt(2) * 0.04), ((0.25, 0.0, 0.0), 0.0), ((0.0, 1.0, 0.0), 0.0), ((0.01, 0.01, 0.0), 0.5)]
    df = spark.createDataFrame([c for c, _ in cases], "iv double, t double, up double")
    got = [r.p for r in df.select(finance.call_premium_pct(F.col("iv"), F.col("t"), F.col("up")).alias("p")).collect()]
    assert got == pytest.approx([w for _, w in cases])


CHAIN = "symbol string, expiration date, side string, strike double, bid double, iv double, days double, volume long, open_interest long"


def view_of(spark, contracts, spot, p25, dividend=0.0):
    chain = spark.createDataFrame([("A", D("2026-06-19"), *c) for c in contracts], CHAIN)
    values = spark.createDataFrame([("A", spot, p25, dividend)], "symbol string, spot double, p25 double, dividend double")
    return options.options_view(chain, values), values


def test_options_view(spark):
    puts = [("put", 95.0, 4.6, 0.4, 3.0, 1, 1), ("put", 70.0, 2.0, 0.4, 3.0, 1, 1), ("put", 96.0, 5.0, 0.4, 3.0, 1, 1), ("put", 94.0, 0.05, 0.4, 3.0, 1, 1)]
    calls = [("call", 120.0, 1.0, 0.4, 365.0, 1, 1), ("call", 125.0, 2.0, 0.4, 365.0, 1, 1), ("call", 130.0, 3.0, 0.4, 365.0, 0, 0)]
    view, values = view_of(spark, puts + calls, 95.16, 123.96, 1.0)
    r = view.first()
    assert (r.put_strike, r.call_strike) == (95.0, 125.0)
    assert (r.put_return, r.put_annual, r.basis, r.discount) == pytest.approx((0.0484210526, 5.8912280702, 90.4, 0.0500210172))
    assert (r.call_static_return, r.call_assigned_return) == pytest.approx(((2 + 1) / 95.16, (2 + 1 + 125 - 95.16) / 95.16))
    assert r.put_short_dated and not r.call_short_dated and r.put_snap_warning and not r.call_snap_warning
    # at or above p25 there is no put; without a strike above spot no call
    assert view_of(spark, puts + calls, 95.16, 95.0)[0].first().put_strike is None
    assert view_of(spark, [("call", 90.0, 9.0, 0.4, 30.0, 1, 1)], 95.0, 120.0)[0].first().call_strike is None
    # no implied volatility, no bid
    assert view_of(spark, [("put", 95.0, 4.6, 0.0, 3.0, 1, 1), ("put", 90.0, 0.0, 0.4, 3.0, 1, 1)], 96.0, 120.0)[0].first().put_strike is None


def test_audit(spark):
    contracts = [("put", 95.0, 4.6, 0.4, 3.0, 0, 0), ("call", 150.0, 9.0, 0.4, 365.0, 1, 1)]
    view, values = view_of(spark, contracts, 95.16, 123.96)
    summary = spark.createDataFrame([("A", 0.6, 0.31)], "symbol string, best_call double, best_put double")
    got = {(r.side, r.severity, r.rule) for r in options.audit_options(view, values, summary).collect()}
    assert got == {
        ("put", "WARN", "Zero liquidity contract"), ("put", "INFO", "Short-dated put"), ("put", "WARN", "Hard snap (>10% off anchor)"), ("call", "WARN", "Hard snap (>10% off anchor)"),
        (None, "WARN", "Best Call > 50% annualized"), (None, "WARN", "Best Put > 30% annualized"),
    }
    none, values = view_of(spark, [("put", 200.0, 4.6, 0.4, 3.0, 1, 1)], 95.0, 120.0)
    assert {r.rule for r in options.audit_options(none, values, summary.limit(0)).collect()} == {"No contracts after filters"}


def test_expirations(spark):
    days = ["2026-04-26", "2026-05-01", "2026-05-15", "2026-06-18", "2026-06-17", "2027-01-15", "2027-01-20"]
    df = spark.createDataFrame([("A", D("2026-04-26"), D(x)) for x in days] + [("B", D("2026-04-26"), D("2027-01-15"))], "symbol string, today date, expiration date")
    got = {(r.symbol, r.kind): str(r.expiration) for r in options.select_expirations(df).collect()}
    assert got == {("A", "weekly"): "2026-05-01", ("A", "monthly"): "2026-05-15", ("A", "yearly"): "2027-01-15", ("B", "weekly"): "2027-01-15"}
    thursday = df.where("symbol = 'A' and expiration <> date '2026-05-15'")
    assert {r.kind: str(r.expiration) for r in options.select_expirations(thursday).collect()}["monthly"] == "2026-06-18"


def test_trade_legs(spark):
    base = dict(spot=100.0, days=270.0, dividend=2.0, call_strike=110.0, call_bid=8.0, put_strike=95.0, put_bid=5.0)
    legs = lambda **over: {r.leg: r for r in options.trade_legs(row(spark, **(base | over))).collect()}
    t = legs(target=120.0)
    own, covered, put, cash, write = (t[x] for x in ("buyOutright", "coveredCall", "cashSecuredPut", "holdCash", "buyWrite"))
    rate = 0.033 * 270 / 365
    assert (own.stock_gain, own.dividend_gain, own.total, own.roi, own.annual) == pytest.approx((20, 1.4795, 21.4795, 0.21479, 0.29036), abs=1e-4)
    assert (covered.capital, covered.stock_gain, covered.cash_gain, covered.total, covered.assigned) == pytest.approx((100, 10, 8 * rate, 10 + 1.47945 + 8 + 8 * rate, True), abs=1e-4)
    assert (put.capital, put.stock_gain, put.cash_gain, put.total, put.assigned) == pytest.approx((95, 0, 100 * rate, 5 + 100 * rate, False), abs=1e-6)
    assert (cash.total, cash.annual) == pytest.approx((100 * rate, 0.033), abs=1e-6)
    assert (write.capital, write.cash_gain, write.total) == pytest.approx((92, 0, 10 + 1.47945 + 8), abs=1e-4)
    low = legs(target=80.0)["cashSecuredPut"]
    assert low.assigned and low.stock_gain == -15
    flat = legs(target=100.0)["coveredCall"]
    assert not flat.assigned and flat.stock_gain == 0
    none = legs(target=120.0, call_strike=("double", None))
    assert none["coveredCall"].total is None and none["buyWrite"].annual is None
    assert options.best_leg(options.trade_legs(row(spark, **base, target=120.0)), ["spot"]).first().leg == "buyOutright"


@pytest.mark.parametrize(
    "capital,strikes,want,yield_",
    [(30000.0, [50, 100, 25], [2, 1, 4], 0.18), (25000.0, [50, 40], [2, 3], 0.18), (30000.0, [50, 40], [3, 3], 0.18), (0.0, [50, 40], [0, 0], None), (-5.0, [50], [0], None), (None, [50], [0], None), (1000.0, [50], [0], None), (9000.0, [50, 0], [1, 0], 0.18), (20000.0, [300, 20], [0, 10], 0.18)],
)
def test_capital_plan(spark, capital, strikes, want, yield_):
    rows = [("p", k, "ABCDE"[k], float(x), 1.5, 0.18, capital) for k, x in enumerate(strikes)]
    df = spark.createDataFrame(rows, "plan_id string, rank int, symbol string, strike double, premium_per_share double, annual double, capital double")
    plan = options.capital_plan(df)
    assert [r.contracts for r in plan.orderBy("symbol").collect()] == want
    total = options.plan_totals(plan).first()
    assert total["yield"] == (yield_ if yield_ is None else pytest.approx(yield_))


def test_capital_plan_top_and_excluded(spark):
    rows = [("p", k, s, 50.0, 1.0, 0.1 * (k + 1), 20000.0, s == "A") for k, s in enumerate("ABCD")]
    df = spark.createDataFrame(rows, "plan_id string, rank int, symbol string, strike double, premium_per_share double, annual double, capital double, skip boolean")
    plan = options.capital_plan(df, top=2, excluded="skip")
    assert {r.symbol: r.contracts for r in plan.collect()} == {"A": 0, "B": 2, "C": 2}
    assert options.plan_totals(plan).first()["yield"] == pytest.approx(0.25)
    assert options.capital_plan(df, top=0).count() == 0


# ---- positions

POSITION = "account_id long, id string, kind string, symbol string, entry_date date, shares double, cost_basis double, option_type string, contracts double, strike double, expiration date, premium double, paired_stock_id string, amount double, yield_pct double"
MARKET = "symbol string, price double, bucket string, composite double, fv_median double, fv_p75 double"


def positions(spark, rows, market, today="2026-04-26"):
    names = [c.split()[0] for c in POSITION.split(", ")]
    base = {"account_id": 1, "entry_date": D("2026-01-15")}
    df = spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], POSITION)
    return portfolio.evaluate_positions(df, spark.createDataFrame(market, MARKET), F.lit(today).cast("date"))


def option(id, kind, contracts, strike, premium, expiration="2026-06-19", symbol="X", **more):
    return {"id": id, "kind": "option", "symbol": symbol, "option_type": kind, "contracts": float(contracts), "strike": float(strike), "premium": float(premium), "expiration": D(expiration), **more}


def test_positions(spark):
    stock = {"id": "s", "kind": "stock", "symbol": "X", "shares": 100.0, "cost_basis": 18000.0}
    rows = [
        stock, option("long", "call", 1, 200, 350), option("covered", "call", -1, 200, 600, paired_stock_id="s"), option("csp", "put", -2, 180, 400), option("naked", "call", -1, 200, 600), option("gone", "put", -1, 200, 300, "2026-04-21"),
        option("near", "put", -1, 200, 300, "2026-05-16"), option("far", "put", -1, 200, 300, "2026-05-18"), option("late", "put", -1, 200, 300, "2026-01-10"), option("unknown", "put", -1, 100, 300, symbol="Z"),
        {"id": "lost", "kind": "stock", "symbol": "Z", "shares": 10.0, "cost_basis": 1000.0}, {"id": "cash", "kind": "cash", "symbol": "USD", "amount": 10000.0, "yield_pct": 5.0, "entry_date": D("2026-01-01")},
    ]
    market = [("X", 195.0, "watch", 40.0, 150.0, 240.0), *[(f"T{i}", 1.0, "ranked", 50.0 + i, None, None) for i in range(4)]]
    got = {r.id: r for r in positions(spark, rows, market).collect()}
    assert (got["s"].market_value, got["s"].profit, got["s"].profit_pct) == (19500.0, 1500.0, pytest.approx(100 / 12))
    assert got["s"].sell_signals == ["price-at-or-above-fv-median", "composite-below-universe-median"]
    assert (got["long"].cash_at_entry, got["long"].intrinsic_dollars, got["long"].days_to_expiration, got["long"].premium_yield_pct) == (-350.0, 0.0, 54, None)
    assert got["covered"].premium_yield_pct == pytest.approx(600 / 18000 * 365 / 155 * 100)
    assert got["csp"].premium_yield_pct == pytest.approx(2.617, abs=1e-3) and got["naked"].premium_yield_pct is None and got["late"].premium_yield_pct is None
    assert (got["gone"].is_expired, got["gone"].near_expiration, got["near"].near_expiration, got["far"].near_expiration) == (True, False, True, False)
    assert got["near"].in_the_money and not got["csp"].in_the_money and got["unknown"].in_the_money is None and got["unknown"].value is None
    assert got["lost"].market_value is None and got["lost"].value == 1000.0 and got["lost"].sell_signals == []
    assert got["cash"].accrued_interest == pytest.approx(10000 * 0.05 * 115 / 365)
    total = portfolio.summarise(positions(spark, rows, market)).first()
    assert (total.positions, total.stocks, total.options, total.cash_positions, total.stocks_in_snapshot, total.with_sell_signal) == (12, 2, 9, 1, 1, 1)
    assert total.value == pytest.approx(19500 + 1000 + 10000 + 10000 * 0.05 * 115 / 365 - 4 * 5 * 100)


def test_sell_signals_of_the_bottom(spark):
    market = [("X", 180.0, "avoid", 5.0, 150.0, 180.0), ("Y", 1.0, "ranked", 50.0, None, None)]
    r = positions(spark, [{"id": "s", "kind": "stock", "symbol": "X", "shares": 1.0, "cost_basis": 0.0}], market).first()
    assert r.sell_signals == ["in-avoid-bucket", "price-at-or-above-fv-p75"] and r.profit_pct is None


def test_milestones(spark):
    stock = {"id": "s", "kind": "stock", "symbol": "X", "shares": 100.0, "cost_basis": 18000.0}
    rows = [stock, option("long", "call", 1, 250, 200), option("covered", "call", -1, 200, 600, paired_stock_id="s"), option("put", "put", -1, 180, 300, paired_stock_id="s"), option("low", "call", -1, 0.5, 10)]
    got = {(r.id, r.scenario): (r["at"], r.option_profit, r.combined_profit) for r in portfolio.milestones(positions(spark, rows, [("X", 220.0, "watch", 40.0, None, None)])).collect()}
    assert got["long", "expires-otm"] == (249.0, -200.0, None) and ("long", "assigned") not in got and ("long", "called-away") not in got
    assert got["covered", "called-away"] == (200.0, 600.0, 600.0 + 20000 - 18000)
    assert got["covered", "current-price"] == (220.0, 600.0 - 2000, -1400.0 + 22000 - 18000)
    assert got["put", "assigned"] == (180.0, 300.0, None) and got["put", "expires-otm"] == (181.0, 300.0, 300.0 + 18100 - 18000)
    assert got["low", "expires-otm"][0] == 0.0


# ---- rules


@pytest.mark.parametrize(
    "t,f,past,limit,want",
    [
        (5.0, 6.0, [4.0, 3.5, 3.0, 2.5], 5, "improving"), (3.0, 2.5, [3.5, 4.0, 5.0, 5.5], 5, "declining"), (5.0, 5.05, [4.0, 3.5, 3.0], 5, "stable"), (2.0, 3.0, [3.0, 4.0, 5.0], 5, "stable"),
        (13.26, 13.27, [13.26, 14.64, 12.20, 7.76, 7.49, 4.50, 4.93], 5, "declining"), (13.26, 13.27, [14.64, 12.20, 7.76, 7.49, 4.50], 5, "declining"), (15.40, 15.30, [14.64, 12.20, 7.76, 7.49, 4.50], 5, "stable"),
        (11.0, 11.5, [15.0, 14.0, 13.0, 10.0], 5, "declining"), (11.0, 14.0, [15.0, 14.0, 13.0, 10.0], 5, "stable"), (13.26, 11.0, [14.64, 12.20, 7.76], 5, "declining"), (-1.5, 2.0, [-2.0, -3.0, -2.5, -1.0], 5, "improving"),
        (2.0, -1.0, [3.0, 2.5, 2.0], 5, "declining"), (-1.0, -2.0, [-0.5, 1.0, 2.0], 5, "declining"), (None, 3.0, [2.5, 2.0], 5, "insufficient_data"), (3.0, 4.0, [2.5], 5, "insufficient_data"), (5.0, None, [4.0, 3.0, 2.5, 2.0], 5, "stable"),
        (5.0, 6.0, [4.0, None, 3.0, 2.5], 5, "improving"), (5.0, 5.3, [4.5, 4.0, 3.5], 10, "stable"), (-2.0, None, [-1.0, -3.0, -4.0], 5, "declining"), (-1.0, None, [2.0, -3.0, -4.0], 5, "declining"),
    ],
)
def test_fundamentals_direction(spark, t, f, past, limit, want):
    df = row(spark, t=("double", t), f=("double", f), past=("array<double>", past))
    assert df.select(ranking.fundamentals_direction(df, "t", "f", "past", limit).alias("x")).first().x == want


def test_recovery_classes(spark):
    kind = [(100.0, 94.0, "lost"), (100.0, 95.0, "stable"), (100.0, 105.0, "stable"), (100.0, 106.0, "partial-gain"), (0.0, 5.0, "stable")]
    got = spark.createDataFrame([(a, b) for a, b, _ in kind], "a double, b double").select(finance.non_recovery_class(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [w for *_, w in kind]
    way = [(100.0, 90.0, "declining"), (100.0, 104.0, "flat"), (100.0, 110.0, "improving"), (None, 50.0, "flat"), (0.0, 50.0, "flat"), (100.0, None, "declining"), (100.0, 0.0, "declining")]
    got = spark.createDataFrame([(a, b) for a, b, _ in way], "a double, b double").select(finance.fv_direction(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [w for *_, w in way]


def test_removal_reasons(spark):
    cases = [("Filed for bankruptcy after a merger", "bankruptcy"), ("Liquidated", "bankruptcy"), ("X acquired Y", "acquired"), ("Acquisition by Z", "acquired"), ("Leveraged buyout", "acquired"), ("Taken private", "acquired"), ("Spun off its unit", "other"), ("Spinoff", "spinoff"), ("Split off from W", "spinoff"), ("Market capitalization change", "market-cap-change"), ("Too small in size", "market-cap-change"), ("No longer of eligibility", "market-cap-change"), ("", "other"), (None, "other")]
    got = [r.x for r in spark.createDataFrame([(t,) for t, _ in cases], "t string").select(membership.removal_reason(F.col("t")).alias("x")).collect()]
    assert got == [w for _, w in cases]


def test_standalone_quarters(spark):
    facts = [
        ("A", "revenue", D("2024-01-01"), D("2024-03-31"), 10.0, 2024, "Q1", D("2024-05-01")), ("A", "revenue", D("2024-01-01"), D("2024-03-31"), 11.0, 2024, "Q1", D("2024-08-01")),
        # no quarter's own fact: the longest counts, though a shorter one was filed later
        ("A", "revenue", D("2024-01-01"), D("2024-06-30"), 25.0, 2024, "Q2", D("2024-08-01")), ("A", "revenue", D("2024-02-15"), D("2024-06-30"), 20.0, 2024, "Q2", D("2024-09-01")),
        ("A", "revenue", D("2024-01-01"), D("2024-09-30"), 40.0, 2024, "Q3", D("2024-11-01")), ("A", "revenue", D("2024-01-01"), D("2024-12-31"), 60.0, 2024, "FY", D("2025-02-01")),
        ("B", "revenue", D("2024-01-01"), D("2024-03-31"), 1.0, 2024, "Q1", D("2024-05-01")), ("B", "revenue", D("2024-04-01"), D("2024-06-30"), 2.0, 2024, "Q1", D("2024-08-01")), ("B", "revenue", D("2024-07-01"), D("2024-09-30"), 3.0, 2024, "Q3", D("2024-11-01")),
        ("B", "revenue", D("2024-01-01"), D("2024-12-31"), 9.0, 2024, "FY", D("2025-02-01")),
    ]
    df = spark.createDataFrame(facts, "symbol string, field string, start date, end date, val double, fy int, fp string, filed date")
    q = fundamentals.standalone_quarters(df)
    assert {(r.symbol, str(r.period_end)): r.val for r in q.collect()} == {("A", "2024-03-31"): 11.0, ("A", "2024-06-30"): 14.0, ("A", "2024-09-30"): 15.0, ("B", "2024-03-31"): 1.0, ("B", "2024-06-30"): 2.0, ("B", "2024-09-30"): 3.0}
    fourth = fundamentals.fourth_quarters(q, fundamentals.annual_values(df))
    assert [(r.symbol, r.val) for r in fourth.collect()] == [("A", 20.0)]  # B has two first quarters and no second


def test_own_multiples_leave_out_worthless_samples(spark):
    snap = row(spark, d=("date", D("2024-12-31")), symbol=("string", "A"))
    periods = row(spark, symbol=("string", "A"), period_end=("date", D("2024-12-31")), eps=1.0, ebitda=10.0, fcf=5.0, shares=10.0, debt=0.0, cash=90.0, price_end=10.0, price_high=20.0, price_low=8.0)
    r = fair_value.own_history(snap, periods).first()
    assert r.own_ev_to_ebitda == pytest.approx((1.0 + 11.0) / 2) and r.own_pe_ratio == 10.0  # 8 x 10 - 90 is below 0


def test_reference_data(spark):
    assert sum(map(len, ref.SUPER_GROUPS.values())) == len({x for g in ref.SUPER_GROUPS.values() for x in g}) and len(ref.SUPER_GROUPS) == 17
    df = spark.createDataFrame([("Tobacco", None, "Denmark"), ("Shell Companies", "CHF", "Denmark"), (None, None, None), ("Semiconductors", None, "Atlantis")], "i string, c string, n string")
    got = df.select(ref.super_group(F.col("i")).alias("g"), ref.reporting_currency(F.col("c"), F.col("n")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("consumer-staples", "DKK"), (None, "CHF"), (None, "USD"), ("semis-hardware", "USD")]


# ---- back-tests


def mulberry(seed):
    a = seed

    def draw():
        nonlocal a
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return (t ^ (t >> 14)) / 4294967296

    return draw


def test_draws_are_the_generators():
    draw = mulberry(42)
    assert stats.draws(42, 0, 5).tolist() == [draw() for _ in range(5)]
    assert stats.draws(42, 3, 2).tolist() == stats.draws(42, 0, 5).tolist()[3:]


@pytest.mark.parametrize("most", [4_000_000, 50])
def test_bootstrap_means(spark, most, monkeypatch):
    monkeypatch.setattr(stats, "DRAWS_A_ROW", most)
    r = random.Random(4)
    values = {g: [r.uniform(-5, 9) for _ in range(n)] for g, n in (("a", 1), ("b", 7), ("c", 40))}
    df = spark.createDataFrame([(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)], "g string, i long, v double").repartition(3)
    for x in stats.bootstrap_means(df, "v", ["g"], ["i"], 200, 42).collect():
        vs, draw = values[x.g], mulberry(42)
        means = sorted(sum(vs[int(draw() * len(vs))] for _ in vs) / len(vs) for _ in range(200))
        assert (x.n, x.mean, x.lo, x.hi) == pytest.approx((len(vs), sum(vs) / len(vs), means[5], means[195]))


def test_bootstrap_in_parts(spark, monkeypatch):
    """A group larger than a row may hold gives the same interval."""
    df = spark.createDataFrame([("a", i, float(i * i % 17)) for i in range(90)], "g string, i long, v double")
    whole = stats.bootstrap_means(df, "v", ["g"], ["i"], 50).first()
    monkeypatch.setattr(stats, "VALUES_A_ROW", 25)
    assert stats.bootstrap_means(df, "v", ["g"], ["i"], 50).first() == pytest.approx(whole)


def midranks(v):
    return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]


def rho(x, y):
    a, b = np.array(midranks(x)), np.array(midranks(y))
    a, b = a - a.mean(), b - b.mean()
    d = math.sqrt((a * a).sum() * (b * b).sum())
    return None if d == 0 else float((a * b).sum() / d)


def test_bootstraps_copy_nothing(spark, monkeypatch):
    """A group's values move once, whatever the resamples; a cell of any size has an interval."""
    r = random.Random(2)
    df = spark.createDataFrame([("a", i, r.random(), r.random()) for i in range(40)], "g string, i long, x double, y double")
    told = stats.bootstrap_spearman(df, "x", "y", ["g"], ["i"], 50).first()
    for name, plan in (("means", stats.bootstrap_means(df, "x", ["g"], ["i"])), ("spearman", stats.bootstrap_spearman(df, "x", "y", ["g"], ["i"]))):
        assert "Generate" not in plan._jdf.queryExecution().toString(), name
    monkeypatch.setattr(stats, "VALUES_A_ROW", 15)
    assert stats.bootstrap_spearman(df, "x", "y", ["g"], ["i"], 50).first() == pytest.approx(told)
    monkeypatch.setattr(stats, "DRAWS_A_ROW", 15)  # another stream
    other = stats.bootstrap_spearman(df, "x", "y", ["g"], ["i"], 400).first()
    assert (other.lo, other.hi) == pytest.approx((told.lo, told.hi), abs=0.25) and other.lo != told.lo


def test_bootstrap_spearman(spark):
    r = random.Random(5)
    groups = {"a": [(r.randint(0, 5), r.random()) for _ in range(12)], "few": [(1, 2)] * 4, "flat": [(1, i) for i in range(9)]}
    df = spark.createDataFrame([(g, i, float(x), float(y)) for g, ps in groups.items() for i, (x, y) in enumerate(ps)], "g string, i long, x double, y double")
    got = {x.g: x for x in stats.bootstrap_spearman(df, "x", "y", ["g"], ["i"], 60, 3).collect()}
    assert set(got) == {"a", "flat"} and got["flat"].lo is None
    draw, ps, found = mulberry(3), groups["a"], []
    for _ in range(60):
        at = [int(draw() * len(ps)) for _ in ps]
        c = rho([ps[i][0] for i in at], [ps[i][1] for i in at])
        found += [c] if c is not None else []
    found.sort()
    assert (got["a"].lo, got["a"].hi) == pytest.approx((found[int(0.025 * len(found))], found[min(len(found) - 1, int(0.975 * len(found)))]))


def observations(spark, seed=6, n=25):
    r = random.Random(seed)
    rows = [(D(f"{y}-{m}-28"), s, g, h, f, r.random() * 100 if r.random() > 0.1 else None, e) for g in ("g1", "g2") for y in (2019, 2020) for m in ("03", "09") for s in range(n if g == "g1" else 3) for h, e in ((1, r.gauss(0, 1)), (3, r.gauss(0, 1))) for f in ("f1", "f2")]
    return spark.createDataFrame(rows, "d date, symbol long, super_group string, horizon int, factor string, pct double, excess double")


@pytest.mark.parametrize("most", [10**6, 60])
def test_null_thresholds(spark, most):
    """Thresholds follow the null distribution: those of plain shuffles in Python, within sampling error; the same for any partitioning; of groups in one row and of dealt ones."""
    obs = observations(spark)
    got = {(x.super_group, x.horizon): x for x in bt.ic_thresholds(obs, 400, most=most).collect()}
    again = {(x.super_group, x.horizon): x for x in bt.ic_thresholds(obs.repartition(7), 400, most=most).collect()}
    assert got == again
    rows = [x for x in obs.collect() if x.pct is not None]
    rng, null = random.Random(1), {k: [] for k in got}
    keys = sorted({(x.super_group, x.d, x.symbol, x.horizon) for x in rows})
    excess = {(x.super_group, x.d, x.symbol, x.horizon): x.excess for x in rows}
    once = {}
    for x in sorted(rows, key=lambda x: x.d):
        once.setdefault((x.super_group, x.factor, x.horizon, x.symbol, x.d.year), x)
    for _ in range(400):
        given = {}
        for bucket in {k[:2] for k in keys}:
            of = [k for k in keys if k[:2] == bucket]
            vals = [excess[k] for k in of]
            rng.shuffle(vals)
            given |= dict(zip(of, vals))
        for g, h in null:
            for f in ("f1", "f2"):
                ps = [(x.pct, given[x.super_group, x.d, x.symbol, x.horizon]) for k, x in once.items() if k[:3] == (g, f, h)]
                c = rho(*zip(*ps))
                null[g, h] += [abs(c)] if c is not None else []
    for k, v in null.items():
        v.sort()
        assert got[k].draws == len(v) and abs(got[k].t99 - v[int(0.99 * len(v))]) < 0.12 and got[k].t99 <= got[k].t995


def test_rolling_spans(spark):
    obs = spark.createDataFrame([(D("2020-01-01") + dt.timedelta(days=k), k, "g", 1, "f", float(k), float(k)) for k in range(11)], "d date, symbol long, super_group string, horizon int, factor string, pct double, excess double")
    assert {r.span: r.n for r in bt.rolling_ic(obs).collect()} == {0: 3, 1: 3, 2: 5}  # ten days: cuts at the third and the sixth
    one = obs.where("symbol = 0")
    assert [(r.span, r.n) for r in bt.rolling_ic(one).collect()] == [(0, 1)]


def test_false_discovery(spark):
    strong = spark.createDataFrame([("a", 1, 0.5), ("b", 1, -0.6), ("c", 1, 0.1)], "super_group string, horizon int, ic double")
    limits = spark.createDataFrame([("a", 1, 0.4), ("b", 1, 0.4), ("c", 1, 0.4), ("d", 1, 0.4)], "super_group string, horizon int, t99 double")
    r = bt.false_discovery(strong, limits, 16).first()
    assert (r.tested, r.surviving, r.expected, r.verdict) == (64, 2, pytest.approx(0.64), "marginal")


def test_frictions(spark):
    df = spark.createDataFrame([(0.3, 3, 1.0, 1.0), (0.3, 1, 0.0, 0.0), (-0.1, 3, 1.0, 0.5), (0.3, 3, 0.5, 0.5)], "r double, y int, t double, i double")
    got = df.select(*[v.alias(k) for k, v in bt.after_frictions(*[F.col(c) for c in "ryti"], 10).items()]).collect()
    net = [0.3 - 0.006, 0.3, -0.106, 0.3 - 0.003]
    assert [x.after_friction for x in got] == pytest.approx(net)
    assert [x.after_tax_long for x in got] == pytest.approx([net[0] * 0.629, net[1] * 0.629, net[2], net[3] * 0.629])
    assert [x.after_tax_blended for x in got] == pytest.approx([net[0] * 0.459, net[1] * 0.459, net[2], net[3] * 0.5 * 0.459 + net[3] * 0.5 * 0.629])


def test_rolling_puts(spark):
    r = random.Random(8)
    bars = {s: {} for s in range(6)}
    for s in bars:
        price, day = 100.0, D("2018-01-01")
        while day < D("2022-06-01"):
            price *= math.exp(r.gauss(0.0003 * (s - 2), 0.012))
            if r.random() > 0.1:
                bars[s][day] = price
            day += dt.timedelta(days=r.choice([1, 1, 2, 5]))
    flags = [(D(d), s, p) for d in ("2019-01-15", "2020-02-29", "2021-11-01") for s in bars for p in [100.0]] + [(D("2019-01-15"), 9, 50.0), (D("2019-01-15"), 0, 0.0)]
    b = spark.createDataFrame([(s, d, p) for s, x in bars.items() for d, p in x.items()], "symbol long, date date, close double")
    got = {(x.d, x.symbol): x for x in outcomes.rolling_puts(spark.createDataFrame(flags, "d date, symbol long, price double"), b).collect()}
    assert len(got) == len(flags) - 1
    for d, s, spot0 in flags[:-1]:
        days = sorted(bars.get(s, {}))
        after = lambda x: next((bars[s][y] for y in days if y >= x), None)
        out = dt.date(d.year + 2, 3, 1) if (d.month, d.day) == (2, 29) else d.replace(year=d.year + 2)
        start, premium, interest, loss, cycles, hit = d, 0.0, 0.0, 0.0, 0, 0
        capital = spot0 * 0.95
        while start + dt.timedelta(days=30) <= out:
            end = start + dt.timedelta(days=30)
            spot, last = after(start), after(end)
            if spot is None or last is None:
                break
            closes = [bars[s][y] for y in days if y <= start][-31:]
            vol = 0.08
            if len(closes) >= 5:
                logs = np.diff(np.log(closes))
                vol = min(0.80, max(0.08, logs.std(ddof=1) * math.sqrt(252)))
            premium += max(0.5, 100 * vol * math.sqrt(30 / 365) * 0.4 * (1 - 5 / 60)) / 100 * spot
            interest += capital * 0.04 * 30 / 365
            cycles += 1
            if last <= spot * 0.95:
                hit = cycles
                final = after(out)
                loss = final - spot * 0.95 if final is not None else 0.0
                break
            start = end
        x = got[d, s]
        assert (x.cycles, x.assigned, x.assigned_at) == (cycles, hit > 0, hit), (d, s)
        assert x.total_pct == pytest.approx((premium + interest + loss) / capital * 100)


def test_instalments(spark):
    bars = [("a", D("2020-01-01"), 10.0), ("a", D("2020-03-01"), 20.0), ("b", D("2020-02-15"), 5.0), ("b", D("2020-05-01"), 4.0)]
    paid = [(D("2019-12-01"), 100.0), (D("2020-01-01"), 100.0), (D("2020-02-20"), 100.0), (D("2020-06-01"), 100.0)]
    b = spark.createDataFrame(bars, "symbol string, date date, close double")
    r = portfolio.instalment_benchmark(spark.createDataFrame(paid, "date date, amount double"), b, F.lit("2020-12-31").cast("date"), b).first()
    shares = {"a": 100 / 10 + 50 / 10 + 50 / 20, "b": 50 / 5 + 50 / 4}
    assert (r.paid, r.value) == pytest.approx((300.0, shares["a"] * 20 + shares["b"] * 4))


def test_hypotheses(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        fired, high = i % 4 == 0, i % 2 == 0
        ret = r.gauss(20, 2 if high else 30)
        rows.append((D("2020-01-01"), i, 3, 100.0, 110.0, 115.0, 130.0, 100 + ret, ret, i % 10 > 0, ret > 15, ret > 30, ret - 5, i % 3 == 0, fired, "high" if high else "low", i % 10 == 0))
    df = spark.createDataFrame(rows, "d date, symbol long, horizon int, price double, p25 double, median double, p75 double, end_price double, ret_pct double, hit_p25 boolean, hit_median boolean, hit_p75 boolean, excess_x double, candidate boolean, outlier_fired boolean, confidence string, divergent boolean")
    got = {x.id: x.verdict for x in bt.hypotheses(df, resamples=200).collect()}
    assert got["H1"] == "pass" and got["H3-x-3y"] == "pass" and got["H5"] == "pass" and got["H6"] == "pass"
    assert set(got) == {"H1", "H2", "H3-x-3y", "H4", "H5", "H6"}


def test_floor_flags(spark):
    names = "d date, symbol long, sector string, n_periods int, profitable_years int, avg_roic double, ebit0 double, interest0 double"
    rows = [(D("2020-01-01"), 1, "s", 5, 5, 0.10, 10.0, 1.0), (D("2020-01-01"), 2, "s", 5, 1, 0.01, 1.0, 1.0), (D("2020-01-01"), 3, "s", 2, 2, 0.05, 3.0, 1.0), (D("2020-01-01"), 4, "s", 5, 4, None, None, 2.0), (D("2020-01-01"), 5, "s", 5, 4, 0.02, 5.0, None), (D("2020-01-01"), 6, "t", 5, 4, 0.01, 0.5, 1.0), (D("2020-01-01"), 7, "t", 5, 4, -0.01, 2.0, 1.0)]
    got = {r.symbol: (r.pass_profit, r.pass_roic, r.pass_coverage, r.pass_combined) for r in bt.floor_flags(spark.createDataFrame(rows, names)).collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, False), 3: (None, True, True, False), 4: (True, None, None, True), 5: (True, True, True, True), 6: (True, True, False, False), 7: (True, False, True, False)}


def test_candidates_from_a_file(spark, tmp_path):
    from rankweave.sources import candidates

    (tmp_path / "c.json").write_text('[{"name": "x", "weights": {"valuation": 0.7, "shareholderReturn": 0.3}, "subFactorWeights": {"valuation": {"evToEbitda": 1.0}}, "filter": {"excludeFundamentalsDirections": ["declining"]}}, {"name": "y", "weights": {"growth": 1.0}}]')
    weights, subs, out = candidates.read_candidates(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in weights.collect()} == {("x", "valuation", 0.7), ("x", "shareholder_return", 0.3), ("y", "growth", 1.0)}
    assert [tuple(r) for r in subs.collect()] == [("x", "valuation", "ev_to_ebitda", 1.0)] and [tuple(r) for r in out.collect()] == [("x", "declining")]
    weights, *_ = candidates.built_in(spark)
    assert weights.groupBy("candidate").sum("w").where("abs(`sum(w)` - 1) > 1e-9").count() == 0 and weights.select("candidate").distinct().count() == 7
