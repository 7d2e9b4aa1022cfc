"""Rules of the ranking and time-series operators against plain Python."""

import bisect
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rankweave.functions import dates, finance, stats
from rankweave.operators import fair_value, membership, options, ranking, timeseries


def test_seeded_draws(spark):
    got = [r.u for r in spark.range(3).select(stats.draw(F.lit(42), F.col("id")).alias("u")).collect()]
    assert got == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


def winsorised(values, own):
    s = sorted(values)
    n = len(s)
    if n < 2:
        return 50.0
    if n >= 3:
        lo_i = int(n * 0.05)
        lo, hi = s[lo_i], s[max(lo_i, -(-n * 95 // 100) - 1)]
        if own < lo or own > hi:
            return 0.0 if own < lo else 100.0
        s = sorted(min(max(v, lo), hi) for v in s)
    below, equal = bisect.bisect_left(s, own), s.count(own)
    return (below + (equal + 1) / 2 - 1) / (n - 1) * 100


@pytest.mark.parametrize("parts", [1, 7])
def test_winsorised_percentile(spark, parts):
    r = random.Random(1)
    rows = [(g, i, None if r.random() < 0.1 else float(r.randint(0, 12))) for g in range(40) for i in range(r.choice([1, 2, 3, 7, 8, 45]))]
    df = spark.createDataFrame(rows, "g long, i long, v double").repartition(parts)
    for x in stats.winsorised_percentile(df, "v", ["g"], "p").collect():
        values = [v for g, _, v in rows if g == x.g and v is not None]
        assert (x.p is None) == (x.v is None)
        if x.v is not None:
            assert x.p == pytest.approx(winsorised(values, x.v)) and 0 <= x.p <= 100


def test_leave_one_out_median(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice([None, -1.0, 0.0, 1.0, 2.0, 5.0, float(r.randint(1, 40))])) for g in range(60) for i in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "g long, i long, v double").repartition(5)
    for x in fair_value.leave_one_out_median(df, "v", ["g"], "i", "m").collect():
        peers = [v for g, i, v in rows if g == x.g and i != x.i and v is not None and v > 0]
        assert x.m == (statistics.median(peers) if peers else None)


def test_bootstrap_is_independent_of_partitions(spark):
    rows = [("a", i, float(i % 7)) for i in range(20)] + [("b", 0, 1.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    one = {r.g: r for r in stats.bootstrap_means(df.repartition(1), "v", ["g"], ["i"], 100).collect()}
    many = {r.g: r for r in stats.bootstrap_means(df.repartition(6), "v", ["g"], ["i"], 100).collect()}
    assert one == many and one["a"].lo <= one["a"].mean <= one["a"].hi and one["b"].n == 1
    draws = [r.u for r in spark.range(2000).select(stats.draw(F.lit(1), F.col("id")).alias("u")).collect()]
    means = sorted(sum(float(int(u * 20) % 7) for u in draws[r * 20 : r * 20 + 20]) / 20 for r in range(100))
    assert one["a"].lo == pytest.approx(means[2]) and one["a"].hi == pytest.approx(means[97])


def test_asof_edges(spark):
    bars = spark.createDataFrame([("x", 5, 1.0), ("x", 7, None), ("x", 9, 3.0)], "s string, t long, v double")
    probes = spark.createDataFrame([("x", p) for p in (4, 5, 6, 7, 9, 10)] + [("y", 5)], "s string, p long")
    back = {(r.s, r.p): r.v for r in timeseries.asof_join(probes, bars, ["s"], "p", "t", ["v"], not_null=True).collect()}
    assert back == {("x", 4): None, ("x", 5): 1.0, ("x", 6): 1.0, ("x", 7): 1.0, ("x", 9): 3.0, ("x", 10): 3.0, ("y", 5): None}
    ahead = {(r.s, r.p): r.v for r in timeseries.asof_join(probes, bars, ["s"], "p", "t", ["v"], forward=True, not_null=True).collect()}
    assert ahead == {("x", 4): 1.0, ("x", 5): 1.0, ("x", 6): 3.0, ("x", 7): 3.0, ("x", 9): 3.0, ("x", 10): None, ("y", 5): None}


def test_buckets_cover_every_row(spark):
    rows = [(1, f"s{i}", "Banks - Regional" if i == 0 else "x", *[None if i == 1 else float(i)] * 5, i == 2, 10.0, None if i == 3 else (20.0 if i % 2 else 5.0), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "d long, symbol string, industry string, valuation double, health double, quality double, shareholder_return double, growth double, negative_equity boolean, price double, p25 double, composite double")
    got = {r.symbol: r.bucket for r in ranking.bucket(df).collect()}
    assert len(got) == 30 and all(got[f"s{i}"] == "avoid" for i in (0, 1, 3, 4, 5))
    assert got["s2"] == "avoid" and got["s6"] == "watch" and got["s7"] == "ranked"


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29), "5 January 2020"), (dt.date(2023, 2, 28), "January 5, 2020"), (None, "junk")], "d date, t string")
    got = df.select(dates.add_years(F.col("d"), 1).alias("y"), dates.parse_date(F.col("t")).alias("p")).collect()
    assert [r.y for r in got] == [dt.date(2025, 3, 1), dt.date(2024, 2, 28), None]
    assert [r.p for r in got] == [dt.date(2020, 1, 5), dt.date(2020, 1, 5), None]


def test_put_view(spark):
    c = finance.cash_put(F.lit(95.16), F.lit(95.0), F.lit(4.6), F.lit(3))
    r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    assert r.put_return == pytest.approx(0.0484210526) and r.put_annual == pytest.approx(5.8912280702) and r.basis == pytest.approx(90.4) and r.discount == pytest.approx(0.0500210172)


def test_capital_plan(spark):
    rows = [(1, 1, "a", 50.0, 1.0, 0.1, 20_000.0), (1, 2, "b", 30.0, 1.0, 0.1, 20_000.0), (1, 3, "c", 300.0, 1.0, 0.1, 20_000.0), (2, 1, "z", 10.0, 0.5, 0.1, 500.0)]
    got = {(r.plan_id, r.symbol): r.contracts for r in options.capital_plan(spark.createDataFrame(rows, "plan_id long, rank int, symbol string, strike double, premium_per_share double, annual double, capital double")).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 3, (1, "c"): 0, (2, "z"): 0}


def test_capital_plans_in_batches(spark):
    """Plans share a batch of the worker, with excluded names and plans without capital; as a loop has it."""
    r = random.Random(5)
    rows = [(p, k, f"s{k}", r.uniform(5, 400), r.random(), r.random(), r.choice([0.0, 20_000.0, 100_000.0]) if k == 0 else None, r.random() < 0.2) for p in range(30) for k in range(r.randrange(1, 7))]
    capital = {p: c for p, k, *_, c, _ in rows if k == 0}
    rows = [(*x[:6], capital[x[0]], x[7]) for x in rows]
    told = options.capital_plan(spark.createDataFrame(rows, "plan_id long, rank int, symbol string, strike double, premium_per_share double, annual double, capital double, skip boolean"), top=4, excluded="skip")
    assert "FlatMapGroupsInPandas" not in told._jdf.queryExecution().toString()
    got, want = {(x.plan_id, x.symbol): (x.contracts, x.collateral) for x in told.collect()}, {}
    for p in capital:
        own = [x for x in rows if x[0] == p]
        kept = [x for x in own if not x[7]][:4]
        n, left = {x[2]: int(capital[p] / len(kept) / (x[3] * 100)) for x in kept}, capital[p]
        left -= sum(n[x[2]] * x[3] * 100 for x in kept)
        while any(x[3] * 100 <= left for x in kept):
            for x in kept:
                if x[3] * 100 <= left:
                    n[x[2]] += 1
                    left -= x[3] * 100
        want |= {(p, x[2]): (n[x[2]], pytest.approx(n[x[2]] * x[3] * 100)) for x in kept} | {(p, x[2]): (0, 0.0) for x in own if x[7]}
    assert got == want


def test_money_weighted_return(spark):
    rows = [(1, dt.date(2020, 1, 1), -100.0), (1, dt.date(2021, 1, 1), 110.0), (2, dt.date(2020, 1, 1), -5.0)]
    got = {r.account_id: r.rate for r in options.money_weighted_return(spark.createDataFrame(rows, "account_id long, date date, amount double")).collect()}
    assert got[1] == pytest.approx(0.0998, abs=1e-3) and got[2] == 0


def test_money_weighted_return_is_native(spark):
    """No worker of Python for each account; as a loop has it, with repeated dates, nulls and accounts without a sign change."""
    r = random.Random(3)
    rows = [(a, dt.date(2020, 1, 1) + dt.timedelta(r.randrange(900)) if r.random() < 0.95 else None, r.choice([None, r.gauss(0, 90), r.gauss(0, 9)])) for a in range(40) for _ in range(r.randrange(1, 9))] + [(90, dt.date(2020, 1, 1), 5.0)] * 2
    told = options.money_weighted_return(spark.createDataFrame(rows, "account_id long, date date, amount double"))
    assert "Pandas" not in told._jdf.queryExecution().toString()
    got = {x.account_id: x.rate for x in told.collect()}
    assert set(got) == {a for a, _, _ in rows}
    for account in got:
        daily = {}
        for _, d, v in (x for x in rows if x[0] == account and None not in x):
            daily[d] = daily.get(d, 0.0) + v
        first = min((d for a, d, _ in rows if a == account and d), default=None)
        value = lambda x: sum(v / (1 + x) ** ((d - first).days / 365.25) for d, v in daily.items())  # noqa: B023, E731
        a, b, want = -0.99, 10.0, 0.0
        if len(daily) >= 2 and value(a) * value(b) < 0:
            for _ in range(80):
                m = (a + b) / 2
                a, b = (m, b) if value(a) * value(m) > 0 else (a, m)
            want = (a + b) / 2
        assert got[account] == pytest.approx(want, abs=1e-9)


def test_membership(spark):
    changes = spark.createDataFrame([(dt.date(2020, 1, 1), "a", "b", "merged"), (dt.date(2021, 1, 1), "b", "a", None), (dt.date(2022, 1, 1), None, "c", "x")], "date date, added string, removed string, reason string")
    current = spark.createDataFrame([("b",), ("q",)], "symbol string")
    i = membership.membership_intervals(changes, current)
    got = sorted((r.symbol, str(r.valid_from), str(r.valid_to)) for r in i.collect())
    assert got == [("a", "2020-01-01", "2021-01-01"), ("b", "1900-01-01", "2020-01-01"), ("b", "2021-01-01", "None"), ("c", "1900-01-01", "2022-01-01"), ("q", "1900-01-01", "None")]
    rows = spark.createDataFrame([(dt.date(2020, 6, 1), s) for s in "abcq"], "d date, symbol string")
    assert sorted(r.symbol for r in membership.members_at(rows, i).collect()) == ["a", "c", "q"]
