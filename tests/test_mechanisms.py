"""Mechanisms for large groups, long histories, pages and stores, on fixed cases and against loops."""

import datetime as dt
import hashlib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import stats
from rankweave.operators import fair_value as fv
from rankweave.operators import html_tables as html
from rankweave.operators import ranking
from rankweave.operators import timeseries as ts
from rankweave.plans import backtest as bt
from rankweave.sources import tables
from rankweave.sources.scratch import saved, shared_dir


@pytest.mark.parametrize("values_a_range", [3, 10**6])
def test_ranged_percentile(spark, values_a_range):
    """The same numbers as by windows, with a third of all rows in one tie, null groups, small groups, negative zero."""
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), 7.0 if r.random() < 0.33 else r.choice([None, -0.0, 0.0, r.gauss(0, 1e6), float(r.randint(-9, 9))]), i, "x") for i in range(700)]
    rows += [("one", 3.0, 700, ""), ("two", 3.0, 701, ""), ("two", 5.0, 702, ""), ("none", None, 703, "")]
    df = saved(spark.createDataFrame(rows, "g string, v double, i long, p string"), "ranged")
    for low, high, least in ((0.05, 0.95, 3), (0.3, 0.6, 3), (0.0, 1.0, 10**9)):
        want = stats.winsorised_percentile(df, "v", ["g"], "p", low, high, least).collect()
        got = stats.ranged_percentile(df, "v", ["g"], "p", low, high, least, values_a_range).collect()
        assert {x.i: x.p for x in got} == pytest.approx({x.i: x.p for x in want}) and len(got) == len(rows)


def test_ranged_percentile_by_ranges(spark):
    """A row is written once, whatever the splitters of its group: ranges of (group, value) of like size, a frequent value counted and not ranked."""
    df = saved(spark.range(6000).selectExpr("id % 3 as g", "cast(case when id % 3 = 0 and id % 2 = 0 then 5 else id * 7919 % 6007 end as double) as v", "id as i"), "many")
    got = stats.ranged_percentile(df, "v", ["g"], "p", values_a_range=100)
    assert {x.i: x.p for x in got.collect()} == pytest.approx({x.i: x.p for x in stats.winsorised_percentile(df, "v", ["g"], "p").collect()})
    folder = {x for x in got.inputFiles() if "/dealt-" in x}
    dealt = spark.read.parquet(next(iter(folder)).rsplit("/", 1)[0])
    assert dealt.count() == 6000 and "_s" not in dealt.columns
    sizes = sorted(x["count"] for x in dealt.groupBy("_r").count().collect())
    # 60 ranges of about 100; the value 5 of a thousand rows is whole in one of them, and told by a join with its count
    assert len(sizes) > 30 and sizes[-2] < 400 and 1000 <= sizes[-1] < 1400 and "tied-values" in "".join(got.inputFiles())


def test_accuracy_rows_by_spans(spark):
    """Peaks, troughs and ends against a loop over all bars, with bars on the first and last day and in a leap year; no row for a month without bars."""
    r = random.Random(5)
    day = lambda: dt.date(1999, 1, 1) + dt.timedelta(r.randrange(2600))
    bars = [(s, x, r.choice([None, r.uniform(1, 99)])) for s in (1, 2, 3) for x in {dt.date(2000, 2, 29), dt.date(2001, 3, 1), dt.date(2003, 3, 1), *[day() for _ in range(90)]}]
    probes = [(x, s, 10.0, 5.0, None, 20.0) for s in (1, 2, 3, 4) for x in {dt.date(2000, 2, 29), dt.date(2000, 12, 31), dt.date(2001, 12, 31), *[day() for _ in range(30)]}]
    probes.append((dt.date(2000, 3, 1), 1, 0.0, 5.0, None, 20.0))
    b = spark.createDataFrame(bars, "symbol int, date date, close double").where("close is not null")
    told = bt.accuracy_rows(spark.createDataFrame(probes, "d date, symbol int, price double, p25 double, median double, p75 double"), b)
    # a key with two bars sixty years apart becomes as many rows as any other
    ends = spark.createDataFrame([(9, dt.date(1950, 1, 1), 1.0), (9, dt.date(2010, 1, 1), 2.0)], "symbol int, date date, close double")
    got = {(x.d, x.symbol, x.horizon): (x.end_price, x.peak, x.trough) for x in told.collect()}
    want = {}
    for d, s, *_ in probes[:-1]:
        for h in (1, 2, 3):
            due = dt.date(d.year + h, 3, 1) if (d.month, d.day) == (2, 29) and (d.year + h) % 4 else d.replace(year=d.year + h)
            own = sorted((t, c) for s2, t, c in bars if s2 == s and c is not None)
            inside, after = [c for t, c in own if d <= t <= due], [c for t, c in own if t >= due]
            if inside and after:
                want[d, s, h] = (after[0], max(inside), min(inside))
    assert got == want and len(want) > 100
    probe = spark.createDataFrame([(dt.date(1950, 1, 1), 9)], "d date, symbol int")
    assert ts.forward_extremes(probe, ends, ["symbol"], "d", (1, 2), "date", "close").count() == 4
    assert "Generate explode(sequence" not in told._jdf.queryExecution().analyzed().toString()


def test_trailing_slope(spark):
    r = random.Random(2)
    days = sorted(r.sample(range(1600), 120))
    rows = [(s, dt.date(2019, 12, 31) + dt.timedelta(d), r.choice([None, r.uniform(-1, 9)])) for s in (1, 2) for d in days] + [(3, dt.date(2024, m, d), float(m * d)) for m, d in ((2, 29), (3, 31), (4, 30))] + [(3, dt.date(2023, 2, 28), 5.0), (3, dt.date(2023, 3, 1), 6.0), (3, dt.date(2022, 2, 28), 2.0)]
    got = {(x.s, x.d): x for x in ts.trailing_slope(spark.createDataFrame(rows, "s int, t date, v double"), ["s"], "t", "v", 24, 3).collect()}
    assert len(got) == len(rows)
    for s, d, _ in rows:
        from_ = dt.date(d.year - 2, d.month, min(d.day, 28) if d.month == 2 else d.day)
        own = sorted((t, v) for s2, t, v in rows if s2 == s and from_ < t <= d and v is not None)
        x = got[s, d]
        assert x.n == len(own)
        if len(own) >= 3 and own[0][1] > 0:
            slope = statistics.linear_regression([(t - dt.date(1970, 1, 1)).days / 365.25 for t, _ in own], [v for _, v in own]).slope
            assert x.slope_pct == pytest.approx(slope / own[0][1] * 100, rel=1e-6, abs=1e-6)
        else:
            assert x.slope_pct is None


def test_slope_needs_no_join(spark):
    df = spark.createDataFrame([], "s int, t date, v double")
    assert "Join" not in ts.trailing_slope(df, ["s"], "t", "v")._jdf.queryExecution().executedPlan().toString()


def test_multiples_known_at_the_date(spark):
    """A year that ends, or becomes public, after d does not count; of the others the newest five do, and of those the ones above 0."""
    day = lambda y: dt.date(y, 12, 31)
    own = [(p, day(y), v and float(v)) for p, vs in {1: [9, 9, 1, 2, 3, -4, 8, 100], 2: [None, None, None, None, None, None, 5, 7]}.items() for y, v in zip(range(2001, 2009), vs)]
    peers = [(dt.date(2008, 3, 1), 9, 1), (dt.date(2008, 3, 1), 9, 2), (dt.date(2008, 4, 1), 9, 1), (dt.date(2008, 4, 1), 9, 2), (dt.date(2001, 6, 1), 9, 1)]
    got = fv.smoothed_multiples(spark.createDataFrame(peers, "d date, symbol int, peer int"), spark.createDataFrame(own, "symbol int, period_end date, value double")).collect()
    # to March 2008 the years 2002 to 2006 are public: 9, 1, 2, 3, -4; from 30 March also 2007: 1, 2, 3, -4, 8, and 5 of the other peer
    assert {x.d: (x.multiple, x.trimmed) for x in got} == {dt.date(2008, 3, 1): (2.5, 2.5), dt.date(2008, 4, 1): (3.75, 3.75)}


def test_observations_by_ranges(spark):
    """The percentiles of the windows over whole groups, by ranges: no window's key is a group alone."""
    rows = spark.range(900).selectExpr("date'2020-01-01' as d", "id as symbol", "if(id % 9 = 0, null, 'g') as sector", "'f' as factor", "'lower' as direction", "if(id % 4 = 0, 1.0, if(id % 7 = 0, null, double(id * 7919 % 907))) as raw")
    rows = saved(rows, "long")
    fwd = saved(rows.selectExpr("d", "symbol", "1 as horizon", "double(symbol) as excess"), "forward")
    told = bt.ic_observations(rows, fwd, rows_a_range=20)
    want = stats.winsorised_percentile(rows.where("sector is not null"), "raw", ["d", "factor", "sector"], "p").collect()
    assert {x.symbol: x.pct for x in told.collect()} == pytest.approx({x.symbol: None if x.p is None else 100 - x.p for x in want})
    dealt = [x for x in told.inputFiles() if "/dealt-" in x]
    assert len(dealt) > 10


def test_user_picks(spark):
    r = random.Random(3)
    days = [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]
    rows = [(d, s, r.choice(["g", "h", None]), r.choice([None, 50.0, 100.0, 0.0, round(r.uniform(0, 100), 2)]), round(r.gauss(0, 1), 3), r.choice([None, 0.5])) for d in days for s in range(60)]
    picks = [(d, s) for d in [*days, dt.date(2022, 1, 1)] for s in range(0, 70, 3)] + [(days[0], 3)]
    got = bt.user_picks(spark.createDataFrame(picks, "d date, symbol int"), spark.createDataFrame(rows, "d date, symbol int, super_group string, composite double, excess_1 double, excess_3 double"), 4, 20).collect()
    assert {(x.d, x.symbol) for x in got} == set(picks) and len(got) == len(set(picks))
    for x in got:
        all_ = sorted([y for y in rows if y[0] == x.d and y[3] is not None], key=lambda y: (-y[3], y[1]))
        at = [k for k, y in enumerate(all_) if y[1] == x.symbol]
        if not at:
            assert x.reason == ("not in universe" if x.d in days else "no snapshot universe") and x.rank_in_universe is None
            continue
        me = all_[at[0]]
        group = [y for y in all_ if y[2] == me[2]]
        k = group.index(me)
        assert x.reason is None and (x.composite, x.rank_in_universe, x.universe_size, x.rank_in_super_group, x.super_group_size, x.excess_1, x.excess_3) == (me[3], at[0] + 1, len(all_), k + 1, len(group), me[4], me[5])
        assert [tuple(b) for b in x.better] == [(i + 1, y[1], y[3], y[4], y[5]) for i, y in enumerate(group[: min(k, 4)])]


PAGE = """<table class="wikitable"><tr><th>Symbol</th></tr><tr><td>A</td></tr></table><table><tr><td>no class</td></tr></table>
<TABLE id=x class='sortable wikitable'><tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan="2">Reason</th></tr>
<tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>
<tr><td rowspan="2">March 17, 2024</td><td><a href="x">AB&amp;C</a></td><td>Alpha&nbsp;Beta
 Co.</td><td>XYZ</td><td>Old</td><td rowspan=3>One reason</td></tr>
<tr><td colspan="2"></td><td>QQ</td><td>Queue</td></tr>
<tr><td>2023-12-18</td><td>N1</td><td>New</td><td> </td><td></td></tr>
<tr><td></td><td>N2</td><td>Newer</td><td>R2</td><td>Gone</td></tr>
<tr><td>7 Sept 2022</td><td>N3</td><td>x</td><td>R3</td><td>y</td><td></td></tr>
<tr><td>soon</td><td>N4</td><td>x</td><td>R4</td><td>y</td></tr>
<tr><td></td><td>N5</td><td>x</td><td>R5</td><td>y</td></tr>
<tr><td colspan=6>note</td></tr></table>"""


def test_index_changes(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>"), (4, "<table class=wikitable></table>")], "page_id int, html string")
    got = [tuple(r)[1:] for r in html.index_changes(pages).orderBy("row").collect()]
    assert got == [
        (2, dt.date(2024, 3, 17), "AB&C", "Alpha Beta Co.", "XYZ", "Old", "One reason"),
        (3, dt.date(2024, 3, 17), None, None, "QQ", "Queue", "One reason"),
        (4, dt.date(2023, 12, 18), "N1", "New", None, None, "One reason"),
        (5, dt.date(2023, 12, 18), "N2", "Newer", "R2", "Gone", None),
        (6, dt.date(2022, 9, 7), "N3", "x", "R3", "y", None),
    ]


def test_spans_of_grids(spark):
    """Spans that cross, overlap in rows, reach to the end or beyond it, against a plain placing of cells."""
    r = random.Random(4)
    pages, want = [], {}
    for page in range(150):
        rows = [[(f"c{page}.{i}.{j}", r.choice([1, 1, 1, 2, 3]), r.choice([1, 1, 1, 2, 3, 0])) for j in range(r.randint(0, 4))] for i in range(7)]
        grid = {}
        for i, row in enumerate(rows):
            col = 0
            for text, wide, high in row:
                while (i, col) in grid:
                    col += 1
                for y in range(i, min(7, i + (high or 99))):
                    for x in range(col, col + wide):
                        grid.setdefault((y, x), text)
                col += wide
        # a cell only moves past those that reach down at its place, so rows whose spans would overlap are left out
        clash = any(sum(w for _, w, _ in row) + sum((i, c) in grid and not grid[i, c].startswith(f"c{page}.{i}.") for c in range(40)) != sum((i, c) in grid for c in range(40)) or any((i, c) not in grid and (i, c + 1) in grid for c in range(40)) for i, row in enumerate(rows))
        if not clash:
            want[page] = [[grid[i, c] for c in range(40) if (i, c) in grid] for i in range(7)]
            pages.append((page, "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan='{h}'>{t}</td>" for t, w, h in row) + "</tr>" for row in rows) + "</table>"))
    assert len(want) >= 5
    got = html.table_grid(spark.createDataFrame(pages, "page_id int, html string")).collect()
    told = {}
    for x in sorted(got, key=lambda x: (x.page_id, x.row)):
        told.setdefault(x.page_id, []).append(list(x.cells))
    assert told == want


def test_store_is_atomic(spark):
    at = shared_dir(spark) + "/store-test"
    row = lambda d, v: (dt.date(2024, 1, d), v)
    frame = lambda rows: spark.createDataFrame(rows, "d date, v int")
    read = lambda df: sorted(map(tuple, df.select("d", "v").collect()))
    with pytest.raises(ValueError):
        tables.read_snapshot(spark, at)
    tables.write_snapshot(frame([row(1, 1), row(1, 2), row(2, 3)]), at)
    held = tables.read_snapshot(spark, at)
    # a write that dies after some of its files are there
    broken = frame([row(2, 9), row(3, 9)]).repartition(2, "d").withColumn("v", F.expr("if(day(d) = 3, raise_error('killed'), v)").cast("int"))
    with pytest.raises(Exception, match="killed"):
        tables.write_snapshot(broken, at)
    assert read(tables.read_snapshot(spark, at)) == [row(1, 1), row(1, 2), row(2, 3)]
    tables.write_snapshot(frame([row(2, 4), row(3, 5)]), at)
    assert read(tables.read_snapshot(spark, at)) == [row(1, 1), row(1, 2), row(2, 4), row(3, 5)]
    assert read(held) == [row(1, 1), row(1, 2), row(2, 3)]  # a reader that began before
    tables.write_snapshot(frame([row(4, 6)]), at, keep=2)
    assert read(tables.read_snapshot(spark, at)) == [row(3, 5), row(4, 6)] and read(tables.latest(spark, at)) == [row(4, 6)]
    tables.write_snapshot(frame([row(5, 7)]), at, keep=1)
    fs, make = tables._files(spark, at)
    # what neither the state nor the one before names is gone
    assert sorted(f.getPath().getParent().getName() for f in fs.globStatus(make(f"{at}/data/d=*/_version=*"))) == ["d=2024-01-03", "d=2024-01-04", "d=2024-01-05"]


def test_flags_without_bars(spark):
    flags = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 10.0, 12.0), (dt.date(2020, 1, 1), "b", 10.0, 12.0)], "d date, symbol string, price double, target double")
    bars = spark.createDataFrame([("a", dt.date(2020, 6, 1), 11.0, 12.5), ("b", dt.date(2019, 6, 1), 11.0, 12.5)], "symbol string, date date, close double, high double")
    assert [(r.symbol, r.recovered) for r in bt.recovery(flags, bars).collect()] == [("a", True)]
    assert sorted((r.symbol, r.recovered, r.final) for r in bt.recovery(flags, bars, unmatched=True).collect()) == [("a", True, 11.0), ("b", False, 10.0)]


def test_adoption_verdicts(spark):
    days = [dt.date(2015 + k, 1, 1) for k in range(8)]
    means = {"default": [0.01] * 8, "good": [0.05] * 8, "wild": [2.0, -1.5] * 4, "near": [0.03] * 8}
    rows = [(c, 3, d, v) for c, vs in means.items() for d, v in zip(days, vs)] + [("short", 1, days[0], 1.0)]
    df = spark.createDataFrame(rows, "candidate string, horizon int, d date, top double")
    got = {r.candidate: (r.verdict, r.reason) for r in bt.adoption_verdicts(df, "default", resamples=200).collect()}
    assert got == {"good": ("adopt", "above the floor and zero"), "wild": ("reject", "interval crosses zero"), "near": ("reject", "below the adoption floor"), "short": ("reject", "insufficient data")}
    none = bt.adoption_verdicts(df.where("candidate <> 'default'"), "default", resamples=20).collect()
    assert {r.verdict for r in none} == {"reject"}


def test_peers_by_middle_values(spark):
    """Medians without the row itself: ties, groups of one and two, null groups, values not above 0."""
    r = random.Random(6)
    rows = [(dt.date(2020, 1, r.randint(1, 2)), i, r.choice(["a", "b", "c", None, f"i{i % 40}"]), r.choice(["s", "t", None]), r.choice([1e9, 5e10, 3e11]), *[r.choice([None, -1.0, 0.0, 2.0, 3.0, float(r.randint(1, 9)), r.uniform(0, 9)]) for _ in fv.MULTIPLES]) for i in range(400)]
    df = spark.createDataFrame(rows, "d date, symbol int, industry string, sector string, market_cap double, " + ", ".join(f"{m} double" for m in fv.MULTIPLES))
    got = fv.peer_medians(df).collect()
    assert len(got) == len(rows)
    bucket = lambda cap: "mega" if cap >= 2e11 else "large" if cap >= 2e10 else "small"
    for x in got:
        others = [y for y in rows if y[0] == x.d and y[1] != x.symbol]
        ind = [y for y in others if y[2] == x.industry]
        cap = [y for y in ind if bucket(y[4]) == bucket(x.market_cap)]
        name, peers = ("cohort", cap) if len(cap) >= 8 else ("narrow", cap) if len(cap) >= 3 else ("industry", ind) if len(ind) >= 3 else ("sector", [y for y in others if y[3] == x.sector])
        assert (x.peer_set, x.peer_count) == (name, len(peers))
        for k, m in enumerate(fv.MULTIPLES):
            good = [y[5 + k] for y in peers if y[5 + k] and y[5 + k] > 0]
            assert x[f"peer_{m}"] == (pytest.approx(statistics.median(good)) if good else None)


def test_draws_of_chunks_add_up():
    import numpy as np

    sizes = np.array([5, 1, 700, 40, 3])
    counts = np.array([[stats.chunk_draws(7, r, sizes, c) for c in range(5)] for r in range(400)])
    assert (counts.sum(axis=1) == 749).all()
    assert counts.mean(axis=0) == pytest.approx(sizes, rel=0.15, abs=0.3) and counts[:, 2].std() == pytest.approx((749 * 700 / 749 * 49 / 749) ** 0.5, rel=0.15)


def test_bootstrap_of_large_groups(spark):
    """By chunks: the same n and mean, the same interval whatever the partitioning, as wide as theory has it; small groups beside them draw as before."""
    r = random.Random(5)
    rows = [("big", i, r.gauss(3, 2)) for i in range(4000)] + [("small", i, float(i)) for i in range(30)] + [("big", -1, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    one, two = ({x.g: x for x in stats.bootstrap_means(d, "v", ["g"], ["i"], 400, large=1000, chunk_rows=150).collect()} for d in (df.repartition(3), df.repartition(7)))
    plain = {x.g: x for x in stats.bootstrap_means(df, "v", ["g"], ["i"], 400).collect()}
    assert tuple(one["small"]) == tuple(plain["small"]) and one["big"].n == 4000
    assert (one["big"].lo, one["big"].hi) == pytest.approx((two["big"].lo, two["big"].hi))
    v = [x for g, _, x in rows if g == "big" and x is not None]
    se = statistics.pstdev(v) / len(v) ** 0.5
    assert one["big"].mean == pytest.approx(statistics.mean(v))
    assert one["big"].mean - one["big"].lo == pytest.approx(1.96 * se, rel=0.2) and one["big"].hi - one["big"].mean == pytest.approx(1.96 * se, rel=0.2)


def test_range_extremes(spark):
    """Against a loop: intervals of a day to thirty years, gaps of years, one month, nulls, repeated bars and probes, keys without bars, an interval turned round."""
    r = random.Random(8)
    day = lambda k: dt.date(1990, 1, 1) + dt.timedelta(k)
    bars = [(s, day(k), r.choice([None, r.gauss(0, 9)])) for s, n in ((1, 11000), (2, 400), (3, 20)) for k in r.sample(range(n), n // 20) * 2] + [(4, day(5), 7.0), (None, day(5), 99.0)]
    bars += [(5, day(k), float(k)) for k in (0, 40, 6000, 6001)]
    probes = [(i, r.choice([1, 1, 1, 2, 3, 4, 5, 6]), day(a), day(a + r.choice([0, 1, 20, 40, 70, 365, 1096, 5000, 11000]))) for i, a in enumerate(r.choices(range(-900, 11500), k=400))]
    probes += [(900, 1, day(500), day(400)), (901, 5, day(41), day(5999)), (902, 5, day(0), day(6001)), (903, 4, day(5), day(5))]
    p = spark.createDataFrame(probes + probes[:3], "i int, s int, a date, z date")
    got = {x.i: (x.peak, x.trough) for x in ts.range_extremes(p, spark.createDataFrame(bars, "s int, t date, v double"), ["s"], "a", "z", "t", "v", ["i", "s", "a", "z"]).collect()}
    assert len(got) == len(probes)
    for i, s, a, z in probes:
        own = [v for b, t, v in bars if b == s and a <= t <= z and v is not None]
        assert got[i] == ((max(own), min(own)) if own else (None, None))
    none = ts.range_extremes(p, spark.createDataFrame([], "s int, t date, v double"), ["s"], "a", "z", "t", "v", ["i", "s", "a", "z"])
    assert none.where("peak is not null").count() == 0 and none.count() == len(probes)


def test_windows_without_closes(spark):
    """A value whose window holds no close is left out, as is one whose window is open; the peak counts closes of both ends."""
    d = dt.date(2020, 1, 1)
    bars = [("a", d, 10.0), ("a", dt.date(2020, 6, 1), 30.0), ("a", dt.date(2021, 1, 1), 12.0), ("b", dt.date(2021, 5, 1), 50.0), ("c", d, 5.0)]
    valued = spark.createDataFrame([(d, s, 10.0, 11.0, 20.0, 40.0) for s in "abc"], "d date, symbol string, price double, p25 double, median double, p75 double")
    (x,) = bt.accuracy_rows(valued, spark.createDataFrame(bars, "symbol string, date date, close double"), horizons=(1,)).collect()
    assert (x.symbol, x.end_price, x.peak, x.trough, x.hit_p25, x.hit_median, x.peak_hit_median, x.peak_hit_p75) == ("a", 12.0, 30.0, 10.0, True, False, True, False)


def test_permuted():
    """A permutation for each key and iteration, of any size; every place is as likely for an index as another."""
    for n in (1, 2, 3, 1024, 1025, 5000):
        i = np.arange(n)
        of = lambda key, it: bt.permuted(i, np.full(n, n), np.full(n, key), 1, np.full(n, it))  # noqa: B023, E731
        assert sorted(of(7, 0)) == sorted(of(-9, 3)) == i.tolist()
        if n > 1000:
            assert abs(np.corrcoef(i, of(7, 0))[0, 1]) < 0.15 and (of(7, 0) != of(7, 1)).mean() > 0.99 < (of(7, 0) != of(8, 0)).mean() + 0.01
            part = i[::3]
            assert (bt.permuted(part, np.full(len(part), n), np.full(len(part), 7), 1, np.full(len(part), 0)) == of(7, 0)[::3]).all()
    places = [bt.permuted(np.array([17]), np.array([1500]), np.array([3]), 1, np.array([it]))[0] for it in range(3000)]
    assert np.histogram(places, 10, (0, 1500))[0].min() > 230


def test_correlations_of_dealt_groups(spark):
    """Every correlation of the dealt way is that of the same permutations in plain numpy, with ties in both, absent factors and a constant one."""
    r = random.Random(9)
    d = [dt.date(2020, 3, 1), dt.date(2021, 3, 1)]
    rows = [("g", x, s, h, r.choice([0.5, 0.5, r.gauss(0, 1)]), r.choice([None, 3.0, r.random()]), r.random(), 1.0) for x in d for s in range(30) for h in (1, 3) if r.random() < 0.9]
    wide = saved(spark.createDataFrame(rows, "super_group string, d date, symbol int, horizon int, excess double, f0 double, f1 double, f2 double"), "wide")
    got = sorted((x.horizon, round(x.ic, 9)) for x in bt._null_of_large(wide, 3, 5, 1, block=2).collect())
    keyed = sorted(wide.withColumns({"h": F.xxhash64("d", "symbol", "horizon"), "key": F.xxhash64("super_group", "d")}).collect(), key=lambda x: (x.d, (x.h >> 56), x.h))
    want = []
    for it in range(5):
        given = {}
        for x in d:
            own = [v for v in keyed if v.d == x]
            n = len(own)
            for v, p in zip(own, bt.permuted(np.arange(n), np.full(n, n), np.full(n, own[0].key), 1, np.full(n, it))):
                given[v] = own[p].excess
        for h in (1, 3):
            for f in ("f0", "f1"):
                both = [(v[f], y) for v, y in given.items() if v.horizon == h and v[f] is not None]
                a, b = (bt._midranks(np.array(z)) for z in zip(*both))
                want.append((h, round(abs(np.corrcoef(a, b)[0, 1]), 9)))
    want.sort()
    assert [h for h, _ in got] == [h for h, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-8)


def test_attach_and_headlines(spark):
    """A name without an entry of options is liquid, one without a call or a put is not; each reason has its headline."""
    d = dt.date(2024, 1, 1)
    cols = "d date, symbol string, industry string, valuation double, health double, quality double, shareholder_return double, growth double, negative_equity boolean, price double, composite double, bucket string, bottom boolean"
    full, none = (70.0, 20.0, 50.0, 50.0, 50.0), (None,) * 5
    rows = [(d, "a", "Software", *full, False, 80.0, 61.5, "ranked", False), (d, "b", "Software", *full, False, 200.0, 61.0, "watch", False), (d, "c", "Software", *full, True, 80.0, 60.0, "watch", False)]
    rows += [(d, "e", "Software", *full, False, 80.0, 12.5, "avoid", True), (d, "f", "Software", *none, False, 80.0, None, "avoid", False), (d, "g", "Software", *full, False, 80.0, 60.0, "avoid", False), (d, "h", "Banks - Regional", *full, False, 80.0, 60.0, "avoid", False)]
    values = spark.createDataFrame([(d, s, 100.0, 25.0, "high", False) for s in "abceh"], "d date, symbol string, p25 double, upside_p25 double, confidence string, divergent boolean")
    best = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, None), ("c", None, None)], "symbol string, best_call double, best_put double")
    trend = spark.createDataFrame([("a", "declining"), ("b", "stable")], "symbol string, trend string")
    placed = fv.attach(spark.createDataFrame(rows, cols), values, best, trend)
    got = {x.symbol: x for x in ranking.bucket_rationale(placed).collect()}
    assert {s: x.liquid for s, x in got.items()} == {"a": True, "b": False, "c": False, "e": True, "f": True, "g": True, "h": True}
    assert [got[s].trend for s in "abc"] == ["declining", "stable", "insufficient_data"] and "Fair value trending down ~2 years (informational; not a demote)" in got["a"].weaknesses
    begins = {"a": "Buy candidate — trades 25.0% below the conservative", "b": "Watch — fair value present", "c": "Watch — sustained buybacks", "e": "Avoid — composite (13/100) sits", "f": "Avoid — failed the §4", "g": "Avoid — couldn't compute", "h": "Avoid — Banks - Regional accounting"}
    assert all(got[s].headline.startswith(t) for s, t in begins.items()) and not any("{}" in x.headline for x in got.values())
    assert fv.attach(spark.createDataFrame(rows, cols), values).where("liquid and trend = 'insufficient_data'").count() == len(rows)


def test_correlations_of_arrays(spark, monkeypatch):
    """Every correlation of groups packed as arrays is that of the same shuffles in plain numpy, with ties in both, absent factors and a constant one; in chunks, the order of rows stays a function of the rows."""
    r = random.Random(9)
    d = [dt.date(2020, 3, 1), dt.date(2021, 3, 1)]
    rows = [("g", x, s, h, r.choice([0.5, 0.5, r.gauss(0, 1)]), r.choice([None, 3.0, r.random()]), r.random(), 1.0) for x in d for s in range(30) for h in (1, 3) if r.random() < 0.9]
    wide = saved(spark.createDataFrame(rows, "super_group string, d date, symbol int, horizon int, excess double, f0 double, f1 double, f2 double"), "wide")
    told = lambda x: sorted((v.horizon, round(v.ic, 9)) for v in bt._null_of_arrays(x, 3, 5, 1).collect())
    got = told(wide)
    keyed = sorted(wide.withColumn("h", F.xxhash64("d", "symbol", "horizon")).collect(), key=lambda x: (x.d, x.h))
    want, name = [], int.from_bytes(hashlib.sha256(b"g").digest()[:8], "little")
    for it in range(5):
        rng, given = np.random.Generator(np.random.SFC64([name, 1, it])), np.unique([v.excess for v in keyed], return_inverse=True)[1]
        at = sum(v.d == d[0] for v in keyed)
        rng.shuffle(given[:at])
        rng.shuffle(given[at:])
        for h in (1, 3):
            for f in ("f0", "f1"):
                a, b = (bt._midranks(np.array(z)) for z in zip(*[(v[f], y) for v, y in zip(keyed, given) if v.horizon == h and v[f] is not None]))
                want.append((h, round(abs(np.corrcoef(a, b)[0, 1]), 9)))
    assert got == sorted(want)
    monkeypatch.setattr(bt, "ROWS_A_CHUNK", 7)
    assert told(wide) == told(wide.repartition(5)) != got


def test_groups_as_arrays_copy_no_rows(spark, monkeypatch):
    """Groups beyond a row go as arrays, those beyond a task dealt; all give as many correlations."""
    r, seen = random.Random(3), []
    rows = [(dt.date(y, 3, 1), s, g, h, f, r.random(), r.gauss(0, 1)) for g, n in (("a", 4), ("b", 8), ("c", 16)) for y in (2020, 2021) for s in range(n) for h in (1, 3) for f in ("f", "g")]
    obs = spark.createDataFrame(rows, "d date, symbol int, super_group string, horizon int, factor string, pct double, excess double").groupBy("d", "symbol", "super_group", "horizon", "factor").agg(F.first("pct").alias("pct"), F.first("excess").alias("excess"))
    for way in ("_null_of_small", "_null_of_arrays", "_null_of_large"):
        f = getattr(bt, way)
        monkeypatch.setattr(bt, way, lambda wide, *a, f=f, way=way: seen.append((way, [x[0] for x in wide.select("super_group").distinct().collect()])) or f(wide, *a))
    got = bt.ic_thresholds(obs, 20, most=20, most_arrays=40).collect()
    assert seen == [("_null_of_small", ["a"]), ("_null_of_arrays", ["b"]), ("_null_of_large", ["c"])]
    assert {(x.super_group, x.horizon, x.draws) for x in got} == {(g, h, 40) for g in "abc" for h in (1, 3)}


def test_deciles_by_ranges(spark, monkeypatch):
    """The best and worst share against a plain sort, with many equal scores, null keys and few names; no window over a whole date."""
    r = random.Random(5)
    rows = [(c, 1, x, dt.date(2020, 1, 1), s, r.choice([1.0, 2.0, r.random() * 3]), r.gauss(0, 1)) for c, n in (("a", 700), ("b", 11), ("c", 9)) for x in ("k", None) for s in range(n)]
    df = spark.createDataFrame(rows, "candidate string, horizon int, kind string, d date, symbol int, score double, excess double")
    seen, f = [], bt.Window.partitionBy
    monkeypatch.setattr(bt.Window, "partitionBy", staticmethod(lambda *a: seen.append(len(a)) or f(*a)))
    got = {(x.candidate, x.kind): (x.top, x.bottom) for x in bt.decile_performance(df, ["kind"]).collect()}
    assert seen == [4, 5]
    for c, n in (("a", 700), ("b", 11)):
        for x in ("k", None):
            of, k = [v for v in rows if v[0] == c and v[2] == x], -(-n // 10)
            top, low = (sorted(of, key=lambda v: (sign * v[5], v[4]))[:k] for sign in (-1, 1))
            assert got.pop((c, x)) == pytest.approx([sum(v[6] for v in z) / k for z in (top, low)])
    assert not got


def test_candidates_copy_no_observations(spark):
    """Observations meet no list of candidates: one aggregation, whatever their number; sub-weights, directions and categories without weight as by hand."""
    d = dt.date(2020, 1, 1)
    rows = [(d, 1, 1, "v", "p", 10.0, 0.1, "declining"), (d, 1, 1, "v", "q", 30.0, 0.1, "declining"), (d, 1, 1, "h", "r", 60.0, 0.1, "declining"), (d, 2, 1, "v", "q", 50.0, 0.2, None), (d, 3, 1, "z", "t", 5.0, 0.3, None), (d, 4, 1, "h", "r", None, 0.3, None)]
    obs = spark.createDataFrame(rows, "d date, symbol int, horizon int, category string, factor string, pct double, excess double, direction string")
    weights = spark.createDataFrame([("x", "v", 0.5), ("x", "h", 0.25), ("y", "v", 1.0), ("y", "h", 1.0), ("n", "v", 1.0), ("o", "z", 0.0)], "candidate string, category string, w double")
    subs = spark.createDataFrame([("y", "v", "p", 3.0)], "candidate string, category string, factor string, w double")
    told = bt.candidate_scores(obs, weights, subs, spark.createDataFrame([("n", "declining")], "candidate string, direction string"))
    assert {(x.candidate, x.symbol): x.score for x in told.collect()} == {("x", 1): pytest.approx((0.5 * 20 + 0.25 * 60) / 0.75), ("x", 2): 50.0, ("y", 1): 35.0, ("n", 2): 50.0, ("o", 3): None}
    assert "Join" not in told._jdf.queryExecution().executedPlan().toString()


def test_rank_correlation_by_ranges(spark):
    """Groups dealt into ranges of both sides give the correlation of one sort, ties, null keys and constant sides included."""
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(60)), float(rng.randrange(40)) if g != "flat" else 1.0) for g in ("a", "b", None, "flat") for _ in range(700)] + [("few", 1.0, 2.0), ("few", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    whole, ranges = ({r.g: (r.n, r.rho) for r in stats.spearman(df, "x", "y", ["g"], rows_a_range=n).collect()} for n in (10**6, 50))
    assert ranges == {g: (n, pytest.approx(rho, abs=1e-12) if rho is not None else None) for g, (n, rho) in whole.items()}
    assert whole["flat"] == (700, None) and whole["few"] == (1, None) and len(whole) == 5
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    assert whole["a"][1] == pytest.approx(pdf[pdf.g == "a"].x.rank().corr(pdf[pdf.g == "a"].y.rank()))


def test_range_of_every_length(spark):
    """The range of a value is the number of splitters below it, whatever their number."""
    for n in (0, 1, 15, 16, 17, 32, 100, 255):
        cuts = F.array(*[F.lit(float(k)) for k in range(n)]).cast("array<double>")
        got = spark.range(-1, 2 * n + 3).select((F.col("id") / 2).alias("v")).withColumn("k", stats.range_of(F.col("v"), cuts)).collect()
        assert [r.k for r in got] == [sum(k < r.v for k in range(n)) for r in got]


def test_trend_verdict_without_resamples(spark):
    """Means and sizes, all that the verdict reads, are the same without the bootstrap; null excesses count for nothing."""
    rng = random.Random(3)
    series = [(f"s{k}", dt.date(y, 12, 31), 10.0 + k % 3 * (y - 2000) * (-1) ** k) for k in range(60) for y in range(2000, 2006)]
    excess = [(d, s, h, rng.random() if rng.random() < 0.9 else None) for s, d, _ in series for h in (1, 3)]
    a, b = spark.createDataFrame(series, "symbol string, d date, fv_median double"), spark.createDataFrame(excess, "d date, symbol string, horizon int, excess double")
    told = [{(r.trend, r.horizon): (r.n, pytest.approx(r.mean_excess)) for r in bt.fv_trend_audit(a, b, 4, 3, resamples=n).collect()} for n in (20, 0)]
    assert told[0] == told[1] and len(told[1]) > 4


def test_recovery_over_spans(spark):
    """Windows that begin and end anywhere in a span give what a loop gives, and a flag is no row a month."""
    rng = random.Random(8)
    day = lambda: dt.date(1999, 1, 1) + dt.timedelta(rng.randrange(2500))
    flags = list({(d, s): (d, s, 10.0, 10.0 + rng.random() * 4) for d, s in ((day(), rng.choice("abc")) for _ in range(150))}.values())
    bars = [(rng.choice("abcd"), day(), 10 + rng.random() * 4.5, 9 + rng.random()) for _ in range(400)]
    bars += [(s, d.replace(day=28, year=d.year + 2), 15.0, 9.5) for d, s, *_ in flags[:20]]
    for months in (5, 24):
        told = bt.recovery(spark.createDataFrame(flags, "d date, symbol string, price double, target double"), spark.createDataFrame(bars, "symbol string, date date, high double, close double"), months, unmatched=True)
        assert "trunc(" not in told._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.d, r.symbol): (r.recovered_on, r.peak_gain) for r in told.collect()}
        for d, s, price, target in flags:
            y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
            last = max(x for x in (dt.date(y, m + 1, 1) + dt.timedelta(k) for k in range(d.day)) if x.month == m + 1)
            inside = [(t, high) for z, t, high, _ in bars if z == s and d < t <= last]
            back = min((t for t, high in inside if high >= target), default=None)
            assert got[d, s] == (back, pytest.approx(max(h for _, h in inside) / price - 1) if inside else None)
        assert len(got) == len(flags)


def wide_case(spark):
    """Values of two factors with ties and nulls, an absent sector, two dates a year for some names, and forward excesses."""
    rng = random.Random(12)
    days = [dt.date(y, m, 1) for y in (2019, 2020, 2021) for m in (3, 9)]
    rows = [(d, s, ("g", "h", None)[s % 3], rng.choice([None, 0.0, 1.0, rng.gauss(0, 1)]), rng.choice([float("nan"), 2.0, rng.random()])) for d in days for s in range(90) if d.month == 3 or s % 5 == 0]
    fwd = [(d, s, h, rng.choice([0.25, rng.gauss(0, 1)])) for d, s, *_ in rows for h in (1, 3) if rng.random() < 0.8]
    values = saved(spark.createDataFrame(rows, "d date, symbol int, sector string, a double, b double"), "values")
    factors = [ranking.Factor("a", "x", "lower", F.col("a")), ranking.Factor("b", "y", "higher", F.col("b"))]
    excess = saved(spark.createDataFrame(fwd, "d date, symbol int, horizon int, excess double"), "excess")
    return values, factors, excess, bt.ic_observations(ranking.factor_rows(values, factors, ["d", "symbol", "sector"]), excess).where("pct is not null").withColumn("pct", F.round("pct", 9))


@pytest.mark.parametrize("most", [10**6, 20])
def test_wide_observations(spark, most):
    """Wide observations hold what the long ones hold, groups ranked as arrays and by ranges alike, and no name is a row a factor."""
    values, factors, excess, long = wide_case(spark)
    wide = bt.wide_observations(values, factors, excess, digits=9, most=most)
    assert {(x.d, x.symbol, x.super_group, x.horizon, f, x[f], x.excess) for x in wide.collect() for f in "ab" if x[f] is not None} == {(x.d, x.symbol, x.super_group, x.horizon, x.factor, x.pct, x.excess) for x in long.collect()}
    if most > 20:
        assert "Generate" not in wide._jdf.queryExecution().optimizedPlan().toString() and not any("/dealt-" in x for x in wide.inputFiles())


@pytest.mark.parametrize("most", [10**6, 20])
def test_cells_of_wide_observations(spark, monkeypatch, most):
    """Cells and spans of wide observations, as arrays and by ranges, are those of the long ones; small packs change nothing."""
    values, factors, excess, long = wide_case(spark)
    wide, long = bt.wide_observations(values, factors, excess, digits=9), saved(long, "long")
    monkeypatch.setattr(bt, "ROWS_PACKED", 30)
    for f, key in ((bt.ic_cells, bt.CELL), (bt.rolling_ic, [*bt.CELL, "span"])):
        want = {tuple(x[c] for c in key): (x.n, x.ic) for x in f(long).collect()}
        got = f(wide, most=most)
        assert {tuple(x[c] for c in key): (x.n, pytest.approx(x.ic, abs=1e-12)) for x in got.collect()} == want and len(want) >= 8
        assert dict(got.dtypes) == dict(f(long).dtypes)


@pytest.mark.parametrize("most, most_arrays", [(10**6, 10**7), (10, 10**7)])
def test_thresholds_of_wide_observations(spark, monkeypatch, most, most_arrays):
    """Thresholds of wide observations are those of the long ones, in one row and as arrays, whatever the factors of a task."""
    values, factors, excess, long = wide_case(spark)
    wide, long = bt.wide_observations(values, factors, excess, digits=9), saved(long, "long")
    told = lambda x: {(r.super_group, r.horizon): tuple(r) for r in bt.ic_thresholds(x, 30, most=most, most_arrays=most_arrays).collect()}
    got = told(wide)
    assert got == told(long) and len(got) == 4
    monkeypatch.setattr(bt, "FACTORS_A_TASK", 1)
    monkeypatch.setattr(bt, "ROWS_OF_MORE", 0)
    assert told(wide) == got


def test_intervals_of_wide_observations(spark):
    """Intervals of wide observations are those of the long ones; cells as arrays are near them, the same for any order, and each resample's correlation is that of the pairs drawn."""
    values, factors, excess, long = wide_case(spark)
    wide, long = bt.wide_observations(values, factors, excess, digits=9), saved(long, "long")
    told = lambda x, **o: {(r.super_group, r.factor, r.horizon): (r.lo, r.hi) for r in bt.ic_intervals(x, 200, **o).collect()}
    want, got = told(long), told(wide, large=20)
    assert told(wide) == {k: pytest.approx(v) for k, v in want.items()} and len(want) == 8
    assert got == {k: pytest.approx(v, abs=0.1) for k, v in want.items()} and got == told(wide.repartition(5), large=20) != want
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 60).astype(float), rng.integers(0, 40, 60) / 7
    order = np.lexsort((y, x))
    for r, c in enumerate(stats.resampled_correlations(x, y, 5, 1)):
        at = order[np.random.Generator(np.random.SFC64([1, r])).integers(0, 60, 60, dtype=np.int32)]
        assert c == pytest.approx(np.corrcoef(stats.midranks(x[at]), stats.midranks(y[at]))[0, 1])
    assert np.isnan(stats.resampled_correlations(np.ones(6), np.arange(6.0), 2, 1)).all()
