"""Queries that once did less than the whole job."""

import collections
import datetime as dt
import inspect
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions import stats
from rankweave.plans import backtest
from rankweave.queries import QUERIES
from rankweave.queries.backtest import undervalued
from rankweave.queries.base import SNAP, bound

SF = "/root/testdata/sf0.001"


def test_better_ranked_of_every_row(spark):
    """Every snapshot row has a peer but the best of each date and sector."""
    got = QUERIES["better_ranked"](spark, SF).select("d", "symbol").distinct().count()
    s = bound(spark, SF, SNAP)
    assert got == s.count() - s.select("d", "sector").distinct().count()
    assert QUERIES["better_ranked"](spark, SF).where(F.col("symbol") % 10 != 0).count() > 0


def test_null_draws_are_whole(spark, monkeypatch):
    """three_gate and bootstrap_means draw 1000 times, as their operators do by default."""
    for module, name, query, count in ((backtest, "ic_thresholds", "three_gate", "iterations"), (stats, "bootstrap_means", "bootstrap_means", "resamples")):
        f, seen = getattr(module, name), []

        def spy(*a, **b):
            seen.append(inspect.signature(f).bind(*a, **b))
            seen[-1].apply_defaults()
            return f(*a, **b)

        monkeypatch.setattr(module, name, spy)
        QUERIES[query](spark, SF)  # planned only
        assert [x.arguments[count] for x in seen] == [1000]


def spearman(pairs):
    def ranks(v):
        return [sum(x < y for x in v) + (v.count(y) + 1) / 2 for y in v]

    x, y = (ranks(list(v)) for v in zip(*pairs))
    return statistics.correlation(x, y) if len(pairs) > 1 and len(set(x)) > 1 and len(set(y)) > 1 else None


def test_ic_thresholds(spark):
    """Against a shuffle in plain Python that orders by the same seeded hash."""
    r = random.Random(4)
    names, days = range(7), [dt.date(2020, 3, 1), dt.date(2020, 9, 1), dt.date(2021, 3, 1)]
    excess = {(d, g, s, h): round(r.gauss(0, 1), 3) for d in days for g in "ab" for s in names for h in (1, 3) if r.random() < 0.9}
    rows = [(d, s + 10 * (g == "b"), g, h, f, float(r.randint(0, 9)), e) for (d, g, s, h), e in excess.items() for f in ("f", "g")]
    obs = spark.createDataFrame(rows, "d date, symbol long, super_group string, horizon int, factor string, pct double, excess double")
    n = 40
    # the order of an iteration is that of the rows' hashes, mixed with its number
    known = obs.select("d", "super_group", "symbol", "horizon").distinct().withColumn("k", F.xxhash64("d", "symbol", "horizon")).collect()
    bucket = collections.defaultdict(list)
    for i in range(n):
        for x, k in zip(known, backtest._mixed(np.array([x.k for x in known]), 1, i).tolist()):
            bucket[i, x.d, x.super_group].append((k, x.symbol, x.horizon))
    of = {(d, s, h): e for d, s, _, h, _, _, e in rows}
    given = {}
    for (i, d, g), v in bucket.items():
        for (_, s, h), (t, u) in zip(sorted(v), sorted((s, h) for _, s, h in v)):
            given[i, d, s, h] = of[d, t, u]
    pools = collections.defaultdict(list)
    for i in range(n):
        cell = collections.defaultdict(dict)
        for d, s, g, h, f, p, _ in sorted(rows):
            cell[g, h, f].setdefault((s, d.year), (p, given[i, d, s, h]))
        for (g, h, _), v in cell.items():
            ic = spearman(list(v.values()))
            if ic is not None:
                pools[g, h].append(abs(ic))
    got = {(x.super_group, x.horizon): x for x in backtest.ic_thresholds(obs.repartition(3), n).collect()}
    assert set(got) == set(pools)
    for k, v in pools.items():
        v.sort()
        assert got[k].draws == len(v)
        assert got[k].n == len({(x[1], x[0].year) for x in rows if (x[2], x[3]) == k})
        assert got[k].t99 == pytest.approx(v[int(len(v) * 0.99)]) and got[k].t995 == pytest.approx(v[int(len(v) * 0.995)])


def test_recovery_of_every_flag(spark):
    """Names flagged too late to have a bar after them stay, as not recovered."""
    flags = undervalued(spark, SF).count()
    assert QUERIES["recovery"](spark, SF).count() == flags
    assert sum(r.n for r in QUERIES["recovery_summary"](spark, SF).collect()) == flags
    one = QUERIES["kept_or_demoted"](spark, SF).first()
    assert one.kept + one.demoted == flags
    assert QUERIES["recovery"](spark, SF).where("peak_gain is null and not recovered and final_gain = 0").count() > 0
