"""Back-test plans over customers as companies."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import stats
from rankweave.operators import fair_value as fv
from rankweave.operators import ranking as rk
from rankweave.plans import backtest as bt
from rankweave.plans import outcomes as out
from rankweave.queries.base import MONTHLY, PERIODS, SNAP, bound, query
from rankweave.queries.ranking import BUCKET_SQL, DIR_SQL, FEATURES_SQL, FLOOR_SQL, OWN_SQL, PEER_SQL, RATIONALE_SQL, SCORES_SQL, direction, factor_sql, fair_values, panel, pct_sql, ranked_with_value
from rankweave.sources import candidates as cand
from rankweave.sources.scratch import saved

R = 7

RETURNS_SQL = f"""
fb as (select symbol, date, max(close) as close from ({MONTHLY}) b group by 1, 2),
fs as (select d, symbol, price, h as horizon, cast(d + h * interval 1 year as date) as due from ({SNAP}) s, (values (1), (3)) v(h)),
fr as (select s.d, s.symbol, s.horizon, b.close / s.price - 1 as ret from fs s asof join fb b on s.symbol = b.symbol and s.due <= b.date where s.price > 0),
fe as (select *, ret - avg(ret) over (partition by d, horizon) as excess from fr)"""


def returns(spark, sf_dir):
    closes = bound(spark, sf_dir, MONTHLY).groupBy("symbol", "date").agg(F.max("close").alias("close"))
    return bt.forward_returns(bound(spark, sf_dir, SNAP), closes)


def excess(spark, sf_dir):
    ret = saved(returns(spark, sf_dir), "returns")  # read twice
    return bt.excess_returns(ret, bt.mean_benchmark(ret)).withColumn("excess", F.round("excess", 6))


EX = RETURNS_SQL.replace("ret - avg(ret) over (partition by d, horizon) as excess", "round(ret - avg(ret) over (partition by d, horizon), 6) as excess")


@query("forward_excess", f"with {EX} select d, symbol, horizon, round(ret, {R}) as ret, excess from fe")
def forward_excess(spark, sf_dir):
    return excess(spark, sf_dir).select("d", "symbol", "horizon", F.round("ret", R).alias("ret"), "excess")


OBS_SQL = f"""{FEATURES_SQL}, {factor_sql('panel')}, {pct_sql('sector')}, {EX},
obs as (select l.d, l.symbol, l.sector as super_group, e.horizon, l.factor, l.category, case when l.direction = 'lower' then 100 - p.pct else p.pct end as pct, e.excess
  from long l join p_sector p on p.d = l.d and p.symbol = l.symbol and p.factor = l.factor join fe e on e.d = l.d and e.symbol = l.symbol)"""


def observations(spark, sf_dir):
    values, factors = rk.saved_values(panel(spark, sf_dir), rk.default_factors(), ["d", "symbol", "sector"])
    return bt.ic_observations(rk.factor_rows(values, factors, ["d", "symbol", "sector"]), excess(spark, sf_dir)).where("pct is not null")


@query("ic_observations", f"with {OBS_SQL} select d, symbol, super_group, horizon, factor, round(pct, 6) as pct from obs")
def ic_observations(spark, sf_dir):
    return observations(spark, sf_dir).select("d", "symbol", "super_group", "horizon", "factor", F.round("pct", 6).alias("pct"))


CELLS_SQL = f"""{OBS_SQL},
once as (select *, row_number() over (partition by super_group, factor, horizon, symbol, year(d) order by d) as k from obs),
rk as (select super_group, factor, horizon, rank() over (partition by super_group, factor, horizon order by round(pct, 9)) + (count(*) over (partition by super_group, factor, horizon, round(pct, 9)) - 1) / 2.0 as rx,
  rank() over (partition by super_group, factor, horizon order by excess) + (count(*) over (partition by super_group, factor, horizon, excess) - 1) / 2.0 as ry from once where k = 1),
cells as (select super_group, factor, horizon, count(*) as n, case when count(*) >= 2 and min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end as ic from rk group by 1, 2, 3)"""


def wide_observations(spark, sf_dir):
    """Observations with rounded percentiles, a row a name, date and horizon; written once."""
    values, factors = rk.saved_values(panel(spark, sf_dir), rk.default_factors(), ["d", "symbol", "sector"])
    return bt.wide_observations(values, factors, excess(spark, sf_dir), digits=9)


@query("ic_cells", f"with {CELLS_SQL} select super_group, factor, horizon, n, round(ic, 6) as ic from cells")
def ic_cells(spark, sf_dir):
    return bt.ic_cells(wide_observations(spark, sf_dir)).withColumn("ic", F.round("ic", 6))


@query("strongest_cells", f"with {CELLS_SQL} select super_group, horizon, arg_max(factor, abs(round(ic, 9))) as factor, round(arg_max(ic, abs(round(ic, 9))), 6) as ic from cells where ic is not null group by 1, 2")
def strongest(spark, sf_dir):
    cells = bt.ic_cells(wide_observations(spark, sf_dir)).withColumn("ic", F.round("ic", 9))
    return bt.strongest_cells(cells).withColumn("ic", F.round("ic", 6))


@query("rolling_ic", f"""with {OBS_SQL}, sp as (select *, min(d) over w as a, max(d) over w as z from obs window w as (partition by super_group, horizon)),
  s2 as (select *, case when a = z then 0 else cast(d - a >= floor(floor((z - a) * 86400000 / 3.0) / 86400000) as int) + cast(d - a >= floor(floor((z - a) * 86400000 / 3.0) * 2 / 86400000) as int) end as span from sp),
  once as (select *, row_number() over (partition by super_group, factor, horizon, span, symbol, year(d) order by d) as k from s2),
  rk as (select super_group, factor, horizon, span, rank() over (partition by super_group, factor, horizon, span order by round(pct, 9)) + (count(*) over (partition by super_group, factor, horizon, span, round(pct, 9)) - 1) / 2.0 as rx,
    rank() over (partition by super_group, factor, horizon, span order by excess) + (count(*) over (partition by super_group, factor, horizon, span, excess) - 1) / 2.0 as ry from once where k = 1)
  select super_group, factor, horizon, span, count(*) as n, round(case when count(*) >= 2 and min(rx) < max(rx) and min(ry) < max(ry) then corr(rx, ry) end, 6) as ic from rk group by 1, 2, 3, 4""")
def rolling(spark, sf_dir):
    return bt.rolling_ic(wide_observations(spark, sf_dir)).withColumn("ic", F.round("ic", 6))


@query("ic_intervals")
def ic_intervals(spark, sf_dir):
    """Intervals of the cells over 1000 paired resamples; tests compare them with a loop."""
    told = bt.ic_intervals(wide_observations(spark, sf_dir))
    return told.select(*bt.CELL, F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("three_gate")
def gates(spark, sf_dir):
    """Cells, spans and shuffled thresholds to verdicts; the shuffle is beyond SQL, tests check its parts."""
    obs = wide_observations(spark, sf_dir)
    gated = bt.three_gate(bt.ic_cells(obs), bt.rolling_ic(obs), bt.ic_thresholds(obs))
    return gated.select(*bt.CELL, "n", F.round("ic", 6).alias("ic"), "verdict")


@query("ic_summary")
def ic_summary(spark, sf_dir):
    """Verdicts counted per horizon."""
    obs = wide_observations(spark, sf_dir)
    return bt.ic_summary(bt.three_gate(bt.ic_cells(obs), bt.rolling_ic(obs), bt.ic_thresholds(obs)))


@query("heat_map")
def heat_map(spark, sf_dir):
    """Passing cells as a table of groups by factors."""
    obs = wide_observations(spark, sf_dir)
    return bt.heat_map(bt.three_gate(bt.ic_cells(obs), bt.rolling_ic(obs), bt.ic_thresholds(obs)), [f.name for f in rk.default_factors()])


@query("false_discovery")
def false_discovery(spark, sf_dir):
    """How many groups' strongest cells pass the null thresholds against what chance gives."""
    obs = wide_observations(spark, sf_dir)
    return bt.false_discovery(bt.strongest_cells(bt.ic_cells(obs)), bt.ic_thresholds(obs), 16)


VALUES = ", ".join(f"('{n}', '{c}', {w})" for n, ws in cand.BUILT_IN.items() for c, w in zip(cand.CATEGORIES, ws))
SUB_VALUES = ", ".join(f"('{n}', '{c}', '{f}', {w})" for (n, c), fs in cand.SUB_WEIGHTS.items() for f, w in fs.items())
SCORE_SQL = f"""{OBS_SQL}, {DIR_SQL.replace("k as (", "dk as (").replace("from k group", "from dk group").replace("g as (", "dg as (").replace("from g)", "from dg)").replace("h as (", "dh as (").replace("from h)", "from dh)").replace("t as (select *, case when sp", "dt as (select *, case when sp")},
dirs as (select d, symbol, case when m < 3 then 'insufficient_data' when t <= 0 and f > 0 then 'improving' when f <= 0 then 'declining' when trend = 'improving' and ahead = 'improving' then 'improving' when ahead = 'declining' then 'declining'
  when (trend = 'declining' or decay) and ahead <> 'improving' then 'declining' else 'stable' end as direction from dt),
wt(candidate, category, w) as (values {VALUES}), sw(candidate, category, factor, s) as (values {SUB_VALUES}),
seen as (select o.*, wt.candidate, wt.w, case when l.candidate is not null then sw.s else 1.0 end as share from obs o join wt using (category) left join (select distinct candidate, category from sw) l on l.candidate = wt.candidate and l.category = o.category
  left join sw on sw.candidate = wt.candidate and sw.category = o.category and sw.factor = o.factor left join dirs r on r.d = o.d and r.symbol = o.symbol where not (wt.candidate = 'value-deep-no-declining-fundamentals' and r.direction = 'declining')),
cat as (select candidate, d, symbol, horizon, category, w, sum(pct * share) / sum(share) as s, any_value(excess) as excess from seen where share is not null group by 1, 2, 3, 4, 5, 6),
sc as (select candidate, d, symbol, horizon, round(sum(w * s) / sum(w), 9) as score, any_value(excess) as excess from cat group by 1, 2, 3, 4 having sum(w) > 0),
rn as (select *, count(*) over v as n, row_number() over (v order by score desc, symbol) as up, row_number() over (v order by score, symbol) as down from sc window v as (partition by candidate, horizon, d)),
daily as (select candidate, horizon, d, avg(excess) filter (up <= greatest(1, ceil(n * 0.1))) as top, avg(excess) filter (down <= greatest(1, ceil(n * 0.1))) as bottom from rn where n >= 10 group by 1, 2, 3)"""


def daily(spark, sf_dir):
    kind = spark.createDataFrame([(f.name, f.category) for f in rk.default_factors()], "factor string, category string")
    seen = observations(spark, sf_dir).join(F.broadcast(kind), "factor").join(direction(spark, sf_dir), ["d", "symbol"], "left")
    scores = bt.candidate_scores(seen, *cand.built_in(spark))
    return bt.decile_performance(scores.withColumn("score", F.round("score", 9)))


@query("decile_performance", f"with {SCORE_SQL} select candidate, horizon, d, round(top, 6) as top, round(bottom, 6) as bottom from daily")
def decile_performance(spark, sf_dir):
    return daily(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("top", "bottom")})


@query("weight_validation", f"""with {SCORE_SQL}, m as (select *, avg(top) over (partition by candidate, horizon order by d) as m from daily), q as (select *, m - max(m) over (partition by candidate, horizon order by d) as dd from m)
  select candidate, horizon, count(*) as dates, round(avg(top), 6) as top, round(case when stddev_samp(top) > 0 then avg(top) / stddev_samp(top) end, 6) as sharpe,
  round(avg(top) / sqrt(avg(top * top) filter (top < 0)), 6) as sortino, round(least(0, min(dd)), 6) as drawdown from q group by 1, 2""")
def weight_validation(spark, sf_dir):
    s = bt.performance_summary(daily(spark, sf_dir))
    return s.select("candidate", "horizon", "dates", *[F.round(c, 6).alias(c) for c in ("top", "sharpe", "sortino", "drawdown")])


PASS_SQL = f"""np as (select s.d, s.symbol, count(*) as n_periods from known s group by 1, 2),
fa as (select k.d, k.symbol, avg(coalesce(roic, case when equity + debt - cash > 0 then net_income / (equity + debt - cash) end)) filter (age < 5) as roic5 from known k group by 1, 2),
f0 as (select p.*, n_periods, roic5, case when interest0 > 0 then ebit0 / interest0 end as cov from panel p join np using (d, symbol) join fa using (d, symbol)),
f1 as (select *, count(roic5) over w as nr, count(cov) over w as nc from f0 window w as (partition by d, sector)),
f2 as (select *, (select 100.0 * (count(*) filter (b.roic5 < a.roic5) + (count(*) filter (b.roic5 = a.roic5) + 1) / 2.0 - 1) / nullif(a.nr - 1, 0) from f0 b where b.d = a.d and b.sector = a.sector) as rp,
  (select 100.0 * (count(*) filter (b.cov < a.cov) + (count(*) filter (b.cov = a.cov) + 1) / 2.0 - 1) / nullif(a.nc - 1, 0) from f0 b where b.d = a.d and b.sector = a.sector) as cp from f1 a),
f3 as (select d, symbol, n_periods, profitable_years >= 3 as profit, case when roic5 is not null then case when roic5 >= 0.08 then true when nr < 3 then roic5 > 0 else rp >= 33 end end as pass_roic,
  case when interest0 is null or interest0 <= 0 then true when cov is not null then case when cov >= 5 then true when nc < 3 then cov >= 1 else cp >= 25 end end as pass_coverage from f2),
fl as (select d, symbol, case when n_periods >= 3 then profit end as pass_profit, pass_roic, pass_coverage, n_periods >= 3 and profit and coalesce(pass_roic, true) and coalesce(pass_coverage, true) as pass_combined from f3),
u as (select d, symbol, 'pass_profit' as rule, pass_profit as passed from fl union all select d, symbol, 'pass_roic', pass_roic from fl union all select d, symbol, 'pass_coverage', pass_coverage from fl union all select d, symbol, 'pass_combined', pass_combined from fl),
fx as (select rule, horizon, passed, count(*) as n, avg(excess) as m from u join fe using (d, symbol) where passed is not null group by 1, 2, 3)"""


def flags(spark, sf_dir):
    """The panel with ROIC from the statements where a period has none."""
    snap, periods = bound(spark, sf_dir, SNAP), bound(spark, sf_dir, PERIODS)
    c = F.col
    invested = c("equity") + c("debt") - F.coalesce("cash", F.lit(0.0))
    periods = periods.withColumn("roic", F.coalesce("roic", F.when(invested > 0, c("net_income") / invested)))
    return bt.floor_flags(snap.drop("roic").join(rk.period_features(snap, periods), ["d", "symbol"]))


@query("floor_audit", f"with {FEATURES_SQL}, {EX}, {PASS_SQL} select rule, horizon, passed, n, round(m, 6) as mean_excess from fx")
def floor_audit(spark, sf_dir):
    told = bt.floor_audit(flags(spark, sf_dir), excess(spark, sf_dir))
    return told.select("rule", "horizon", "passed", "n", F.round("mean_excess", 6).alias("mean_excess"))


@query("floor_verdict", f"""with {FEATURES_SQL}, {EX}, {PASS_SQL}, g as (select max(m) filter (passed) - max(m) filter (not passed) as gap from fx where rule = 'pass_combined' and horizon = 3)
  select round(gap, 6) as gap, case when gap < -0.02 then 'fail' when gap > 0.02 then 'pass' else 'inconclusive' end as verdict from g""")
def floor_verdict(spark, sf_dir):
    return bt.floor_verdict(bt.floor_audit(flags(spark, sf_dir), excess(spark, sf_dir))).withColumn("gap", F.round("gap", 6))


@query("static_portfolios", f"""with {RETURNS_SQL}, b as (select d, horizon, avg(ret) as ret from fr group by 1, 2), p as (select 'hold' as portfolio, d, horizon, ret as r, 0.0 as t, 0.0 as i, ret from b union all select 'barbell', d, horizon, 0.5 * ret + 0.5 * (pow(1.1e0, horizon) - 1), 0.5, 0.5, ret from b
    union all select 'puts', d, horizon, pow(1.1e0, horizon) - 1, 1.0, 1.0, ret from b), g as (select portfolio, horizon, count(*) as n, avg(r) as m, avg(r - ret) as e, max(t) as t, max(i) as i from p where d >= date '1996-01-01' group by 1, 2),
  f as (select *, m - 2 * 10 / 10000.0 * t * horizon as net from g)
  select portfolio, horizon, n, round(m, 6) as mean_realised, round(e, 6) as mean_excess, round(net, 6) as after_friction, round(case when net <= 0 then net else net * (1 - 0.371) end, 6) as after_tax_long,
    round(case when net <= 0 then net when horizon <= 1 then net * (1 - 0.541) else net * i * (1 - 0.541) + net * (1 - i) * (1 - 0.371) end, 6) as after_tax_blended from f""")
def static_portfolios(spark, sf_dir):
    bench = bt.mean_benchmark(returns(spark, sf_dir))
    perf = bt.performance(bt.static_returns(bench, bt.static_portfolios(0.04, 0.06), "1996-01-01"), ["portfolio", "horizon"])
    c = F.col
    of = lambda k: sum((F.when(c("portfolio") == n, v[k]).otherwise(0.0) for n, v in bt.STATIC_TURNOVER.items()), F.lit(0.0))
    cols = bt.after_frictions(c("mean_realised"), c("horizon"), of(0), of(1), 10)
    return perf.select("portfolio", "horizon", "n", F.round("mean_realised", 6).alias("mean_realised"), F.round("mean_excess", 6).alias("mean_excess"), *[F.round(v, 6).alias(k) for k, v in cols.items()])


@query("mean_benchmark", f"with {RETURNS_SQL}, b as (select d, horizon, avg(ret) as ret from fr group by 1, 2) select horizon, round(avg(ret), 7) as mean_benchmark from b where d >= date '1996-01-01' group by 1")
def mean_benchmark(spark, sf_dir):
    return bt.mean_by_horizon(bt.mean_benchmark(returns(spark, sf_dir)), "1996-01-01").withColumn("mean_benchmark", F.round("mean_benchmark", 7))


@query("usable_dates", f"select distinct d from ({SNAP}) s where (d <= date '1998-12-31' and d + interval 3 year <= date '2001-08-01') or d = date '2000-12-31'")
def usable_dates(spark, sf_dir):
    s = bound(spark, sf_dir, SNAP)
    day = lambda x: F.lit(x).cast("date")
    return bt.usable_dates(s, day("1998-12-31"), day("2001-08-01"), 3, s.where("d = date '2000-12-31'"))


# ---- values over time, and what became of them

VALUE_SQL = f"{PEER_SQL}, {OWN_SQL}, vt as (select d, symbol, price, round(p25, 8) as p25, round(med, 8) as median, round(p75, 8) as p75, sector from fvs)"
#: Bars on the scale of the snapshots' prices.
BAR_SQL = f"bars as (select symbol, date, max(close) / 800 as close, max(high) / 800 as high from ({MONTHLY}) b group by 1, 2)"


def bars(spark, sf_dir):
    return bound(spark, sf_dir, MONTHLY).groupBy("symbol", "date").agg((F.max("close") / 800).alias("close"), (F.max("high") / 800).alias("high"))


def values(spark, sf_dir, *more):
    told = fair_values(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("p25", "median", "p75")})
    return told.select("d", "symbol", "price", "p25", "median", "p75", *more)


TREND_SQL = "case when p is null then 'insufficient_data' when p > 5 then 'improving' when p < -5 then 'declining' else 'stable' end"


@query("fv_trend", f"""with {VALUE_SQL}, g as (select symbol, d, median from vt where median > 0), e as (select symbol, max(d) as z from g group by 1), w as (select g.* from g join e using (symbol) where d >= z - interval 6 year),
  r as (select symbol, count(*) as samples, min(d) as window_start, arg_min(median, d) as f, arg_max(median, d) as l, regr_slope(median, cast(datediff('day', date '1970-01-01', d) as double) / 365.25) as s from w group by 1), q as (select *, case when samples >= 4 then s / f * 100 end as p from r)
  select v.symbol, coalesce(samples, 0) as samples, window_start, round(p, 5) as slope_pct, round(case when samples >= 4 then (l - f) / f * 100 end, 5) as change_pct, {TREND_SQL} as trend from (select distinct symbol from vt) v left join q using (symbol)""")
def fv_trend(spark, sf_dir):
    """Trends of yearly values over six years with four samples: the snapshots are a year apart."""
    series = saved(values(spark, sf_dir).select("symbol", F.col("d").alias("date"), F.col("median").alias("fv_median")), "series")
    newest = series.where("date = date '2000-12-31'")
    told = bt.fv_trend(bt.append_today(series.where("date < date '2000-12-31'"), newest.unionByName(series.where("date > date '2000-12-31'"))), 6, 4)
    return told.select("symbol", "samples", "window_start", F.round("slope_pct", 5).alias("slope_pct"), F.round("change_pct", 5).alias("change_pct"), "trend")


#: Orders as a summary of options: some names have a call, some a put, those with few orders no entry.
BEST = """
select o_custkey as symbol, max(case when o_orderkey % 5 < 3 then o_totalprice end) as best_call, max(case when o_orderkey % 7 < 4 then o_totalprice end) as best_put
from {orders} group by o_custkey having count(*) > 4"""


def _headline_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    told = {"actionable-buy": "coalesce(printf('%.1f', up) || '% ', '')", "bottom-decile-composite": "cast(floor(round(composite, 7) + 0.5) as int)", "model-incompatible-industry": "industry"}
    parts = {n: t.replace("{} ", "{}") if n == "actionable-buy" else t for n, t in rk.HEADLINES.items()}
    return "case reason " + " ".join(f"when '{n}' then " + " || ".join([quoted(t.partition("{}")[0]), *([told[n], quoted(t.partition("{}")[2])] if n in told else [])]) for n, t in parts.items()) + " end"


@query("rationale_attached", f"""with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}, {VALUE_SQL}, {BUCKET_SQL}, {RATIONALE_SQL}, z_bo as ({BEST}),
  z_g as (select symbol, d, median from vt where median > 0), z_ge as (select symbol, max(d) as z from z_g group by 1), z_gw as (select z_g.* from z_g join z_ge using (symbol) where d >= z - interval 6 year),
  z_gr as (select symbol, count(*) as samples, arg_min(median, d) as f, regr_slope(median, cast(datediff('day', date '1970-01-01', d) as double) / 365.25) as s from z_gw group by 1), z_gt as (select symbol, case when samples >= 4 then s / f * 100 end as p from z_gr),
  z_tr as (select symbol, {TREND_SQL} as trend from z_gt)
  select d, symbol, bucket, reason, {_headline_sql()} as headline, cast(case when z_bo.symbol is null then true else best_call is not null and best_put is not null end as int) as liquid, coalesce(trend, 'insufficient_data') as trend,
    array_to_string(list_slice(list_concat(list_slice(coalesce(down_, []), 1, 3), list_filter([case when negative_equity then 'Negative shareholders'' equity (sustained buybacks; ROIC nulls structurally)' end, case when trend = 'declining' then 'Fair value trending down ~2 years (informational; not a demote)' end,
      case when divergent then 'Peer cohort deemed unreliable — FV uses own history only' end, case when confidence = 'low' then 'Low-confidence fair value (limited anchor coverage)' end, case when lacking is not null then 'Missing data for: ' || lacking end], lambda x: x is not null)), 1, 3), '; ') as weaknesses
  from rr join lists using (d, symbol) left join z_bo using (symbol) left join z_tr using (symbol)""")
def rationale_attached(spark, sf_dir):
    """Ranked rows with value, liquidity and the trend of their fair values, and what is said of their bucket."""
    value = saved(fair_values(spark, sf_dir).select("d", "symbol", "p25", "median", "upside_p25", "confidence", "divergent"), "values")
    series = value.select("symbol", F.col("d").alias("date"), F.round("median", 8).alias("fv_median"))
    best = bound(spark, sf_dir, BEST)
    rows = fv.attach(rk.rank(panel(spark, sf_dir)), value.drop("median"), best, bt.fv_trend(series, 6, 4))
    told = rk.bucket_rationale(rk.bucket(rows).withColumns({c: F.round(c, 6) for c in ("price", "p25")}))
    return told.select("d", "symbol", "bucket", "reason", "headline", F.col("liquid").cast("int").alias("liquid"), "trend", F.array_join("weaknesses", "; ").alias("weaknesses"))


FV_AUDIT_SQL = f"""{VALUE_SQL}, {EX}, j as (select a.symbol, a.d, b.d as t, b.median from vt a join vt b on a.symbol = b.symbol and b.d > a.d - interval 4 year and b.d <= a.d and b.median is not null),
  g as (select symbol, d, count(*) as n, arg_min(median, t) as f, regr_slope(median, cast(datediff('day', date '1970-01-01', t) as double) / 365.25) as s from j group by 1, 2), q as (select v.symbol, v.d, case when n >= 3 and f > 0 then s / f * 100 end as p from vt v left join g using (symbol, d)),
  tr as (select symbol, d, {TREND_SQL} as trend from q), au as (select trend, horizon, count(*) as n, avg(excess) as m from tr join fe using (d, symbol) group by 1, 2)"""


def fv_audit(spark, sf_dir, **options):
    series = saved(values(spark, sf_dir).select("symbol", "d", F.col("median").alias("fv_median")), "series")
    return bt.fv_trend_audit(series, excess(spark, sf_dir), 4, 3, **options)


@query("fv_trend_audit", f"with {FV_AUDIT_SQL} select trend, horizon, n, round(m, 6) as mean_excess from au")
def fv_trend_audit(spark, sf_dir):
    return fv_audit(spark, sf_dir).select("trend", "horizon", "n", F.round("mean_excess", 6).alias("mean_excess"))


@query("fv_trend_verdict", f"""with {FV_AUDIT_SQL}, x as (select max(m) filter (trend = 'declining') as a, max(n) filter (trend = 'declining') as an, max(n) filter (trend = 'stable') as sn, sum(m * n) filter (trend in ('stable', 'improving')) / sum(n) filter (trend in ('stable', 'improving')) as k from au where horizon = 3),
  y as (select case when an >= 30 and sn >= 30 then a - k end as gap from x) select round(gap, 6) as gap, case when gap < -0.02 then 'pass' when gap > 0.02 then 'fail' else 'inconclusive' end as verdict from y""")
def fv_trend_verdict(spark, sf_dir):
    return bt.fv_trend_verdict(fv_audit(spark, sf_dir, resamples=0)).withColumn("gap", F.round("gap", 6))


BACK_SQL = f"""{VALUE_SQL}, {BAR_SQL}, fg as (select d, symbol, price, p25 as target from vt where price > 0 and price < p25),
  jr as (select f.*, b.date as t, b.high, b.close from fg f left join bars b on b.symbol = f.symbol and b.date > f.d and b.date <= f.d + interval 24 month),
  rc as (select d, symbol, price, target, min(t) filter (high >= target) as t, max(high) as peak, coalesce(arg_max(close, t) filter (t is not null), any_value(price)) as final from jr group by 1, 2, 3, 4)"""


def undervalued(spark, sf_dir):
    v = values(spark, sf_dir)
    return v.where(fv.undervalued(F.col("price"), F.col("p25"))).select("d", "symbol", "price", F.col("p25").alias("target"))


def recovered(spark, sf_dir):
    """Every flag, those without a bar in their window too: as not recovered."""
    return bt.recovery(undervalued(spark, sf_dir), bars(spark, sf_dir), unmatched=True)


@query("recovery", f"with {BACK_SQL} select d, symbol, t is not null as recovered, t as recovered_on, round(peak / price - 1, 6) as peak_gain, round(final / price - 1, 6) as final_gain from rc")
def recovery(spark, sf_dir):
    told = recovered(spark, sf_dir)
    return told.select("d", "symbol", "recovered", "recovered_on", F.round("peak_gain", 6).alias("peak_gain"), F.round("final_gain", 6).alias("final_gain"))


def direction_sql():
    """The directions of names as in SCORE_SQL, alone."""
    return SCORE_SQL[SCORE_SQL.index("dk as (") : SCORE_SQL.index("wt(candidate")].rstrip().rstrip(",")


@query("recovery_summary", f"""with {BACK_SQL}, {direction_sql()}, r as (select rc.*, direction from rc join dirs using (d, symbol))
  select direction, count(*) as n, round(count(t) * 1.0 / count(*), 6) as rate, round(count(*) filter (t - d <= 12 * 30.44) * 1.0 / count(*), 6) as within_12m, round(quantile_cont(peak / price - 1, 0.5) filter (t is not null), 6) as peak_median,
    round(count(*) filter (t is null and (final - price) / price * 100 < -5) * 1.0 / count(*), 6) as lost, round(count(*) filter (t is null and (final - price) / price * 100 > 5) * 1.0 / count(*), 6) as partial_gain from r group by 1""")
def recovery_summary(spark, sf_dir):
    rows = recovered(spark, sf_dir).join(direction(spark, sf_dir), ["d", "symbol"])
    told = bt.recovery_summary(rows, ["direction"])
    return told.select("direction", "n", *[F.round(c, 6).alias(c) for c in ("rate", "within_12m", "peak_median", "lost", "partial_gain")])


@query("kept_or_demoted", f"""with {BACK_SQL}, {direction_sql()}, r as (select coalesce(direction = 'improving', false) as k, t is not null as b, t is null and (final - price) / price * 100 < -5 as l from rc join dirs using (d, symbol)),
  g as (select count(*) filter (k) as kept, count(*) filter (not k) as demoted, avg(b::int) filter (k) * 100 as kb, avg(b::int) filter (not k) * 100 as db, avg(l::int) filter (k) * 100 as kl, avg(l::int) filter (not k) * 100 as dl from r)
  select kept, demoted, round(kb, 6) as kept_recovery, round(db, 6) as demoted_recovery, round(kb - db, 6) as recovery_gap, round(kl - dl, 6) as lost_gap from g""")
def kept_or_demoted(spark, sf_dir):
    rows = recovered(spark, sf_dir).join(direction(spark, sf_dir), ["d", "symbol"])
    told = bt.kept_or_demoted(rows, F.col("direction") == "improving")
    return told.select("kept", "demoted", *[F.round(c, 6).alias(c) for c in ("kept_recovery", "demoted_recovery", "recovery_gap", "lost_gap")])


ACC_SQL = f"""{VALUE_SQL}, {BAR_SQL}, aw as (select v.*, h as horizon, cast(d + h * interval 1 year as date) as due from vt v, (values (1), (2), (3)) t(h) where price > 0),
  ax as (select a.d, a.symbol, a.horizon, max(b.close) as peak, min(b.close) as trough from aw a join bars b on b.symbol = a.symbol and b.date between a.d and a.due group by 1, 2, 3),
  ar as (select a.*, peak, trough, b.close as e, (b.close - price) / price * 100 as ret from (select * from aw join ax using (d, symbol, horizon)) a asof join bars b on a.symbol = b.symbol and a.due <= b.date),
  ab as (select d, horizon, avg(ret) as m, quantile_disc(-ret, 0.5) * -1 as q, sum(ret * market_cap) / sum(market_cap) as c from ar join (select d, symbol, market_cap from ({SNAP}) s) using (d, symbol) group by 1, 2),
  ac as (select ar.*, ret - m as ex_mean, ret - q as ex_mid, ret - c as ex_cap from ar join ab using (d, horizon))"""


def accuracy_rows(spark, sf_dir, *more):
    """Outcomes of fair values against the mean, the middle name and the mean by market value of the date."""
    v, b = saved(values(spark, sf_dir, "sector", "market_cap", *more), "values"), bars(spark, sf_dir).select("symbol", "date", "close")
    plain = saved(bt.accuracy_rows(v, b), "outcomes")
    rows = plain.groupBy("d", "horizon").agg(F.avg("ret_pct").alias("mean"), stats.upper_median("ret_pct").alias("mid"), (F.sum(F.col("ret_pct") * F.col("market_cap")) / F.sum("market_cap")).alias("cap"))
    bench = rows.select("d", "horizon", F.expr("stack(3, 'mean', mean, 'mid', mid, 'cap', cap) as (name, ret_pct)"))
    return saved(bt.with_benchmarks(plain, bench), "accuracy")


HIT_SQL = ", ".join(f"cast({x} >= {y} as int) as {n}hit_{y}" for n, x in (("", "e"), ("peak_", "peak")) for y in ("p25", "median", "p75"))


@query("accuracy_rows", f"with {ACC_SQL} select d, symbol, horizon, round(ret, 5) as ret_pct, round(peak, 6) as peak, round(trough, 6) as trough, round(ex_mean, 5) as excess_mean, round(ex_cap, 5) as excess_cap, {HIT_SQL} from (select * replace (round(e, 8) as e, round(peak, 8) as peak) from ac) ac")
def accuracy_outcomes(spark, sf_dir):
    told = accuracy_rows(spark, sf_dir)
    hits = [(F.round(reached, 8) >= F.col(x)).cast("int").alias(f"{kind}hit_{x}") for kind, reached in (("", "end_price"), ("peak_", "peak")) for x in bt.HITS]
    return told.select("d", "symbol", "horizon", *[F.round(c, 5).alias(c) for c in ("ret_pct", "excess_mean", "excess_cap")], *[F.round(c, 6).alias(c) for c in ("peak", "trough")], *hits)


def wilson_sql(k: str, m: str, side: str) -> str:
    return f"(({k} * 1.0 / {m} + 1.96 * 1.96 / (2 * {m})) {side} 1.96 * sqrt({k} * 1.0 / {m} * (1 - {k} * 1.0 / {m}) / {m} + 1.96 * 1.96 / (4.0 * {m} * {m}))) / (1 + 1.96 * 1.96 / {m})"


@query("accuracy", f"""with {ACC_SQL}, g as (select sector, horizon, count(*) as n, count(*) filter (e >= p25) as k, count(p25) as m, count(*) filter (e >= median) as k2, count(*) filter (peak >= p25) as k3, avg(ret) as r, avg(ex_mean) as x, avg(ex_cap) as y from ac group by 1, 2)
  select sector, horizon, n, round(case when m >= 30 then k * 1.0 / m end, 6) as rate_p25, round(case when m >= 30 then greatest(0, {wilson_sql('k', 'm', '-')}) end, 6) as rate_p25_lo, round(case when m >= 30 then least(1, {wilson_sql('k', 'm', '+')}) end, 6) as rate_p25_hi,
    round(case when m >= 30 then k2 * 1.0 / m end, 6) as rate_median, round(case when m >= 30 then k3 * 1.0 / m end, 6) as rate_peak_p25, round(case when n >= 30 then r end, 5) as ret_mean, round(case when n >= 30 then x end, 5) as excess_mean, round(case when n >= 30 then y end, 5) as excess_cap from g""")
def accuracy(spark, sf_dir):
    told = bt.accuracy(accuracy_rows(spark, sf_dir), ["sector", "horizon"])
    means = {"ret_pct_mean": "ret_mean", "excess_mean_mean": "excess_mean", "excess_cap_mean": "excess_cap"}
    return told.select("sector", "horizon", "n", *[F.round(c, 6).alias(c) for c in ("rate_p25", "rate_p25_lo", "rate_p25_hi", "rate_median", "rate_peak_p25")], *[F.round(c, 5).alias(n) for c, n in means.items()])


@query("apply_overlay", f"with {ACC_SQL} select d, symbol, horizon, round(ret + 4 * horizon, 5) as ret_pct, round(ex_mid + 4 * horizon, 5) as excess_mid from ac")
def overlay(spark, sf_dir):
    told = bt.apply_overlay(accuracy_rows(spark, sf_dir), 4.0)
    return told.select("d", "symbol", "horizon", F.round("ret_pct", 5).alias("ret_pct"), F.round("excess_mid", 5).alias("excess_mid"))


@query("hypotheses")
def hypotheses(spark, sf_dir):
    """Six statements with bootstrap bounds; tests check them on a small table."""
    rows = accuracy_rows(spark, sf_dir, "confidence", "divergent", "outlier_fired").withColumn("candidate", F.round("price", 8) < F.round("p25", 8))
    # one date a year of every name and horizon, one on which it was a candidate before others
    rows = rk.yearly_first(rows, ["symbol", "horizon"], "d", prefer="candidate")
    return bt.hypotheses(rows)


@query("miss_analysis", f"""with {ACC_SQL}, ms as (select a.*, cast(d + horizon * interval 1 year as date) as due2 from ac a where p25 is not null and not (e >= p25)), h as (select symbol, d as at, p25 as lp, median as lm from vt where p25 is not null),
  mj as (select m.*, (lp - p25) / p25 * 100 as ch from ms m asof left join h on m.symbol = h.symbol and m.due2 <= h.at)
  select horizon, count(*) filter (ch > 0) as up, count(*) filter (ch < 0) as down, count(*) filter (ch = 0) as flat, count(*) filter (ch < 0 and ret < ch) as fell_more from mj where ch is not null group by 1""")
def miss_analysis(spark, sf_dir):
    history = values(spark, sf_dir).select("symbol", F.col("d").alias("date"), "p25", "median")
    return out.miss_crosstab(out.miss_rows(accuracy_rows(spark, sf_dir), history))


@query("miss_distribution", f"""with {ACC_SQL}, x as (select horizon, e >= p25 as hit, ret from ac where p25 is not null), l as (select horizon, hit, list(ret order by ret) as v, avg(ret) as m, count(*) as n, avg(case when ret < 0 then 1.0 else 0.0 end) as neg from x group by 1, 2)
  select horizon, hit, n, round(m, 5) as mean, round(v[cast(floor(n * 0.25) as int) + 1], 5) as p25, round(v[cast(floor(n * 0.5) as int) + 1], 5) as median, round(v[cast(floor(n * 0.75) as int) + 1], 5) as p75, round(neg, 6) as negative from l""")
def miss_distribution(spark, sf_dir):
    rows = accuracy_rows(spark, sf_dir).where("hit_p25 is not null").withColumnRenamed("hit_p25", "hit")
    g = out.describe(rows, ["horizon", "hit"], "ret_pct")
    return g.select("horizon", "hit", "n", *[F.round(c, 5).alias(c) for c in ("mean", "p25", "median", "p75")], F.round("negative", 6).alias("negative"))


STRATEGY_SQL = f"""{BACK_SQL}, ha as (select v.d, v.symbol, v.price, b.close as e, datediff('day', v.d, date '2002-06-30') / 365.25 as y from (select *, date '2002-06-30' as today from vt where price > 0 and median > 0 and price <= median) v asof join bars b on v.symbol = b.symbol and v.today >= b.date where b.close > 0),
  hold as (select *, (e - price) / price * 100 as tot, (e - price) / price * 100 / y as ann from ha where y >= 0.5),
  ca as (select *, (target - price) / price * 100 as up, t is not null as assigned, case when t is not null then (target - price) / price * 100 else (final - price) / price * 100 end as cap from rc),
  cb as (select *, greatest(0.5, 100 * 0.25 * sqrt(2) * 0.4 * greatest(0.1, 1 - up / 60)) as prem from ca), calls as (select *, cap + prem as tot, (cap + prem) / 2 as ann from cb)"""


def strategies(spark, sf_dir):
    v, b = saved(values(spark, sf_dir), "values"), bars(spark, sf_dir)
    return out.hold_outcomes(v, b, F.lit("2002-06-30").cast("date")), out.call_outcomes(v, b)


@query("strategy_comparison", f"""with {STRATEGY_SQL}, u as (select 'hold' as strategy, ann, tot, cast(null as boolean) as a, cast(null as double) as up, cast(null as double) as prem from hold union all select 'covered_call', ann, tot, assigned, up, prem from calls)
  select strategy, count(*) as n, round(quantile_cont(ann, 0.25), 5) as p25, round(quantile_cont(ann, 0.5), 5) as median, round(quantile_cont(ann, 0.75), 5) as p75, round(avg(case when ann > 0 then 1.0 else 0.0 end), 6) as win_rate, round(avg(case when tot < 0 then 1.0 else 0.0 end), 6) as loss_rate,
    round(avg(a::int), 6) as assigned_rate, round(avg(up), 4) as mean_upside_pct, round(avg(prem), 5) as mean_premium_pct from u group by 1""")
def strategy_comparison(spark, sf_dir):
    s = out.strategy_summary(*strategies(spark, sf_dir))
    return s.select("strategy", "n", *[F.round(c, 5).alias(c) for c in ("p25", "median", "p75")], *[F.round(c, 6).alias(c) for c in ("win_rate", "loss_rate", "assigned_rate")], F.round("mean_upside_pct", 4).alias("mean_upside_pct"), F.round("mean_premium_pct", 5).alias("mean_premium_pct"))


@query("premium_sensitivity", f"""with {STRATEGY_SQL}, x as (select iv, (cap + greatest(0.5, 100 * iv * sqrt(2) * 0.4 * greatest(0.1, 1 - up / 60))) / 2 as a from calls, (values (0.15::double), (0.25), (0.40)) t(iv))
  select iv, round(quantile_cont(a, 0.25), 5) as p25, round(quantile_cont(a, 0.5), 5) as median, round(quantile_cont(a, 0.75), 5) as p75 from x group by 1""")
def premium_sensitivity(spark, sf_dir):
    s = out.premium_sensitivity(strategies(spark, sf_dir)[1])
    return s.select("iv", *[F.round(c, 5).alias(c) for c in ("p25", "median", "p75")])


@query("strategy_overlap", f"with {STRATEGY_SQL} select c.d, c.symbol, round(c.tot, 5) as total_pct from calls c join hold h on h.d = c.d and h.symbol = c.symbol")
def strategy_overlap(spark, sf_dir):
    both = out.both_strategies(*strategies(spark, sf_dir))
    return both.select("d", "symbol", F.round("total_pct", 5).alias("total_pct"))


@query("rolling_puts")
def rolling_puts(spark, sf_dir):
    """Every snapshot row as a flag; tests compare the run of cycles with a loop."""
    flags_ = bound(spark, sf_dir, SNAP).select("d", "symbol", "price")
    p = out.rolling_puts(flags_, bars(spark, sf_dir), cycle=91)
    return p.withColumn("total_pct", F.round("total_pct", 5))


TWO_SQL = f"""{BAR_SQL}, tw as (select d, symbol, price, h as horizon, cast(d + h * interval 1 year as date) as due from ({SNAP}) s, (values (1), (2)) v(h) where price > 0),
  tr2 as (select t.d, t.symbol, t.horizon, (b.close - price) / price * 100 as ret from tw t asof join bars b on t.symbol = b.symbol and t.due <= b.date),
  bm as (select d, horizon, quantile_disc(-ret, 0.5) * -1 as bench from tr2 where symbol not in (1, 2, 3) group by 1, 2)"""


def two_years(spark, sf_dir):
    ret = bt.forward_returns(bound(spark, sf_dir, SNAP), bars(spark, sf_dir).select("symbol", "date", "close"), (1, 2))
    ret = ret.select("d", "symbol", "horizon", (F.col("ret") * 100).alias("ret_pct"))
    return ret, out.median_benchmark(ret, [1, 2, 3])


@query("median_benchmark", f"with {TWO_SQL} select d, horizon, round(bench, 5) as bench_pct from bm")
def median_benchmark(spark, sf_dir):
    return two_years(spark, sf_dir)[1].withColumn("bench_pct", F.round("bench_pct", 5))


OUTCOME_SQL = f"""{FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}, {PEER_SQL}, {OWN_SQL}, {BUCKET_SQL}, {TWO_SQL}, pl as (select d, symbol, bucket, composite, price, p25 from bucketed),
  dc as (select d, symbol, case when n >= 10 then least(10, floor(i / ceil(n / 10.0)) + 1) end as decile from (select d, symbol, row_number() over (partition by d order by composite desc, symbol) - 1 as i, count(*) over (partition by d) as n from pl where bucket = 'ranked') z),
  fo as (select p.d, p.symbol, min(b.date) filter (high >= p25) as t from pl p left join bars b on b.symbol = p.symbol and b.date > p.d and b.date <= p.d + interval 24 month where round(p25, 8) > round(price, 8) group by 1, 2),
  wd as (select d, symbol, max(ret) filter (horizon = 1) as ret_1, max(ret - bench) filter (horizon = 1) as excess_1, max(ret) filter (horizon = 2) as ret_2, max(ret - bench) filter (horizon = 2) as excess_2 from tr2 join bm using (d, horizon) group by 1, 2),
  oc as (select pl.*, decile, f.d is not null as tg, t, t - pl.d as days, w.* exclude (d, symbol), case when pl.d < date '1998-01-01' then 'early' else 'late' end as regime from pl left join dc using (d, symbol) left join fo f using (d, symbol) left join wd w using (d, symbol))"""


def outcomes(spark, sf_dir):
    placed = rk.bucket(ranked_with_value(spark, sf_dir)).select("d", "symbol", "bucket", "composite", "price", "p25")
    ret, bench = two_years(spark, sf_dir)
    rows = saved(out.bucket_outcomes(saved(placed, "placed"), bars(spark, sf_dir), ret, bench), "outcomes")
    return rows.withColumn("regime", F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "early").otherwise("late"))


@query("bucket_report", f"""with {OUTCOME_SQL} select bucket, regime, count(*) as n, count(*) filter (tg) as with_target, round(count(t) * 1.0 / nullif(count(*) filter (tg), 0), 6) as recovery, round(count(*) filter (days <= 12 * 30.44) * 1.0 / nullif(count(*) filter (tg), 0), 6) as within_12m,
    round(quantile_cont(days, 0.5), 4) as median_days, round(quantile_cont(ret_2, 0.5), 4) as median_ret_2, round(quantile_cont(excess_2, 0.5), 4) as median_excess_2 from oc group by grouping sets ((bucket), (bucket, regime))""")
def bucket_report(spark, sf_dir):
    r = out.bucket_report(outcomes(spark, sf_dir), [["bucket"], ["bucket", "regime"]])
    return r.select("bucket", "regime", "n", "with_target", F.round("recovery", 6).alias("recovery"), F.round("within_12m", 6).alias("within_12m"), *[F.round(c, 4).alias(c) for c in ("median_days", "median_ret_2", "median_excess_2")])


@query("decile_report", f"""with {OUTCOME_SQL} select cast(decile as int) as decile, count(*) as n, round(count(t) * 1.0 / nullif(count(*) filter (tg), 0), 6) as recovery, round(quantile_cont(ret_1, 0.5), 4) as median_ret_1, round(quantile_cont(excess_2, 0.5), 4) as median_excess_2 from oc where bucket = 'ranked' group by 1""")
def decile_report(spark, sf_dir):
    r = out.bucket_report(outcomes(spark, sf_dir).where("bucket = 'ranked'"), [["decile"]])
    return r.select("decile", "n", F.round("recovery", 6).alias("recovery"), F.round("median_ret_1", 4).alias("median_ret_1"), F.round("median_excess_2", 4).alias("median_excess_2"))


@query("avoid_causes", f"with {OUTCOME_SQL} select p25 is not null as has_value, count(*) as n, round(quantile_cont(ret_2, 0.5), 4) as median_ret_2, round(quantile_cont(excess_2, 0.5), 4) as median_excess_2 from oc where bucket = 'avoid' group by 1")
def avoid_causes(spark, sf_dir):
    r = out.avoid_causes(outcomes(spark, sf_dir))
    return r.select("has_value", "n", F.round("median_ret_2", 4).alias("median_ret_2"), F.round("median_excess_2", 4).alias("median_excess_2"))


@query("put_report")
def put_report(spark, sf_dir):
    """Rolled puts on ranked names beside their outcomes, by decile and regime and in all; the parts have tests of their own."""
    o = outcomes(spark, sf_dir).where("bucket = 'ranked'")
    p = out.rolling_puts(o.select("d", "symbol", "price"), bars(spark, sf_dir), cycle=91)
    r = out.put_report(p, o, [["decile"], ["regime"], []])
    return r.withColumns({c: F.round(c, 4) for c in ("p25", "median", "p75", "hold_median", "over_hold", "over_benchmark", "assigned_rate", "mean_cycles")})


@query("wide_dates", f"with s as ({SNAP}), n as (select d, count(*) as c from s group by 1) select s.d, s.symbol from s join n using (d) where c >= 50")
def wide_dates(spark, sf_dir):
    return out.wide_dates(bound(spark, sf_dir, SNAP).select("d", "symbol"))


@query("outcome_strata", f"""with {EX}, a as (select s.sector, year(s.d) as y, e.ret from ({SNAP}) s join fe e on e.d = s.d and e.symbol = s.symbol where horizon = 1)
  select sector, y, count(*) as n, round(avg(ret), 6) as mean, round(quantile_cont(ret, 0.5), 6) as median from a group by grouping sets ((sector), (y), ())""")
def outcome_strata(spark, sf_dir):
    rows = bound(spark, sf_dir, SNAP).select("d", "symbol", "sector").join(excess(spark, sf_dir).where("horizon = 1"), ["d", "symbol"]).withColumn("y", F.year("d").cast("long"))
    return bt.strata_means(rows, "ret", [["sector"], ["y"], []]).select("sector", "y", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("better_ranked", f"""with r as (select d, symbol, sector, row_number() over (partition by d, sector order by market_cap desc, symbol) as k from ({SNAP}) s)
  select a.d, a.symbol, b.symbol as peer, b.k as peer_rank from r a join r b on a.d = b.d and a.sector = b.sector and b.k < a.k and b.k <= 5""")
def better_ranked(spark, sf_dir):
    s = bound(spark, sf_dir, SNAP).withColumn("score", F.col("market_cap"))
    return bt.better_ranked(s, s)


PICKS = "select distinct o_custkey as symbol, make_date(cast(year(o_orderdate) as int) + 1, 12, 31) as d from {orders}"

PICK_SQL = f"""{SCORE_SQL}, gr1 as (select distinct d, symbol, super_group from obs),
u as (select d, symbol, super_group, round(max(score), 6) as composite, max(excess) filter (horizon = 1) as e1, max(excess) filter (horizon = 3) as e3 from sc join gr1 using (d, symbol) where candidate = 'default' group by 1, 2, 3),
ur as (select *, row_number() over (partition by d order by composite desc, symbol) as ku, count(*) over (partition by d) as nu, row_number() over (partition by d, super_group order by composite desc, symbol) as kg, count(*) over (partition by d, super_group) as ng from u),
pk as ({PICKS}),
bt as (select p.d, p.symbol, string_agg(b.symbol || ':' || b.kg, ',' order by b.kg) as better, sum(b.e3) as better_excess_3 from pk p join ur a using (d, symbol) join ur b on b.d = a.d and b.super_group = a.super_group and b.kg < a.kg and b.kg <= 5 group by 1, 2)"""


@query("user_picks", f"""with {PICK_SQL} select p.d, p.symbol, composite, ku as rank_in_universe, nu as universe_size, kg as rank_in_super_group, ng as super_group_size, e1 as excess_1, e3 as excess_3,
  coalesce(better, '') as better, round(better_excess_3, 6) as better_excess_3, case when p.d not in (select d from u) then 'no snapshot universe' when composite is null then 'not in universe' end as reason
  from pk p left join ur using (d, symbol) left join bt using (d, symbol)""")
def user_picks(spark, sf_dir):
    """Every customer a year after a year with orders, as a pick: where it stood under the default weights, and what the names above it did."""
    kind = spark.createDataFrame([(f.name, f.category) for f in rk.default_factors()], "factor string, category string")
    obs = saved(observations(spark, sf_dir).join(F.broadcast(kind), "factor"), "picked-observations")
    weights = cand.built_in(spark)[0].where("candidate = 'default'")
    scores = bt.candidate_scores(obs, weights).withColumn("score", F.round("score", 9)).join(obs.select("d", "symbol", "super_group").distinct(), ["d", "symbol"])
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("excess"))).alias(f"excess_{h}")
    scored = saved(scores.groupBy("d", "symbol", "super_group").agg(F.round(F.max("score"), 6).alias("composite"), at(1), at(3)), "picked-scores")
    told = bt.user_picks(bound(spark, sf_dir, PICKS), scored)
    names = F.array_join(F.transform("better", lambda p: F.concat_ws(":", p["symbol"], p["rank"])), ",")
    known = F.filter("better", lambda p: p["excess_3"].isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, p: a + p["excess_3"]))
    return told.select("d", "symbol", "composite", "rank_in_universe", "universe_size", "rank_in_super_group", "super_group_size", "excess_1", "excess_3", F.coalesce(names, F.lit("")).alias("better"), F.round(total, 6).alias("better_excess_3"), "reason")


@query("adoption_verdicts")
def adoption_verdicts(spark, sf_dir):
    """Every candidate against the default weights over the later dates, which no weight was chosen on; the bounds are seeded draws, tests check the rule."""
    told = bt.adoption_verdicts(daily(spark, sf_dir).where("d >= date'1995-12-31'"), "default")
    return told.select("candidate", "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi", "gain")], "verdict", "reason")


@query("bucket_outcomes", f"""with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}, {PEER_SQL}, {OWN_SQL}, {BUCKET_SQL}, {EX}
  select bucket, horizon, count(*) as n, round(avg(excess), 4) as mean_excess, round(quantile_cont(excess, 0.5), 4) as median_excess from bucketed join fe using (d, symbol) group by 1, 2""")
def bucket_outcomes(spark, sf_dir):
    placed = rk.bucket(ranked_with_value(spark, sf_dir)).select("d", "symbol", "bucket")
    out = placed.join(excess(spark, sf_dir), ["d", "symbol"]).groupBy("bucket", "horizon")
    return out.agg(F.count("*").alias("n"), F.round(F.avg("excess"), 4).alias("mean_excess"), F.round(F.percentile("excess", F.lit(0.5)), 4).alias("median_excess"))
