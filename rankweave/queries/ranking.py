"""Factors, percentiles, floor, ranks, buckets and fair value over customers as companies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankweave.functions import stats
from rankweave.operators import fair_value as fv
from rankweave.operators import ranking as rk
from rankweave.operators import reference_data as ref
from rankweave.operators import timeseries as ts
from rankweave.queries.base import MONTHLY, PERIODS, SNAP, bound, query

R = 6


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, R) for c in cols})


def panel(spark, sf_dir):
    """Snapshots with what is known of their periods, and momentum of their monthly closes."""
    snap, periods = bound(spark, sf_dir, SNAP), bound(spark, sf_dir, PERIODS)
    moved = ts.momentum_at(snap.select("d", "symbol"), bound(spark, sf_dir, MONTHLY), ["symbol"], "d", "date", "close", "momentum_12_1")
    return snap.join(rk.period_features(snap, periods), ["d", "symbol"]).join(moved, ["d", "symbol"], "left")


# ---- the same rules as SQL; quantities that order rows are computed by equal expressions

FEATURES_SQL = f"""
known as (select s.d, p.*, row_number() over (partition by s.d, p.symbol order by p.period_end desc) - 1 as age
  from ({SNAP}) s join ({PERIODS}) p on p.symbol = s.symbol and p.period_end <= s.d),
gr as (select d, symbol,
  max(revenue) filter (age = 0) as r0, arg_max(revenue, age) filter (revenue is not null and age between 1 and 7) as r1, max(age) filter (revenue is not null and age between 1 and 7) as rn,
  max(eps) filter (age = 0) as e0, arg_max(eps, age) filter (eps is not null and age between 1 and 7) as e1, max(age) filter (eps is not null and age between 1 and 7) as en,
  max(dividends / shares) filter (age = 0) as v0, arg_max(dividends / shares, age) filter (dividends is not null and age between 1 and 5) as v1, max(age) filter (dividends is not null and age between 1 and 5) as vn,
  max(ebit) filter (age = 0) as ebit0, max(interest) filter (age = 0) as interest0, max(net_income) filter (age = 0) as net_income0, max(cfo) filter (age = 0) as cfo0,
  max(revenue) filter (age = 0) as revenue0, max(buybacks) filter (age = 0) as buybacks0, max(shares) filter (age = 0) as shares0, max(shares) filter (age = 1) as shares1,
  avg(roic) filter (age < 5) as avg_roic, sum(case when age < 5 and net_income > 0 then 1 else 0 end) as profitable_years
  from known group by 1, 2),
mo0 as (select symbol, date_trunc('month', date) as m, min(date) as seen, arg_max(close, (date, close)) as close from ({MONTHLY}) b group by 1, 2),
mo1 as (select symbol, seen, case when row_number() over w >= 14 and lag(close, 13) over w > 0 then lag(close, 1) over w / lag(close, 13) over w - 1 end as momentum_12_1 from mo0 window w as (partition by symbol order by m)),
mo as (select s.d, s.symbol, momentum_12_1 from ({SNAP}) s asof join mo1 on s.symbol = mo1.symbol and s.d >= mo1.seen),
panel as (select s.*, g.* exclude (d, symbol), momentum_12_1,
  case when r0 > 0 and r1 > 0 then pow(r0 / r1, 1.0 / rn) - 1 end as revenue_growth, case when e0 > 0 and e1 > 0 then pow(e0 / e1, 1.0 / en) - 1 end as eps_growth,
  case when v0 > 0 and v1 > 0 then pow(v0 / v1, 1.0 / vn) - 1 end as dividend_growth
  from ({SNAP}) s join gr g on g.d = s.d and g.symbol = s.symbol left join mo on mo.d = s.d and mo.symbol = s.symbol)"""

FACTOR_SQL = {
    "ev_to_ebitda": ("valuation", "lower", "ev_to_ebitda"), "price_to_fcf": ("valuation", "lower", "price_to_fcf"),
    "pe_ratio": ("valuation", "lower", "case when pe_ratio >= 0 then pe_ratio end"), "price_to_book": ("valuation", "lower", "case when price_to_book >= 0 then price_to_book end"),
    "debt_to_ebitda": ("health", "lower", "net_debt_to_ebitda"), "current_ratio": ("health", "higher", "current_ratio"),
    "interest_coverage": ("health", "higher", "case when interest0 > 0 then ebit0 / interest0 end"), "roic": ("quality", "higher", "roic"),
    "accruals": ("quality", "lower", "case when revenue0 > 0 then (net_income0 - cfo0) / revenue0 end"), "dividend_yield": ("shareholder_return", "higher", "dividend_yield"),
    "buyback_yield": ("shareholder_return", "higher", "case when market_cap > 0 then buybacks0 / market_cap end"), "dividend_growth": ("shareholder_return", "higher", "dividend_growth"),
    "net_issuance": ("shareholder_return", "lower", "case when shares1 > 0 then shares0 / shares1 end - 1"), "revenue_growth": ("growth", "higher", "revenue_growth"),
    "eps_growth": ("growth", "higher", "eps_growth"), "momentum": ("momentum", "higher", "momentum_12_1"),
}
LONG_SQL = "long as (" + " union all ".join(f"select d, symbol, industry, sector, '{k}' as factor, '{c}' as category, '{g}' as direction, cast({x} as double) as raw from SRC" for k, (c, g, x) in FACTOR_SQL.items()) + ")"


def factor_sql(src):
    return LONG_SQL.replace("SRC", src)


def pct_sql(level, src="long"):
    """Winsorised mid-rank percentile of raw at one level, written with counts instead of ranks."""
    by = "d, factor" + (f", {level}" if level else "")
    on = " and ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    name = level or "all"
    return f"""
b_{name} as (select {by}, count(*) as n, list(raw order by raw) as vs from {src} where raw is not null group by {by}),
c_{name} as (select *, case when n >= 3 then vs[cast(floor(n * 0.05) as int) + 1] else vs[1] end as lo,
  case when n >= 3 then vs[greatest(cast(floor(n * 0.05) as int) + 1, cast(ceil(n * 0.95) as int))] else vs[n] end as hi from b_{name}),
v_{name} as (select a.*, b.n, b.lo, b.hi, greatest(least(a.raw, b.hi), b.lo) as clip from {src} a join c_{name} b on {on} where a.raw is not null),
q_{name} as (select {by}, clip, count(*) as eq, sum(count(*)) over (partition by {by} order by clip) - count(*) as below from v_{name} group by {by}, clip),
p_{name} as (select a.d, a.symbol, a.factor, case when a.n < 2 then 50.0 when a.raw < a.lo then 0.0 when a.raw > a.hi then 100.0
    else (b.below + (b.eq + 1) / 2.0 - 1) / (a.n - 1) * 100 end as pct from v_{name} a join q_{name} b on {on} and a.clip = b.clip)"""


FLOOR_SQL = """
fl0 as (select *, case when interest0 > 0 then ebit0 / interest0 end as cov from panel),
fl1 as (select *, count(avg_roic) over w as nr, count(cov) over w as nc from fl0 window w as (partition by d, sector)),
fl2 as (select *,
  (select 100.0 * (count(*) filter (b.avg_roic < a.avg_roic) + (count(*) filter (b.avg_roic = a.avg_roic) + 1) / 2.0 - 1) / nullif(a.nr - 1, 0) from fl0 b where b.d = a.d and b.sector = a.sector) as rp,
  (select 100.0 * (count(*) filter (b.cov < a.cov) + (count(*) filter (b.cov = a.cov) + 1) / 2.0 - 1) / nullif(a.nc - 1, 0) from fl0 b where b.d = a.d and b.sector = a.sector) as cp
  from fl1 a),
floored as (select *, case when profitable_years < 3 then 'few_profitable_years'
  when avg_roic < 0.08 and (case when nr >= 3 then rp < 33 else avg_roic <= 0 end) then 'low_avg_roic'
  when cov < 5 and (case when nc >= 3 then cp < 25 else cov < 1 end) then 'low_interest_coverage' end as floor_reason from fl2)"""

COHORT_SQL = f"""
{pct_sql('industry')}, {pct_sql('sector')}, {pct_sql('')},
sizes as (select *, count(*) over (partition by d, factor, industry) as k_i, count(*) over (partition by d, factor, sector) as k_s from long),
chosen as (select z.d, z.symbol, z.factor, z.category, z.raw, case when k_i >= 8 then 'industry' when k_s >= 8 then 'sector' else 'universe' end as cohort,
  case when direction = 'lower' then 100 - p else p end as pct from (
    select z.*, case when k_i >= 8 then i.pct when k_s >= 8 then s.pct else u.pct end as p from sizes z
    left join p_industry i on i.d = z.d and i.symbol = z.symbol and i.factor = z.factor
    left join p_sector s on s.d = z.d and s.symbol = z.symbol and s.factor = z.factor
    left join p_all u on u.d = z.d and u.symbol = z.symbol and u.factor = z.factor) z)"""


@query("period_features", f"""with {FEATURES_SQL} select d, symbol, round(revenue_growth, {R}) as revenue_growth, round(eps_growth, {R}) as eps_growth,
  round(dividend_growth, {R}) as dividend_growth, round(avg_roic, {R}) as avg_roic, cast(profitable_years as bigint) as profitable_years, round(shares1, {R}) as shares1 from panel""")
def period_features(spark, sf_dir):
    cols = ["revenue_growth", "eps_growth", "dividend_growth", "avg_roic", "shares1"]
    return rounded(panel(spark, sf_dir), *cols).select("d", "symbol", *cols, "profitable_years")


@query("factors", f"with {FEATURES_SQL}, {factor_sql('panel')} select d, symbol, factor, category, direction, round(raw, {R}) as raw from long where raw is not null")
def factors(spark, sf_dir):
    rows = rk.factor_rows(panel(spark, sf_dir), rk.default_factors(), ["d", "symbol"]).where("raw is not null")
    return rounded(rows, "raw")


@query("quality_floor", f"with {FEATURES_SQL}, {FLOOR_SQL} select d, symbol, floor_reason from floored")
def quality_floor(spark, sf_dir):
    return rk.quality_floor(panel(spark, sf_dir)).select("d", "symbol", "floor_reason")


@query("cohort_percentiles", f"with {FEATURES_SQL}, {factor_sql('panel')}, {COHORT_SQL} select d, symbol, factor, cohort, round(pct, {R}) as pct from chosen where pct is not null")
def cohort_percentiles(spark, sf_dir):
    return rounded(rk.cohort_percentiles(panel(spark, sf_dir), rk.default_factors()).where("pct is not null"), "pct").select("d", "symbol", "factor", "cohort", "pct")


@query("ranged_percentiles", f"with {FEATURES_SQL}, {factor_sql('panel')}, {COHORT_SQL} select d, symbol, factor, cohort, round(pct, {R}) as pct from chosen where pct is not null")
def ranged_percentiles(spark, sf_dir):
    """The percentiles by ranges of some hundred values, as dates of very many rows have them."""
    return rounded(rk.cohort_percentiles(panel(spark, sf_dir), rk.default_factors(), ranged=200).where("pct is not null"), "pct").select("d", "symbol", "factor", "cohort", "pct")


SCORES_SQL = f"""
fine as (select * from floored where floor_reason is null), {factor_sql('fine')}, {COHORT_SQL},
cats as (select d, symbol, avg(pct) filter (category = 'valuation') as valuation, avg(pct) filter (category = 'health') as health, avg(pct) filter (category = 'quality') as quality,
  avg(pct) filter (category = 'shareholder_return') as shareholder_return, avg(pct) filter (category = 'growth') as growth from chosen group by 1, 2),
comp as (select f.*, c.* exclude (d, symbol),
  (coalesce(valuation * 0.5, 0) + coalesce(health * 0.2, 0) + coalesce(quality * 0.1, 0) + coalesce(shareholder_return * 0.1, 0) + coalesce(growth * 0.1, 0))
  / nullif((case when valuation is null then 0 else 0.5 end + case when health is null then 0 else 0.2 end + case when quality is null then 0 else 0.1 end
  + case when shareholder_return is null then 0 else 0.1 end + case when growth is null then 0 else 0.1 end), 0) as cmp from fine f join cats c using (d, symbol)),
ranked as (select *, coalesce(cmp, 0) as composite from comp)"""


@query("rank", f"""with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}
select d, symbol, round(valuation, 7) as valuation, round(health, 7) as health, round(quality, 7) as quality, round(composite, 7) as composite, cast(null as varchar) as floor_reason,
  row_number() over (partition by d, industry order by round(composite, 8) desc, quality desc nulls last, shareholder_return desc nulls last, market_cap desc, symbol) as industry_rank,
  row_number() over (partition by d order by round(composite, 8) desc, quality desc nulls last, shareholder_return desc nulls last, market_cap desc, symbol) as universe_rank from ranked
union all select d, symbol, null, null, null, null, floor_reason, null, null from floored where floor_reason is not null""")
def rank(spark, sf_dir):
    out = rk.rank(panel(spark, sf_dir))
    out = out.withColumns({c: F.round(c, 7) for c in ("valuation", "health", "quality", "composite")})
    return out.select("d", "symbol", "valuation", "health", "quality", "composite", "floor_reason", "industry_rank", "universe_rank")


def fair_values(spark, sf_dir, **options):
    return fv.fair_value(bound(spark, sf_dir, SNAP), bound(spark, sf_dir, PERIODS), **options)


def ranked_with_value(spark, sf_dir):
    value = fair_values(spark, sf_dir).select("d", "symbol", "p25", "median", "n_anchors")
    return rk.rank(panel(spark, sf_dir)).join(value, ["d", "symbol"], "left")


def loo_sql(m, by, tag):
    """Leave-one-out median by rebuilding the list without the row."""
    on = " and ".join(f"b.{c} = a.{c}" for c in by)
    return f"(select quantile_cont(b.{m}, 0.5) from s0 b where {on} and b.symbol <> a.symbol and b.{m} > 0) as {tag}_{m}"


MULT = ["pe_ratio", "ev_to_ebitda", "price_to_fcf"]
LEVELS = {"cap": ["d", "industry", "cap"], "ind": ["d", "industry"], "sec": ["d", "sector"]}
PEER_SQL = f"""
s0 as (select *, case when market_cap >= 200e9 then 'mega' when market_cap >= 20e9 then 'large' else 'midSmall' end as cap from ({SNAP}) s),
s1 as (select a.*, {', '.join(f"(select count(*) from s0 b where {' and '.join(f'b.{c} = a.{c}' for c in by)} and b.symbol <> a.symbol) as k_{t}" for t, by in LEVELS.items())},
  {', '.join(loo_sql(m, by, t) for t, by in LEVELS.items() for m in MULT)} from s0 a),
peers as (select *, case when k_cap >= 8 then 'cohort' when k_cap >= 3 then 'narrow' when k_ind >= 3 then 'industry' else 'sector' end as peer_set,
  case when k_cap >= 3 then k_cap when k_ind >= 3 then k_ind else k_sec end as peer_count,
  {', '.join(f"case when k_cap >= 3 then cap_{m} when k_ind >= 3 then ind_{m} else sec_{m} end as peer_{m}" for m in MULT)} from s1)"""


@query("peer_medians", f"with {PEER_SQL} select d, symbol, peer_set, peer_count, {', '.join(f'round(peer_{m}, {R}) as peer_{m}' for m in MULT)} from peers")
def peer_medians(spark, sf_dir):
    out = fv.peer_medians(bound(spark, sf_dir, SNAP))
    cols = [f"peer_{m}" for m in fv.MULTIPLES]
    return rounded(out, *cols).select("d", "symbol", "peer_set", "peer_count", *cols)


OWN_SQL = f"""
k0 as (select s.d, p.*, row_number() over (partition by s.d, p.symbol order by p.period_end desc) - 1 as age from ({SNAP}) s join ({PERIODS}) p on p.symbol = s.symbol and p.period_end <= s.d),
{', '.join(f'''pos_{x} as (select d, symbol, case when count(*) >= 5 then avg({x}) filter (rk <= 5) end as five from
  (select d, symbol, {x}, row_number() over (partition by d, symbol order by age) as rk from k0 where age < 7 and {x} > 0) z group by 1, 2),
all_{x} as (select d, symbol, avg({x}) as mean from k0 where age < 7 group by 1, 2)''' for x in ('eps', 'ebitda', 'fcf'))},
own0 as (select d, symbol, unnest([price_end, price_high, price_low]) as p, eps, ebitda, fcf, shares, debt, cash from k0),
own1 as (select d, symbol, quantile_cont(p / eps, 0.5) filter (p > 0 and eps > 0) as own_pe_ratio,
  quantile_cont((p * shares + coalesce(debt, 0) - coalesce(cash, 0)) / ebitda, 0.5) filter (p > 0 and shares > 0 and ebitda > 0 and p * shares + coalesce(debt, 0) - coalesce(cash, 0) > 0) as own_ev_to_ebitda,
  quantile_cont(p * shares / fcf, 0.5) filter (p > 0 and shares > 0 and fcf > 0) as own_price_to_fcf from own0 group by 1, 2),
prior as (select d, symbol, avg(eps) filter (age between 1 and 3 and eps > 0) as prior_eps, count(*) filter (age between 1 and 3 and eps > 0) as n_eps,
  avg(ebitda) filter (age between 1 and 3 and ebitda > 0) as prior_ebitda, count(*) filter (age between 1 and 3 and ebitda > 0) as n_ebitda,
  max(eps) filter (age = 0) as eps0, max(ebitda) filter (age = 0) as ebitda0, max(fcf) filter (age = 0) as fcf0, max(shares) filter (age = 0) as shares0,
  max(debt) filter (age = 0) as debt0, max(cash) filter (age = 0) as cash0 from k0 group by 1, 2),
f0 as (select e.*, o.* exclude (d, symbol), r.* exclude (d, symbol), {', '.join(f'coalesce(pos_{x}.five, all_{x}.mean) as normal_{x}' for x in ('eps', 'ebitda', 'fcf'))},
  coalesce(case when pe_ratio > 0 and price > 0 then price / pe_ratio end, eps0) as eps, coalesce(case when ev_to_ebitda > 0 and enterprise_value > 0 then enterprise_value / ev_to_ebitda end, ebitda0) as ebitda,
  coalesce(case when price_to_fcf > 0 and price > 0 and shares0 > 0 then price / price_to_fcf * shares0 end, fcf0) as fcf
  from peers e left join own1 o using (d, symbol) left join prior r using (d, symbol) {' '.join(f'left join pos_{x} using (d, symbol) left join all_{x} using (d, symbol)' for x in ('eps', 'ebitda', 'fcf'))}),
f1 as (select *, case when n_eps >= 2 and eps > prior_eps * 1.5 and not coalesce(forward_eps > 0 and forward_eps >= eps * 0.7, false) then prior_eps else eps end as aeps,
  case when n_ebitda >= 2 and ebitda > prior_ebitda * 1.5 then prior_ebitda else ebitda end as aebitda,
  coalesce(case when pe_ratio > 0 and peer_pe_ratio > 0 then greatest(peer_pe_ratio / pe_ratio, pe_ratio / peer_pe_ratio) > 5 end, false) as divergent,
  coalesce(own_pe_ratio, case when pe_ratio > 0 then pe_ratio end) as ope, coalesce(own_ev_to_ebitda, case when ev_to_ebitda > 0 then ev_to_ebitda end) as oev,
  coalesce(own_price_to_fcf, case when price_to_fcf > 0 then price_to_fcf end) as ofc from f0),
f2 as (select *, case when not divergent and aeps > 0 then aeps * peer_pe_ratio end as a1, case when not divergent and aebitda > 0 then (aebitda * peer_ev_to_ebitda - debt0 + cash0) / shares0 end as a2,
  case when not divergent and fcf > 0 then fcf * peer_price_to_fcf / shares0 end as a3, case when aeps > 0 then aeps * ope end as a4,
  case when aebitda > 0 then (aebitda * oev - debt0 + cash0) / shares0 end as a5, case when fcf > 0 then fcf * ofc / shares0 end as a6,
  case when not divergent and normal_eps > 0 then normal_eps * peer_pe_ratio end as a7, case when not divergent and normal_ebitda > 0 then (normal_ebitda * peer_ev_to_ebitda - debt0 + cash0) / shares0 end as a8,
  case when not divergent and normal_fcf > 0 then normal_fcf * peer_price_to_fcf / shares0 end as a9 from f1),
f3 as (select *, [x for x in [a1, a2, a3, a4, a5, a6, a7, a8, a9] if x > 0] as a from f2),
fvs as (select *, len(a) as n_anchors, list_aggregate(a, 'quantile_cont', 0.25) as p25, list_aggregate(a, 'quantile_cont', 0.5) as med, list_aggregate(a, 'quantile_cont', 0.75) as p75 from f3)"""


@query("fair_value", f"""with {PEER_SQL}, {OWN_SQL} select d, symbol, peer_set, divergent, cast(n_anchors as int) as n_anchors, round(p25, 8) as p25, round(med, 8) as median, round(p75, 8) as p75,
  case when peer_set = 'cohort' and n_anchors >= 6 and p75 / p25 <= 1.5 then 'high' when peer_set in ('cohort', 'narrow') and n_anchors >= 6 and p75 / p25 <= 2.5 then 'medium' else 'low' end as confidence,
  round((med - price) / price * 100, 8) as upside_median from fvs""")
def fair_value(spark, sf_dir):
    out = fair_values(spark, sf_dir).withColumns({c: F.round(c, 8) for c in ("p25", "median", "p75", "upside_median")})
    return out.select("d", "symbol", "peer_set", "divergent", "n_anchors", "p25", "median", "p75", "confidence", "upside_median")


BUCKET_SQL = """
bk0 as (select r.*, v.p25 from (select d, symbol, industry, valuation, health, quality, shareholder_return, growth, negative_equity, price, composite from ranked
    union all select d, symbol, industry, null, null, null, null, null, negative_equity, price, null from floored where floor_reason is not null) r left join fvs v using (d, symbol)),
bk1 as (select *, case when (valuation is null and health is null and quality is null and shareholder_return is null and growth is null) or p25 is null then 'avoid'
  when negative_equity then 'watch' when round(price, 8) < round(p25, 8) then 'ranked' else 'watch' end as klass from bk0),
bk2 as (select d, list(composite order by composite) as cs from bk1 where klass <> 'avoid' and composite > 0 group by 1),
bk3 as (select b.*, cs[cast(greatest(1, ceil(len(cs) * 0.10)) as int)] as cut from bk1 b left join bk2 using (d)),
bucketed as (select *, case when klass <> 'avoid' and composite > 0 and composite <= cut then 'avoid' else klass end as bucket from bk3)"""


@query("buckets", f"with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}, {PEER_SQL}, {OWN_SQL}, {BUCKET_SQL} select d, symbol, bucket from bucketed")
def buckets(spark, sf_dir):
    return rk.bucket(ranked_with_value(spark, sf_dir)).select("d", "symbol", "bucket")


@query("midrank_percentile", f"""with s as ({SNAP}) select a.d, a.symbol, round(case when count(*) = 1 then 50 else (count(*) filter (b.pe_ratio < a.pe_ratio) + (count(*) filter (b.pe_ratio = a.pe_ratio) + 1) / 2.0 - 1) / nullif(count(*) - 1, 0) * 100 end, {R}) as pct
  from s a join s b on a.d = b.d and a.industry = b.industry where a.pe_ratio is not null and b.pe_ratio is not null group by a.d, a.symbol, a.pe_ratio""")
def midrank(spark, sf_dir):
    df = bound(spark, sf_dir, SNAP).withColumn("pct", stats.midrank_percentile("pe_ratio", ["d", "industry"]))
    return rounded(df.where("pct is not null"), "pct").select("d", "symbol", "pct")


@query("spearman", f"""with s as ({SNAP}), r as (select d, sector, pe_ratio x, market_cap y from s where pe_ratio is not null and market_cap is not null),
  k as (select d, sector, rank() over (partition by d, sector order by x) + (count(*) over (partition by d, sector, x) - 1) / 2.0 as rx, rank() over (partition by d, sector order by y) + (count(*) over (partition by d, sector, y) - 1) / 2.0 as ry from r)
  select d, sector, count(*) as n, round(corr(rx, ry), {R}) as rho from k group by 1, 2""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(bound(spark, sf_dir, SNAP), "pe_ratio", "market_cap", ["d", "sector"]), "rho")


@query("wilson_interval", f"""with s as (select sector, count(*) as n, count(*) filter (pe_ratio > 0) as k from ({SNAP}) s group by 1)
  select sector, n, k, round((k * 1.0 / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), {R}) as lo,
  round((k * 1.0 / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k * 1.0 / n * (1 - k * 1.0 / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), {R}) as hi from s""")
def wilson(spark, sf_dir):
    df = bound(spark, sf_dir, SNAP).groupBy("sector").agg(F.count("*").alias("n"), F.count_if(F.col("pe_ratio") > 0).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return df.select("sector", "n", "k", F.round(lo, R).alias("lo"), F.round(hi, R).alias("hi"))


@query("decile", f"""with s as (select d, symbol, row_number() over (partition by d order by market_cap desc, symbol) - 1 as i, count(*) over (partition by d) as n from ({SNAP}) s)
  select d, symbol, cast(case when n >= 10 then least(10, floor(i / ceil(n / 10.0)) + 1) end as int) as decile from s""")
def deciles(spark, sf_dir):
    return rk.decile(bound(spark, sf_dir, SNAP), ["d"], "market_cap", "symbol").select("d", "symbol", "decile")


@query("quartile_bin", f"""with s as ({SNAP}), q as (select d, quantile_cont(market_cap, 0.25) a, quantile_cont(market_cap, 0.5) b, quantile_cont(market_cap, 0.75) c from s group by 1)
  select s.d, symbol, case when market_cap <= a then 1 when market_cap <= b then 2 when market_cap <= c then 3 else 4 end as bin from s join q on s.d = q.d""")
def quartile_bins(spark, sf_dir):
    s = bound(spark, sf_dir, SNAP)
    cuts = s.groupBy("d").agg(*[stats.quantile(F.col("market_cap"), q).alias(n) for q, n in ((0.25, "a"), (0.5, "b"), (0.75, "c"))])
    return s.join(cuts, "d").select("d", "symbol", stats.quartile_bin(F.col("market_cap"), F.col("a"), F.col("b"), F.col("c")).alias("bin"))


@query("upper_median", f"with s as ({SNAP}) select d, industry, count(*) as n, list(market_cap order by market_cap)[cast(floor(count(*) / 2.0) as int) + 1] as upper_median from s group by 1, 2")
def upper_median(spark, sf_dir):
    return bound(spark, sf_dir, SNAP).groupBy("d", "industry").agg(F.count("*").alias("n"), stats.upper_median("market_cap").alias("upper_median"))


@query("yearly_dedup", f"with s as ({SNAP}) select sector, symbol, min(d) as d from s group by sector, symbol, year(d)")
def yearly_dedup(spark, sf_dir):
    return rk.yearly_first(bound(spark, sf_dir, SNAP), ["sector", "symbol"], "d").select("sector", "symbol", "d")


DIR_SQL = f"""
k as (select s.d, s.symbol, s.forward_eps, p.eps, row_number() over (partition by s.d, s.symbol order by p.period_end desc) - 1 as age from ({SNAP}) s join ({PERIODS}) p on p.symbol = s.symbol and p.period_end <= s.d),
g as (select d, symbol, max(forward_eps) as f, max(eps) filter (age = 0) as t, list(eps order by age) filter (age > 0) as past, count(*) as m, min(age) as z,
  regr_slope(eps, -age) as slope, arg_max(eps, age) as start, max(eps) filter (age between 1 and 3) as peak from k group by 1, 2),
h as (select *, case when abs(start) >= 0.01 then slope / abs(start) * 100 end as sp from g),
t as (select *, case when sp > 5 then 'improving' when sp < -5 then 'declining' when sp is not null then 'flat' else 'unknown' end as trend,
  coalesce(case when peak > 0 then t <= 0 or (t - peak) / peak * 100 < -5 else t < peak end, false) as decay,
  case when f is null then 'unknown' when t <= 0 and f > t then 'improving' when t <= 0 and f < t then 'declining' when t <= 0 then 'flat' when f <= 0 then 'declining'
    when (f - t) / t * 100 > 5 then 'improving' when (f - t) / t * 100 < -5 then 'declining' else 'flat' end as ahead from h)"""


@query("fundamentals_direction", f"""with {DIR_SQL} select d, symbol, case when m < 3 then 'insufficient_data' when t <= 0 and f > 0 then 'improving' when f <= 0 then 'declining'
  when trend = 'improving' and ahead = 'improving' then 'improving' when ahead = 'declining' then 'declining' when (trend = 'declining' or decay) and ahead <> 'improving' then 'declining' else 'stable' end as direction from t""")
def direction(spark, sf_dir):
    snap, periods = bound(spark, sf_dir, SNAP), bound(spark, sf_dir, PERIODS)
    known = snap.select("d", "symbol", "forward_eps").join(periods.select("symbol", "period_end", "eps"), "symbol").where("period_end <= d")
    aged = known.withColumn("age", F.row_number().over(Window.partitionBy("d", "symbol").orderBy(F.desc("period_end"))) - 1)
    past = F.transform(F.array_sort(F.collect_list(F.when(F.col("age") > 0, F.struct("age", "eps")))), lambda x: x["eps"])
    g = aged.groupBy("d", "symbol").agg(F.max("forward_eps").alias("f"), F.max(F.when(F.col("age") == 0, F.col("eps"))).alias("t"), past.alias("past"))
    return g.select("d", "symbol", rk.fundamentals_direction(g, "t", "f", "past").alias("direction"))


RATIONALE_SQL = """
rs as (select b.*, b.klass <> 'avoid' and b.composite > 0 and b.composite <= b.cut as bottom, v.med, v.divergent, v.price as px, (v.p25 - v.price) / v.price * 100 as up, len(a) as na,
  case when peer_set = 'cohort' and len(a) >= 6 and p75 / v.p25 <= 1.5 then 'high' when peer_set in ('cohort', 'narrow') and len(a) >= 6 and p75 / v.p25 <= 2.5 then 'medium' else 'low' end as confidence
  from bucketed b left join fvs v using (d, symbol)),
rr as (select *, case when bucket = 'avoid' and coalesce(bottom, false) then 'bottom-decile-composite' when bucket = 'avoid' and valuation is null and health is null and quality is null and shareholder_return is null and growth is null then 'failed-quality-floor'
  when bucket = 'avoid' then 'no-fair-value' when bucket = 'ranked' then 'actionable-buy' when negative_equity then 'negative-equity' else 'above-conservative-tail' end as reason from rs),
sc as (select d, symbol, k, v, label from rr cross join lateral (values (0, valuation, 'Valuation'), (1, health, 'Financial health'), (2, quality, 'Quality'), (3, shareholder_return, 'Shareholder return'), (4, growth, 'Growth')) t(k, v, label)),
lists as (select d, symbol, list(label || ' score ' || cast(floor(round(v, 7) + 0.5) as int) || '/100' order by -round(v, 7), k) filter (v >= 65) as up_, list(label || ' score ' || cast(floor(round(v, 7) + 0.5) as int) || '/100' order by round(v, 7), k) filter (v <= 35) as down_,
  string_agg(label, ', ' order by k) filter (v is null) as lacking from sc group by 1, 2)"""


@query("bucket_rationale", f"""with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL}, {PEER_SQL}, {OWN_SQL}, {BUCKET_SQL}, {RATIONALE_SQL}
  select d, symbol, bucket, reason, array_to_string(list_slice(list_concat(list_slice(coalesce(up_, []), 1, 3), list_filter([case when round(price, 6) < round(p25, 6) then 'Trades ' || printf('%.1f', up) || '% below conservative fair value (p25)' end,
      case when confidence = 'high' then 'High-confidence fair value (full anchor coverage)' end], lambda x: x is not null)), 1, 3), '; ') as strengths,
    array_to_string(list_slice(list_concat(list_slice(coalesce(down_, []), 1, 3), list_filter([case when negative_equity then 'Negative shareholders'' equity (sustained buybacks; ROIC nulls structurally)' end, case when divergent then 'Peer cohort deemed unreliable — FV uses own history only' end,
      case when confidence = 'low' then 'Low-confidence fair value (limited anchor coverage)' end, case when lacking is not null then 'Missing data for: ' || lacking end], lambda x: x is not null)), 1, 3), '; ') as weaknesses
  from rr join lists using (d, symbol)""")
def bucket_rationale(spark, sf_dir):
    value = fair_values(spark, sf_dir).select("d", "symbol", "p25", "upside_p25", "confidence", "divergent")
    placed = rk.bucket(rk.rank(panel(spark, sf_dir)).join(value, ["d", "symbol"], "left")).withColumn("trend", F.lit(None).cast("string"))
    out = rk.bucket_rationale(placed.withColumns({c: F.round(c, 6) for c in ("price", "p25")}))
    return out.select("d", "symbol", "bucket", "reason", F.array_join("strengths", "; ").alias("strengths"), F.array_join("weaknesses", "; ").alias("weaknesses"))


@query("results_order", f"""with {FEATURES_SQL}, {FLOOR_SQL}, {SCORES_SQL} select d, symbol, row_number() over (partition by d order by composite desc nulls last, valuation desc nulls last, health desc nulls last, quality desc nulls last, growth desc nulls last, symbol) as place
  from (select d, symbol, round(composite, 7) as composite, round(valuation, 7) as valuation, round(health, 7) as health, round(quality, 7) as quality, round(growth, 7) as growth from ranked)""")
def results_order(spark, sf_dir):
    """Results by six keys, missing ones last."""
    cols = ["composite", "valuation", "health", "quality", "growth"]
    ranked = rounded7(rk.rank(panel(spark, sf_dir)).where("floor_reason is null"), *cols)
    order = [*[F.desc_nulls_last(c) for c in cols], F.asc("symbol")]
    return ranked.select("d", "symbol", F.row_number().over(Window.partitionBy("d").orderBy(*order)).alias("place"))


def rounded7(df, *cols):
    return df.withColumns({c: F.round(c, 7) for c in cols})


@query("peer_picks", f"""with s as ({SNAP}), i as (select a.d, a.symbol, b.symbol as peer, row_number() over (partition by a.d, a.symbol order by b.market_cap desc, b.symbol) as place, count(*) over (partition by a.d, a.symbol) as n from s a join s b on a.d = b.d and a.industry = b.industry and a.symbol <> b.symbol),
  e as (select a.d, a.symbol, b.symbol as peer, row_number() over (partition by a.d, a.symbol order by b.market_cap desc, b.symbol) as place, count(*) over (partition by a.d, a.symbol) as n from s a join s b on a.d = b.d and a.sector = b.sector and a.symbol <> b.symbol where not exists (select 1 from i where i.d = a.d and i.symbol = a.symbol and i.n >= 2))
  select d, symbol, peer, place, 'industry' as level from i where place <= 5 and n >= 2 union all select d, symbol, peer, place, 'sector' from e where place <= 5 and n >= 2""")
def peer_picks(spark, sf_dir):
    return fv.peer_picks(bound(spark, sf_dir, SNAP), 5)


@query("smoothed_multiples", f"""with s as ({SNAP}), i as (select a.d, a.symbol, b.symbol as peer, row_number() over (partition by a.d, a.symbol order by b.market_cap desc, b.symbol) as place, count(*) over (partition by a.d, a.symbol) as n from s a join s b on a.d = b.d and a.industry = b.industry and a.symbol <> b.symbol),
  e as (select a.d, a.symbol, b.symbol as peer, row_number() over (partition by a.d, a.symbol order by b.market_cap desc, b.symbol) as place, count(*) over (partition by a.d, a.symbol) as n from s a join s b on a.d = b.d and a.sector = b.sector and a.symbol <> b.symbol where not exists (select 1 from i where i.d = a.d and i.symbol = a.symbol and i.n >= 2)),
  p as (select * from i where place <= 8 and n >= 2 union all select * from e where place <= 8 and n >= 2), py as (select p.d, p.peer, q.price_end / q.eps as v, q.eps > 0 and q.price_end / q.eps > 0 as ok, row_number() over (partition by p.d, p.peer order by q.period_end desc) as age from (select distinct d, peer from p) p join ({PERIODS}) q on q.symbol = p.peer and q.period_end <= p.d - interval 90 day),
  m as (select d, peer, quantile_cont(v, 0.5) as m from py where ok and age <= 5 group by 1, 2),
  k as (select p.d, p.symbol, m.m, row_number() over (partition by p.d, p.symbol order by m.m, p.peer) as k, count(*) over (partition by p.d, p.symbol) as c from p join m using (d, peer)),
  t as (select *, case when c >= 5 then greatest(1, floor(c * 0.1)) else 0 end as cut from k)
  select d, symbol, round(quantile_cont(m, 0.5), 6) as multiple, round(quantile_cont(m, 0.5) filter (k > cut and k <= c - cut), 6) as trimmed from t group by 1, 2""")
def smoothed_multiples(spark, sf_dir):
    own = bound(spark, sf_dir, PERIODS).select("symbol", "period_end", F.when(F.col("eps") > 0, F.col("price_end") / F.col("eps")).alias("value"))
    return rounded(fv.smoothed_multiples(fv.peer_picks(bound(spark, sf_dir, SNAP), 8), own), "multiple", "trimmed")


NAMES = [n for names in ref.SUPER_GROUPS.values() for n in names]
GROUP_VALUES = ", ".join(f"('{n}', '{g}')" for g, names in ref.SUPER_GROUPS.items() for n in names)
INDUSTRY = f"element_at(array({', '.join(repr(n) for n in NAMES)}, 'Shell Companies', null), cast(1 + c_custkey % {len(NAMES) + 2} as int))"


@query("super_groups", f"""with n(name, g) as (values {GROUP_VALUES}), l as (select list(name) as names from (select name from n)), c as (select c_custkey, ([{', '.join(f"'{n}'" for n in NAMES)}, 'Shell Companies', null])[1 + c_custkey % {len(NAMES) + 2}] as industry from {{customer}})
  select c_custkey, industry, g as super_group from c left join n on n.name = c.industry""")
def super_groups(spark, sf_dir):
    c = bound(spark, sf_dir, f"select c_custkey, {INDUSTRY} as industry from {{customer}}")
    return c.withColumn("super_group", ref.super_group(F.col("industry")))


COUNTRIES = ["Denmark", "Japan", "Canada", "USA", "Bermuda", "Israel", "Atlantis"]
RATES = [("DKK", "USD", 0.14), ("JPY", "USD", 0.007), ("CAD", "USD", 0.73), ("EUR", "USD", 1.1)]
PROVIDER = f"""select c_custkey as symbol, price_end as price, price_end * shares as market_cap, price_end * shares + debt - cash as enterprise_value, case when y % 3 = 0 then price_end / nullif(eps, 0) end as trailing_pe, eps as trailing_eps, ebitda, debt as total_debt,
  case when y % 2 = 0 then cash end as total_cash, fcf as free_cash_flow, equity, ebit, y, case when c_custkey % 4 = 0 then 'EUR' end as stated, element_at(array({', '.join(repr(c) for c in COUNTRIES)}, null), cast(1 + c_custkey % 8 as int)) as country, 'USD' as quote_currency
  from ({PERIODS}) p join {{customer}} on symbol = c_custkey"""
PROVIDER_SQL = PROVIDER.replace(f"element_at(array({', '.join(repr(c) for c in COUNTRIES)}, null), cast(1 + c_custkey % 8 as int))", f"([{', '.join(repr(c) for c in COUNTRIES)}, null])[1 + c_custkey % 8]")


@query("provider_ttm", f"""with r as ({PROVIDER_SQL}), c as (select *, coalesce(stated, case country when 'Denmark' then 'DKK' when 'Japan' then 'JPY' when 'Canada' then 'CAD' when 'Israel' then 'ILS' else 'USD' end) as cur from r),
  f(s, t, rate) as (values {', '.join(str(r) for r in RATES)}), x as (select c.*, case when cur <> 'USD' then coalesce(rate, 1.0) else 1.0 end::double as fx, cur <> 'USD' and rate is null as fx_missing from c left join f on s = cur),
  m as (select *, case when trailing_pe > 0 then trailing_pe when trailing_eps > 0 then price / trailing_eps end as pe, equity + total_debt * fx - coalesce(total_cash * fx, 0) as inv from x)
  select symbol, y, cur as reporting_currency, fx_missing, round(pe, 6) as pe_ratio, round(case when free_cash_flow * fx > 0 and market_cap > 0 then market_cap / (free_cash_flow * fx) end, 6) as price_to_fcf, round(case when ebitda * fx > 0 then (total_debt * fx - total_cash * fx) / (ebitda * fx) end, 6) as net_debt_to_ebitda,
    round(case when inv > 0 then ebit * 0.79 / inv end, 7) as roic, round(case when market_cap > 0 then free_cash_flow * fx / market_cap end, 8) as fcf_yield from m""")
def provider_ttm(spark, sf_dir):
    rows = bound(spark, sf_dir, PROVIDER).withColumn("reporting_currency", ref.reporting_currency(F.col("stated"), F.col("country")))
    fx = spark.sql(f"select * from values {', '.join(str(r) for r in RATES)} as t(source, target, rate)").withColumn("rate", F.col("rate").cast("double"))
    out = ref.provider_ttm(ref.with_fx(rows, fx))
    return out.select("symbol", "y", "reporting_currency", "fx_missing", F.round("pe_ratio", 6).alias("pe_ratio"), F.round("price_to_fcf", 6).alias("price_to_fcf"), F.round("net_debt_to_ebitda", 6).alias("net_debt_to_ebitda"), F.round("roic", 7).alias("roic"), F.round("fcf_yield", 8).alias("fcf_yield"))


@query("profile_rules", f"""select symbol, y, round(coalesce(case when price_end > 0 and rev_cap > 0 then rev_cap / price_end end, sh, 0), 4) as shares, round(coalesce(dy, 0) * price_end, 8) as dividend, coalesce(eq < 0, false) as negative_equity, round(coalesce(ph, price_high, 0), 4) as high
  from (select symbol, y, price_end, price_high, case when y % 2 = 0 then revenue * 3 end as rev_cap, case when y % 3 > 0 then shares end as sh, case when y % 4 > 0 then 0.01 end as dy, net_income as eq, case when y % 5 = 0 then price_high * 1.1 end as ph from ({PERIODS}) p) q""")
def profile_rules(spark, sf_dir):
    """Shares, dividend, equity's sign and the year's range where the provider's figure is missing."""
    q = bound(spark, sf_dir, f"select symbol, y, price_end, price_high, price_low, case when y % 2 = 0 then revenue * 3 end as rev_cap, case when y % 3 > 0 then shares end as sh, case when y % 4 > 0 then 0.01e0 end as dy, net_income as eq, case when y % 5 = 0 then price_high * 1.1 end as ph from ({PERIODS}) p")
    c = F.col
    high, _ = ref.range_of_year(c("ph"), F.lit(None), c("price_high"), c("price_low"))
    return q.select("symbol", "y", F.round(ref.authoritative_shares(c("rev_cap"), c("price_end"), c("sh")), 4).alias("shares"), F.round(ref.annual_dividend(c("dy"), c("price_end")), 8).alias("dividend"), ref.negative_equity(c("eq")).alias("negative_equity"), F.round(high, 4).alias("high"))


@query("industries", "select distinct n_name as industry from {customer} join {nation} on c_nationkey = n_nationkey")
def industries(spark, sf_dir):
    return bound(spark, sf_dir, "select n_name as industry from {customer} join {nation} on c_nationkey = n_nationkey").distinct()


@query("facts_and_bars", "select c_custkey as symbol from {customer} where c_custkey in (select o_custkey from {orders}) and c_custkey in (select o_custkey from {orders} where o_orderpriority = '1-URGENT')")
def facts_and_bars(spark, sf_dir):
    """Symbols that have both: an intersection."""
    every, urgent = (bound(spark, sf_dir, f"select distinct o_custkey as symbol from {{orders}} {w}") for w in ("", "where o_orderpriority = '1-URGENT'"))
    return every.intersect(urgent)
