"""Options, portfolios, membership and row rules over parts, lineitems, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import finance as fn
from rankweave.functions import stats
from rankweave.operators import html_tables as html
from rankweave.operators import membership as mb
from rankweave.operators import options as op
from rankweave.operators import portfolio as pf
from rankweave.queries.base import PERIODS, SNAP, bound, query

#: Parts as option contracts: a brand is a symbol, retail prices its strikes.
CHAIN = """select p_brand as symbol, make_date(2024, 1 + cast(p_size % 12 as int), 1 + cast(p_partkey % 28 as int)) as expiration, case when p_partkey % 2 = 0 then 'call' else 'put' end as side,
  p_retailprice as strike, case when p_partkey % 11 = 0 then 0.0 when p_partkey % 13 = 0 then 0.05 else p_retailprice * 0.01 * (1 + p_size % 5) end as bid, case when p_partkey % 7 = 0 then 0.0 else 0.3 end as iv,
  cast(10 + p_size as double) as days, cast(p_partkey % 3 as bigint) as volume, cast(p_partkey % 2 as bigint) as open_interest, p_partkey from {part}"""
VALUES = f"select symbol, cast(950 as double) as spot, cast(case when symbol like '%1' then 940 when symbol like '%2' then 955 else 1000 end as double) as p25, cast(case when symbol like '%3' then 0 else 24 end as double) as dividend from ({CHAIN}) c group by symbol"


@query("select_expirations", f"""with c as (select distinct symbol, expiration as e from ({CHAIN}) c where expiration > date '2024-01-10'), w as (select symbol, min(e) as weekly from c group by 1),
  t as (select symbol, e, date_trunc('month', e) as m from c where day(e) between 15 and 21),
  b as (select t.symbol, m, coalesce(min(e) filter (dayofweek(e) = 5), max(e)) as e from t join w using (symbol) where e > weekly group by 1, 2), mo as (select symbol, arg_min(e, m) as monthly from b group by 1),
  y as (select t.symbol, t.m, coalesce(min(e) filter (dayofweek(e) = 5), max(e)) as e from t join w using (symbol) left join mo using (symbol) where month(e) = 1 and e > coalesce(monthly, weekly) group by 1, 2), yr as (select symbol, arg_min(e, m) as yearly from y group by 1)
  select symbol, 'weekly' as kind, weekly as expiration from w union all select symbol, 'monthly', monthly from mo union all select symbol, 'yearly', yearly from yr""")
def select_expirations(spark, sf_dir):
    return op.select_expirations(bound(spark, sf_dir, CHAIN).withColumn("today", F.lit("2024-01-10").cast("date")))


PICK = "struct_pack(strike := ch.strike, bid := bid, days := days, spot := spot, p25 := p25, dividend := dividend, volume := volume, oi := open_interest)"
VIEW_SQL = f"""ch as (select c.*, v.spot, v.p25, v.dividend from ({CHAIN}) c join ({VALUES}) v using (symbol)),
sn as (select symbol, expiration, coalesce(min(strike) filter (strike >= p25), max(strike)) as strike from ch where side = 'call' and p25 > spot group by 1, 2),
ca as (select ch.symbol, ch.expiration, arg_max({PICK}, (bid, days, volume, open_interest)) as x from ch join sn on sn.symbol = ch.symbol and sn.expiration = ch.expiration and sn.strike = ch.strike where side = 'call' and ch.strike > spot and bid > 0 group by 1, 2),
pu as (select symbol, expiration, arg_max({PICK}, (strike, bid, days, volume, open_interest)) as y from ch where side = 'put' and spot < p25 and strike >= 0.75 * spot and strike < spot and bid > 0 and iv > 0 and bid * 100 >= 10 group by 1, 2),
view_ as (select k.symbol, k.expiration, x.strike as call_strike, (x.bid + x.dividend * x.days / 365) / x.spot as call_static_return, (x.bid + x.dividend * x.days / 365) / x.spot * 365 / x.days as call_static_annual,
  (x.strike - x.spot + x.bid + x.dividend * x.days / 365) / x.spot * 365 / x.days as call_assigned_annual, x.days as call_days, x.days < 30 as call_short, x.volume = 0 and x.oi = 0 as call_idle, abs(x.strike - x.p25) / x.p25 as call_off,
  y.strike as put_strike, y.bid as put_bid, y.bid / y.strike * 365 / y.days as put_annual, (y.spot - (y.strike - y.bid)) / y.spot as discount, y.days as put_days, y.days < 30 as put_short, y.volume = 0 and y.oi = 0 as put_idle, abs(y.strike - y.p25) / y.p25 as put_off
  from (select distinct symbol, expiration from ch) k left join ca on ca.symbol = k.symbol and ca.expiration = k.expiration left join pu on pu.symbol = k.symbol and pu.expiration = k.expiration),
best as (select symbol, max(call_static_annual) filter (call_days >= 30) as best_call, max(put_annual) filter (put_days >= 30) as best_put from view_ group by 1)"""


def view(spark, sf_dir):
    """The view of all brands; of several contracts at a strike the one of best bid."""
    return op.options_view(bound(spark, sf_dir, CHAIN), bound(spark, sf_dir, VALUES))


def best(spark, sf_dir):
    """Calls and puts each by their own days."""
    v = view(spark, sf_dir)
    return v.groupBy("symbol").agg(F.max(F.when(~F.col("call_short_dated"), F.col("call_static_annual"))).alias("best_call"), F.max(F.when(~F.col("put_short_dated"), F.col("put_annual"))).alias("best_put"))


@query("options_view", f"with {VIEW_SQL} select symbol, expiration, call_strike, round(call_static_return, 7) as call_static_return, round(call_assigned_annual, 7) as call_assigned_annual, put_strike, round(put_annual, 7) as put_annual, round(discount, 7) as discount, cast(call_off > 0.05 as int) as call_snap_warning, cast(put_short as int) as put_short_dated from view_")
def options_view(spark, sf_dir):
    cols = ["call_static_return", "call_assigned_annual", "put_annual", "discount"]
    return view(spark, sf_dir).select("symbol", "expiration", "call_strike", "put_strike", *[F.round(c, 7).alias(c) for c in cols], F.col("call_snap_warning").cast("int").alias("call_snap_warning"), F.col("put_short_dated").cast("int").alias("put_short_dated"))


@query("options_best", f"with {VIEW_SQL} select symbol, round(best_call, 7) as best_call, round(best_put, 7) as best_put from best")
def options_best(spark, sf_dir):
    return best(spark, sf_dir).select("symbol", F.round("best_call", 7).alias("best_call"), F.round("best_put", 7).alias("best_put"))


RULES_SQL = [
    ("call", "CRITICAL", "ITM call survived", "call_strike < spot"), ("call", "WARN", "Zero liquidity contract", "call_idle"), ("call", "INFO", "Short-dated covered call", "call_short"), ("call", "WARN", "Hard snap (>10% off anchor)", "call_off > 0.10"),
    ("put", "CRITICAL", "ITM put survived", "put_strike > spot"), ("put", "CRITICAL", "Put effective cost > spot", "put_strike - put_bid > spot"), ("put", "WARN", "Zero liquidity contract", "put_idle"), ("put", "INFO", "Short-dated put", "put_short"), ("put", "WARN", "Hard snap (>10% off anchor)", "put_off > 0.10"),
]


@query("options_audit", f"""with {VIEW_SQL}, vs as (select v.*, w.spot from view_ v join ({VALUES}) w using (symbol)), n as (select symbol, count(call_strike) + count(put_strike) as n from view_ group by 1)
  {' union all '.join(f"select symbol, expiration, '{side}' as side, '{sev}' as severity, '{rule}' as rule from vs where {cond}" for side, sev, rule, cond in RULES_SQL)}
  union all select symbol, null, null, 'WARN', 'No contracts after filters' from n where n = 0 union all select symbol, null, null, 'WARN', 'Single-contract chain' from n where n = 1
  union all select symbol, null, null, 'WARN', 'Best Call > 50% annualized' from best where best_call > 0.50 union all select symbol, null, null, 'WARN', 'Best Put > 30% annualized' from best where best_put > 0.30""")
def options_audit(spark, sf_dir):
    return op.audit_options(view(spark, sf_dir), bound(spark, sf_dir, VALUES), best(spark, sf_dir))


@query("run_statistics", f"""with {VIEW_SQL} select case when call_strike is null and put_strike is null then 'skipped' else 'ok' end as status, count(*) as n from view_ group by 1""")
def run_statistics(spark, sf_dir):
    """How many expirations have a contract left."""
    status = F.when(F.col("call_strike").isNull() & F.col("put_strike").isNull(), "skipped").otherwise("ok")
    return view(spark, sf_dir).groupBy(status.alias("status")).agg(F.count("*").alias("n"))


#: Parts as trades; every eleventh has no call, every thirteenth no put; the scenario turns with the size.
LEGS = """select p_partkey, p_retailprice as spot, cast(30 + p_size * 7 as double) as days, p_retailprice * 0.02 as dividend, case when p_partkey % 11 > 0 then p_retailprice * 1.1 end as call_strike, p_retailprice * 0.02 as call_bid,
  case when p_partkey % 13 > 0 then p_retailprice * 0.9 end as put_strike, p_retailprice * 0.015 as put_bid, case when p_size % 3 = 0 then 'p25' when p_size % 3 = 1 then 'flat' else 'median' end as scenario,
  p_retailprice * (0.7 + p_size / 100.0e0) as p25, p_retailprice * (0.9 + p_size / 100.0e0) as median from {part}"""
LEGS_SQL = f"""t as (select *, days / 365 as y, case scenario when 'p25' then p25 when 'flat' then spot else median end as e from ({LEGS}) l),
u as (select p_partkey, days, 0 as k, 'buyOutright' as leg, spot as capital, e - spot + dividend * y as total from t
  union all select p_partkey, days, 1, 'buyWrite', case when call_strike is not null then spot - call_bid end, case when e >= call_strike then call_strike - spot else e - spot end + dividend * y + call_bid from t
  union all select p_partkey, days, 2, 'coveredCall', case when call_strike is not null then spot end, case when e >= call_strike then call_strike - spot else e - spot end + dividend * y + call_bid + call_bid * 0.033 * y from t
  union all select p_partkey, days, 3, 'cashSecuredPut', put_strike, case when e < put_strike then e - put_strike else 0 end + put_bid + (put_strike + put_bid) * 0.033 * y from t
  union all select p_partkey, days, 4, 'holdCash', spot, spot * 0.033 * y from t),
v as (select *, total / capital * 365 / days as annual from u)"""


def legs(spark, sf_dir):
    c = F.col
    rows = bound(spark, sf_dir, LEGS).withColumn("target", op.end_price(c("scenario"), c("spot"), c("p25"), c("median")))
    return op.trade_legs(rows)


@query("trade_comparison", f"with {LEGS_SQL} select p_partkey, leg, round(capital, 6) as capital, round(case when capital is not null then total end, 6) as total, round(annual, 7) as annual from v")
def trade_comparison(spark, sf_dir):
    return legs(spark, sf_dir).select("p_partkey", "leg", F.round("capital", 6).alias("capital"), F.round("total", 6).alias("total"), F.round("annual", 7).alias("annual"))


@query("best_trade_leg", f"with {LEGS_SQL}, r as (select *, row_number() over (partition by p_partkey order by annual desc nulls last, k) as n from v) select p_partkey, leg, round(annual, 7) as annual from r where n = 1")
def best_trade_leg(spark, sf_dir):
    return op.best_leg(legs(spark, sf_dir), ["p_partkey"]).select("p_partkey", "leg", F.round("annual", 7).alias("annual"))


@query("put_strike_search", """with t as (select p_partkey, p_retailprice as spot, p_retailprice * (0.85 + p_size / 200.0e0) as p25, 0.15 + p_size / 200.0e0 as iv, cast(30 + p_size * 14 as double) as days from {part}),
  g as (select t.*, m, spot * m as k from t, (values (0.80::double), (0.85), (0.90), (0.93), (0.95), (0.97), (0.99), (1.00)) v(m)),
  p as (select *, greatest(0, k * exp(-0.04 * days / 365) - spot * exp(-0.02 * days / 365)) + greatest(0.5, 100 * iv * sqrt(days / 365) * 0.4 * greatest(0.1, 1 - abs((k - spot) / spot * 100) / 60)) / 100 * spot as price from g),
  r as (select *, (price - greatest(0, k - spot)) / k as y from p where k <= p25), b as (select p_partkey, arg_max(k, (round(y, 12), -m)) as put_strike, max(y) as y from r where y > 0 group by 1)
  select t.p_partkey, round(put_strike, 6) as put_strike, round(y, 8) as time_yield from t left join b using (p_partkey)""")
def put_strike_search(spark, sf_dir):
    rows = bound(spark, sf_dir, "select p_partkey, p_retailprice as spot, p_retailprice * (0.85 + p_size / 200.0e0) as p25, 0.15e0 + p_size / 200.0e0 as iv, cast(30 + p_size * 14 as double) as days from {part}")
    return op.put_strike_search(rows).select("p_partkey", F.round("put_strike", 6).alias("put_strike"), F.round("time_yield", 8).alias("time_yield"))


PLAN = """select o_custkey as plan_id, o_orderkey as symbol, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rank, o_totalprice / 1000 as strike, o_totalprice / 50000 as premium_per_share,
  o_totalprice / 1000000 as annual, cast(case when o_custkey % 10 = 0 then 0 else 100000 end as double) as capital, o_orderkey % 7 = 0 as skip from {orders}"""


@query("capital_plan")
def capital_plan(spark, sf_dir):
    """Contracts of every customer's plan; the top-up is sequential, tests compare it with a loop."""
    out = op.capital_plan(bound(spark, sf_dir, PLAN), top=5, excluded="skip")
    return out.select("plan_id", "symbol", "contracts", F.round("collateral", 4).alias("collateral"), F.round("premium", 4).alias("premium"))


@query("plan_totals")
def plan_totals(spark, sf_dir):
    """Totals of every customer's plan; tests compare them with a loop."""
    out = op.plan_totals(op.capital_plan(bound(spark, sf_dir, PLAN), top=5, excluded="skip"))
    return out.select("plan_id", "contracts", F.round("collateral", 4).alias("collateral"), F.round("premium", 4).alias("premium"), F.round("yield", 7).alias("yield"))


FLOWS = "select o_custkey as account_id, cast(o_orderdate as date) as date, case when o_orderkey % 3 = 0 then o_totalprice else -o_totalprice * 0.4 end as amount from {orders}"


@query("money_weighted_return")
def money_weighted_return(spark, sf_dir):
    """Yearly rate of every customer's dated flows, by bisection; tests check that it nulls the flows."""
    return op.money_weighted_return(bound(spark, sf_dir, FLOWS)).withColumn("rate", F.round("rate", 6))


#: Lineitems as positions of customers: shares, cash, and options on parts, long and short; a short call may name the order's first line.
POSITIONS = """select o_custkey as account_id, l_orderkey * 10 + l_linenumber as id, case when l_linenumber % 3 = 0 then 'cash' when l_linenumber % 3 = 1 then 'stock' else 'option' end as kind, l_partkey as symbol,
  l_quantity as shares, l_extendedprice as cost_basis, case when l_orderkey % 2 = 0 then 'call' else 'put' end as option_type, case when l_suppkey % 3 = 0 then l_quantity else -l_quantity end as contracts,
  (8900 + l_suppkey % 5 * 500) / 10000.0e0 * 1000 as strike, date_add(cast(l_shipdate as date), cast(30 + l_suppkey % 400 as int)) as expiration, l_extendedprice * 0.03 as premium, case when l_linenumber = 2 then l_orderkey * 10 + 1 end as paired_stock_id,
  l_extendedprice as amount, l_discount * 100 as yield_pct, cast(l_shipdate as date) as entry_date from {lineitem} join {orders} on l_orderkey = o_orderkey"""
#: Parts as a market: every tenth is unknown to it.
MARKET = """select p_partkey as symbol, p_retailprice as price, case when p_size % 5 = 0 then 'avoid' when p_size % 5 < 3 then 'ranked' else 'watch' end as bucket, cast(p_size * 2 % 90 as double) as composite,
  p_retailprice * (0.8 + p_size / 100.0e0) as fv_median, p_retailprice * (0.9 + p_size / 100.0e0) as fv_p75 from {part} where p_partkey % 10 <> 0"""
TODAY = "2000-01-01"
EVALUATED_SQL = f"""p as ({POSITIONS.replace("date_add(cast(l_shipdate as date), cast(30 + l_suppkey % 400 as int))", "cast(cast(l_shipdate as date) + cast(30 + l_suppkey % 400 as int) as date)")}), m as ({MARKET}), md as (select quantile_disc(composite, 0.5 order by composite desc) as um from (select -composite as composite from m where composite > 0)),
e0 as (select p.*, price, bucket, composite, fv_median, fv_p75, m.symbol is not null as in_snapshot, -md.um as um, s.shares as ps, s.cost_basis as pb from p left join m using (symbol) cross join md left join (select account_id, id, shares, cost_basis from p where kind = 'stock') s on s.id = p.paired_stock_id and s.account_id = p.account_id),
e1 as (select *, case when kind = 'option' and price is not null then (case option_type when 'call' then greatest(0, price - strike) else greatest(0, strike - price) end) * 100 * abs(contracts) end as inner_,
  case when kind = 'stock' then case when bucket = 'avoid' then 1 else 0 end + case when price >= fv_median then 1 else 0 end + case when composite > 0 and composite < um and bucket <> 'avoid' then 1 else 0 end end as n_signals,
  case when kind = 'cash' then greatest(0, date '{TODAY}' - entry_date) end as held, case option_type when 'call' then pb else strike * 100 * abs(contracts) end as coll from e0),
ev as (select *, amount * yield_pct / 100 * held / 365 as interest, case kind when 'stock' then coalesce(price * shares, cost_basis) when 'cash' then amount + amount * yield_pct / 100 * held / 365 else case when contracts > 0 then inner_ else -inner_ end end as value_ from e1)"""


def evaluated(spark, sf_dir):
    return pf.evaluate_positions(bound(spark, sf_dir, POSITIONS), bound(spark, sf_dir, MARKET), F.lit(TODAY).cast("date"))


@query("portfolio_positions", f"""with {EVALUATED_SQL} select id, round(value_, 4) as value, round(case when kind = 'stock' then price * shares - cost_basis end, 4) as profit, n_signals, round(interest, 4) as accrued_interest,
  case when kind = 'option' then expiration - date '{TODAY}' end as days_to_expiration, cast(case when kind = 'option' then expiration - date '{TODAY}' between 0 and 21 end as int) as near_expiration, cast(case when kind = 'option' then inner_ > 0 end as int) as in_the_money,
  round(case when kind = 'option' and contracts < 0 and coll > 0 then premium / coll * 365 / (expiration - entry_date) * 100 end, 6) as premium_yield_pct from ev""")
def positions(spark, sf_dir):
    out = evaluated(spark, sf_dir)
    signals = F.when(F.col("kind") == "stock", F.size("sell_signals")).alias("n_signals")
    return out.select("id", F.round("value", 4).alias("value"), F.round("profit", 4).alias("profit"), signals, F.round("accrued_interest", 4).alias("accrued_interest"), "days_to_expiration", F.col("near_expiration").cast("int").alias("near_expiration"), F.col("in_the_money").cast("int").alias("in_the_money"), F.round("premium_yield_pct", 6).alias("premium_yield_pct"))


@query("portfolio_summary", f"""with {EVALUATED_SQL} select account_id, count(*) as positions, count(*) filter (kind = 'stock') as stocks, count(*) filter (kind = 'option') as options, count(*) filter (kind = 'cash') as cash_positions, count(*) filter (kind = 'stock' and in_snapshot) as stocks_in_snapshot,
  count(*) filter (kind = 'stock' and bucket = 'avoid') as in_avoid, count(*) filter (n_signals > 0) as with_sell_signal, round(coalesce(sum(value_), 0), 2) as value, round(coalesce(sum(price * shares - cost_basis) filter (kind = 'stock'), 0), 2) as stock_profit, round(coalesce(sum(interest), 0), 2) as accrued_interest from ev group by 1""")
def summary(spark, sf_dir):
    out = pf.summarise(evaluated(spark, sf_dir))
    return out.withColumns({c: F.round(c, 2) for c in ("value", "stock_profit", "accrued_interest")})


@query("position_milestones", f"""with {EVALUATED_SQL}, o as (select * from ev where kind = 'option'), q as (select id, 'current-price' as scenario, price as at_, strike, option_type, contracts, premium, ps, pb from o where price is not null
  union all select id, case option_type when 'call' then 'called-away' else 'assigned' end, strike, strike, option_type, contracts, premium, ps, pb from o where contracts < 0
  union all select id, 'expires-otm', case option_type when 'call' then greatest(0, strike - 1) else strike + 1 end, strike, option_type, contracts, premium, ps, pb from o where contracts <> 0),
  g as (select *, case option_type when 'call' then greatest(0, at_ - strike) else greatest(0, strike - at_) end * 100 * abs(contracts) as i from q), h as (select *, case when contracts > 0 then i - premium else premium - i end as p from g)
  select id, scenario, round(p, 4) as option_profit, round(case when scenario <> 'assigned' then p + at_ * ps - pb end, 4) as combined_profit from h""")
def milestones(spark, sf_dir):
    return pf.milestones(evaluated(spark, sf_dir)).select("id", "scenario", F.round("option_profit", 4).alias("option_profit"), F.round("combined_profit", 4).alias("combined_profit"))


CHANGES = "select cast(min(o_orderdate) as date) as date, o_custkey as added, cast(null as bigint) as removed, cast(null as string) as reason from {orders} group by o_custkey"
GONE = "select cast(max(o_orderdate) as date) as date, cast(null as bigint) as added, o_custkey as removed, case o_custkey % 18 when 0 then 'Acquired by another' when 3 then 'Market capitalization change' when 6 then 'Chapter 11, then acquired' when 9 then 'Split off of a unit' when 12 then 'No longer of a size' else 'note' end as reason from {orders} where o_custkey % 3 = 0 group by o_custkey"
CURRENT = "select c_custkey as symbol from {customer} where c_custkey % 3 <> 0"


def changes(spark, sf_dir):
    return bound(spark, sf_dir, CHANGES).unionByName(bound(spark, sf_dir, GONE))


@query("membership_intervals", """with a as (select o_custkey as symbol, cast(min(o_orderdate) as date) as f, cast(max(o_orderdate) as date) as t from {orders} group by 1)
  select symbol, f as valid_from, case when symbol % 3 = 0 then t end as valid_to from a union all select c_custkey, date '1900-01-01', null from {customer} where c_custkey % 3 <> 0 and c_custkey not in (select symbol from a)""")
def membership(spark, sf_dir):
    return mb.membership_intervals(changes(spark, sf_dir), bound(spark, sf_dir, CURRENT))


@query("members_at", f"""with a as (select o_custkey as symbol, cast(min(o_orderdate) as date) as f, cast(max(o_orderdate) as date) as t from {{orders}} group by 1)
  select d, s.symbol from ({SNAP}) s join a on a.symbol = s.symbol where d >= f and (s.symbol % 3 <> 0 or d < t)""")
def members(spark, sf_dir):
    i = mb.membership_intervals(changes(spark, sf_dir), bound(spark, sf_dir, CURRENT))
    return mb.members_at(bound(spark, sf_dir, SNAP), i).select("d", "symbol")


@query("delisted", """select o_custkey as symbol, cast(max(o_orderdate) as date) as date, case o_custkey % 18 when 0 then 'acquired' when 6 then 'bankruptcy' when 9 then 'spinoff' when 3 then 'market-cap-change' when 12 then 'market-cap-change' else 'other' end as class from {orders} where o_custkey % 3 = 0 group by 1""")
def delisted(spark, sf_dir):
    return mb.delisted(changes(spark, sf_dir), bound(spark, sf_dir, CURRENT)).select("symbol", "date", "class")


@query("universe_drift", """with o as (select distinct o_custkey as s from {orders} where year(o_orderdate) = 1996), n as (select distinct o_custkey as s from {orders} where year(o_orderdate) = 1999)
  select s as symbol, 'added' as change from n where s not in (select s from o) union all select s, 'removed' from o where s not in (select s from n)""")
def drift(spark, sf_dir):
    year = lambda y: bound(spark, sf_dir, f"select o_custkey as symbol from {{orders}} where year(o_orderdate) = {y}")
    return mb.drift(year(1996), year(1999))


@query("row_rules", f"""with s as ({SNAP}) select d, symbol, round(case when year_high > 0 then greatest(0, (year_high - price) / year_high * 100) else 0 end, 6) as off_high, round(case when year_low > 0 then greatest(0, (price - year_low) / year_low * 100) else 0 end, 6) as above_low,
  case when price < 25 then 2.5 when price < 200 then 5.0 else 10.0 end::double as increment, round(greatest(0.5, 100 * 0.3 * sqrt(0.5) * 0.4 * greatest(0.1, 1 - price / 10 / 60)), 6) as premium from s""")
def row_rules(spark, sf_dir):
    s = bound(spark, sf_dir, SNAP)
    p = F.col("price")
    half = F.lit(0.5)
    return s.select("d", "symbol", F.round(fn.pct_off_high(p, F.col("year_high")), 6).alias("off_high"), F.round(fn.pct_above_low(p, F.col("year_low")), 6).alias("above_low"), fn.strike_increment(p).alias("increment"), F.round(fn.call_premium_pct(F.lit(0.3), half, p / 10), 6).alias("premium"))


@query("statement_rules", f"""with p as ({PERIODS}) select symbol, y, round(case when 500000 + debt - coalesce(cash, 0) > 0 then ebit * 0.79 / (500000 + debt - coalesce(cash, 0)) end, 7) as roic, round(cfo - abs(capex), 4) as fcf, round(coalesce(debt, 0) + coalesce(interest, 0), 4) as total_debt,
  case when shares > 0 and abs(shares * 1 / 1e6 - 1) <= 0.3 then 1.0 when abs(shares * 1e3 / 1e6 - 1) <= 0.3 then 1e3 else 1.0 end as scale from (select *, -lo_ * 0.2 as capex from (select *, debt / 0.8 as lo_ from p) q) p""")
def statement_rules(spark, sf_dir):
    p = bound(spark, sf_dir, PERIODS).withColumn("capex", -(F.col("debt") / 0.8) * 0.2)
    c = F.col
    return p.select("symbol", "y", F.round(fn.roic(c("ebit"), F.lit(500000), c("debt"), c("cash")), 7).alias("roic"), F.round(fn.free_cash_flow(c("cfo"), c("capex")), 4).alias("fcf"), F.round(fn.total_debt(c("debt"), F.lit(None), F.lit(None), c("interest")), 4).alias("total_debt"), fn.shares_scale(c("shares"), F.lit(1e6)).alias("scale"))


@query("page_rows", r"""select page_id, len(regexp_extract_all(html, '<li[^>]*><a href="([^"]*)"', 1)) as links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from {pages}""")
def page_rows(spark, sf_dir):
    rows = pf.link_rows(bound(spark, sf_dir, "select page_id, html from {pages}"))
    titles = bound(spark, sf_dir, "select page_id, html from {pages}").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return titles.join(rows.groupBy("page_id").agg(F.count("*").alias("links")), "page_id", "left").select("page_id", F.coalesce("links", F.lit(0)).alias("links"), "title")


#: Customers as positions of all ages: old ones without a kind, current ones with and without an id, and rows that are no positions.
AGED = """select case when c_custkey % 5 = 0 then null when c_custkey % 5 = 1 then 'stock' when c_custkey % 5 = 2 then 'option' when c_custkey % 5 = 3 then 'cash' else 'short-put' end as kind,
  case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then '' else concat('p', c_custkey) end as id, c_custkey as account_id, case when c_custkey % 7 > 0 then c_mktsegment end as symbol,
  case when c_custkey % 3 > 0 then c_acctbal end as entry_price, cast(c_nationkey as double) as shares_owned, cast(10 as double) as shares, c_acctbal * 2 as cost_basis from {customer}"""


@query("migrate", f"""select account_id, symbol, coalesce(kind, 'stock') as kind, case when kind is null then shares_owned else shares end as shares, round(case when kind is null then entry_price * shares_owned else cost_basis end, 4) as cost_basis,
  coalesce(id, '') <> '' as had_id, true as has_id from ({AGED}) p where kind in ('stock', 'option', 'cash') or (kind is null and symbol is not null and entry_price is not null and shares_owned is not null)""")
def migrate(spark, sf_dir):
    rows = bound(spark, sf_dir, AGED).withColumn("had_id", F.coalesce("id", F.lit("")) != "")
    return pf.migrate(rows).select("account_id", "symbol", "kind", "shares", F.round("cost_basis", 4).alias("cost_basis"), "had_id", (F.coalesce("id", F.lit("")) != "").alias("has_id"))


#: Orders as a log of changes, one page a customer; a month's changes share one date.
CHANGE_LOG = """
select o_custkey as page_id, 1 + row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as row, cast(min(o_orderdate) over m as date) as date, row_number() over (m order by o_orderdate, o_orderkey) as k, count(*) over m as n,
  case when o_orderkey % 3 <> 0 then concat('A', o_orderkey) end as added, case when o_orderkey % 2 = 0 then concat('R&', o_orderkey) end as removed, case when o_orderkey % 7 <> 0 then o_orderpriority end as reason
from {orders} window m as (partition by o_custkey, date_trunc('month', o_orderdate))"""


def change_pages(spark, sf_dir):
    """The log written as pages: dates in three styles that span a month's rows, absent tickers as one cell over two columns, reasons left out at the end of rows."""
    c = F.col
    rows = bound(spark, sf_dir, CHANGE_LOG.replace(" window m as (partition by o_custkey, date_trunc('month', o_orderdate))", "").replace("over m ", "over (partition by o_custkey, date_trunc('month', o_orderdate)) ").replace("over (m order", "over (partition by o_custkey, date_trunc('month', o_orderdate) order"))
    style = F.when(c("page_id") % 3 == 0, F.date_format("date", "yyyy-MM-dd")).when(c("page_id") % 3 == 1, F.date_format("date", "MMMM d, yyyy")).otherwise(F.date_format("date", "d MMM yyyy"))
    date = F.when(c("k") == 1, F.concat(F.lit('<td rowspan="'), c("n").cast("string"), F.lit('">'), style, F.lit("</td>"))).otherwise("")
    both = lambda x: F.when(c(x).isNull(), F.lit('<td colspan=2></td>')).otherwise(F.concat(F.lit("<td><a href='/x'>"), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</a></td><td>Name of&nbsp; "), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("\n</td>")))
    line = F.concat(F.lit("<tr>"), date, both("added"), both("removed"), F.coalesce(F.concat(F.lit("<td>"), c("reason"), F.lit("</td>")), F.lit("")), F.lit("</tr>"))
    head = '<p>x</p><table class="wikitable"><tr><th>Symbol</th><td>B</td></tr></table><table class="wikitable sortable"><tr><th rowspan=2>Date</th><th colspan=2>Added</th><th colspan="2">Removed</th><th rowspan=2>Reason</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>'
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("page_id").agg(F.concat(F.lit(head), body, F.lit("</table>")).alias("html"))


@query("index_changes", f"""select page_id, cast(row as int) as row, date, added, 'Name of ' || added as added_name, removed, 'Name of ' || removed as removed_name, reason from ({CHANGE_LOG}) c""")
def index_changes(spark, sf_dir):
    return html.index_changes(change_pages(spark, sf_dir))


DAILY = "select o_custkey as symbol, cast(o_orderdate as date) as date, max(o_totalprice) / 1000 as close from {orders} group by o_custkey, cast(o_orderdate as date)"
MONTHS = "select distinct last_day(cast(o_orderdate as date)) as date, cast(1000 as double) as amount from {orders}"


@query("instalment_benchmark", f"""with b as ({DAILY}), m as ({MONTHS}), s as (select distinct symbol from b), buys as (select s.symbol, m.date, m.amount from m, s),
  p as (select x.symbol, x.date, x.amount, b.close from buys x asof join b on x.symbol = b.symbol and x.date >= b.date), sh as (select symbol, close, amount / count(*) over (partition by date) / close as n from p),
  h as (select symbol, sum(n) as shares, sum(n * close) as paid, date '2002-12-31' as date from sh group by 1), e as (select h.*, b.close from h asof join b on h.symbol = b.symbol and h.date >= b.date)
  select round(sum(paid), 4) as paid, round(sum(shares * close), 4) as value, round(sum(shares * close) / sum(paid) - 1, 7) as total_return from e""")
def instalments(spark, sf_dir):
    bars = bound(spark, sf_dir, DAILY)
    out = pf.instalment_benchmark(bound(spark, sf_dir, MONTHS), bars, F.lit("2002-12-31").cast("date"), bars)
    return out.select(F.round("paid", 4).alias("paid"), F.round("value", 4).alias("value"), F.round("total_return", 7).alias("total_return"))


TOP_SQL = f"""s as (select d, symbol, price, row_number() over (partition by d order by market_cap desc, symbol) as rank from ({SNAP}) s where pe_ratio > 0),
t as (select *, case when price < 50 then 2.5 when price < 200 then 5.0 else 10.0 end as step from s where rank <= 30), c as (select *, cast(floor(price * 0.95 / step) * step * 100 as double) as capital from t)"""


@query("top_candidates", f"with {TOP_SQL} select d, symbol, rank, capital, case when capital < 3000 then '<$3k' when capital < 7000 then '$3-7k' when capital < 15000 then '$7-15k' when capital < 30000 then '$15-30k' else '$30k+' end as capital_class from c")
def top_candidates(spark, sf_dir):
    told = op.top_candidates(bound(spark, sf_dir, SNAP).where("pe_ratio > 0"), "market_cap", 30)
    return told.select("d", "symbol", "rank", "capital", "capital_class")


@query("capital_histogram", f"with {TOP_SQL}, l as (select d, list(capital order by capital) as v, count(*) as n from c group by 1) select d, n, v[cast(floor(n / 2.0) as int) + 1] as median_capital, len(list_filter(v, lambda x: x < 3000)) as under_3k, len(list_filter(v, lambda x: x >= 30000)) as from_30k from l")
def capital_histogram(spark, sf_dir):
    told = op.top_candidates(bound(spark, sf_dir, SNAP).where("pe_ratio > 0"), "market_cap", 30)
    k = F.col("capital_class")
    return told.groupBy("d").agg(F.count("*").alias("n"), stats.upper_median("capital").alias("median_capital"), F.count_if(k == "<$3k").alias("under_3k"), F.count_if(k == "$30k+").alias("from_30k"))


@query("liquid_symbols", f"with {VIEW_SQL} select symbol from best where best_call is not null and best_put is not null")
def liquid_symbols(spark, sf_dir):
    return op.liquid_symbols(best(spark, sf_dir))


@query("finance_rules", """with p as (select p_partkey, p_retailprice as s, p_retailprice * (0.8 + p_size / 125.0e0) as k, 0.1 + p_size / 100.0e0 as iv, cast(p_size * 10 - 20 as double) as days, p_retailprice * 0.9 as a, p_retailprice * (0.3 + p_size / 20.0e0) as b from {part}),
  v as (select *, case when days > 0 then greatest(0.5, 100 * iv * sqrt(days / 365) * 0.4 * greatest(0.1, 1 - abs((k - s) / s * 100) / 60)) / 100 * s end as tv from p)
  select p_partkey, round(case when days <= 0 then greatest(0, s - k) else greatest(0, s * exp(-0.02 * days / 365) - k * exp(-0.04 * days / 365)) + tv end, 6) as call_value, round(case when days <= 0 then greatest(0, k - s) else greatest(0, k * exp(-0.04 * days / 365) - s * exp(-0.02 * days / 365)) + tv end, 6) as put_value,
    round(s * pow(1 + 0.05e0 / 365, greatest(0, days)), 6) as compounded, round(pow(1.05e0, days / 365) - 1, 8) as yield_, abs(a / s - 1) > 0.5 and abs(b / s - 1) > 0.5 as inconsistent, round(case when p_partkey % 3 > 0 then a else s - b end, 6) as gross_profit from v""")
def finance_rules(spark, sf_dir):
    p = bound(spark, sf_dir, "select p_partkey, p_retailprice as s, p_retailprice * (0.8 + p_size / 125.0e0) as k, 0.1e0 + p_size / 100.0e0 as iv, cast(p_size * 10 - 20 as double) as days, p_retailprice * 0.9 as a, p_retailprice * (0.3 + p_size / 20.0e0) as b from {part}")
    c = F.col
    value = lambda put: F.round(fn.option_value(c("s"), c("k"), c("iv"), c("days"), put), 6)
    stated = F.when(c("p_partkey") % 3 > 0, c("a"))
    return p.select(
        "p_partkey", value(False).alias("call_value"), value(True).alias("put_value"), F.round(fn.daily_compound(c("s"), F.lit(0.05), c("days")), 6).alias("compounded"), F.round(fn.cumulative_yield(F.lit(0.05), c("days") / 365), 8).alias("yield_"),
        fn.price_inconsistent(c("s"), c("a"), c("b")).alias("inconsistent"), F.round(fn.gross_profit(stated, c("s"), c("b")), 6).alias("gross_profit"),
    )


@query("ticker_match", """with n as (select c_custkey, case c_custkey % 3 when 0 then 'a' || c_custkey || '.b' when 1 then 'A' || c_custkey || '-b' else ' a' || c_custkey end as symbol from {customer}),
  t as (select c_custkey, upper(trim(symbol)) as s from n), r as (select case c_custkey % 3 when 0 then 'A' || c_custkey || '-B' when 1 then 'A' || c_custkey || 'B' else 'Z' || c_custkey end as ticker, c_custkey * 10 as cik from {customer})
  select t.c_custkey, coalesce((select min(cik) from r where ticker = s), (select min(cik) from r where ticker = replace(s, '.', '-')), (select min(cik) from r where ticker = replace(replace(s, '.', ''), '-', ''))) as cik from t""")
def ticker_match(spark, sf_dir):
    names = bound(spark, sf_dir, "select c_custkey, case c_custkey % 3 when 0 then concat('a', c_custkey, '.b') when 1 then concat('A', c_custkey, '-b') else concat(' a', c_custkey) end as symbol from {customer}").withColumn("symbol", F.upper(F.trim("symbol")))
    registry = bound(spark, sf_dir, "select case c_custkey % 3 when 0 then concat('A', c_custkey, '-B') when 1 then concat('A', c_custkey, 'B') else concat('Z', c_custkey) end as ticker, c_custkey * 10 as cik from {customer}")
    return mb.match_ticker(names, registry).select("c_custkey", "cik")
