"""Periods from facts and point-in-time snapshots over orders and lineitems."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import fundamentals as fd
from rankweave.queries.base import MONTHLY, PERIODS, SNAP, bound, query

#: Orders as facts: Q1 a quarter's value, Q2 and Q3 year to date, FY the year; two tags, the second a fallback.
FACTS = """select symbol, case when symbol % 2 = 0 then 'Revenues' else 'SalesRevenueNet' end as concept, make_date(fy, 1, 1) as start, make_date(fy, m, case when m in (6, 9) then 30 else 31 end) as end, round(v, 2) as val, fy, fp, make_date(fy, m, 28) as filed from (
  select o_custkey as symbol, cast(year(o_orderdate) as int) as fy, 3 as m, 'Q1' as fp, sum(case when month(o_orderdate) <= 3 then o_totalprice else 0 end) as v from {orders} group by o_custkey, year(o_orderdate)
  union all select o_custkey, cast(year(o_orderdate) as int), 6, 'Q2', sum(case when month(o_orderdate) <= 6 then o_totalprice else 0 end) from {orders} group by o_custkey, year(o_orderdate)
  union all select o_custkey, cast(year(o_orderdate) as int), 9, 'Q3', sum(case when month(o_orderdate) <= 9 then o_totalprice else 0 end) from {orders} group by o_custkey, year(o_orderdate)
  union all select o_custkey, cast(year(o_orderdate) as int), 12, 'FY', sum(o_totalprice) from {orders} group by o_custkey, year(o_orderdate)) t"""

PLAIN_FACTS = FACTS.replace(" as end,", ' as "end",')


def facts(spark, sf_dir):
    return bound(spark, sf_dir, FACTS.replace(" as end,", " as `end`,"))


def concepts(spark):
    return spark.createDataFrame([("revenue", "Revenues", 0), ("revenue", "SalesRevenueNet", 1)], "field string, concept string, priority int")


@query("xbrl_periods", f"""with f as ({PLAIN_FACTS}), w as (select symbol, fy, max(val) filter (fp = 'Q1') as q1, max(val) filter (fp = 'Q2') as q2, max(val) filter (fp = 'Q3') as q3, max(val) filter (fp = 'FY') as y from f group by 1, 2),
  u as (select symbol, 'A' as freq, make_date(fy, 12, 31) as period_end, y as revenue from w union all select symbol, 'Q', make_date(fy, 3, 31), q1 from w union all select symbol, 'Q', make_date(fy, 6, 30), q2 - q1 from w
    union all select symbol, 'Q', make_date(fy, 9, 30), q3 - q2 from w union all select symbol, 'Q', make_date(fy, 12, 31), y - q3 from w),
  r as (select *, row_number() over (partition by symbol, freq order by period_end desc) as k from u) select symbol, freq, period_end, round(revenue, 2) + 0.0 as revenue from r where k <= case freq when 'A' then 7 else 12 end""")
def xbrl_periods(spark, sf_dir):
    out = fd.xbrl_periods(facts(spark, sf_dir), concepts(spark))
    return out.select("symbol", "freq", "period_end", (F.round("revenue", 2) + 0.0).alias("revenue"))


QUARTERLY = """select o_custkey as symbol, case when o_orderpriority = '1-URGENT' then 'A' else 'Q' end as freq, cast(o_orderdate as date) as period_end, round(sum(o_totalprice), 2) as revenue, max(o_totalprice) * 0.1 as net_income, max(o_totalprice) * 0.2 as ebitda,
  max(o_totalprice) * 0.08 as fcf, case when count(*) > 1 then null else min(o_totalprice) end as debt, min(o_totalprice) * 0.3 as cash, cast(500000 as double) as equity, cast(1000 as double) as shares from {orders} group by o_custkey, case when o_orderpriority = '1-URGENT' then 'A' else 'Q' end, cast(o_orderdate as date)"""


@query("snapshot_as_of", f"""with s as (select distinct d, symbol from ({SNAP}) s), p as ({QUARTERLY}), b as (select symbol, date, max(close) as close, max(high) as high, min(low) as low from ({MONTHLY}) m group by 1, 2),
  k as (select s.d, p.*, row_number() over (partition by s.d, p.symbol, freq order by period_end desc) - 1 as age from s join p using (symbol) where period_end <= s.d - case freq when 'A' then 90 else 45 end * interval 1 day),
  g as (select d, symbol, case when count(net_income) filter (freq = 'Q' and age < 4) = 4 then sum(net_income) filter (freq = 'Q' and age < 4) end as ni, coalesce(arg_max(debt, period_end) filter (freq = 'Q' and debt is not null), arg_max(debt, period_end) filter (freq = 'A' and debt is not null)) as debt,
    coalesce(arg_max(shares, period_end) filter (freq = 'Q'), arg_max(shares, period_end) filter (freq = 'A')) as shares from k group by 1, 2),
  pr as (select s.d, s.symbol, b.close as price from s asof join b on s.symbol = b.symbol and s.d >= b.date), hl as (select s.d, s.symbol, max(high) as year_high from s join b on b.symbol = s.symbol and b.date between s.d - interval 365 day and s.d group by 1, 2)
  select pr.d, pr.symbol, price, year_high, debt, round(price * shares / nullif(ni, 0), 6) as pe_ratio from pr left join hl using (d, symbol) left join g using (d, symbol)""")
def snapshot_as_of(spark, sf_dir):
    bars = bound(spark, sf_dir, MONTHLY).groupBy("symbol", "date").agg(F.max("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"))
    out = fd.snapshot_as_of(bound(spark, sf_dir, SNAP).select("d", "symbol"), bound(spark, sf_dir, QUARTERLY), bars)
    return out.select("d", "symbol", "price", "year_high", "debt", F.round("pe_ratio", 6).alias("pe_ratio"))


FLOWS, STOCKS = ("eps", "net_income", "ebitda", "fcf", "dividends"), ("shares", "equity", "debt", "cash", "current_assets", "current_liabilities")
#: Years of PERIODS, and quarters in which a customer ordered.
BOTH = f"""select symbol, 'A' as freq, period_end, {', '.join((*FLOWS, *STOCKS))} from ({PERIODS}) p union all
select o_custkey, 'Q', cast(last_day(cast(o_orderdate as date)) as date), max(o_totalprice) / 4000, max(o_totalprice) * 0.1 - 5000, case when count(*) > 1 then max(o_totalprice) * 0.2 end, max(o_totalprice) * 0.08 - 9000, min(o_totalprice) * 0.01, cast(1100 as double), max(o_totalprice) * 0.5, min(o_totalprice), min(o_totalprice) * 0.3,
  max(o_totalprice), case when count(*) > 1 then min(o_totalprice) end from {{orders}} group by o_custkey, cast(last_day(cast(o_orderdate as date)) as date)"""


@query("snapshot_as_of_annual", f"""with s as (select distinct d, symbol from ({SNAP}) s), p as ({BOTH}), b as (select symbol, date, max(close) as close from ({MONTHLY}) m group by 1, 2),
  k as (select s.d, p.*, row_number() over (partition by s.d, p.symbol, freq order by period_end desc) - 1 as age from s join p using (symbol) where period_end <= s.d - case freq when 'A' then 70 else 45 end * interval 1 day),
  g as (select d, symbol, count(*) filter (freq = 'A' and age = 0) as years, {', '.join(f"case when count(*) filter (freq = 'Q' and age < 4) = 4 then case when count({x}) filter (freq = 'Q' and age < 4) = 4 then sum({x}) filter (freq = 'Q' and age < 4) end else max({x}) filter (freq = 'A' and age = 0) end as {x}" for x in FLOWS)},
    {', '.join(f"case when count(*) filter (freq = 'Q' and age < 4) = 4 then max({x}) filter (freq = 'Q' and age = 0) else max({x}) filter (freq = 'A' and age = 0) end as {x}" for x in STOCKS)} from k group by 1, 2),
  r as (select pr.d, pr.symbol, pr.price, g.* exclude (d, symbol, years), coalesce(debt, 0) - coalesce(cash, 0) as net from (select s.d, s.symbol, b.close as price from s asof join b on s.symbol = b.symbol and s.d >= b.date) pr join g using (d, symbol) where years > 0)
  select d, symbol, round(price, 4) as price, round(case when eps > 0 then price / eps end, 6) as pe_ratio, round(case when ebitda > 0 then (coalesce(shares * price, 0) + net) / ebitda end, 6) as ev_to_ebitda, round(case when equity > 0 and shares > 0 then price / (equity / shares) end, 6) as price_to_book,
    round(case when coalesce(equity, 0) + net > 0 then net_income / (coalesce(equity, 0) + net) end, 7) as roic, round(case when shares * price > 0 then dividends / (shares * price) end, 10) as dividend_yield, round(case when current_liabilities > 0 then current_assets / current_liabilities end, 6) as current_ratio from r""")
def snapshot_as_of_annual(spark, sf_dir):
    bars = bound(spark, sf_dir, MONTHLY).groupBy("symbol", "date").agg(F.max("close").alias("close"))
    out = fd.snapshot_as_of_annual(bound(spark, sf_dir, SNAP).select("d", "symbol"), bound(spark, sf_dir, BOTH), bars)
    return out.select("d", "symbol", F.round("price", 4).alias("price"), *[F.round(x, 6).alias(x) for x in ("pe_ratio", "ev_to_ebitda", "price_to_book", "current_ratio")], F.round("roic", 7).alias("roic"), F.round("dividend_yield", 10).alias("dividend_yield"))
