"""Time-series operators over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions import dates, stats
from rankweave.operators import timeseries as ts
from rankweave.queries.base import ANNUAL, MONTHLY, PERIODS, SNAP, bound, query

R = 6


def asof_sql(forward):
    return f"""with p as (select event_id, user_id, ts as at from {{events}} where event_id % 2 = 0),
      b as (select user_id, ts as seen, max(value) as price from {{events}} where event_id % 2 = 1 group by 1, 2)
      select p.event_id, b.seen, b.price from p asof left join b on p.user_id = b.user_id and p.at {'<=' if forward else '>='} b.seen"""


def probes_and_bars(spark, sf_dir):
    p = bound(spark, sf_dir, "select event_id, user_id, ts as at from {events} where event_id % 2 = 0")
    b = bound(spark, sf_dir, "select user_id, ts as seen, value as price from {events} where event_id % 2 = 1")
    return p, b


@query("asof_backward", asof_sql(False))
def asof_backward(spark, sf_dir):
    p, b = probes_and_bars(spark, sf_dir)
    return ts.asof_join(p, b, ["user_id"], "at", "seen", ["price"]).select("event_id", "seen", "price")


@query("asof_forward", asof_sql(True))
def asof_forward(spark, sf_dir):
    p, b = probes_and_bars(spark, sf_dir)
    out = ts.asof_join(p, b.groupBy("user_id", "seen").agg(F.max("price").alias("price")), ["user_id"], "at", "seen", ["price"], forward=True)
    return out.select("event_id", "seen", "price")


@query("interval_high_low", f"""with s as ({SNAP}), b as ({MONTHLY})
  select s.d, s.symbol, max(b.high) as high, min(b.low) as low, count(b.close) as bars from s left join b on b.symbol = s.symbol and b.date between s.d - interval 365 day and s.d group by 1, 2""")
def interval_high_low(spark, sf_dir):
    s, b = bound(spark, sf_dir, SNAP), bound(spark, sf_dir, MONTHLY)
    aggs = [F.max("high").alias("high"), F.min("low").alias("low"), F.count("close").alias("bars")]
    return ts.interval_aggregate(s, b, ["symbol"], F.date_sub("d", 365), F.col("d"), "date", aggs, ["d", "symbol"])


@query("forward_window", f"""with s as ({SNAP}), b as ({MONTHLY})
  select s.d, s.symbol, max(b.high) as peak, min(b.low) as trough, arg_max(b.close, (b.date, b.o_orderkey)) as last_close from s left join b on b.symbol = s.symbol and b.date > s.d and b.date <= s.d + interval 365 day group by 1, 2""")
def forward_window(spark, sf_dir):
    s, b = bound(spark, sf_dir, SNAP), bound(spark, sf_dir, MONTHLY)
    aggs = [F.max("high").alias("peak"), F.min("low").alias("trough"), F.max_by("close", F.struct("date", "o_orderkey")).alias("last_close")]
    return ts.interval_aggregate(s, b, ["symbol"], F.col("d"), F.date_add("d", 365), "date", aggs, ["d", "symbol"], open_left=True)


QUARTERS = """select o_custkey as symbol, cast(date_trunc('quarter', o_orderdate) as date) as quarter, round(sum(o_totalprice), 2) as revenue,
  case when count(*) > 1 then min(o_totalprice) end as margin from {orders} group by o_custkey, cast(date_trunc('quarter', o_orderdate) as date)"""


@query("trailing_four_quarters", f"""with q as ({QUARTERS}) select symbol, quarter,
  round(case when count(revenue) over w = 4 then sum(revenue) over w end, 4) as ttm_revenue, round(case when count(margin) over w = 4 then sum(margin) over w end, 4) as ttm_margin
  from q window w as (partition by symbol order by quarter rows between 3 preceding and current row)""")
def trailing_four(spark, sf_dir):
    q = bound(spark, sf_dir, QUARTERS)
    q = ts.trailing_sum(ts.trailing_sum(q, ["symbol"], "quarter", "revenue", "ttm_revenue"), ["symbol"], "quarter", "margin", "ttm_margin")
    return q.select("symbol", "quarter", F.round("ttm_revenue", 4).alias("ttm_revenue"), F.round("ttm_margin", 4).alias("ttm_margin"))


@query("month_end_bars", f"""with b as ({MONTHLY}), m as (select symbol, cast(date_trunc('month', date) as date) as month, max((date, close)) as x from b group by 1, 2),
  r as (select symbol, month, x[1] as date, x[2] as close, row_number() over (partition by symbol order by month desc) as k from m) select symbol, month, date, close from r where k <= 14""".replace("max((date, close)) as x", "arg_max(close, (date, close)) as close, max(date) as date").replace("x[1] as date, x[2] as close", "date, close"))
def month_ends(spark, sf_dir):
    return ts.month_end_bars(bound(spark, sf_dir, MONTHLY), ["symbol"], "date", ["close"], 14).select("symbol", "month", "date", "close")


@query("momentum", f"""with b as ({MONTHLY}), m as (select symbol, cast(date_trunc('month', date) as date) as month, arg_max(close, (date, close)) as close from b group by 1, 2),
  r as (select *, row_number() over (partition by symbol order by month desc) - 1 as k, count(*) over (partition by symbol) as n from m)
  select symbol, round(case when max(n) >= 14 then max(close) filter (k = 1) / max(close) filter (k = 13) - 1 end, {R}) as momentum from r group by 1""")
def momentum(spark, sf_dir):
    m = ts.month_end_bars(bound(spark, sf_dir, MONTHLY), ["symbol"], "date", ["close"])
    return ts.momentum(m, ["symbol"], "month", "close").withColumn("momentum", F.round("momentum", R))


@query("period_growth", f"""with k as (select *, row_number() over (partition by symbol order by y desc) - 1 as age from ({PERIODS}) p),
  g as (select symbol, max(revenue) filter (age = 0) as a, arg_max(revenue, age) filter (age between 1 and 7) as b, max(age) filter (age between 1 and 7) as n, avg(roic) filter (age < 5) as avg_roic,
    count(*) filter (age < 5 and net_income > 0) as profitable from k group by 1)
  select symbol, round(case when a > 0 and b > 0 then pow(a / b, 1.0 / n) - 1 end, {R}) as growth, round(avg_roic, {R}) as avg_roic, profitable from g""")
def period_growth(spark, sf_dir):
    aged = ts.newest_first(bound(spark, sf_dir, PERIODS), ["symbol"], "y")
    age = F.col("age")
    out = aged.groupBy("symbol").agg(ts.cagr(F.col("revenue"), age, 7).alias("growth"), ts.average_of_newest(F.col("roic"), age, 5).alias("avg_roic"), ts.count_above(F.col("net_income"), age, 5).alias("profitable"))
    return out.select("symbol", F.round("growth", R).alias("growth"), F.round("avg_roic", R).alias("avg_roic"), "profitable")


SLOPE = "regr_slope(revenue, cast(datediff('day', date '1970-01-01', period_end) as double) / 365.25)"


@query("value_trend", f"""with a as ({ANNUAL}), g as (select symbol, count(*) as n, arg_min(revenue, period_end) as f, {SLOPE} as s from a group by 1),
  t as (select symbol, n, case when n >= 4 and f > 0 then s / f * 100 end as p from g)
  select symbol, n, round(p, 4) as slope_pct, case when p is null then 'insufficient_data' when p > 5 then 'improving' when p < -5 then 'declining' else 'stable' end as trend from t""")
def value_trend(spark, sf_dir):
    out = ts.slope_per_year(bound(spark, sf_dir, ANNUAL), ["symbol"], "period_end", "revenue", 4)
    return out.select("symbol", "n", F.round("slope_pct", 4).alias("slope_pct"), ts.trend_class(F.col("slope_pct")).alias("trend"))


@query("trailing_trend", f"""with a as ({ANNUAL}), j as (select a.symbol, a.period_end as d, b.period_end, b.revenue from a join a b on a.symbol = b.symbol and b.period_end > a.period_end - interval 48 month and b.period_end <= a.period_end),
  g as (select symbol, d, count(*) as n, arg_min(revenue, period_end) as f, {SLOPE} as s from j group by 1, 2) select symbol, d, n, round(case when n >= 3 and f > 0 then s / f * 100 end, 4) as slope_pct from g""")
def trailing_trend(spark, sf_dir):
    out = ts.trailing_slope(bound(spark, sf_dir, ANNUAL), ["symbol"], "period_end", "revenue", 48, 3)
    return out.withColumn("slope_pct", F.round("slope_pct", 4))


@query("realised_volatility", f"""with b as ({MONTHLY}), r as (select *, row_number() over w as k, ln(close / lag(close) over w) as r from b window w as (partition by symbol order by o_orderkey)),
  v as (select o_orderkey, count(*) over (partition by symbol order by o_orderkey rows between 29 preceding and current row) as n, stddev_samp(r) over (partition by symbol order by o_orderkey rows between 28 preceding and current row) as s from r)
  select o_orderkey, round(case when n < 5 then 0.08 else coalesce(greatest(0.08, least(0.80, s * sqrt(252))), 0.08) end, {R}) as vol from v""")
def volatility(spark, sf_dir):
    return ts.realised_volatility(bound(spark, sf_dir, MONTHLY), ["symbol"], "o_orderkey", "close").select("o_orderkey", F.round("vol", R).alias("vol"))


@query("upsert_by_date", """with o as (select o_custkey as symbol, cast(o_orderdate as date) as date, max(o_totalprice) as close from {orders} group by 1, 2),
  f as (select o_custkey as symbol, cast(o_orderdate as date) as date, min(o_totalprice) / 2 as close from {orders} where o_orderpriority = '1-URGENT' group by 1, 2)
  select * from f union all select * from o where not exists (select 1 from f where f.symbol = o.symbol and f.date = o.date)""")
def upsert(spark, sf_dir):
    old = bound(spark, sf_dir, "select o_custkey as symbol, cast(o_orderdate as date) as date, max(o_totalprice) as close from {orders} group by o_custkey, cast(o_orderdate as date)")
    new = bound(spark, sf_dir, "select o_custkey as symbol, cast(o_orderdate as date) as date, min(o_totalprice) / 2 as close from {orders} where o_orderpriority = '1-URGENT' group by o_custkey, cast(o_orderdate as date)")
    return ts.upsert(old, new, ["symbol", "date"])


@query("calendar", """with r as (select o_custkey as symbol, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from {orders} group by 1),
  m as (select symbol, a, b, cast(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), interval 1 month)) as date) as f from r)
  select symbol, count(*) filter (last_day(f) >= a and last_day(f) <= b) as month_ends, count(*) filter (month(f) % 3 = 0 and last_day(f) > a and last_day(f) <= b) as quarter_ends, count(*) filter (f >= a and f <= b) as month_starts from m group by 1""")
def calendar(spark, sf_dir):
    r = bound(spark, sf_dir, "select o_custkey as symbol, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from {orders} group by o_custkey")
    a, b = F.col("a"), F.col("b")
    n = lambda x: F.size(x).cast("long")
    return r.select("symbol", n(dates.month_ends(a, b)).alias("month_ends"), n(dates.quarter_ends(a, b)).alias("quarter_ends"), n(dates.month_starts(a, b)).alias("month_starts"))


@query("date_rules", """with o as (select o_orderkey, cast(o_orderdate as date) as d from {orders})
  select o_orderkey, case when month(d) = 2 and day(d) = 29 then make_date(year(d) + 1, 3, 1) else cast(d + interval 1 year as date) end as next_year, day(d) between 15 and 21 as third_week, dayofweek(d) = 5 as friday,
  concat(year(d), 'Q', quarter(d)) as label from o""")
def date_rules(spark, sf_dir):
    o = bound(spark, sf_dir, "select o_orderkey, cast(o_orderdate as date) as d from {orders}")
    d = F.col("d")
    return o.select("o_orderkey", dates.add_years(d, 1).alias("next_year"), dates.in_third_week(d).alias("third_week"), dates.is_friday(d).alias("friday"), dates.quarter_label(d).alias("label"))




@query("seeded_draws", """with k as (select o_orderkey, (42 + (o_orderkey + 1) * 1831565813::hugeint) % 4294967296 as t from {orders}),
  a as (select o_orderkey, (xor(t::bigint, t::bigint >> 15)::hugeint * (t::bigint | 1)::hugeint) % 4294967296 as x, t from k),
  b as (select o_orderkey, x::bigint as x, (x + (xor(x::bigint, x::bigint >> 7)::hugeint * (x::bigint | 61)::hugeint) % 4294967296) % 4294967296 as y from a),
  c as (select o_orderkey, xor(x, y::bigint) as z from b) select o_orderkey, xor(z, z >> 14) / 4294967296.0::double as u from c""")
def seeded_draws(spark, sf_dir):
    return bound(spark, sf_dir, "select o_orderkey from {orders}").select("o_orderkey", stats.draw(F.lit(42), F.col("o_orderkey")).alias("u"))


@query("bootstrap_means")
def bootstrap(spark, sf_dir):
    """Intervals of mean revenue by customer and year's count; no oracle: the draws are checked by seeded_draws, the intervals by tests."""
    a = bound(spark, sf_dir, ANNUAL)
    out = stats.bootstrap_means(a, "revenue", ["symbol"], ["y"])
    return out.select("symbol", "n", F.round("mean", 4).alias("mean"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("one_horizon", f"""with s as ({SNAP}), r as (select d, symbol, h as horizon, row_number() over (partition by d, symbol order by h) as k from s, (values (3), (1)) v(h) where not (symbol % 7 = 0 and h = 1)) select d, symbol, horizon from r where k = 1""")
def one_horizon(spark, sf_dir):
    """One row per name and date of rows over several horizons: the shortest."""
    rows = bound(spark, sf_dir, SNAP).select("d", "symbol", F.explode(F.array(F.lit(3), F.lit(1))).alias("horizon")).where("not (symbol % 7 = 0 and horizon = 1)")
    return ts.first_of(rows, ["d", "symbol"], "horizon")
