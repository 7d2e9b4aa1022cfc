"""The driver's tables bound to the operators' columns, as SQL text that Spark and the oracle both read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Customers as companies: a year of orders is a fiscal period.
ANNUAL = """
select o_custkey as symbol, cast(year(o_orderdate) as int) as y, make_date(cast(year(o_orderdate) as int), 12, 31) as period_end,
  round(sum(o_totalprice), 2) as revenue, cast(count(*) as int) as n_orders, max(o_totalprice) as hi, min(o_totalprice) as lo
from {orders} group by o_custkey, year(o_orderdate)"""

PERIODS = f"""
select symbol, y, period_end, revenue, hi * 0.6 - lo * 0.5 - 40000 as net_income, hi * 0.7 - lo * 0.4 - 40000 as ebit,
  hi * 0.8 - lo * 0.4 - 30000 as ebitda, case when n_orders > 1 then lo * 0.1 end as interest, hi * 0.5 - lo * 0.3 - 20000 as cfo,
  hi * 0.5 - lo * 0.5 - 20000 as fcf, lo * 0.05 as buybacks, lo * 0.02 as dividends, cast(1000 + n_orders * 10 as double) as shares,
  (hi * 0.6 - lo * 0.5 - 40000) / cast(1000 + n_orders * 10 as double) as eps,
  case when n_orders > 1 then (hi * 0.7 - lo * 0.4 - 40000) / revenue end as roic,
  revenue / 1000 as price_end, hi / 500 as price_high, lo / 500 as price_low, lo * 0.8 as debt, hi * 0.1 as cash, hi * 0.4 as equity,
  hi as current_assets, lo as current_liabilities
from ({ANNUAL}) a"""

SNAP = f"""
select period_end as d, symbol, n_name as industry, r_name as sector, abs(c_acctbal) * 30000000 as market_cap, price_end as price,
  price_high as year_high, price_low as year_low, price_end / nullif(eps, 0) as pe_ratio,
  (price_end * shares + debt - cash) / nullif(ebitda, 0) as ev_to_ebitda, price_end * shares / nullif(fcf, 0) as price_to_fcf,
  price_end * shares / nullif(c_acctbal * 100, 0) as price_to_book, case when interest is not null then dividends / (price_end * shares) end as dividend_yield,
  current_assets / nullif(current_liabilities, 0) as current_ratio, case when ebitda > 0 then (debt - cash) / ebitda end as net_debt_to_ebitda, roic,
  price_end * shares + debt - cash as enterprise_value, case when c_nationkey % 3 = 0 then eps * 0.9 when c_nationkey % 3 = 2 then eps * 0.5 end as forward_eps,
  c_acctbal < 0 as negative_equity
from ({PERIODS}) p join {{customer}} on symbol = c_custkey join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey"""

MONTHLY = """
select o_custkey as symbol, cast(o_orderdate as date) as date, o_orderkey, o_totalprice as close, o_totalprice * 1.05 as high, o_totalprice * 0.9 as low from {orders}"""

_TABLES = ("orders", "customer", "nation", "region", "lineitem", "part", "supplier", "events", "pages", "labels")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables it names in braces."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def plain(sql: str) -> str:
    """The same text with the tables' own names, for the oracle."""
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its oracle."""

    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = plain(sql)
        return f

    return wrap
