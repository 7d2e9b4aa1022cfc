"""Periods from tagged facts, and companies as they were known at past dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.stats import ratio
from rankweave.operators.timeseries import asof_join, interval_aggregate, newest_first, newest_n

KEY = ["symbol", "field"]


def choose_concept(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """facts (symbol, concept, ...) with field: of a field's concepts (field, concept, priority) the first for which the symbol has any fact."""
    named = facts.join(F.broadcast(concepts), "concept")  # a fixed list of tags
    best = F.min("priority").over(Window.partitionBy("symbol", "field"))
    return named.withColumn("_b", best).where("priority = _b").drop("_b", "priority")


def latest_filed(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of facts for one key, the one filed last; of those filed together, the first by value."""
    w = Window.partitionBy(*by).orderBy(F.desc("filed"), "val")
    return facts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def annual_values(facts: DataFrame, low: int = 340, high: int = 380) -> DataFrame:
    """Yearly values: (symbol, field, period_end, val) from facts that span a year, or have no start."""
    span = F.datediff("end", "start")
    rows = facts.where(F.col("start").isNull() | span.between(low, high)).where(F.col("fp") == "FY")
    return latest_filed(rows, [*KEY, "end"]).select(*KEY, F.col("fy"), F.col("end").alias("period_end"), "val", "filed")


def standalone_quarters(facts: DataFrame, low: int = 60, high: int = 100) -> DataFrame:
    """Quarter values from facts that may be year-to-date: (symbol, field, fy, fp, period_end, val).

    At each end of a fiscal year a fact spanning one quarter is taken as it is, the one filed last; else
    of the year-to-date facts the longest, then filed last, less what has been summed so far. A quarter
    adds to the sum, a year-to-date value replaces it. At most four ends a year are folded inside one row.
    """
    q = facts.where(F.col("fp").startswith("Q") & F.col("start").isNotNull() & F.col("fy").isNotNull())
    span = F.datediff("end", "start")
    one = span.between(low, high)
    w = Window.partitionBy(*KEY, "fy", "end").orderBy(F.desc("_one"), F.when(F.col("_one"), 0).otherwise(-span), F.desc("filed"), "val")
    q = q.withColumn("_one", one).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    g = q.groupBy(*KEY, "fy").agg(F.array_sort(F.collect_list(F.struct("end", "_one", "val", "fp"))).alias("_q"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.expr("cast(array() as array<struct<end:date,val:double,fp:string>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = F.when(x["_one"], x["val"]).otherwise(x["val"] - a["sum"])
        total = F.when(x["_one"], a["sum"] + x["val"]).otherwise(x["val"])
        return F.struct(total.alias("sum"), F.array_append(a["out"], F.struct(x["end"].alias("end"), own.alias("val"), x["fp"].alias("fp"))).alias("out"))

    folded = g.select(*KEY, "fy", F.explode(F.aggregate("_q", zero, step)["out"]).alias("_x"))
    return folded.select(*KEY, "fy", F.col("_x.fp").alias("fp"), F.col("_x.end").alias("period_end"), F.col("_x.val").alias("val"))


def fourth_quarters(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    """The year less its first three quarters, where exactly these three exist."""
    three = quarters.groupBy(*KEY, "fy").agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("fp")).alias("_fps"), F.sum("val").alias("_s"))
    three = three.where((F.col("_n") == 3) & (F.col("_fps") == F.array(F.lit("Q1"), F.lit("Q2"), F.lit("Q3"))))
    return annual.join(three, [*KEY, "fy"]).select(*KEY, "fy", F.lit("Q4").alias("fp"), "period_end", (F.col("val") - F.col("_s")).alias("val"))


def xbrl_periods(facts: DataFrame, concepts: DataFrame, annual_kept: int = 7, quarters_kept: int = 12) -> DataFrame:
    """(symbol, freq, period_end, one column per field) from facts (symbol, concept, start, end, val, fy, fp, filed): the newest periods of either frequency."""
    named = choose_concept(facts, concepts)
    year = annual_values(named)
    quarter = standalone_quarters(named)
    quarter = quarter.unionByName(fourth_quarters(quarter, year))
    long = year.select(*KEY, "period_end", "val", F.lit("A").alias("freq")).unionByName(quarter.select(*KEY, "period_end", "val", F.lit("Q").alias("freq")))
    fields = sorted(r[0] for r in concepts.select("field").distinct().collect())  # a fixed list of tags
    wide = long.groupBy("symbol", "freq", "period_end").agg(*[F.max(F.when(F.col("field") == f, F.col("val"))).alias(f) for f in fields])
    return newest_n(wide.where("freq = 'A'"), ["symbol"], "period_end", annual_kept).unionByName(newest_n(wide.where("freq = 'Q'"), ["symbol"], "period_end", quarters_kept))


def known_at(dates: DataFrame, periods: DataFrame, annual_lag: int = 90, quarter_lag: int = 45) -> DataFrame:
    """periods (symbol, freq, period_end, ...) known at each (d, symbol): those that ended the lag of their frequency before d, with age from 0."""
    lag = F.when(F.col("freq") == "A", annual_lag).otherwise(quarter_lag)
    rows = dates.join(periods, "symbol").where(F.col("period_end") <= F.date_sub("d", lag))
    return newest_first(rows, ["d", "symbol", "freq"], "period_end")


def snapshot_as_of(dates: DataFrame, periods: DataFrame, bars: DataFrame, fields: Mapping[str, str] | None = None, annual_lag: int = 90, quarter_lag: int = 45) -> DataFrame:
    """Companies at each (d, symbol): price and 52-week range at d, trailing sums of four quarters, latest balance, and ratios.

    Flows: revenue, net_income, ebitda, fcf; balance: debt, cash, equity, shares. Trailing sums are null
    unless four quarters are known and set; a balance figure is the newest set one of a quarter, else of
    a year. Symbols without a price at d are left out.
    """
    flows, balance = ("revenue", "net_income", "ebitda", "fcf"), ("debt", "cash", "equity", "shares")
    known = known_at(dates.select("d", "symbol").distinct(), periods, annual_lag, quarter_lag)
    last4 = (F.col("freq") == "Q") & (F.col("age") < 4)
    ttm = [F.when(F.count(F.when(last4, F.col(x))) == 4, F.sum(F.when(last4, F.col(x)))).alias(f"ttm_{x}") for x in flows]
    newest = lambda x, f: F.max_by(F.col(x), F.when((F.col("freq") == f) & F.col(x).isNotNull(), F.col("period_end")))
    stock = [F.coalesce(newest(x, "Q"), newest(x, "A")).alias(x) for x in balance]
    figures = known.groupBy("d", "symbol").agg(*ttm, *stock)
    priced = asof_join(dates.select("d", "symbol").distinct(), bars, ["symbol"], "d", "date", ["close"]).where("close is not null")
    span = interval_aggregate(dates.select("d", "symbol").distinct(), bars, ["symbol"], F.date_sub("d", 365), F.col("d"), "date", [F.max("high").alias("year_high"), F.min("low").alias("year_low")], ["d", "symbol"])
    df = priced.select("d", "symbol", F.col("close").alias("price")).join(span, ["d", "symbol"], "left").join(figures, ["d", "symbol"], "left")
    c = F.col
    cap = c("price") * c("shares")
    ev = cap + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    zero = lambda a, b: F.when(b != 0, a / b)
    return df.withColumns({"market_cap": cap, "enterprise_value": ev, "pe_ratio": zero(cap, c("ttm_net_income")), "ev_to_ebitda": zero(ev, c("ttm_ebitda")), "price_to_fcf": zero(cap, c("ttm_fcf")), "price_to_book": zero(cap, c("equity")), "net_debt_to_ebitda": ratio(c("debt") - F.coalesce("cash", F.lit(0.0)), c("ttm_ebitda"))})


def snapshot_as_of_annual(dates: DataFrame, periods: DataFrame, bars: DataFrame, annual_lag: int = 70, quarter_lag: int = 45) -> DataFrame:
    """Companies at each (d, symbol) by a second rule: figures as a whole from the last four quarters if four are known, else from the newest year.

    Flows: eps, net_income, ebitda, fcf, dividends; balance: shares, equity, debt, cash, current_assets,
    current_liabilities. ROIC is net income over invested capital; multiples need positive figures.
    Names without a known year or a price are left out.
    """
    c = F.col
    at = dates.select("d", "symbol").distinct()
    known = known_at(at, periods, annual_lag, quarter_lag)
    quarter, year = (c("freq") == "Q") & (c("age") < 4), (c("freq") == "A") & (c("age") == 0)
    four = F.count(F.when(quarter, 1)) == 4
    newest = (c("freq") == "Q") & (c("age") == 0)
    of = lambda cond, x: F.max(F.when(cond, c(x)))
    flow = lambda x: F.when(four, F.when(F.count(F.when(quarter, c(x))) == 4, F.sum(F.when(quarter, c(x))))).otherwise(of(year, x)).alias(x)
    stock = lambda x: F.when(four, of(newest, x)).otherwise(of(year, x)).alias(x)
    figures = known.groupBy("d", "symbol").agg(F.count(F.when(year, 1)).alias("_years"), *[flow(x) for x in ("eps", "net_income", "ebitda", "fcf", "dividends")], *[stock(x) for x in ("shares", "equity", "debt", "cash", "current_assets", "current_liabilities")])
    priced = asof_join(at, bars, ["symbol"], "d", "date", ["close"]).where("close is not null").select("d", "symbol", c("close").alias("price"))
    df = priced.join(figures.where("_years > 0").drop("_years"), ["d", "symbol"])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    cap, net = F.coalesce(c("shares") * c("price"), F.lit(0.0)), zero("debt") - zero("cash")
    invested = zero("equity") + net
    per_share = lambda x: F.when((c(x) > 0) & (c("shares") > 0), c("price") / (c(x) / c("shares")))
    return df.withColumns({
        "market_cap": cap, "enterprise_value": cap + net, "invested_capital": invested, "pe_ratio": F.when(c("eps") > 0, c("price") / c("eps")), "ev_to_ebitda": F.when(c("ebitda") > 0, (cap + net) / c("ebitda")),
        "price_to_fcf": per_share("fcf"), "price_to_book": per_share("equity"), "roic": F.when(invested > 0, c("net_income") / invested), "dividend_yield": F.when(cap > 0, c("dividends") / cap),
        "current_ratio": F.when(c("current_liabilities") > 0, c("current_assets") / c("current_liabilities")), "net_debt_to_ebitda": F.when(c("ebitda") > 0, net / c("ebitda")),
    })


def join_statements(income: DataFrame, balance: DataFrame, cash_flow: DataFrame, ratios: DataFrame, metrics: DataFrame) -> DataFrame:
    """Provider statements by (symbol, fiscal_year) on the income statement.

    Of rows for one year the greatest counts. Dividends are the common ones, else the net ones; outflows are
    amounts above 0; ratios fall back on metrics, net debt the other way round.
    """
    key = ["symbol", "fiscal_year"]
    out = income
    for part in (balance, cash_flow, ratios.withColumnsRenamed({"net_debt_to_ebitda": "_r_nd", "current_ratio": "_r_cr"}), metrics.withColumnsRenamed({"net_debt_to_ebitda": "_m_nd", "current_ratio": "_m_cr"})):
        rest = [c for c in part.columns if c not in key]
        out = out.join(part.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_one")).select(*key, "_one.*"), key, "left")
    return out.withColumns({
        "dividends_paid": F.abs(F.coalesce("common_dividends", "net_dividends")), "buybacks": F.abs("buybacks"), "net_debt_to_ebitda": F.coalesce("_m_nd", "_r_nd"), "current_ratio": F.coalesce("_r_cr", "_m_cr"),
    }).drop("common_dividends", "net_dividends", "_r_nd", "_r_cr", "_m_nd", "_m_cr")
