"""Portfolio positions, summaries, instalment benchmarks and tables parsed from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.finance import intrinsic, premium_yield_pct


#: Days to expiry within which an option that is not expired is near its end.
NEAR_EXPIRATION = 21


def with_market(positions: DataFrame, market: DataFrame) -> DataFrame:
    """positions with what is known of their symbol: price, bucket, composite, fv_median, fv_p75, in_snapshot, and the universe's composite_median.

    market: one row a symbol. The median is the upper one of composites above 0.
    """
    known = market.select("symbol", "price", "bucket", "composite", "fv_median", "fv_p75", F.lit(True).alias("_in"))
    median = market.where("composite > 0").agg(F.expr("percentile_disc(0.5) within group (order by composite desc)").alias("composite_median"))
    out = positions.join(known, "symbol", "left").withColumn("in_snapshot", F.coalesce("_in", F.lit(False))).drop("_in")
    return out.join(F.broadcast(median))  # one row


def paired(positions: DataFrame) -> DataFrame:
    """positions with paired_shares and paired_basis of the stock position of the same account that an option names."""
    stock = positions.where("kind = 'stock'").select("account_id", F.col("id").alias("paired_stock_id"), F.col("shares").alias("paired_shares"), F.col("cost_basis").alias("paired_basis"))
    return positions.join(stock, ["account_id", "paired_stock_id"], "left")


def evaluate_positions(positions: DataFrame, market: DataFrame, today: Column) -> DataFrame:
    """positions with what they are worth and what to do about them at today.

    kind stock: shares, cost_basis (of all shares); option: option_type, contracts (of 100, below 0 for
    short ones), strike, expiration, premium (of the whole position), paired_stock_id; cash: amount,
    yield_pct (simple interest from entry_date). Symbols without market data have no price: a stock
    then counts at its cost, an option not at all. market: see with_market.
    """
    c = F.col
    df = paired(with_market(positions, market))
    stock, option, cash = c("kind") == "stock", c("kind") == "option", c("kind") == "cash"
    only = lambda kind, x: F.when(kind, x)
    worth = only(stock, c("shares") * c("price"))
    df = df.withColumns({"market_value": worth, "profit": worth - c("cost_basis")})
    df = df.withColumn("profit_pct", F.when(c("cost_basis") > 0, c("profit") / c("cost_basis") * 100))
    avoid = F.coalesce(c("bucket") == "avoid", F.lit(False))
    signals = F.array_compact(F.array(
        F.when(avoid, "in-avoid-bucket"),
        F.when(c("price") >= c("fv_p75"), "price-at-or-above-fv-p75").when(c("price") >= c("fv_median"), "price-at-or-above-fv-median"),
        F.when((c("composite") > 0) & (c("composite_median") > 0) & (c("composite") < c("composite_median")) & ~avoid, "composite-below-universe-median"),
    ))
    size = 100 * F.abs("contracts")
    inner = only(option, intrinsic(c("price"), c("strike"), c("option_type")))
    collateral = F.when(c("option_type") == "call", c("paired_basis")).otherwise(c("strike") * size)
    left = only(option, F.datediff("expiration", today))
    held = only(cash, F.greatest(F.lit(0), F.datediff(today, c("entry_date"))))
    df = df.withColumns({
        "sell_signals": only(stock, signals),
        "days_to_expiration": left, "is_expired": left < 0, "near_expiration": (left >= 0) & (left <= NEAR_EXPIRATION),
        "cash_at_entry": only(option, F.when(c("contracts") > 0, -c("premium")).otherwise(c("premium"))),
        "intrinsic_dollars": inner * size, "in_the_money": inner > 0,
        "premium_yield_pct": only(option & (c("contracts") < 0), premium_yield_pct(c("premium"), collateral, c("entry_date"), c("expiration"))),
        "days_held": held, "accrued_interest": c("amount") * c("yield_pct") / 100 * held / 365,
    })
    value = F.when(stock, F.coalesce("market_value", "cost_basis")).when(cash, c("amount") + c("accrued_interest")).otherwise(F.when(c("contracts") > 0, 1).otherwise(-1) * c("intrinsic_dollars"))
    return df.withColumn("value", value)


def milestones(options: DataFrame) -> DataFrame:
    """Rows (scenario, at, option_profit, combined_profit) per option of evaluate_positions: at the current price, at the strike for short ones, and expired worthless.

    combined_profit adds the paired shares sold at the same price; at the strike only for a short call.
    """
    c = F.col
    call, short = c("option_type") == "call", c("contracts") < 0
    scenario = lambda cond, name, at: F.when(cond, F.struct(name.alias("scenario"), at.cast("double").alias("at")))
    rows = F.array_compact(F.array(
        scenario(c("price").isNotNull(), F.lit("current-price"), c("price")),
        scenario(short, F.when(call, "called-away").otherwise("assigned"), c("strike")),
        scenario(c("contracts") != 0, F.lit("expires-otm"), F.when(call, F.greatest(F.lit(0.0), c("strike") - 1)).otherwise(c("strike") + 1)),
    ))
    out = options.where("kind = 'option'").select("*", F.explode(rows).alias("_m")).select(*options.columns, "_m.*")
    inner = intrinsic(c("at"), c("strike"), c("option_type")) * 100 * F.abs("contracts")
    out = out.withColumn("option_profit", F.when(c("contracts") > 0, inner - c("premium")).otherwise(c("premium") - inner))
    own = c("option_profit") + c("at") * c("paired_shares") - c("paired_basis")
    return out.withColumn("combined_profit", F.when(c("scenario") != "assigned", own))


def summarise(evaluated: DataFrame, by: str = "account_id") -> DataFrame:
    """Counts and totals per account of evaluate_positions."""
    c = F.col
    kind = lambda k: F.count_if(c("kind") == k)
    stock = c("kind") == "stock"
    total = lambda x, cond: F.coalesce(F.sum(F.when(cond, c(x))), F.lit(0.0))
    return evaluated.groupBy(by).agg(
        F.count("*").alias("positions"), kind("stock").alias("stocks"), kind("option").alias("options"), kind("cash").alias("cash_positions"),
        F.count_if(stock & c("in_snapshot")).alias("stocks_in_snapshot"), F.count_if(stock & (c("bucket") == "avoid")).alias("in_avoid"),
        F.count_if(stock & (F.size("sell_signals") > 0)).alias("with_sell_signal"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"),
        total("profit", stock).alias("stock_profit"), total("accrued_interest", c("kind") == "cash").alias("accrued_interest"),
    )


def migrate(positions: DataFrame) -> DataFrame:
    """Positions of any age as stock, option or cash, each with an id.

    A row without a kind that has a symbol, an entry_price and shares_owned is an old stock position: its shares and cost_basis come from those.
    Other rows without one of the three kinds are left out; a missing or empty id is drawn. entry_price and shares_owned go.
    """
    c = F.col
    old = c("kind").isNull() & c("symbol").isNotNull() & c("entry_price").isNotNull() & c("shares_owned").isNotNull()
    rows = positions.withColumn("_old", old).where(c("_old") | c("kind").isin("stock", "option", "cash"))
    out = rows.withColumns({
        "kind": F.when(c("_old"), "stock").otherwise(c("kind")), "shares": F.when(c("_old"), c("shares_owned")).otherwise(c("shares")), "cost_basis": F.when(c("_old"), c("entry_price") * c("shares_owned")).otherwise(c("cost_basis")),
        "id": F.when(F.coalesce(c("id").cast("string"), F.lit("")) != "", c("id").cast("string")).otherwise(F.expr("uuid()")),
    })
    return out.drop("_old", "entry_price", "shares_owned")


def instalment_benchmark(contributions: DataFrame, bars: DataFrame, end: Column, symbols: DataFrame) -> DataFrame:
    """Total return of spreading every contribution (date, amount) evenly over symbols at the last close up to it, valued at the last close up to end.

    No pair of contribution and symbol is made: a symbol's bar serves the contributions from its own date
    to that of its next bar, and what these buy is a sum of amount over the number of symbols priced by
    then, taken from running totals over the dates.
    """
    held = bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi").where("close > 0").groupBy("symbol", "date").agg(F.max("close").alias("close"))
    w = Window.partitionBy("symbol").orderBy("date")
    spans = held.withColumns({"_next": F.lead("date").over(w), "_first": F.row_number().over(w) == 1})
    # one row a date: what came in, and how many symbols have a price from it on; running totals over dates
    days = contributions.select("date", F.col("amount").alias("in"), F.lit(0).alias("new")).unionByName(spans.select("date", F.lit(0.0).alias("in"), F.col("_first").cast("int").alias("new")))
    days = days.groupBy("date").agg(F.sum("in").alias("in"), F.sum("new").alias("new"))
    over = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("priced", F.sum("new").over(over)).withColumn("share", F.when(F.col("priced") > 0, F.col("in") / F.col("priced")).otherwise(0.0))
    days = days.withColumn("upto", F.sum("share").over(over)).select("date", "share", "upto")
    at = spans.join(days.select("date", (F.col("upto") - F.col("share")).alias("_before")), "date")
    last = days.agg(F.max("upto").alias("_all"))
    at = at.join(days.select(F.col("date").alias("_next"), (F.col("upto") - F.col("share")).alias("_until")), "_next", "left").join(F.broadcast(last))  # one row
    bought = at.withColumn("paid", F.coalesce("_until", "_all") - F.col("_before"))
    sums = bought.groupBy("symbol").agg(F.sum("paid").alias("paid"), F.sum(F.col("paid") / F.col("close")).alias("shares"), F.max_by("close", F.when(F.col("date") <= end, F.col("date"))).alias("final"))
    return sums.agg(F.sum("paid").alias("paid"), F.sum(F.col("shares") * F.col("final")).alias("value")).withColumn("total_return", F.when(F.col("paid") > 0, F.col("value") / F.col("paid") - 1))


def link_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per list link of a page: id, position, href, text."""
    each = F.regexp_extract_all(html_col, F.lit(r"(<li[^>]*><a href=\"[^\"]*\">[^<]*</a>)"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(each).alias("position", "_x"))
    return rows.select(id_col, "position", F.regexp_extract("_x", r'href="([^"]*)"', 1).alias("href"), F.regexp_extract("_x", r">([^<]*)</a>", 1).alias("text"))


def table_rows(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per table row of a page: id, position, cells (texts without tags)."""
    trs = F.regexp_extract_all(html_col, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select(id_col, F.posexplode(trs).alias("position", "_r"))
    cells = F.transform(F.regexp_extract_all("_r", F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return rows.select(id_col, "position", cells.alias("cells"))
