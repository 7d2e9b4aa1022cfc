"""Readers and writers: each query writes what it derives from the tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankweave.operators import fundamentals as fd
from rankweave.queries.base import MONTHLY, PERIODS, SNAP, bound, query
from rankweave.queries.fundamentals import PLAIN_FACTS, facts
from rankweave.queries.portfolio import VALUES, VIEW_SQL, best, view
from rankweave.sources import tables
from rankweave.sources.scratch import shared_dir


def place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("snapshot_documents", f"select d, symbol, sector, round(market_cap, 2) as market_cap, round(price, 6) as price, round(pe_ratio, 6) as pe_ratio from ({SNAP}) s")
def snapshot_documents(spark, sf_dir):
    """A nested document a date, in a file of its own, and back."""
    s = bound(spark, sf_dir, SNAP)
    c = F.col
    quote = F.struct(c("price").alias("price"), c("year_high").alias("yearHigh"), c("year_low").alias("yearLow"))
    ttm = F.struct(c("pe_ratio").alias("peRatio"), c("roic").alias("roic"))
    company = F.struct(c("symbol").cast("string").alias("symbol"), c("sector").alias("sector"), c("industry").alias("industry"), c("market_cap").alias("marketCap"), quote.alias("quote"), ttm.alias("ttm"))
    at = place(spark, "snapshots")
    s.groupBy("d").agg(F.collect_list(company).alias("companies")).withColumn("day", c("d")).withColumn("snapshotDate", F.when(F.year("d") % 2 == 0, c("d").cast("string"))).drop("d").write.partitionBy("day").json(at)
    companies, _ = tables.read_snapshots(spark, at + "/*")
    return companies.select("d", c("symbol").cast("long").alias("symbol"), "sector", F.round("market_cap", 2).alias("market_cap"), F.round("price", 6).alias("price"), F.round("pe_ratio", 6).alias("pe_ratio"))


@query("snapshot_store", f"select d, symbol, round(price, 6) as price from ({SNAP}) s where d >= date '1999-01-01' and d = (select max(d) from ({SNAP}) t)")
def snapshot_store(spark, sf_dir):
    """Two writes by date, all but the newest two dates deleted, and the latest date read."""
    s, at = bound(spark, sf_dir, SNAP).select("d", "symbol", "price"), place(spark, "store")
    tables.write_snapshot(s.withColumn("price", F.lit(0.0)), at)
    tables.write_snapshot(s.where("d >= date '1999-01-01'"), at, keep=2)
    return tables.latest(spark, at).select("d", "symbol", F.round("price", 6).alias("price"))


@query("fact_documents", f"with f as ({PLAIN_FACTS}) select symbol as cik, concept, fy, fp, filed, val from f")
def fact_documents(spark, sf_dir):
    """A document of nested facts a company, and back."""
    c, at = F.col, place(spark, "facts")
    fact = F.struct("start", "end", "val", F.col("fy").cast("int").alias("fy"), "fp", F.lit("10-K").alias("form"), "filed")
    by = facts(spark, sf_dir).groupBy("symbol", "concept").agg(F.collect_list(fact).alias("list"))
    units = F.struct(F.create_map(F.lit("USD"), c("list")).alias("units"))
    docs = by.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct(c("concept"), units))).alias("m")).select(c("symbol").alias("cik"), F.create_map(F.lit("us-gaap"), c("m")).alias("facts"))
    docs.write.json(at)
    return tables.read_facts(spark, at, multi_line=False).select("cik", "concept", F.col("fy").cast("long").alias("fy"), "fp", "filed", "val")


@query("bar_files", f"with b as ({MONTHLY}) select cast(symbol as varchar) as symbol, date, close from b where symbol in (select c_custkey from {{customer}} where c_mktsegment = 'BUILDING')")
def bar_files(spark, sf_dir):
    """Bars as files, of those symbols only that are listed."""
    at = place(spark, "bars")
    bound(spark, sf_dir, MONTHLY).select(F.col("symbol").cast("string").alias("symbol"), "date", F.col("close").cast("double").alias("close"), F.col("high").cast("double").alias("high"), F.col("low").cast("double").alias("low")).write.parquet(at)
    listed = bound(spark, sf_dir, "select cast(c_custkey as string) as symbol from {customer} where c_mktsegment = 'BUILDING'")
    return tables.read_bars(spark, at, symbols=listed).select("symbol", "date", "close")


@query("universe_file", "select cast(c_custkey as varchar) as symbol, c_name as name from {customer}")
def universe_file(spark, sf_dir):
    at = place(spark, "universe")
    bound(spark, sf_dir, "select cast(c_custkey as string) as symbol, c_name as name from {customer}").write.json(at)
    return tables.read_universe(spark, at, multi_line=False).select("symbol", "name")


@query("option_documents", f"""with {VIEW_SQL}, p as (select v.symbol, w.spot, expiration, 'call' as side, call_strike as strike from view_ v join ({VALUES}) w using (symbol) where call_strike is not null
  union all select v.symbol, w.spot, expiration, 'put', put_strike from view_ v join ({VALUES}) w using (symbol) where put_strike is not null
  union all select v.symbol, w.spot, expiration, null, null from view_ v join ({VALUES}) w using (symbol) where call_strike is null and put_strike is null) select * from p""")
def option_documents(spark, sf_dir):
    """A document of expirations and legs a symbol, and back."""
    c, at = F.col, place(spark, "views")
    leg = lambda side: F.when(c(f"{side}_strike").isNotNull(), F.array(F.struct(c("p25").alias("anchorPrice"), F.struct(c(f"{side}_strike").alias("strike"), c(f"{side}_bid").alias("bid")).alias("contract"))))
    rows = view(spark, sf_dir).join(bound(spark, sf_dir, VALUES).select("symbol", "spot", "p25"), "symbol")
    e = F.struct("expiration", F.lit("monthly").alias("selectionReason"), leg("call").alias("coveredCalls"), leg("put").alias("puts"))
    rows.groupBy("symbol", c("spot").alias("currentPrice")).agg(F.collect_list(e).alias("expirations")).write.json(at)
    return tables.read_views(spark, at).select("symbol", "spot", "expiration", "side", "strike")


@query("option_partitions", f"with {VIEW_SQL} select symbol, expiration, call_strike, put_strike from view_ where symbol <> 'Brand#11'")
def option_partitions(spark, sf_dir):
    """A partition a symbol; writing again without one drops it."""
    at = place(spark, "partitions")
    v = view(spark, sf_dir).select("symbol", "expiration", "call_strike", "put_strike")
    tables.write_views(v, at)
    tables.write_views(v.where("symbol <> 'Brand#11'"), at)
    return spark.read.schema(v.schema).parquet(at).select("symbol", "expiration", "call_strike", "put_strike")


@query("option_summary", f"with {VIEW_SQL} select symbol, round(best_call, 7) as best_call, round(best_put, 7) as best_put from best")
def option_summary(spark, sf_dir):
    at = place(spark, "summary")
    entry = F.struct("symbol", F.struct(F.col("best_call").alias("bestCallAnnualized"), F.col("best_put").alias("bestPutAnnualized")))
    tables.write_json(best(spark, sf_dir).groupBy(F.hash("symbol") % 4).agg(F.map_from_entries(F.collect_list(entry)).alias("symbols")).select("symbols"), at)
    return tables.read_summary(spark, at).select("symbol", F.round("best_call", 7).alias("best_call"), F.round("best_put", 7).alias("best_put"))


@query("report_files", f"select symbol, y, round(revenue, 2) as revenue, round(interest, 4) as interest from ({PERIODS}) p")
def report_files(spark, sf_dir):
    """Rows as CSV with a header; empty text comes back as null."""
    at = place(spark, "report")
    tables.write_report(bound(spark, sf_dir, PERIODS).select("symbol", "y", F.round("revenue", 2).alias("revenue"), F.round("interest", 4).alias("interest")), at)
    return tables.read_report(spark, at, "symbol long, y int, revenue double, interest double")


@query("error_table", f"select symbol, 'ebit' as \"check\", y from ({PERIODS}) p where ebit < 0 union all select symbol, 'fcf', y from ({PERIODS}) p where fcf < 0")
def error_table(spark, sf_dir):
    """Which rows fail which check; the rows themselves stay."""
    rows = bound(spark, sf_dir, PERIODS)
    return tables.errors(rows, {"ebit": F.col("ebit") >= 0, "fcf": F.col("fcf") >= 0}, ["symbol", "y"]).select("symbol", "check", "y")


@query("provider_statements", f"""select symbol, y as fiscal_year, round(revenue, 2) as revenue, case when y % 3 > 0 then round(debt, 4) end as total_debt, round(case when y % 2 = 0 then dividends when y % 3 > 0 then dividends * 2 end, 4) as dividends_paid, round(case when y % 4 > 0 then buybacks end, 4) as buybacks,
  round(case when y % 5 > 0 then 1.5 else 2.5 end, 2) as net_debt_to_ebitda, round(case when y % 7 > 0 then 3.5 else 4.5 end, 2) as current_ratio from ({PERIODS}) p""")
def provider_statements(spark, sf_dir):
    """Five statements of a provider joined by year."""
    p = bound(spark, sf_dir, PERIODS).withColumn("fiscal_year", F.col("y"))
    k = ["symbol", "fiscal_year"]
    y = F.col("y")
    balance = p.where(y % 3 > 0).select(*k, F.col("debt").alias("total_debt"))
    cash = p.select(*k, F.when(y % 2 == 0, -F.col("dividends")).alias("common_dividends"), F.when(y % 3 > 0, -2 * F.col("dividends")).alias("net_dividends"), F.when(y % 4 > 0, -F.col("buybacks")).alias("buybacks"))
    ratios = p.select(*k, F.lit(2.5).alias("net_debt_to_ebitda"), F.when(y % 7 > 0, 3.5).alias("current_ratio"))
    metrics = p.select(*k, F.when(y % 5 > 0, 1.5).alias("net_debt_to_ebitda"), F.lit(4.5).alias("current_ratio"), "roic")
    out = fd.join_statements(p.select(*k, "revenue"), balance, cash, ratios, metrics)
    return out.select(*k, F.round("revenue", 2).alias("revenue"), F.round("total_debt", 4).alias("total_debt"), F.round("dividends_paid", 4).alias("dividends_paid"), F.round("buybacks", 4).alias("buybacks"), "net_debt_to_ebitda", "current_ratio")
