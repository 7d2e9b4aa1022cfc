"""Index membership as intervals, delisted names, list differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def membership_intervals(changes: DataFrame, current: DataFrame, first_date: str = "1900-01-01") -> DataFrame:
    """(symbol, valid_from, valid_to) from a log of changes (date, added, removed) and the current members (symbol).

    valid_to is exclusive, null for current members. A symbol removed without having been added was a
    member from first_date; one added again has several intervals; events without effect are ignored.
    """
    ins = changes.where("added is not null").select(F.col("added").alias("symbol"), F.col("date"), F.lit(1).alias("kind"))
    outs = changes.where("removed is not null").select(F.col("removed").alias("symbol"), F.col("date"), F.lit(-1).alias("kind"))
    base = current.select("symbol").distinct().select("symbol", F.lit(None).cast("date").alias("date"), F.lit(0).alias("kind"))
    w = Window.partitionBy("symbol").orderBy("date", F.desc("kind"))
    ev = ins.unionByName(outs).distinct()
    ev = ev.withColumn("_prev", F.lag("kind").over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col("kind"))).drop("_prev")
    ev = ev.withColumns({"_next": F.lead("date").over(w), "_rn": F.row_number().over(w)})
    start = F.lit(first_date).cast("date")
    opened = ev.where("kind = 1").select("symbol", F.col("date").alias("valid_from"), F.col("_next").alias("valid_to"))
    early = ev.where("kind = -1 and _rn = 1").select("symbol", start.alias("valid_from"), F.col("date").alias("valid_to"))
    always = base.join(ev.select("symbol").distinct(), "symbol", "left_anti").select("symbol", start.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return opened.unionByName(early).unionByName(always)


def members_at(rows: DataFrame, intervals: DataFrame, date: str = "d", symbol: str = "symbol") -> DataFrame:
    """The rows whose symbol is a member at their date."""
    i = intervals.select(F.col("symbol").alias("_s"), "valid_from", "valid_to")
    on = (F.col(symbol) == F.col("_s")) & (F.col(date) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(date) < F.col("valid_to")))
    return rows.join(i, on, "left_semi")


def removal_reason(text: Column) -> Column:
    """Class of a removal by words in its note; the first class in order with a word there, else other."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # fixed values: classes in order of preference, and their words
    classes = [
        ("bankruptcy", ["bankrupt", "chapter 11", "liquidat"]),
        ("acquired", ["acqui", "merger", "merge ", "buyout", "taken private"]),
        ("spinoff", ["spin", "split off"]),
        ("market-cap-change", ["market cap", "size", "eligibility"]),
    ]
    return F.coalesce(*[F.when(t.contains(w), name) for name, words in classes for w in words], F.lit("other"))


def delisted(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Removed symbols that are not current members, with their earliest removal."""
    gone = changes.where("removed is not null").groupBy(F.col("removed").alias("symbol")).agg(F.min_by(F.struct("date", "reason"), F.struct("date", "reason")).alias("_x"))
    return gone.join(current.select("symbol"), "symbol", "left_anti").select("symbol", "_x.*", removal_reason(F.col("_x.reason")).alias("class"))


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, change): added or removed between two lists."""
    a, b = old.select("symbol").distinct(), new.select("symbol").distinct()
    return b.join(a, "symbol", "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, "symbol", "left_anti").withColumn("change", F.lit("removed")))


def clean_ticker(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(text)), r"\.", "-")


def match_ticker(names: DataFrame, registry: DataFrame, symbol: str = "symbol", ticker: str = "ticker", cik: str = "cik") -> DataFrame:
    """names with cik: the first registry match of the symbol as written, with '-' for '.', or without either."""
    s = F.upper(F.col(symbol))
    forms = F.array_distinct(F.array(s, F.regexp_replace(s, r"\.", "-"), F.regexp_replace(s, r"[.-]", "")))
    tried = names.select(symbol, F.posexplode(forms).alias("_k", "_form")).join(registry.select(F.upper(ticker).alias("_form"), F.col(cik).alias("_cik")), "_form")
    best = tried.groupBy(symbol).agg(F.min(F.struct("_k", "_cik"))["_cik"].alias("cik"))
    return names.join(best, symbol, "left")
