"""Readers and writers of the library's tables: nested snapshots, facts, bars, views, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = """schemaVersion int, snapshotDate string, companies array<struct<symbol: string, name: string, sector: string, industry: string, exchange: string, marketCap: double, currency: string,
  quote: struct<price: double, yearHigh: double, yearLow: double, volume: double, averageVolume: double>,
  ttm: struct<peRatio: double, evToEbitda: double, priceToFcf: double, priceToBook: double, dividendYield: double, currentRatio: double, netDebtToEbitda: double, roic: double, enterpriseValue: double, forwardEps: double>>>,
  errors array<struct<symbol: string, endpoint: string, message: string>>"""
FACTS = "cik bigint, entityName string, facts map<string, map<string, struct<units: map<string, array<struct<start: date, end: date, val: double, fy: int, fp: string, form: string, filed: date>>>>>>"
BARS = "symbol string, date date, close double, high double, low double"
UNIVERSE = "symbol string, name string, sector string, industry string"


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(companies, errors) of snapshot documents: one flat row per (d, symbol); d from the document, else from the file name."""
    docs = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path)
    named = F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2}-\d{2})", 1)
    docs = docs.withColumn("d", F.coalesce(F.try_to_date(F.substring("snapshotDate", 1, 10), "yyyy-MM-dd"), F.try_to_date(named, "yyyy-MM-dd")))
    c = docs.select("d", F.explode("companies").alias("c")).select("d", "c.*")
    flat = c.select("d", "symbol", "name", "sector", "industry", "exchange", F.col("marketCap").alias("market_cap"), "currency", "quote.*", "ttm.*")
    snake = {n: "".join(f"_{x.lower()}" if x.isupper() else x for x in n) for n in flat.columns}
    return flat.select(*[F.col(k).alias(v) for k, v in snake.items()]), docs.select("d", F.explode("errors").alias("e")).select("d", "e.*")


def read_facts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(cik, concept, unit, start, end, val, fy, fp, form, filed) of fact documents, one a file or (multi_line off) one a line: explodes, no inference."""
    docs = spark.read.schema(FACTS).option("multiLine", multi_line).json(path)
    by_concept = docs.select("cik", F.explode("facts").alias("_tax", "_c")).select("cik", F.explode("_c").alias("concept", "_u"))
    by_unit = by_concept.select("cik", "concept", F.explode("_u.units").alias("unit", "_f"))
    return by_unit.select("cik", "concept", "unit", F.explode("_f").alias("_x")).select("cik", "concept", "unit", "_x.*")


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbols: DataFrame | None = None) -> DataFrame:
    """Bars; with symbols, those of its symbols only: a symbol without bars disappears."""
    bars = spark.read.schema(BARS).format(fmt).load(path)
    return bars if symbols is None else bars.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def read_universe(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The list of symbols, a JSON array or (multi_line off) an object a line; raises if one has no symbol or name."""
    df = spark.read.schema(UNIVERSE).option("multiLine", multi_line).json(path)
    bad = df.where("symbol is null or name is null").limit(1).count()
    if bad:
        raise ValueError("the universe holds an entry without symbol or name")
    return df


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV report with header; empty text is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _files(spark: SparkSession, path: str):
    """The file system of path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


MANIFEST = "manifest.json"


def snapshot_state(spark: SparkSession, path: str) -> dict[str, str]:
    """Which version of every date the store's manifest names, by date as text; empty without a store. One entry a date."""
    fs, make = _files(spark, path)
    if not fs.exists(make(f"{path}/{MANIFEST}")):
        return {}
    return {r.d: r.v for r in spark.read.schema("d string, v string").json(f"{path}/{MANIFEST}").collect()}


def _swap(spark: SparkSession, path: str, state: dict[str, str]) -> None:
    """Put a new manifest in the place of the old one by one rename."""
    jvm = spark.sparkContext._jvm
    fs, make = _files(spark, path)
    fresh = make(f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write("".join(json.dumps({"d": d, "v": v}) + "\n" for d, v in sorted(state.items())).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, make(f"{path}/{MANIFEST}"), over)


def write_snapshot(companies: DataFrame, path: str, keep: int | None = None) -> None:
    """Write the dates in companies (column d, not null) as new versions beside the store's, then make them its state by one rename of its manifest.

    Only these dates are replaced; with keep, all but the newest so many dates leave the state. Readers follow the manifest: a write that
    fails or is killed half-way leaves the old state. Versions that neither this state nor the one before it names are
    deleted at the end, so that a reader that began just before still finds its files. One writer at a time.
    """
    spark = companies.sparkSession
    fs, make = _files(spark, path)
    before, version = snapshot_state(spark, path), uuid.uuid4().hex
    companies.withColumn("_version", F.lit(version)).write.partitionBy("d", "_version").mode("append").parquet(f"{path}/data")
    written = [f.getPath().getParent().getName().removeprefix("d=") for f in fs.globStatus(make(f"{path}/data/d=*/_version={version}"))]
    state = before | dict.fromkeys(written, version)
    state = {d: state[d] for d in sorted(state, reverse=True)[:keep]}
    _swap(spark, path, state)
    for f in fs.globStatus(make(f"{path}/data/d=*/_version=*")):
        d, v = f.getPath().getParent().getName().removeprefix("d="), f.getPath().getName().removeprefix("_version=")
        if v not in (state.get(d), before.get(d)):
            fs.delete(f.getPath(), True)


def read_snapshot(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """The rows of the store's state, or of some of its dates; raises without any."""
    state = snapshot_state(spark, path)
    held = [f"{path}/data/d={d}/_version={v}" for d, v in state.items() if dates is None or d in dates]
    if not held:
        raise ValueError(f"no snapshot of these dates in {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*held).drop("_version")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest date's rows: its partition alone is listed and read."""
    return read_snapshot(spark, path, [max(snapshot_state(spark, path), default="")])


def write_views(view: DataFrame, path: str) -> None:
    """One partition a symbol, replaced as a whole: symbols not in view disappear."""
    view.write.partitionBy("symbol").mode("overwrite").parquet(path)


VIEW = """symbol string, currentPrice double, expirations array<struct<expiration: date, selectionReason: string,
  coveredCalls: array<struct<anchorPrice: double, contract: struct<strike: double, bid: double, daysToExpiry: double, openInterest: bigint, volume: bigint>>>,
  puts: array<struct<anchorPrice: double, contract: struct<strike: double, bid: double, daysToExpiry: double, openInterest: bigint, volume: bigint>>>>>"""
SUMMARY = "symbols map<string, struct<bestCallAnnualized: double, bestPutAnnualized: double>>"


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, spot, expiration, kind, side, anchor, strike, bid, days, open_interest, volume) of option view documents, one a line; an expiration without a leg has one row of nulls."""
    e = spark.read.schema(VIEW).json(path).select("symbol", F.col("currentPrice").alias("spot"), F.explode("expirations").alias("e"))
    side = lambda name, legs: F.transform(F.coalesce(legs, F.array()), lambda x: F.struct(F.lit(name).alias("side"), x.alias("leg")))
    legs = e.select("symbol", "spot", F.col("e.expiration").alias("expiration"), F.col("e.selectionReason").alias("kind"), F.explode_outer(F.concat(side("call", F.col("e.coveredCalls")), side("put", F.col("e.puts")))).alias("x"))
    k = F.col("x.leg.contract")
    return legs.select("symbol", "spot", "expiration", "kind", F.col("x.side").alias("side"), F.col("x.leg.anchorPrice").alias("anchor"), k["strike"].alias("strike"), k["bid"].alias("bid"), k["daysToExpiry"].alias("days"), k["openInterest"].alias("open_interest"), k["volume"].alias("volume"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, best_call, best_put) of summary documents, one a line."""
    each = spark.read.schema(SUMMARY).json(path).select(F.explode("symbols").alias("symbol", "x"))
    return each.select("symbol", F.col("x.bestCallAnnualized").alias("best_call"), F.col("x.bestPutAnnualized").alias("best_put"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def errors(rows: DataFrame, checks: dict, key: list[str] | None = None) -> DataFrame:
    """(key, check, message) of the rows that fail a check; the rows themselves stay where they are."""
    key = key or ["symbol"]
    each = F.explode(F.filter(F.array(*[F.when(~cond, F.struct(F.lit(n).alias("check"), F.lit(f"{n} does not hold").alias("message"))) for n, cond in checks.items()]), lambda x: x.isNotNull()))
    return rows.select(*key, each.alias("_e")).select(*key, "_e.*")
