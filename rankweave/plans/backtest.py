"""Factor-efficacy and valuation back-tests over many dates: observations, rank correlations, null thresholds, weight validation, outcomes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.dates import add_years
from rankweave.functions.finance import cumulative_yield, non_recovery_class
from rankweave.functions.stats import LARGE, bootstrap_means, bootstrap_spearman, correlation_bounds, midrank_percentile, midranks, rank_correlation, ranged, ranged_percentile, resampled_correlations, spearman, splitters, wilson, winsorised_percentiles
from rankweave.operators.ranking import Factor, factor_rows, yearly_first
from rankweave.operators.timeseries import asof_join, forward_extremes, trailing_slope, trend_class, upsert
from rankweave.sources.scratch import saved, small


def forward_returns(snapshots: DataFrame, bars: DataFrame, horizons: Sequence[int] = (1, 3), price: str = "price") -> DataFrame:
    """(d, symbol, horizon, ret): the first bar at or after d + horizon years over the snapshot's price; rows without either are left out."""
    probes = snapshots.select("d", "symbol", F.col(price).alias("_p0"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    due = F.lit(None).cast("date")
    for h in horizons:
        due = F.when(F.col("horizon") == h, add_years(F.col("d"), h)).otherwise(due)
    found = asof_join(probes.withColumn("_due", due), bars, ["symbol"], "_due", "date", ["close"], forward=True)
    return found.where("close is not null and _p0 > 0").select("d", "symbol", "horizon", (F.col("close") / F.col("_p0") - 1).alias("ret"))


def mean_benchmark(returns: DataFrame) -> DataFrame:
    """(d, horizon, ret): the mean return of all names."""
    return returns.groupBy("d", "horizon").agg(F.avg("ret").alias("ret"))


def excess_returns(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """returns with excess over the benchmark of the date and horizon; rows without one are left out."""
    return returns.join(benchmark.withColumnRenamed("ret", "_b"), ["d", "horizon"]).withColumn("excess", F.col("ret") - F.col("_b")).drop("_b")


def ic_observations(factor_rows: DataFrame, excess: DataFrame, group: str = "sector", unmatched: bool = False, rows_a_range: int = 100_000) -> DataFrame:
    """(d, symbol, super_group, horizon, factor, pct, excess): percentiles in the group without fallback, joined to excess returns.

    With unmatched, names without a forward return follow with horizon 0 and null excess. factor_rows is read several times (saved_values); no
    task ranks a group: values go by ranges of about rows_a_range (ranged_percentile).
    """
    rows = ranged_percentile(factor_rows.where(F.col(group).isNotNull()).select("d", "symbol", group, "factor", "direction", "raw"), "raw", ["d", "factor", "direction", group], "_p", values_a_range=rows_a_range)
    pct = F.when(F.col("direction") == "lower", 100 - F.col("_p")).otherwise(F.col("_p"))
    rows = rows.select("d", "symbol", F.col(group).alias("super_group"), "factor", pct.alias("pct"))
    out = rows.join(excess.select("d", "symbol", "horizon", "excess"), ["d", "symbol"])
    if unmatched:
        rest = rows.join(excess.select("d", "symbol").distinct(), ["d", "symbol"], "left_anti")
        out = out.unionByName(rest.withColumns({"horizon": F.lit(0), "excess": F.lit(None).cast("double")}))
    return out


#: Rows of a date and group that one task ranks as arrays, and of a group and horizon, at most: larger ones go by ranges.
ROWS_A_GROUP, ROWS_A_CELL = 1_000_000, 8_000_000
#: What a wide observation holds beside its factors.
WIDE = ["super_group", "d", "symbol", "horizon", "excess"]


def wide_observations(values: DataFrame, factors: Sequence[Factor], excess: DataFrame, group: str = "sector", digits: int | None = None, most: int = ROWS_A_GROUP) -> DataFrame:
    """ic_observations with one row a date, name and horizon, and a column of percentiles a factor, rounded to digits; written once.

    values (a saved table): d, symbol, group and what the factors read. A date's group of up to most rows is ranked in one task, all factors as arrays
    (some 400 bytes a row); larger ones go by ranges (ranged_percentile). Names move whole, not once a factor. Rows without a percentile or an excess are left out.
    """
    names, lower = [f.name for f in factors], [f.direction == "lower" for f in factors]
    by = ["super_group", "d"]
    rows = values.where(F.col(group).isNotNull()).select(F.col(group).alias("super_group"), "d", "symbol", *[f.value.cast("double").alias(f.name) for f in factors])
    large = saved(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most), "large-groups")
    some = not large.isEmpty()
    on = lambda a, b: a["super_group"].eqNullSafe(b["super_group"]) & a["d"].eqNullSafe(b["d"])

    def rank(table: pa.Table) -> pa.Table:
        for name, low in zip(names, lower):
            v = table.column(name).combine_chunks()
            there = v.is_valid().to_numpy(zero_copy_only=False)
            p, full = winsorised_percentiles(v.to_numpy(zero_copy_only=False)[there]), np.zeros(len(v))
            full[there] = 100 - p if low else p
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(full, mask=~there))
        return table

    few = rows.join(F.broadcast(large), on(rows, large), "left_anti") if some else rows
    # so many tasks that hardly two of these keys meet in one
    ranked = few.repartition(256, *by).groupBy(*by).applyInArrow(rank, rows.schema)
    if some:
        long = saved(factor_rows(values.where(F.col(group).isNotNull()).withColumnRenamed(group, "super_group"), factors, [*by, "symbol"]).drop("category"), "large-factors")
        told = ranged_percentile(long.join(F.broadcast(large), on(long, large), "left_semi"), "raw", ["d", "factor", "direction", "super_group"], "_p")
        pct = F.when(F.col("direction") == "lower", 100 - F.col("_p")).otherwise(F.col("_p"))
        ranked = ranked.unionByName(told.groupBy(*by, "symbol").agg(*[F.max(F.when(F.col("factor") == n, pct)).alias(n) for n in names]))
    met = ranked.where(F.coalesce(*names).isNotNull()).join(excess.where("excess is not null").select("d", "symbol", "horizon", "excess"), ["d", "symbol"])
    return saved(met.select(*WIDE, *[(F.col(n) if digits is None else F.round(n, digits)).alias(n) for n in names]), "wide-observations")


def _factors(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c not in WIDE]


def _long(wide: DataFrame, *keep: str) -> DataFrame:
    """Wide observations as those of ic_observations."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("pct")) for n in _factors(wide.drop(*keep))]))
    return wide.select(*WIDE, *keep, each.alias("_x")).select(*WIDE, *keep, "_x.*").where("pct is not null")


def _once_a_year(wide: DataFrame, *by: str) -> DataFrame:
    """wide with null for what is not of a name's first date of the year with that factor; wide itself where no name has two rows a year."""
    names, key = _factors(wide.drop(*by)), ["super_group", "horizon", *by, "symbol", F.year("d")]
    if wide.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return wide
    one = wide.groupBy(*[c for c in WIDE if c != "excess"], *by).agg(F.first("excess").alias("excess"), *[F.max(n).alias(n) for n in names])
    first = lambda n: F.min(F.when(F.col(n).isNotNull(), F.col("d"))).over(Window.partitionBy(*key))
    return one.select(*WIDE, *by, *[F.when(F.col("d").eqNullSafe(first(n)), F.col(n)).alias(n) for n in names])


#: Rows that a task packs at a time.
ROWS_PACKED = 100_000


def _packed(wide: DataFrame, *keep: str) -> DataFrame:
    """(super_group, horizon, factor, xs, ys, one array a column of keep, int): a factor's percentiles and excesses, of some rows as arrays; those without a value are left out."""
    names, kinds = _factors(wide.drop(*keep)), dict(wide.dtypes)

    def emit(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        codes = table.select(["super_group", "horizon"]).to_pandas().groupby(["super_group", "horizon"], dropna=False, sort=False).ngroup().to_numpy()
        numbers = lambda c, kind: table.column(c).to_numpy().astype(kind, copy=False)
        ys, others, out = numbers("excess", float), [numbers(c, np.int32) for c in keep], []
        factors = [(n, numbers(n, float), table.column(n).combine_chunks().is_valid().to_numpy(zero_copy_only=False)) for n in names]
        for k in range(codes.max() + 1):
            of = np.flatnonzero(codes == k)
            group, horizon = (table.column(c)[int(of[0])].as_py() for c in ("super_group", "horizon"))
            for n, xs, there in factors:
                at = of[there[of]]
                if len(at):
                    out.append((group, horizon, n, xs[at].tobytes(), ys[at].tobytes(), *[v[at].tobytes() for v in others]))
        kinds_ = [table.schema.field("super_group").type, pa.int32(), pa.string(), *[pa.binary()] * (2 + len(keep))]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=t) for j, t in enumerate(kinds_)], names=["super_group", "horizon", "factor", "xs", "ys", *keep])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS_PACKED:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return wide.where("excess is not null").withColumn("horizon", F.col("horizon").cast("int")).mapInArrow(run, f"super_group {kinds['super_group']}, horizon int, factor string, xs binary, ys binary" + "".join(f", {c} binary" for c in keep))


def _joined(arrays, kind=float) -> np.ndarray:
    return np.frombuffer(b"".join(arrays), dtype=kind)


def _split_cells(wide: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """wide in groups and horizons of up to most rows, and the larger ones, if any."""
    large = saved(wide.groupBy("super_group", "horizon").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(F.col("super_group").alias("_g"), F.col("horizon").alias("_h")), "large-cells")
    if large.isEmpty():
        return wide, None
    on = F.col("super_group").eqNullSafe(F.col("_g")) & F.col("horizon").eqNullSafe(F.col("_h"))
    return wide.join(F.broadcast(large), on, "left_anti"), wide.join(F.broadcast(large), on, "left_semi")


def _wide_correlations(wide: DataFrame, out: Sequence[str], most: int) -> DataFrame:
    """ic of every cell, or of every cell and span where out names it. A cell of a group and horizon of up to most rows meets in one task as two arrays, larger ones go by ranges (spearman)."""
    keep = [c for c in out if c not in CELL]
    few, large = _split_cells(wide, most)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = _joined(pdf["xs"]), _joined(pdf["ys"])
        parts = [((), slice(None))]
        if keep:
            spans = _joined(pdf[keep[0]], np.int32)
            parts = [((k,), np.flatnonzero(spans == k)) for k in np.unique(spans)]
        told = [(*pdf[CELL].iloc[0], *k, len(xs[at]), rank_correlation(xs[at], ys[at])) for k, at in parts]
        return pd.DataFrame(told, columns=[*out, "n", "ic"])

    kinds = dict(wide.dtypes) | {"horizon": "int", "factor": "string"}
    # a cell is much work on few bytes: so many tasks that hardly two of these keys meet in one
    told = _packed(few, *keep).repartition(256, *CELL).groupBy(*CELL).applyInPandas(rank, ", ".join(f"{c} {kinds[c]}" for c in out) + ", n long, ic double")
    told = told if large is None else told.unionByName(spearman(_long(large, *keep), "pct", "excess", list(out), "ic"))
    return saved(told, "cells")  # a few rows, read several times


CELL = ["super_group", "factor", "horizon"]


def ic_cells(observations: DataFrame, most: int = ROWS_A_CELL) -> DataFrame:
    """(super_group, factor, horizon, n, ic): Spearman of percentile and excess, one date a year and symbol; observations may be wide (wide_observations)."""
    if "factor" not in observations.columns:
        return _wide_correlations(_once_a_year(observations), CELL, most)
    once = yearly_first(observations.where("pct is not null and excess is not null"), [*CELL, "symbol"], "d")
    return spearman(once, "pct", "excess", CELL, "ic")


def ic_intervals(observations: DataFrame, resamples: int = 1000, seed: int = 1, large: int = LARGE) -> DataFrame:
    """(super_group, factor, horizon, lo, hi): the interval of every cell's ic over paired resamples; cells of under five pairs are left out.

    observations may be wide (wide_observations). Of those, cells of a group and horizon of over large rows meet in a task as two arrays, and draw by another
    stream of the same distribution (resampled_correlations).
    """
    if "factor" in observations.columns:
        once = yearly_first(observations.where("pct is not null and excess is not null"), [*CELL, "symbol"], "d")
        return bootstrap_spearman(once, "pct", "excess", CELL, ["d", "symbol"], resamples, seed).drop("n")
    few, many = _split_cells(_once_a_year(observations), large)
    told = bootstrap_spearman(_long(few), "pct", "excess", CELL, ["d", "symbol"], resamples, seed).drop("n")
    if many is None:
        return told

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = _joined(pdf["xs"]), _joined(pdf["ys"])
        rows = [(*pdf[CELL].iloc[0], len(xs), 0, resampled_correlations(xs, ys, resamples, seed))] if len(xs) >= 5 else []
        return pd.DataFrame(rows, columns=[*CELL, "n", "part", "sums"])

    # a cell is much work on few bytes: so many tasks that hardly two of these keys meet in one
    kind = dict(observations.dtypes)["super_group"]
    got = _packed(many).repartition(256, *CELL).groupBy(*CELL).applyInPandas(run, f"super_group {kind}, factor string, horizon int, n long, part long, sums array<double>")
    return told.unionByName(correlation_bounds(got, CELL).drop("n"))


def _with_spans(obs: DataFrame, spans: int) -> DataFrame:
    """obs (a saved table) with span."""
    # a few rows: the dates' range per group and horizon
    range_ = saved(obs.groupBy("super_group", "horizon").agg(F.min("d").alias("_a"), F.max("d").alias("_z")), "date-ranges")
    obs = obs.join(small(range_), ["super_group", "horizon"])
    stride = F.floor(F.datediff("_z", "_a").cast("long") * F.lit(86_400_000) / spans)
    past = [(F.datediff("d", "_a") >= F.floor(stride * k / 86_400_000)).cast("int") for k in range(1, spans)]
    span = F.when(F.col("_a") == F.col("_z"), 0).otherwise(sum(past[1:], past[0]) if past else F.lit(0))
    return obs.withColumn("span", span.cast("int")).drop("_a", "_z")


def rolling_ic(observations: DataFrame, spans: int = 3, most: int = ROWS_A_CELL) -> DataFrame:
    """ic per cell and span: the range of dates of a cell's group and horizon in spans of equal whole days, 0 to spans - 1; the last one takes the rest.

    observations may be wide (wide_observations).
    """
    if "factor" not in observations.columns:
        return _wide_correlations(_once_a_year(_with_spans(observations, spans), "span"), [*CELL, "span"], most)
    # read twice
    obs = saved(observations.where("pct is not null and excess is not null").select(*CELL, "symbol", "d", "pct", "excess"), "observations")
    return spearman(yearly_first(_with_spans(obs, spans), [*CELL, "span", "symbol"], "d"), "pct", "excess", [*CELL, "span"], "ic")


#: Iterations that one row of the null distribution stands for; observations of a super-group that meet in one row at most, and as arrays in one task at most.
ITERATIONS_A_ROW, OBSERVATIONS_A_ROW, OBSERVATIONS_A_TASK = 50, 500_000, 8_000_000


def ic_thresholds(observations: DataFrame, iterations: int = 1000, seed: int = 1, quantiles: Sequence[float] = (0.99, 0.995), most: int = OBSERVATIONS_A_ROW, most_arrays: int = OBSERVATIONS_A_TASK) -> DataFrame:
    """(super_group, horizon, n, draws, one threshold a quantile): of absolute rank correlations when excess is shuffled within date and group.

    A bucket's excesses, of all horizons, are shuffled together. n is the names times years of the cell, draws the correlations
    of all its factors over all iterations; the threshold is the element at floor(q draws) of those. Which date of a year counts,
    and the ranks of the factors, do not change from shuffle to shuffle: they are found once.

    A group of up to most observations (names times dates times horizons) meets in one row, for every run of iterations; the order is that of a seeded
    hash of (iteration, row). One of up to most_arrays moves as arrays to a task for every eight factors and half of the iterations (_null_of_arrays). Larger groups stay
    dealt (_null_of_large). These are other streams of the same distribution. None depends on partitioning; all are other streams than a
    sequential shuffle. Super-groups may not be null. observations may be wide (wide_observations).
    """
    if "factor" in observations.columns:
        obs = observations.where("pct is not null and excess is not null and super_group is not null")
        names = sorted(r[0] for r in obs.select("factor").distinct().collect())  # a fixed list
        pivoted = obs.groupBy("super_group", "d", "symbol", "horizon").agg(F.first("excess").alias("excess"), *[F.max(F.when(F.col("factor") == n, F.col("pct"))).alias(n) for n in names])
        pivoted = saved(pivoted.select(*WIDE, *names), "null-observations")
    else:
        pivoted, names = observations.where("excess is not null and super_group is not null"), _factors(observations)
    # a factor counts on its first date of the year
    dated = _once_a_year(pivoted)
    wide = dated.select(*WIDE, *[F.col(n).alias(f"f{k}") for k, n in enumerate(names)])
    if dated is not pivoted:
        wide = saved(wide, "null-observations")
    sizes = saved(wide.groupBy("super_group").agg(F.count("*").alias("_n")), "group-sizes")
    ics = None
    for of, way in ((f"_n <= {most}", _null_of_small), (f"_n > {most} and _n <= {most_arrays}", _null_of_arrays), (f"_n > {most} and _n > {most_arrays}", _null_of_large)):
        some = sizes.where(of).select("super_group")
        if not some.isEmpty():
            told = way(wide.join(small(some), "super_group", "left_semi"), len(names), iterations, seed)
            ics = told if ics is None else ics.unionByName(told)
    if ics is None:
        ics = _null_of_small(wide, len(names), iterations, seed)
    # at most factors times iterations numbers a cell
    told = ics.groupBy("super_group", "horizon").agg(F.sort_array(F.collect_list("ic")).alias("_a"))
    names_a_year = wide.select("super_group", "horizon", "symbol", F.year("d").alias("_y")).distinct().groupBy("super_group", "horizon").agg(F.count("*").alias("n"))
    a, n = F.col("_a"), F.size("_a")
    return told.join(names_a_year, ["super_group", "horizon"]).select("super_group", "horizon", "n", n.cast("long").alias("draws"), *[F.get(a, F.least(F.floor(n * q), n - 1).cast("int")).alias(f"t{str(q)[2:]}") for q in quantiles])


def _null_of_small(wide: DataFrame, n_factors: int, iterations: int, seed: int) -> DataFrame:
    """(super_group, horizon, ic): absolute correlations of all iterations; a group's rows meet in one row for every run of iterations."""
    row = F.struct("d", "symbol", "horizon", F.xxhash64("d", "symbol", "horizon").alias("h"), "excess", *[f"f{k}" for k in range(n_factors)])
    whole = wide.groupBy("super_group").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    columns = {"bucket": "d", "horizon": "horizon", "h": "h", "excess": "excess"} | {f"f{k}": f"f{k}" for k in range(n_factors)}
    parts = whole.select("super_group", *[_column(c).alias(n) for n, c in columns.items()])
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(ITERATIONS_A_ROW))).alias("at"))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bucket, horizon, h, excess = (np.asarray(x) for x in (r.bucket, r.horizon, r.h, r.excess))
                cells = _null_cells(horizon, [np.array(getattr(r, f"f{k}"), dtype=float) for k in range(n_factors)])
                for it in range(r.at, min(r.at + ITERATIONS_A_ROW, iterations)):
                    given = np.empty(len(excess))
                    given[np.lexsort((_mixed(h, seed, it), bucket))] = excess[np.argsort(bucket, kind="stable")]
                    for hz, of in cells.items():
                        found = _null_correlations(given, of)
                        if len(found):
                            out.append((r.super_group, int(hz), found))
            yield pd.DataFrame(out, columns=["super_group", "horizon", "ics"])

    kind = dict(wide.dtypes)["super_group"]
    ics = parts.mapInPandas(run, f"super_group {kind}, horizon int, ics array<double>")
    return ics.select("super_group", "horizon", F.explode("ics").alias("ic"))


#: Factors and iterations of a task of _null_of_arrays, twice the factors in groups of up to so many rows, and rows of a chunk, about.
FACTORS_A_TASK, ITERATIONS_A_TASK, ROWS_OF_MORE, ROWS_A_CHUNK = 8, 500, 4_000_000, 50_000


def _null_of_arrays(wide: DataFrame, n_factors: int, iterations: int, seed: int) -> DataFrame:
    """(super_group, horizon, ic): a group's rows are packed into arrays where they lie, which move to a task for every FACTORS_A_TASK factors and ITERATIONS_A_TASK iterations.

    Excesses are shuffled there as codes (the same shuffle for all factors of an iteration), and ranked by counting codes, once for all factors that
    the same rows have: codes of a horizon are counted once, those of rows without the factor taken off. Nothing is sorted or moved for an iteration. A task holds a group's arrays:
    by their count some 350 bytes an observation, not measured. The chunk and place of a row come from its hash, so that the order is always the same.
    """
    rows = {r[0]: r[1] for r in wide.groupBy("super_group").count().collect()}  # a few groups
    sizes, widths = {g: -(-n // ROWS_A_CHUNK) for g, n in rows.items()}, {g: FACTORS_A_TASK * (2 if n <= ROWS_OF_MORE else 1) for g, n in rows.items()}
    hashed = wide.select("super_group", F.xxhash64("d", "symbol", "horizon").alias("h"), F.datediff("d", F.lit("1970-01-01").cast("date")).alias("d"), F.col("horizon").cast("int").alias("horizon"), "excess", *[f"f{k}" for k in range(n_factors)])
    kind = dict(wide.dtypes)["super_group"]
    base = {"h": np.int64, "d": np.int32, "horizon": np.int32, "excess": float}

    def pack(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= ROWS_PACKED:
                yield packed_rows(held)
                held, size = [], 0
        if size:
            yield packed_rows(held)

    def packed_rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table, out = pa.Table.from_batches(held), []
        codes = table.column("super_group").combine_chunks().dictionary_encode()
        of, groups = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        numbers = {c: table.column(c).to_numpy().astype(t, copy=False) for c, t in base.items()}
        factors = [table.column(f"f{k}").to_numpy().astype(float, copy=False) for k in range(n_factors)]
        for k, group in enumerate(groups):
            at = np.flatnonzero(of == k)
            told = [v[at].tobytes() for v in numbers.values()]
            out += [(group, j, *told, [v[at].tobytes() for v in factors[j : j + widths[group]]]) for j in range(0, n_factors, widths[group])]
        types = [table.schema.field("super_group").type, pa.int32(), *[pa.binary()] * len(base), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=t) for j, t in enumerate(types)], names=["super_group", "part", *base, "fs"])

    packed = hashed.mapInArrow(pack, f"super_group {kind}, part int, " + ", ".join(f"{c} binary" for c in base) + ", fs array<binary>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group, start = pdf["super_group"].iloc[0], int(pdf["start"].iloc[0])
        h, bucket, horizon, excess = (_joined(pdf[c], t) for c, t in base.items())
        order = np.lexsort((horizon, h, h % sizes[group], bucket))
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
        horizon = horizon[order]
        codes = np.unique(excess[order], return_inverse=True)[1].astype(np.int32)
        cells = []  # rows of a horizon, and of the factors that the same of them have: which, which not, centred ranks with 0 for those without
        for hz in np.unique(horizon):
            of, alike = np.flatnonzero(horizon == hz), {}
            for j in range(len(pdf["fs"].iloc[0])):
                f = _joined([v[j] for v in pdf["fs"]])[order[of]]
                there = ~np.isnan(f)
                if there.sum() >= 2:
                    x = np.zeros(len(of))
                    x[there] = _midranks(f[there]) - (there.sum() + 1) / 2
                    if (x != 0).any():
                        alike.setdefault(np.packbits(there).tobytes(), (np.flatnonzero(there), np.flatnonzero(~there), []))[2].append(x / np.sqrt(np.einsum("i,i", x, x)))
            cells.append((int(hz), of, list(alike.values())))
        del pdf, h, bucket, excess, order, horizon
        n = int(codes.max()) + 1
        ranks, equal, given, own, code, mine = np.empty(n), np.empty(n), np.empty_like(codes), np.empty_like(codes), np.empty(len(codes), dtype=np.intp), np.empty(len(codes))
        name = int.from_bytes(hashlib.sha256(str(group).encode()).digest()[:8], "little")
        found: dict = {}
        for it in range(start, min(start + ITERATIONS_A_TASK, iterations)):
            rng, given[:] = np.random.Generator(np.random.SFC64([name, seed & 0xFFFFFFFF, it])), codes
            for a, z in zip(starts, starts[1:]):
                rng.shuffle(given[a:z])
            for hz, of, alike in cells:
                # in buffers that all iterations share
                y, y_ranks = code[: len(of)], mine[: len(of)]
                np.take(given, of, out=own[: len(of)], mode="clip")
                y[:] = own[: len(of)]
                every = np.bincount(y, minlength=n)
                for at, rest, xs in alike:
                    count = every - np.bincount(y[rest], minlength=n) if len(rest) < len(at) else np.bincount(y[at], minlength=n)
                    # the centred mid-rank of every code
                    np.cumsum(count, out=ranks)
                    np.multiply(count, -0.5, out=equal)
                    np.add(ranks, equal, out=ranks)
                    np.subtract(ranks, len(at) / 2, out=ranks)
                    np.multiply(count, ranks, out=equal)
                    size = np.einsum("i,i", equal, ranks)
                    if size > 0:
                        np.take(ranks, y, out=y_ranks, mode="clip")
                        # no threads of a library's own beside the task's
                        found.setdefault(hz, []).extend(abs(float(np.einsum("i,i", x, y_ranks))) / np.sqrt(size) for x in xs)
        return pd.DataFrame([(group, hz, v) for hz, v in found.items()], columns=["super_group", "horizon", "ics"])

    # much work on few bytes: so many tasks that hardly two of these keys meet in one
    dealt = packed.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), F.lit(ITERATIONS_A_TASK)))).repartition(256, "super_group", "part", "start")
    told = dealt.groupBy("super_group", "part", "start").applyInPandas(run, f"super_group {kind}, horizon int, ics array<double>")
    return saved(told, "null-correlations").select("super_group", "horizon", F.explode("ics").alias("ic"))


#: Buckets up to this size are permuted whole, larger ones by a keyed bijection of the index.
WHOLE_BUCKET = 1024


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int, iteration: np.ndarray) -> np.ndarray:
    """Where a permutation of 0 to size - 1, one for each (key, iteration), takes index: each row finds its place alone.

    Above WHOLE_BUCKET it is a Feistel network over the next even number of bits; what lands beyond size goes through again.
    """
    out = np.empty(len(index), dtype=np.int64)
    whole = size <= WHOLE_BUCKET
    if whole.any():
        at = np.flatnonzero(whole)
        which = np.stack([key[at], iteration[at], size[at]], axis=1)
        order = np.lexsort(which.T)
        new = np.r_[True, (which[order][1:] != which[order][:-1]).any(axis=1)]
        for part in np.split(order, np.flatnonzero(new)[1:]):
            k, it, n = which[part[0]]
            rng = np.random.Generator(np.random.Philox(key=np.array([np.int64(k).astype(np.uint64), np.uint64((seed & 0xFFFFFFFF) << 32 | int(it))], dtype=np.uint64)))
            out[at[part]] = rng.permutation(n)[index[at[part]]]
    at = np.flatnonzero(~whole)
    x, n = index[at].astype(np.uint64), size[at].astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(size[at], 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    keyed = _finalised(key[at].astype(np.int64).view(np.uint64) ^ _finalised(iteration[at].astype(np.uint64) + np.uint64((seed & 0xFFFFFFFF) << 32)))
    todo = np.arange(len(at))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(6):
            left, right = right, left ^ (_finalised(keyed[todo] + right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    out[at] = x.astype(np.int64)
    return out


def _null_of_large(wide: DataFrame, n_factors: int, iterations: int, seed: int, block: int = 50) -> DataFrame:
    """(super_group, horizon, ic) of groups of any size: no task holds a group, a date or a cell.

    Rows of a bucket (date and group) are numbered by ranges of a hash. In an iteration a row goes to the place that a keyed bijection
    gives its number, and meets the excess there; equal excesses of a cell are then one row with their count and their sum of factor ranks.
    Values are ranked inside ranges of the excess, ranges are put together from their sums. A block of iterations is written at a
    time, so that the disk holds the group's rows times block.
    """
    c, fs = F.col, range(n_factors)
    key = ["super_group", "d"]
    w = Window.partitionBy(*key, "_c").orderBy("_h", "symbol", "horizon")
    dealt = saved(wide.withColumn("_h", F.xxhash64("d", "symbol", "horizon")).withColumn("_c", F.shiftright("_h", 56)).withColumn("_k", F.row_number().over(w) - 1), "null-chunks")
    counts = dealt.groupBy(*key, "_c").agg(F.count("*").alias("_t"))
    every = Window.partitionBy(*key)  # at most 256 rows
    offsets = saved(counts.select(*key, "_c", (F.sum("_t").over(every.orderBy("_c")) - c("_t")).alias("_o"), F.sum("_t").over(every).alias("_n")), "null-offsets")
    rows = saved(dealt.join(offsets, [*key, "_c"]).withColumn("_i", c("_k") + c("_o")).drop("_c", "_k", "_o", "_h"), "null-numbered")
    # the excess by its place, with its range; the factors as centred ranks of the rows that count
    given = saved(ranged(rows.select(*key, "_i", "excess"), "excess", ["super_group"], splitters(rows, "excess", ["super_group"])), "null-excesses")
    long = rows.select(*key, "symbol", "horizon", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c(f"f{k}").alias("pct")) for k in fs])).alias("_x")).select(*key, "symbol", "horizon", "_x.*").where("pct is not null")
    cell = ["super_group", "horizon", "k"]
    values = ranged(long.groupBy(*cell, "pct").agg(F.count("*").alias("_eq")), "pct", cell, splitters(long, "pct", cell))
    values = saved(values, "null-values")
    sums = values.groupBy(*cell, "_r").agg(F.sum("_eq").alias("_t"))
    below = saved(sums.select(*cell, "_r", (F.sum("_t").over(Window.partitionBy(*cell).orderBy("_r")) - c("_t")).alias("_o"), F.sum("_t").over(Window.partitionBy(*cell)).alias("_n")), "null-below")
    inside = F.sum("_eq").over(Window.partitionBy(*cell, "_r").orderBy("pct")) - c("_eq")
    ranks = saved(values.join(small(below), [*cell, "_r"]).select(*cell, "pct", ((inside + c("_o") + (c("_eq") + 1) / 2) - (c("_n") + 1) / 2).alias("x")), "null-ranks")
    ranked = long.join(ranks, [*cell, "pct"]).groupBy(*key, "symbol", "horizon").agg(*[F.max(F.when(c("k") == k, c("x"))).alias(f"x{k}") for k in fs])
    xs = saved(rows.select(*key, "symbol", "horizon", "_i", "_n").join(ranked, [*key, "symbol", "horizon"]).drop("symbol").withColumn("_key", F.xxhash64(*key)), "null-factors")

    @F.pandas_udf("long")
    def place(i: pd.Series, n: pd.Series, k: pd.Series, it: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n.to_numpy(), k.to_numpy(), seed, it.to_numpy()))

    out = None
    for start in range(0, iterations, block):
        moved = xs.withColumn("it", F.explode(F.sequence(F.lit(start), F.lit(min(start + block, iterations) - 1)))).withColumn("_i", place("_i", "_n", "_key", "it")).drop("_n", "_key")
        met = moved.join(given, [*key, "_i"])
        one = ["super_group", "horizon", "it"]
        equal = met.groupBy(*one, "_r", "excess").agg(*[f for k in fs for f in (F.count(f"x{k}").alias(f"n{k}"), F.sum(f"x{k}").alias(f"s{k}"), F.sum(c(f"x{k}") * c(f"x{k}")).alias(f"q{k}"))])
        w = Window.partitionBy(*one, "_r").orderBy("excess")
        mids = equal.withColumns({f"y{k}": F.sum(f"n{k}").over(w) - (c(f"n{k}") - 1) / 2 for k in fs})
        n, s, y = (lambda k, p=p: c(f"{p}{k}") for p in "nsy")
        parts = mids.groupBy(*one, "_r").agg(*[f.alias(f"{name}{k}") for k in fs for name, f in (("n", F.sum(n(k))), ("v", F.count_if(n(k) > 0)), ("s", F.sum(s(k))), ("q", F.sum(f"q{k}")), ("sy", F.sum(s(k) * y(k))), ("y", F.sum(n(k) * y(k))), ("yy", F.sum(n(k) * y(k) * y(k))))])
        w = Window.partitionBy(*one).orderBy("_r")  # at most 256 rows
        off = lambda k: c(f"o{k}")
        parts = parts.withColumns({f"o{k}": F.sum(f"n{k}").over(w) - n(k) for k in fs})
        cells = parts.groupBy(*one).agg(*[f.alias(f"{name}{k}") for k in fs for name, f in (("n", F.sum(n(k))), ("v", F.sum(f"v{k}")), ("q", F.sum(f"q{k}")), ("sy", F.sum(c(f"sy{k}") + off(k) * s(k))), ("y", F.sum(y(k) + off(k) * n(k))), ("yy", F.sum(c(f"yy{k}") + 2 * off(k) * y(k) + off(k) * off(k) * n(k))))])
        spread = lambda k: c(f"yy{k}") - c(f"y{k}") * c(f"y{k}") / n(k)
        # centred mid-ranks are exact halves: those of a constant add up to 0 exactly
        ic = lambda k: F.when((c(f"v{k}") >= 2) & (c(f"q{k}") > 0), F.abs(c(f"sy{k}")) / F.sqrt(c(f"q{k}") * spread(k)))
        told = saved(cells.select("super_group", "horizon", F.explode(F.array_compact(F.array(*[ic(k) for k in fs]))).alias("ic")), "null-correlations")
        out = told if out is None else out.unionByName(told)
    return out


def _column(field: str) -> Column:
    """A field of the collected rows as an array; dates as days."""
    return F.transform("rows", lambda x: F.datediff(x[field], F.lit("1970-01-01").cast("date")) if field == "d" else x[field])


def _mixed(h: np.ndarray, seed: int, iteration: int) -> np.ndarray:
    """Order keys of an iteration: a 64-bit finaliser of the rows' hashes and the iteration's number."""
    return _finalised(h.astype(np.int64).view(np.uint64) ^ np.uint64((seed * 1_000_003 + iteration + 1) * 0x9E3779B97F4A7C15 % 2**64))


def _finalised(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_midranks = midranks


def _null_cells(horizon: np.ndarray, factors: list[np.ndarray]) -> dict:
    """Per horizon, the rows of every factor that count, with the centred mid-ranks of its values."""
    out = {}
    for hz in np.unique(horizon):
        of = []
        for f in factors:
            at = np.flatnonzero((horizon == hz) & ~np.isnan(f))
            if len(at) >= 2:
                x = _midranks(f[at])
                x = x - x.mean()
                if (x != 0).any():
                    of.append((at, x / np.sqrt((x * x).sum())))
        out[hz] = of
    return out


def _null_correlations(given: np.ndarray, cells: list) -> np.ndarray:
    out = []
    for at, x in cells:
        y = _midranks(given[at])
        y = y - y.mean()
        size = np.sqrt((y * y).sum())
        if size > 0:
            out.append(abs(float((x * y).sum() / size)))
    return np.array(out)


def false_discovery(strongest: DataFrame, thresholds: DataFrame, n_factors: int, share: float = 0.01) -> DataFrame:
    """One row: cells tested, how many groups' strongest ic passes the first threshold, how many would by chance, their ratio, and a verdict.

    strongest: super_group, horizon, ic; thresholds: super_group, horizon, t99.
    """
    both = thresholds.join(strongest.select("super_group", "horizon", "ic"), ["super_group", "horizon"], "left")
    g = both.agg((F.count("*") * n_factors).alias("tested"), F.count_if(F.abs("ic") >= F.col("t99")).alias("surviving"))
    g = g.withColumn("expected", F.col("tested") * share)
    g = g.withColumn("ratio", F.when(F.col("expected") > 0, F.col("surviving") / F.col("expected")).otherwise(0.0))
    return g.withColumn("verdict", F.when(F.col("ratio") > 5, "real-signal").when(F.col("ratio") > 2, "marginal").otherwise("noise"))


def three_gate(cells: DataFrame, rolling: DataFrame, thresholds: DataFrame, threshold: str = "t99", least_ic: float = 0.05, least_spans: int = 2) -> DataFrame:
    """cells with verdict: pass, or the first gate that fails: insufficient, statistical, economic or stability."""
    same = rolling.where("ic is not null").select(*CELL, F.col("ic").alias("_w")).join(cells.select(*CELL, "ic"), CELL).groupBy(*CELL).agg(F.count_if(F.signum("_w") == F.signum("ic")).alias("same_sign"))
    df = cells.join(same, CELL, "left").join(thresholds.select("super_group", "horizon", F.col(threshold).alias("threshold")), ["super_group", "horizon"], "left")
    size = F.abs("ic")
    verdict = F.when(F.col("ic").isNull() | F.col("threshold").isNull(), "insufficient").when(size < F.col("threshold"), "statistical").when(size < least_ic, "economic").when(F.coalesce("same_sign", F.lit(0)) < least_spans, "stability").otherwise("pass")
    return df.withColumn("verdict", verdict)


def ic_summary(gated: DataFrame) -> DataFrame:
    """Verdict counts per horizon."""
    return gated.groupBy("horizon").pivot("verdict", ["pass", "statistical", "economic", "stability", "insufficient"]).count().na.fill(0)


def heat_map(gated: DataFrame, factors: Sequence[str]) -> DataFrame:
    """ic of passing cells: one row per group and horizon, one column per factor."""
    return gated.groupBy("super_group", "horizon").pivot("factor", list(factors)).agg(F.first(F.when(F.col("verdict") == "pass", F.col("ic"))))


def strongest_cells(cells: DataFrame) -> DataFrame:
    return cells.where("ic is not null").groupBy("super_group", "horizon").agg(F.max_by(F.struct("factor", "ic"), F.struct(F.abs("ic"), "factor")).alias("_x")).select("super_group", "horizon", "_x.*")


def candidate_scores(observations: DataFrame, weights: DataFrame, sub_weights: DataFrame | None = None, excluded: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """(candidate, d, symbol, horizon, extra, score, excess): weighted mean of category scores present; null without weight.

    observations: d, symbol, horizon, category, factor, pct, excess, and direction where excluded is
    given; weights: candidate, category, w; sub_weights: candidate, category, factor, w, which replace
    the plain mean of that category's factors, unlisted ones counting nothing; excluded: candidate,
    direction of rows that the candidate does not see. The three are short lists: they become one pass of sums over
    a name's observations, which move once, not once a candidate.
    """
    c = F.col
    told = [(r["candidate"], r["category"], r["w"]) for r in weights.select("candidate", "category", "w").collect() if r["w"] is not None]
    subs, out = {}, {}
    for r in sub_weights.select("candidate", "category", "factor", "w").collect() if sub_weights is not None else []:
        subs.setdefault((r["candidate"], r["category"]), {})[r["factor"]] = r["w"]
    for r in excluded.select("candidate", "direction").collect() if excluded is not None else []:
        out.setdefault(r["candidate"], set()).add(r["direction"])
    # a category's mean is the same for all candidates with the same shares and directions: one sum each, whatever the candidates
    means: dict = {}
    by_candidate: dict = {}
    for name, category, w in told:
        mean = (category, tuple(sorted(subs.get((name, category), {}).items())), (name, category) in subs, tuple(sorted(x for x in out.get(name, ()) if x is not None)))
        by_candidate.setdefault(name, []).append((means.setdefault(mean, len(means)), float(w)))
    sums = []
    for (category, shares, own, without), k in means.items():
        share = F.lit(1.0)
        if own:
            share = F.lit(None).cast("double")
            for factor, w in shares:
                share = F.when(c("factor") == factor, w).otherwise(share)
        of = c("category") == category
        if without:
            of = of & ~F.coalesce(c("direction").isin(*without), F.lit(False))
        sums += [F.sum(F.when(of, c("pct") * share)).alias(f"_p{k}"), F.sum(F.when(of, share)).alias(f"_w{k}")]
    if not sums:
        raise ValueError("no weights")
    names = observations.where("pct is not null").groupBy("d", "symbol", "horizon", *extra).agg(F.first("excess").alias("excess"), *sums)
    names = names.select("d", "symbol", "horizon", *extra, "excess", *[F.when(c(f"_w{k}") > 0, c(f"_p{k}") / c(f"_w{k}")).alias(f"_s{k}") for k in means.values()])
    rows = []
    for name, of in by_candidate.items():
        total = sum((F.when(c(f"_s{k}").isNotNull(), w).otherwise(0.0) for k, w in of), F.lit(0.0))
        score = sum((F.coalesce(c(f"_s{k}") * w, F.lit(0.0)) for k, w in of), F.lit(0.0)) / total
        rows.append(F.when(F.coalesce(*[c(f"_s{k}") for k, _ in of]).isNotNull(), F.struct(F.lit(name).alias("candidate"), F.when(total > 0, score).alias("score"))))
    scored = names.select("d", "symbol", "horizon", *extra, "excess", F.explode(F.array_compact(F.array(*rows))).alias("_c"))
    return scored.select("_c.candidate", "d", "symbol", "horizon", *extra, "_c.score", "excess")


def decile_performance(scores: DataFrame, extra: Sequence[str] = (), share: float = 0.1, least: int = 10) -> DataFrame:
    """(candidate, horizon, extra, d, top, bottom): mean excess of the best and worst share of names of every date with at least least.

    A date's names are dealt into ranges of the score by sampled splitters; the places in the ranges below and above come from sums, so that no task orders a date.
    """
    by = ["candidate", "horizon", *extra, "d"]
    # null keys are groups too
    g = [f"_g{k}" for k in range(len(by))]
    rows = saved(scores.where("score is not null and excess is not null").select(*[F.struct(F.col(x)).alias(k) for k, x in zip(g, by)], "symbol", "score", "excess"), "scores")
    dealt = saved(ranged(rows, "score", g, splitters(rows, "score", g)), "dealt-scores")
    w = Window.partitionBy(*g)  # at most 256 rows
    counts = dealt.groupBy(*g, "_r").agg(F.count("*").alias("_t"))
    counts = counts.select(*g, "_r", F.sum("_t").over(w).alias("_n"), (F.sum("_t").over(w.orderBy("_r")) - F.col("_t")).alias("_below"), (F.sum("_t").over(w.orderBy(F.desc("_r"))) - F.col("_t")).alias("_above"))
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    # only ranges that reach into a share are ordered
    near = saved(counts.where((F.col("_n") >= least) & ((F.col("_above") < k) | (F.col("_below") < k))), "near-ranges")
    inside = Window.partitionBy(*g, "_r")
    placed = dealt.join(small(near, 256), [*g, "_r"]).withColumns({"_up": F.row_number().over(inside.orderBy(F.desc("score"), "symbol")) + F.col("_above"), "_down": F.row_number().over(inside.orderBy("score", "symbol")) + F.col("_below")})
    ends = placed.groupBy(*g).agg(F.avg(F.when(F.col("_up") <= k, F.col("excess"))).alias("top"), F.avg(F.when(F.col("_down") <= k, F.col("excess"))).alias("bottom"))
    return ends.select(*[F.col(x)[n].alias(n) for x, n in zip(g, by)], "top", "bottom")


def performance_summary(daily: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per candidate and horizon: dates, means, sharpe (sample deviation), sortino (downside RMS) and drawdown of the running mean."""
    by = ["candidate", "horizon", *extra]
    w = Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("_m", F.avg("top").over(w))
    df = df.withColumn("_dd", F.col("_m") - F.max("_m").over(w))
    sd, down = F.stddev_samp("top"), F.sqrt(F.avg(F.when(F.col("top") < 0, F.col("top") * F.col("top"))))
    return df.groupBy(*by).agg(
        F.count("*").alias("dates"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom"),
        F.when(sd > 0, F.avg("top") / sd).alias("sharpe"), F.when(down > 0, F.avg("top") / down).alias("sortino"), F.least(F.lit(0.0), F.min("_dd")).alias("drawdown"),
    )


def adoption_verdicts(daily: DataFrame, baseline: str, horizon: int = 3, least_gain: float = 0.03, resamples: int = 1000) -> DataFrame:
    """Per candidate of daily but the baseline: n, mean, bootstrap bounds, gain over the baseline's mean at horizon, verdict (adopt or reject) and reason.

    A candidate, or all of them for want of a baseline, without dates at horizon is rejected for want of data.
    """
    rows = daily.where(F.col("horizon") == horizon)
    ci = bootstrap_means(rows, "top", ["candidate"], ["d"], resamples)
    base = ci.where(F.col("candidate") == baseline).agg(F.max("mean").alias("_b"))  # one row
    names = daily.select("candidate").distinct().where(F.col("candidate") != baseline)
    df = names.join(ci, "candidate", "left").join(F.broadcast(base)).withColumn("gain", F.col("mean") - F.col("_b"))
    gain, lo = F.col("gain"), F.col("lo")
    reason = F.when(gain.isNull(), "insufficient data").when(gain < least_gain, "below the adoption floor").when(lo.isNull() | (lo <= 0), "interval crosses zero").otherwise("above the floor and zero")
    adopt = F.coalesce((gain >= least_gain) & (lo > 0), F.lit(False))
    return df.select("candidate", "n", "mean", "lo", "hi", "gain", F.when(adopt, "adopt").otherwise("reject").alias("verdict"), reason.alias("reason"))


HITS = ("p25", "median", "p75")


def accuracy_rows(valued: DataFrame, bars: DataFrame, benchmarks: DataFrame | None = None, horizons: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(d, symbol, horizon, price, p25, median, p75, ..., end_price, peak, trough, ret_pct, hit_*, peak_hit_*, excess_<benchmark>) of fair values (d, symbol, price, p25, median, p75).

    The end is the first close at or after d + horizon years; peak and trough are those of the closes from d to that day. Rows without
    an end have an open window, rows without a close inside tell nothing: both are left out. benchmarks: see with_benchmarks.
    """
    due = F.lit(None).cast("date")
    for h in horizons:
        due = F.when(F.col("horizon") == h, add_years(F.col("d"), h)).otherwise(due)
    valued = valued.where("price > 0")
    probes = valued.select("symbol", "d").distinct().withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("_due", due)
    # keys and figures alone are sorted; what else a row holds comes back by one join
    window = forward_extremes(valued, bars, ["symbol"], "d", horizons, "date", "close").select("symbol", "d", F.col("_years").alias("horizon"), "_hi", "_lo")
    ends = asof_join(probes, bars, ["symbol"], "_due", "date", ["close"], forward=True).select("symbol", "d", "horizon", "close")
    told = window.unionByName(ends, allowMissingColumns=True).groupBy("symbol", "d", "horizon").agg(F.max("close").alias("end_price"), F.max("_hi").alias("peak"), F.min("_lo").alias("trough"))
    out = valued.join(told.where("end_price is not null and peak is not null"), ["d", "symbol"])
    out = out.withColumn("ret_pct", (F.col("end_price") - F.col("price")) / F.col("price") * 100)
    out = out.withColumns({f"{kind}hit_{x}": F.when(F.col(x).isNotNull(), F.col(reached) >= F.col(x)) for kind, reached in (("", "end_price"), ("peak_", "peak")) for x in HITS})
    return out if benchmarks is None else with_benchmarks(out, benchmarks)


def with_benchmarks(rows: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """accuracy_rows with bench_<name> and excess_<name> for every benchmark of benchmarks: name, d, horizon, ret_pct (a few rows a date)."""
    names = sorted(r[0] for r in benchmarks.select("name").distinct().collect())  # a fixed list
    if not names:
        return rows
    wide = benchmarks.groupBy("d", "horizon").agg(*[F.max(F.when(F.col("name") == n, F.col("ret_pct"))).alias(f"bench_{n}") for n in names])
    out = rows.join(wide, ["d", "horizon"], "left")
    return out.withColumns({f"excess_{n}": F.col("ret_pct") - F.col(f"bench_{n}") for n in names})


def apply_overlay(rows: DataFrame, annual_pct: float) -> DataFrame:
    """accuracy_rows with a yearly income of annual_pct added to every return and excess; nothing changes at 0 or below."""
    if annual_pct <= 0:
        return rows
    bump = F.lit(annual_pct) * F.col("horizon")
    return rows.withColumns({c: F.col(c) + bump for c in rows.columns if c == "ret_pct" or c.startswith("excess_")})


def accuracy(rows: DataFrame, strata: Sequence[str], least: int = 30, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Per strata: n, rates of hits at the end and at the peak with Wilson bounds, means of the return and the excesses with bootstrap bounds; null under least values."""
    values = ["ret_pct", *sorted(c for c in rows.columns if c.startswith("excess_"))]
    kinds = [f"{kind}{x}" for kind in ("", "peak_") for x in HITS if f"{kind}hit_{x}" in rows.columns]
    column = lambda x: f"peak_hit_{x[5:]}" if x.startswith("peak_") else f"hit_{x}"
    hits = {x: (F.count_if(F.col(column(x))), F.count(column(x))) for x in kinds}
    g = rows.groupBy(*strata).agg(F.count("*").alias("n"), *[k.alias(f"_k_{x}") for x, (k, _) in hits.items()], *[m.alias(f"_m_{x}") for x, (_, m) in hits.items()])
    cols = [F.col(c) for c in (*strata, "n")]
    for x in kinds:
        k, m = F.col(f"_k_{x}"), F.col(f"_m_{x}")
        lo, hi = wilson(k, m)
        cols += [F.when(m >= least, v).alias(name) for v, name in ((k / m, f"rate_{x}"), (lo, f"rate_{x}_lo"), (hi, f"rate_{x}_hi"))]
    out = g.select(*cols)
    # the means of all values in one pass: a value is one more key
    long = rows.select(*strata, "d", "symbol", F.explode(F.array(*[F.struct(F.lit(v).alias("what"), F.col(v).alias("value")) for v in values])).alias("_x")).select(*strata, "d", "symbol", "_x.*")
    means = bootstrap_means(long, "value", [*strata, "what"], ["d", "symbol"], resamples, seed).where(F.col("n") >= least)
    wide = means.groupBy(*strata).agg(*[F.max(F.when(F.col("what") == v, F.col(c))).alias(f"{v}_{c}") for v in values for c in ("mean", "lo", "hi")])
    on = [out[c].eqNullSafe(wide[c]) for c in strata]
    return out.join(wide, on, "left").select(*[out[c] for c in out.columns], *[c for c in wide.columns if c not in strata])


def hit_verdict(lo: Column, hi: Column, threshold: float) -> Column:
    return F.when(lo.isNull(), "inconclusive").when(lo >= threshold, "pass").when(hi < threshold, "fail").otherwise("inconclusive")


def hypotheses(rows: DataFrame, least: int = 30, resamples: int = 1000) -> DataFrame:
    """(id, n, verdict): six statements about accuracy_rows, each pass, fail or inconclusive.

    H1 and H2: names below p25 (the median) reach it in three years at 60 % (50 %) or more. H3: candidates
    beat each benchmark over each horizon. H4: where the outlier rule fired the excess is no worse. H5:
    high confidence has the narrower interval of the mean. H6: divergent cohorts hit p25 less. Also
    needs candidate, outlier_fired, confidence and divergent.
    """
    c = F.col
    three = c("horizon") == 3
    tags = [
        F.when(three & (c("price") < c("p25")), "H1"), F.when(three & (c("price") < c("median")), "H2"),
        F.when(c("candidate"), F.concat(F.lit("H3-"), c("horizon").cast("string"), F.lit("y"))),
        F.when(three, F.when(c("outlier_fired"), "H4-fired").otherwise("H4-other")), F.when(three & c("confidence").isin("high", "low"), F.concat(F.lit("H5-"), c("confidence"))),
        F.when(three, F.when(c("divergent"), "H6-divergent").otherwise("H6-stable")),
    ]
    tagged = rows.withColumn("id", F.explode(F.array_compact(F.array(*tags))))
    a = accuracy(tagged, ["id"], least, resamples)
    names = sorted(x[7:-5] for x in a.columns if x.startswith("excess_") and x.endswith("_mean"))
    plain = a.where("id in ('H1', 'H2')").select("id", "n", F.when(c("id") == "H1", hit_verdict(c("rate_p25_lo"), c("rate_p25_hi"), 0.60)).otherwise(hit_verdict(c("rate_median_lo"), c("rate_median_hi"), 0.50)).alias("verdict"))
    beat = lambda b: F.when(c(f"excess_{b}_lo") > 0, "pass").when(c(f"excess_{b}_hi") < 0, "fail").otherwise("inconclusive")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), beat(b).alias("verdict")) for b in names]))
    third = a.where("id like 'H3-%'").select("id", "n", each.alias("_x")).select(F.concat_ws("-", F.lit("H3"), F.col("_x.b"), F.substring("id", 4, 9)).alias("id"), "n", F.col("_x.verdict").alias("verdict"))
    first = names[0] if names else None
    value = F.when(c("id").startswith("H4"), c(f"excess_{first}_mean") if first else F.lit(None)).when(c("id").startswith("H5"), c("ret_pct_hi") - c("ret_pct_lo")).otherwise(c("rate_p25"))
    two = a.where("id rlike '^H[456]'").select(F.substring("id", 1, 2).alias("h"), F.substring("id", 4, 20).alias("side"), "n", value.alias("v")).groupBy("h").agg(
        F.sum("n").alias("n"), F.max(F.when(c("side").isin("fired", "high", "divergent"), c("v"))).alias("x"), F.max(F.when(~c("side").isin("fired", "high", "divergent"), c("v"))).alias("y")
    )
    better = F.when(c("h") == "H4", c("x") >= c("y")).otherwise(c("x") < c("y"))
    return plain.unionByName(third).unionByName(two.select(c("h").alias("id"), "n", F.when(c("x").isNull() | c("y").isNull(), "inconclusive").when(better, "pass").otherwise("fail").alias("verdict")))


def recovery(flags: DataFrame, bars: DataFrame, months: int = 24, unmatched: bool = False) -> DataFrame:
    """flags (d, symbol, price, target) with recovered, the first date in (d, d + months] whose high reaches the target, days, peak and final gains.

    final is the last close in the window, the entry price without one. A flag without any bar in its window tells nothing
    and is left out; with unmatched it stays, as not recovered. Time is cut into spans of as many months as a window has: a flag is two rows, which
    meet the bars of their spans only.
    """
    f = flags.select("d", "symbol", "price", "target", F.add_months("d", months).alias("_to"))
    span = lambda t: F.floor((F.year(t) * 12 + F.month(t)) / max(1, months)).cast("int")
    f = f.withColumn("_m", F.explode(F.sequence(span("d"), span("_to"))))
    b = bars.select(F.col("symbol").alias("_s"), span("date").alias("_bm"), F.col("date").alias("_t"), "high", "close")
    j = f.join(b, (F.col("symbol") == F.col("_s")) & (F.col("_m") == F.col("_bm")) & (F.col("_t") > F.col("d")) & (F.col("_t") <= F.col("_to")), "left")
    last = F.max_by("close", F.when(F.col("_t").isNotNull(), F.struct("_t", "close")))
    g = (j if unmatched else j.where("_t is not null")).groupBy("d", "symbol", "price", "target").agg(F.min(F.when(F.col("high") >= F.col("target"), F.col("_t"))).alias("recovered_on"), F.max("high").alias("peak"), F.coalesce(last, F.first("price")).alias("final"))
    gain = lambda x: F.when(F.col("price") > 0, F.col(x) / F.col("price") - 1)
    return g.select("d", "symbol", "price", "target", F.col("recovered_on").isNotNull().alias("recovered"), "recovered_on", F.datediff("recovered_on", "d").alias("days"), gain("peak").alias("peak_gain"), "final", gain("final").alias("final_gain"))


def recovery_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of recovery rows: n, rate, shares within 3, 6, 12, 18, 24 months, quartiles of the gains of those that came back, and what the others did."""
    c = F.col
    within = [(F.count_if(c("days") <= m * 30.44) / F.count("*")).alias(f"within_{m}m") for m in (3, 6, 12, 18, 24)]
    back = lambda x: F.when(c("recovered"), c(x))
    quart = [F.percentile(back(f"{k}_gain"), F.lit(q)).alias(f"{k}_{n}") for k in ("peak", "final") for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    kind = F.when(~c("recovered"), non_recovery_class(c("price"), c("final")))
    shares = [(F.count_if(kind == k) / F.count("*")).alias(k.replace("-", "_")) for k in ("lost", "stable", "partial-gain")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if("recovered") / F.count("*")).alias("rate"), *within, *quart, *shares)


def kept_or_demoted(rows: DataFrame, keep: Column) -> DataFrame:
    """One row: recovery and loss rates of the flags kept and of the others, and their differences in points."""
    lost = F.coalesce(~F.col("recovered") & (non_recovery_class(F.col("price"), F.col("final")) == "lost"), F.lit(False))
    r = rows.withColumns({"_keep": F.coalesce(keep, F.lit(False)), "_lost": lost})
    rate = lambda what, side: F.avg(F.when(side, F.col(what).cast("double"))) * 100
    k, d = F.col("_keep"), ~F.col("_keep")
    g = r.agg(F.count_if(k).alias("kept"), F.count_if(d).alias("demoted"), rate("recovered", k).alias("kept_recovery"), rate("recovered", d).alias("demoted_recovery"), rate("_lost", k).alias("kept_lost"), rate("_lost", d).alias("demoted_lost"))
    return g.withColumns({"recovery_gap": F.col("kept_recovery") - F.col("demoted_recovery"), "lost_gap": F.col("kept_lost") - F.col("demoted_lost")})


def strata_means(rows: DataFrame, value: str, strata: Sequence[Sequence[str]]) -> DataFrame:
    """n, mean and quartiles of value over several groupings of one table in one pass; a column outside a grouping is null."""
    names = list(dict.fromkeys(c for s in strata for c in s))
    g = rows.groupingSets([[F.col(c) for c in s] for s in strata], *[F.col(c) for c in names])
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, F.lit(q)).alias(n) for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))])


def better_ranked(picks: DataFrame, ranked: DataFrame, group: str = "sector", most: int = 5) -> DataFrame:
    """Per pick (d, symbol), the names of its group ranked above it, most at the top: d, symbol, peer, peer_rank."""
    w = Window.partitionBy("d", group).orderBy(F.desc("score"), "symbol")
    placed = ranked.withColumn("_r", F.row_number().over(w))
    mine = placed.join(picks.select("d", "symbol"), ["d", "symbol"], "left_semi").select("d", group, "symbol", F.col("_r").alias("_mine"))
    top = placed.where(F.col("_r") <= most).select("d", group, F.col("symbol").alias("peer"), F.col("_r").alias("peer_rank"))
    return mine.join(top, ["d", group]).where("peer_rank < _mine").select("d", "symbol", "peer", "peer_rank")


def user_picks(picks: DataFrame, scored: DataFrame, most: int = 5, cells: int = 1000) -> DataFrame:
    """Per pick (d, symbol): composite, its place among all names of the date and of its super-group, their sizes, realised excess, and the best names above it.

    scored: d, symbol (one row each), super_group (may be null: those are a group), composite (0 to 100; null counts as absent), excess_1, excess_3.
    Best first, ties by symbol. better: at most `most` names of the super-group above the pick, as structs of symbol, composite, rank, excess_1,
    excess_3. A pick that cannot be placed has reason: no universe at the date, or not in it. Repeated picks are one.

    Names are counted in cells of the scale of composites. A place is the count of the cells above plus the place
    inside the cell, and only cells that hold a pick, or a super-group's first names, are ranked: no window holds a date.
    """
    c = F.col
    valid = scored.where("composite is not null").select("d", "symbol", F.struct("super_group").alias("_g"), "composite", "excess_1", "excess_3", F.least(F.greatest(F.floor((100 - F.col("composite")) * (cells / 100)), F.lit(0)), F.lit(cells - 1)).alias("_cell"))
    groups = {"d": ["d"], "g": ["d", "_g"]}
    counts = valid.groupBy("d", "_g", "_cell").agg(F.count("*").alias("_n"))
    above, inside = {}, {}
    for name, by in groups.items():
        w = Window.partitionBy(*by)  # of cells, not of names
        n = counts.groupBy(*by, "_cell").agg(F.sum("_n").alias("_n"))
        above[name] = n.select(*by, "_cell", (F.sum("_n").over(w.orderBy("_cell")) - c("_n")).alias(f"_above_{name}"), F.sum("_n").over(w).alias(f"_size_{name}"))
        inside[name] = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(F.desc("composite"), "symbol"))
    asked = picks.select("d", "symbol").distinct()
    mine = valid.join(asked, ["d", "symbol"], "left_semi").withColumn("_mine", F.lit(True))
    held = valid.join(mine.select("d", "_cell").distinct(), ["d", "_cell"], "left_semi")
    placed = held.withColumn("_k_d", inside["d"]).withColumn("_k_g", inside["g"]).join(asked, ["d", "symbol"], "left_semi")
    for name, by in groups.items():
        placed = placed.join(above[name], [*by, "_cell"])
    placed = placed.select("d", "symbol", "_g", "composite", "excess_1", "excess_3", *[x for name, out in (("d", "universe"), ("g", "super_group")) for x in ((c(f"_k_{name}") + c(f"_above_{name}")).alias(f"rank_in_{out}"), c(f"_size_{name}").alias(f"{out}_size"))])
    first = valid.join(above["g"].where(c("_above_g") < most), ["d", "_g", "_cell"]).join(placed.select("d", "_g").distinct(), ["d", "_g"], "left_semi")
    peer = F.struct((inside["g"] + c("_above_g")).alias("rank"), "symbol", "composite", "excess_1", "excess_3")
    top = first.select("d", "_g", peer.alias("_p")).where(c("_p.rank") <= most).groupBy("d", "_g").agg(F.sort_array(F.collect_list("_p")).alias("_top"))
    placed = placed.join(top, ["d", "_g"])
    placed = placed.withColumn("better", F.filter("_top", lambda p: p["rank"] < c("rank_in_super_group"))).withColumn("super_group", c("_g.super_group")).drop("_top", "_g")
    dates = valid.select("d").distinct().withColumn("_known", F.lit(True))
    out = asked.join(placed, ["d", "symbol"], "left").join(dates, "d", "left")
    reason = F.when(c("_known").isNull(), "no snapshot universe").when(c("composite").isNull(), "not in universe")
    return out.withColumn("reason", reason).drop("_known")


def floor_flags(panel: DataFrame, least_years: int = 3, years: int = 3, roic: float = 0.08, roic_percentile: float = 33, coverage: float = 5, coverage_percentile: float = 25, least_peers: int = 3) -> DataFrame:
    """panel with pass_profit, pass_roic, pass_coverage and pass_combined, each rule by itself; null where it cannot be judged.

    Peers are the row's sector at d, itself included. A ROIC or coverage at the absolute bound passes;
    below it the percentile among peers decides, with few peers a plain bound. Without interest the
    coverage passes. Short histories leave the profit rule open and fail the combined one.
    """
    c = F.col
    by = ["d", "sector"]
    cov = F.when((c("interest0") > 0) & c("ebit0").isNotNull(), c("ebit0") / c("interest0"))
    df = panel.withColumn("_cov", cov)
    df = df.withColumns({"_rp": midrank_percentile("avg_roic", by), "_cp": midrank_percentile("_cov", by), "_rn": F.count("avg_roic").over(Window.partitionBy(*by)), "_cn": F.count("_cov").over(Window.partitionBy(*by))})
    own = c("avg_roic")
    pass_roic = F.when(own.isNotNull(), F.when(own >= roic, True).when(c("_rn") < least_peers, own > 0).otherwise(c("_rp") >= roic_percentile))
    pass_cov = F.when(~F.coalesce(c("interest0") > 0, F.lit(False)), True).when(c("_cov").isNotNull(), F.when(c("_cov") >= coverage, True).when(c("_cn") < least_peers, c("_cov") >= 1).otherwise(c("_cp") >= coverage_percentile))
    profit = c("profitable_years") >= years
    df = df.withColumns({"pass_profit": F.when(c("n_periods") >= least_years, profit), "pass_roic": pass_roic, "pass_coverage": pass_cov})
    whole = (c("n_periods") >= least_years) & profit & F.coalesce("pass_roic", F.lit(True)) & F.coalesce("pass_coverage", F.lit(True))
    return df.withColumn("pass_combined", F.coalesce(whole, F.lit(False))).drop("_cov", "_rp", "_cp", "_rn", "_cn")


RULES = ("pass_profit", "pass_roic", "pass_coverage", "pass_combined")


def floor_audit(flags: DataFrame, excess: DataFrame, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """Per rule, horizon and outcome: n, mean excess and its bootstrap bounds (null under five)."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("passed")) for r in RULES]))
    rows = flags.select("d", "symbol", rules.alias("_x")).select("d", "symbol", "_x.*").where("passed is not null")
    return _strata(rows.join(excess.select("d", "symbol", "horizon", "excess"), ["d", "symbol"]), ["rule", "horizon", "passed"], resamples, seed)


def _strata(rows: DataFrame, by: Sequence[str], resamples: int, seed: int) -> DataFrame:
    # read several times
    rows = saved(rows.select(*by, "d", "symbol", "excess"), "strata")
    out = bootstrap_means(rows, "excess", by, ["d", "symbol"], resamples, seed)
    few = F.col("n") >= 5
    return out.select(*by, "n", F.col("mean").alias("mean_excess"), F.when(few, F.col("lo")).alias("lo"), F.when(few, F.col("hi")).alias("hi"))


def gap_verdict(gap: Column, worse_is: str, better_is: str, bound: float = 0.02) -> Column:
    """A verdict on a difference of means: beyond the bound below or above, else inconclusive."""
    return F.when(gap < -bound, worse_is).when(gap > bound, better_is).otherwise("inconclusive")


def floor_verdict(audit: DataFrame, horizon: int = 3) -> DataFrame:
    """One row: gap of the mean excess of rows that pass the combined floor over those that fail, and whether that justifies it."""
    rows = audit.where((F.col("rule") == "pass_combined") & (F.col("horizon") == horizon))
    gap = F.max(F.when(F.col("passed"), F.col("mean_excess"))) - F.max(F.when(~F.col("passed"), F.col("mean_excess")))
    return rows.agg(gap.alias("gap")).withColumn("verdict", gap_verdict(F.col("gap"), "fail", "pass"))


# ---------------------------------------------------------------- fair values over time


def fv_trend(series: DataFrame, years: int = 2, least: int = 6, bound: float = 5.0) -> DataFrame:
    """Per symbol of series (symbol, date, fv_median): trend, slope_pct, first and last values, change_pct, samples in the window of years up to the last value above 0."""
    c = F.col
    good = series.where("fv_median > 0")
    last = good.groupBy("symbol").agg(F.max("date").alias("_end"))
    inside = good.join(last, "symbol").where(c("date") >= F.add_months("_end", -12 * years))
    x = F.datediff("date", F.lit("1970-01-01").cast("date")) / 365.25
    g = inside.groupBy("symbol").agg(F.count("*").alias("samples"), F.min("date").alias("window_start"), F.max("date").alias("window_end"), F.min_by("fv_median", "date").alias("first"), F.max_by("fv_median", "date").alias("last"), F.regr_slope(c("fv_median"), x).alias("_slope"))
    enough = c("samples") >= least
    g = g.withColumn("slope_pct", F.when(enough, c("_slope") / c("first") * 100)).withColumn("change_pct", F.when(enough, (c("last") - c("first")) / c("first") * 100))
    every = series.select("symbol").distinct().join(g.drop("_slope"), "symbol", "left")
    return every.withColumns({"trend": trend_class(c("slope_pct"), bound), "samples": F.coalesce("samples", F.lit(0)).cast("long")})


def append_today(series: DataFrame, today: DataFrame) -> DataFrame:
    """series with today's samples in place of those of the same symbol and date."""
    return upsert(series, today, ["symbol", "date"])


def fv_trend_audit(series: DataFrame, excess: DataFrame, years: int = 2, least: int = 4, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(trend, horizon, n, mean_excess, lo, hi) of series (d, symbol, fv_median) classed by the slope of their own trailing window.

    Without resamples there are no bounds: a verdict needs means and sizes alone.
    """
    slopes = trailing_slope(series, ["symbol"], "d", "fv_median", 12 * years, least)
    rows = slopes.select("symbol", "d", trend_class(F.col("slope_pct")).alias("trend")).join(excess.select("d", "symbol", "horizon", "excess"), ["d", "symbol"])
    if not resamples:
        return rows.where("excess is not null").groupBy("trend", "horizon").agg(F.count("*").alias("n"), F.avg("excess").alias("mean_excess"))
    return _strata(rows, ["trend", "horizon"], resamples, seed)


def fv_trend_verdict(audit: DataFrame, horizon: int = 3, least: int = 30) -> DataFrame:
    """One row: gap of the mean excess of declining values under stable and improving ones together, and whether it justifies demotion."""
    c = F.col
    rows = audit.where(c("horizon") == horizon)
    of = lambda t, x: F.max(F.when(c("trend") == t, c(x)))
    kept = c("trend").isin("stable", "improving")
    g = rows.agg(of("declining", "mean_excess").alias("_d"), of("declining", "n").alias("_dn"), of("stable", "n").alias("_sn"), (F.sum(F.when(kept, c("mean_excess") * c("n"))) / F.sum(F.when(kept, c("n")))).alias("_k"))
    enough = (c("_dn") >= least) & (c("_sn") >= least)
    return g.select(F.when(enough, c("_d") - c("_k")).alias("gap")).withColumn("verdict", F.coalesce(gap_verdict(c("gap"), "pass", "fail"), F.lit("inconclusive")))


# ---------------------------------------------------------------- portfolios that follow a rule


def static_returns(benchmark: DataFrame, portfolios: Mapping[str, Callable[[Column, Column], Column]], start: str) -> DataFrame:
    """(portfolio, d, horizon, realised, excess) from start on; a portfolio is a function of the benchmark's cumulative return and the years."""
    rows = benchmark.where(F.col("d") >= F.lit(start).cast("date"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("portfolio"), f(F.col("ret"), F.col("horizon")).cast("double").alias("realised")) for n, f in portfolios.items()]))
    return rows.select("d", "horizon", "ret", each.alias("_p")).select("_p.portfolio", "d", "horizon", "_p.realised", (F.col("_p.realised") - F.col("ret")).alias("excess"))


def static_portfolios(collateral_yield: float, premium_yield: float) -> dict[str, Callable[[Column, Column], Column]]:
    """Buying and holding the benchmark, half of it beside puts on it, and puts alone, which earn on collateral and premium."""
    income = lambda years: cumulative_yield(F.lit(collateral_yield + premium_yield), years)
    return {"hold": lambda ret, years: ret, "barbell": lambda ret, years: 0.5 * ret + 0.5 * income(years), "puts": lambda ret, years: income(years)}


#: Yearly turnover and share of income of the static portfolios.
STATIC_TURNOVER = {"hold": (0.0, 0.0), "barbell": (0.5, 0.5), "puts": (1.0, 1.0)}


def mean_by_horizon(benchmark: DataFrame, start: str) -> DataFrame:
    """(horizon, mean_benchmark) of the benchmark's returns from start on."""
    return benchmark.where(F.col("d") >= F.lit(start).cast("date")).groupBy("horizon").agg(F.avg("ret").alias("mean_benchmark"))


def performance(rows: DataFrame, by: Sequence[str], resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(by, n, mean_realised, mean_excess, lo, hi) of rows (by, d, realised, excess)."""
    ci = bootstrap_means(rows, "excess", by, ["d"], resamples, seed).withColumnRenamed("mean", "mean_excess")
    return ci.join(rows.groupBy(*by).agg(F.avg("realised").alias("mean_realised")), list(by))


#: Combined tax rates on income and short gains, and on long gains.
SHORT_RATE, LONG_RATE = 0.37 + 0.133 + 0.038, 0.20 + 0.133 + 0.038


def after_frictions(ret: Column, years: Column, turnover: Column, income_share: Column, round_trip_bps: float = 0.0, short_rate: float = SHORT_RATE, long_rate: float = LONG_RATE) -> dict[str, Column]:
    """A cumulative return after trading costs, and after tax by two rules: long gains only, or by holding time and share of income. Losses are not taxed."""
    net = ret - 2 * (round_trip_bps / 10_000) * turnover * years
    taxed = lambda x: F.when(net <= 0, net).otherwise(x)
    blended = F.when(years <= 1, net * (1 - short_rate)).otherwise(net * income_share * (1 - short_rate) + net * (1 - income_share) * (1 - long_rate))
    return {"after_friction": net, "after_tax_long": taxed(net * (1 - long_rate)), "after_tax_blended": taxed(blended)}


def exclude_directions(rows: DataFrame, column: str, excluded: Sequence[str]) -> DataFrame:
    """rows whose direction is not excluded; unknown ones stay."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*excluded)) if excluded else rows


def usable_dates(dates: DataFrame, cap: Column, today: Column, horizon: int, picks: DataFrame | None = None) -> DataFrame:
    """The dates (d) up to cap whose window of horizon years has closed, and those of picks whatever their window."""
    out = dates.select("d").where((F.col("d") <= cap) & (add_years(F.col("d"), horizon) <= today))
    return (out.unionByName(picks.select("d")) if picks is not None else out).distinct()
