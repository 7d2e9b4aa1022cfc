"""Statistics as column expressions and window shapes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.sources.scratch import saved, small


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is not above zero."""
    return F.when(b > 0, a / b)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between the two nearest order statistics."""
    return F.percentile(x, F.lit(q))


def upper_median(name: str) -> Column:
    """Aggregate: the element at floor(n / 2) of the column's values in order, no averaging."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)")


def floor_quartile(name: str, quarters: int) -> Column:
    """Aggregate: the element at floor(n quarters / 4) of the column's values in order; quarters 1 to 3."""
    return F.expr(f"percentile_disc({1 - quarters / 4}) within group (order by `{name}` desc)")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of hits out of n; null without trials."""
    p = F.when(n > 0, hits / n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def midrank_percentile(value: str, by: Sequence[str]) -> Column:
    """Percentile 0 to 100 of value in its group by the mean rank of its ties; 50 in a group of one, null for null."""
    w = Window.partitionBy(*by, F.col(value).isNull())
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, value))
    n = F.count("*").over(w)
    p = F.when(n == 1, 50.0).otherwise((below + (equal + 1) / 2 - 1) / (n - 1) * 100)
    return F.when(F.col(value).isNotNull(), p)


def midrank(value: str, by: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean."""
    below = F.rank().over(Window.partitionBy(*by).orderBy(value)) - 1
    equal = F.count("*").over(Window.partitionBy(*by, value))
    return below + (equal + 1) / 2


def winsorised_percentile(df: DataFrame, value: str, by: Sequence[str], out: str, low: float = 0.05, high: float = 0.95, least: int = 3) -> DataFrame:
    """df with out: the midrank percentile of value in its group after clipping to the order statistics at low and high.

    Clipping needs least values; fewer than two give 50. A value outside the clipping bounds is 0 or
    100. One sort of the group serves bounds and ranks: inside the bounds a value keeps its rank, and
    those clipped to a bound tie with it.
    """
    v = F.col(value)
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy(F.asc_nulls_last(value))
    # names that cannot meet a column of df's
    df = df.withColumns({"_wp_k": F.row_number().over(ordered), "_wp_first": F.rank().over(ordered), "_wp_eq": F.count(value).over(ordered.rangeBetween(Window.currentRow, Window.currentRow)), "_wp_n": F.count(value).over(whole)})
    n, k, first, eq = (F.col(f"_wp_{x}") for x in ("n", "k", "first", "eq"))
    lo_at = F.floor(n * low) + 1
    hi_at = F.greatest(lo_at, F.ceil(n * high))
    at = lambda place, x: F.max(F.when(k == place, x)).over(whole)
    df = df.withColumns({"_wp_lo": at(lo_at, v), "_wp_hi": at(hi_at, v), "_wp_upto": at(lo_at, first - 1 + eq), "_wp_from": at(hi_at, first - 1)})
    lo, hi = F.col("_wp_lo"), F.col("_wp_hi")
    clipped = n >= least
    below = F.when(clipped & (v == lo), 0).otherwise(first - 1)
    equal = F.when(clipped & (lo == hi), n).when(clipped & (v == lo), F.col("_wp_upto")).when(clipped & (v == hi), n - F.col("_wp_from")).otherwise(eq)
    p = (below + (equal + 1) / 2 - 1) / (n - 1) * 100
    p = F.when(n < 2, 50.0).when(clipped & (v < lo), 0.0).when(clipped & (v > hi), 100.0).otherwise(p)
    return df.withColumn(out, F.when(v.isNotNull(), p)).drop(*[f"_wp_{x}" for x in ("k", "first", "eq", "n", "lo", "hi", "upto", "from")])


#: Parts that ranged_percentile deals values into, at most.
PARTS = 256


def ranged_percentile(df: DataFrame, value: str, by: Sequence[str], out: str, low: float = 0.05, high: float = 0.95, least: int = 3, values_a_range: int = 1_000_000) -> DataFrame:
    """df (a saved table, or cheap to derive from one: it is read several times) with the column out of winsorised_percentile, for groups of any size.

    The values of all groups are dealt into ranges of (group, value), of about values_a_range or of a 256th of all, and ranked inside; how many of a group
    stand in the ranges below comes from sums of a few rows a group. A range far above the mean holds a frequent value: there equal values are
    counted first and are one row. So no task ranks a group, nor all rows of a value. Whether a value is clipped follows from its places alone.
    """
    v = F.col(value).cast("double")
    # null keys are groups too; a group is one number from here on, with the places of its clipping bounds
    keys = [F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]
    groups = saved(df.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")), "groups").withColumn("_id", F.monotonically_increasing_id())
    groups = groups.withColumn("_lo", F.floor(F.col("_n") * low) + 1).withColumn("_hi", F.greatest(F.col("_lo"), F.ceil(F.col("_n") * high)))
    groups = saved(groups, "numbered-groups")
    total = groups.agg(F.sum("_n")).first()[0] or 0
    parts = max(1, min(PARTS, -(-total // values_a_range)))
    on = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    rows = df.withColumn("_v", v).where("_v is not null").join(small(groups), on).select("_id", "_v", *[c for c in df.columns if c not in by and c != out])
    dealt = saved(rows.repartitionByRange(parts, "_id", "_v").withColumn("_r", F.spark_partition_id()), "dealt")
    sums = saved(dealt.groupBy("_id", "_r").agg(F.count("*").alias("_t")), "range-sizes")
    below = F.sum("_t").over(Window.partitionBy("_id").orderBy("_r")) - F.col("_t")
    sums = saved(sums.withColumns({"_o": below, "_tied": F.col("_t") > 4 * total / parts}), "offsets")
    told = dealt.join(small(sums), ["_id", "_r"])
    ordered = Window.partitionBy("_id", "_r").orderBy("_v")
    equal = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = told.where("not _tied").withColumns({"_first": F.rank().over(ordered) - 1, "_eq": equal})
    if not sums.where("_tied").isEmpty():
        counts = told.where("_tied").groupBy("_id", "_r", "_v").agg(F.count("*").alias("_eq"))
        counts = saved(counts.withColumn("_first", F.sum("_eq").over(ordered) - F.col("_eq")), "tied-values")
        ranked = ranked.unionByName(told.where("_tied").join(small(counts), ["_id", "_r", "_v"]).select(*ranked.columns))
    ranked = ranked.withColumn("_first", F.col("_first") + F.col("_o")).join(small(groups), "_id")
    n, first, upto, eq = F.col("_n"), F.col("_first"), F.col("_first") + F.col("_eq"), F.col("_eq")
    at_lo, at_hi = [(first < F.col(x)) & (F.col(x) <= upto) for x in ("_lo", "_hi")]
    mid = lambda under, ties: (under + (ties + 1) / 2 - 1) / (n - 1) * 100
    p = F.when(upto < F.col("_lo"), 0.0).when(first >= F.col("_hi"), 100.0).when(at_lo, mid(F.lit(0), F.when(at_hi, n).otherwise(upto))).when(at_hi, mid(first, n - first)).otherwise(mid(first, eq))
    p = F.when(n < 2, 50.0).when(n < least, mid(first, eq)).otherwise(p)
    named = ranked.select(*[F.col(f"_g{by.index(c)}").alias(c) if c in by else F.col(c) for c in df.columns if c != out], p.alias(out))
    return named.unionByName(df.where(v.isNull()).withColumn(out, F.lit(None).cast("double")).select(*named.columns))


def winsorised_percentiles(v: np.ndarray, low: float = 0.05, high: float = 0.95, least: int = 3) -> np.ndarray:
    """The percentiles of winsorised_percentile for one group's values, by the same steps. NaN is the largest value."""
    n, order = len(v), np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))]) if n else np.zeros(0, dtype=np.int64)
    eq = np.diff(np.r_[first, n])
    out = np.empty(n)
    if n < 2:
        out[:] = 50.0
        return out
    upto, lo = first + eq, int(np.floor(n * low)) + 1
    hi = max(lo, int(np.ceil(n * high)))
    mid = lambda under, ties: (under + (ties + 1) / 2 - 1) / (n - 1) * 100
    p = mid(first, eq)
    if n >= least:
        at_lo, at_hi = ((first < x) & (x <= upto) for x in (lo, hi))
        p = np.where(upto < lo, 0.0, np.where(first >= hi, 100.0, np.where(at_lo, mid(0, np.where(at_hi, n, upto)), np.where(at_hi, mid(first, n - first), p))))
    out[order] = np.repeat(p, eq)
    return out


def midranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, those of equal values at their mean; NaN is the largest value."""
    _, at, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[at]


def rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Spearman of two arrays; None for fewer than two pairs or a constant side."""
    if len(x) < 2:
        return None
    a, b = (midranks(v) - (len(x) + 1) / 2 for v in (x, y))
    size = np.einsum("i,i", a, a) * np.einsum("i,i", b, b)
    return float(np.einsum("i,i", a, b) / np.sqrt(size)) if size > 0 else None


def range_of(value: Column, cuts: Column) -> Column:
    """How many of cuts, a sorted array of at most 256 splitters, lie below value: every sixteenth is looked at first, then the sixteen beside it."""
    n = F.size(cuts)
    coarse = F.transform(F.sequence(F.lit(16), F.greatest(n, F.lit(16)), F.lit(16)), lambda k: F.get(cuts, k - 1))
    whole = F.size(F.filter(coarse, lambda s: s < value))
    return whole * 16 + F.size(F.filter(F.slice(cuts, whole * 16 + 1, F.lit(16)), lambda s: s < value))


def ranged(df: DataFrame, value: str, by: Sequence[str], cuts: DataFrame) -> DataFrame:
    """df with _r: how many of the splitters s (an array) of cuts (by, s) lie below value. Groups of cuts are all those of df's; by may not be null."""
    return df.join(small(cuts, 256 * 9), list(by)).withColumn("_r", range_of(F.col(value), F.col("s"))).drop("s")


def splitters(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, s): up to 255 sampled values that cut each group's values into ranges of like size; written once."""
    return saved(df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, [k / 256 for k in range(1, 256)], 10_000)).alias("s")), "splitters")


#: Rows of a group of spearman that one window may hold, about.
ROWS_A_RANGE = 200_000


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], out: str = "rho", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """One row per group: n and out, the correlation of mid-ranks over rows where both are set; null when n < 2 or a side is constant.

    Groups of over rows_a_range rows are dealt into up to 256 ranges of each side by sampled splitters and ranked inside a range; what stands in
    the ranges below comes from sums of a few hundred rows a group. So no task holds a group.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    # null keys are groups too
    rows = saved(both.select(F.struct(*by).alias("_g"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "pairs")
    # a few rows: groups with a number, by which the rows are then sorted
    sizes = saved(rows.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_id", F.row_number().over(Window.orderBy("_g"))), "group-sizes")
    some = not sizes.where(F.col("_n") > rows_a_range).isEmpty()
    rows = rows.join(small(sizes, 256), "_g").drop("_g")
    if some:
        of = lambda v: F.array_distinct(F.percentile_approx(v, [k / 256 for k in range(1, 256)], 2_000)).alias(f"_s{v}")
        cuts = saved(rows.where(F.col("_n") > rows_a_range).groupBy("_id").agg(of("_x"), of("_y")), "splitters")
        none = F.array().cast("array<double>")
        rows = rows.join(small(cuts, 512 * 9), "_id", "left").withColumns({f"_r{v}": range_of(F.col(v), F.coalesce(f"_s{v}", none)) for v in ("_x", "_y")}).drop("_s_x", "_s_y")
    ranked = rows = rows.drop("_n")
    for v in ("_x", "_y"):
        part = ["_id", f"_r{v}"] if some else ["_id"]
        ordered = Window.partitionBy(*part).orderBy(v)
        rank = F.rank().over(ordered) - 1 + (F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow)) + 1) / 2
        ranked = ranked.withColumn(f"_rank{v}", rank)
        if some:
            sums = saved(rows.groupBy(*part).agg(F.count("*").alias("_t")), "range-sizes")
            below = saved(sums.select(*part, (F.sum("_t").over(Window.partitionBy("_id").orderBy(f"_r{v}")) - F.col("_t")).alias("_o")), "offsets")
            ranked = ranked.join(small(below), part).withColumn(f"_rank{v}", F.col(f"_rank{v}") + F.col("_o")).drop("_o")
    n = F.count("*")
    a, b = "_rank_x", "_rank_y"
    varied = (n >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    # corr divides by zero on a constant side before a condition around it is looked at
    told = ranked.groupBy("_id").agg(n.alias("n"), F.when(varied, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))).alias(out))
    return told.join(small(sizes, 256), "_id").select(*[F.col("_g")[c].alias(c) for c in by], "n", out)


def quartile_bin(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """1 to 4 by a reference distribution's quartiles, each cut belonging to the lower bin."""
    return F.when(value <= q1, 1).when(value <= q2, 2).when(value <= q3, 3).when(value.isNotNull(), 4)


# ---------------------------------------------------------------- seeded draws

_MASK = 0xFFFFFFFF
#: Fixed value: the step of the generator's state.
STEP = 0x6D2B79F5


def _let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of the product of two 32-bit values, without leaving 64 bits."""
    high = F.shiftrightunsigned(a, 16) * b
    return (high.bitwiseAND(F.lit(0xFFFF)) * 65536 + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_MASK))


def draw(seed: Column, k: Column) -> Column:
    """The k-th (from 0) uniform draw in [0, 1) of a generator seeded with seed: a closed form, so that draws can be made anywhere."""
    # the counter is reduced first, so that its product with the step stays inside 64 bits
    state = (seed.cast("long") + ((k.cast("long") + 1).bitwiseAND(F.lit(_MASK))) * F.lit(STEP)).bitwiseAND(F.lit(_MASK))
    first = lambda t: _mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 15)), t.bitwiseOR(F.lit(1)))
    second = lambda x: x.bitwiseXOR((x + _mul32(x.bitwiseXOR(F.shiftrightunsigned(x, 7)), x.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK)))
    last = lambda z: z.bitwiseXOR(F.shiftrightunsigned(z, 14)) / F.lit(4294967296.0)
    return _let(_let(_let(state, first), second), last)


#: Draws made at a time, and values of a group that a row holds, at most.
DRAWS_A_ROW, VALUES_A_ROW = 4_000_000, 1_000_000
#: Groups beyond this size draw by chunks, and rows of a chunk.
LARGE, CHUNK_ROWS = 100_000, 100_000


def draws(seed: int, first: int, count: int) -> np.ndarray:
    """draw(seed, k) for k from first on, as an array."""
    u = np.uint32
    k = np.arange(first + 1, first + count + 1, dtype=np.uint64).astype(u)
    t = k * u(STEP) + u(seed & _MASK)
    x = (t ^ (t >> u(15))) * (t | u(1))
    z = x ^ (x + (x ^ (x >> u(7))) * (x | u(61)))
    return (z ^ (z >> u(14))) / 4294967296.0


def _numbered(df: DataFrame, value: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(by, value as doubles, _i, n) of rows with all values: a row's number from 0 in its group, and the group's size."""
    w = Window.partitionBy(*by)
    return df.where(" and ".join(f"`{c}` is not null" for c in value)).select(*by, *[F.col(c).cast("double").alias(f"_{c}") for c in value], (F.row_number().over(w.orderBy(*order)) - 1).alias("_i"), F.count("*").over(w).alias("n"))


def _interval(sums: DataFrame, by: Sequence[str], confidence: float) -> DataFrame:
    """(by, lo, hi) of rows (by, part, sums array): parts are added up, the resamples ordered; null where there are none."""
    added = F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("part", "sums"))), lambda x: x["sums"]), F.lit(None).cast("array<double>"), lambda a, x: F.when(a.isNull(), x).otherwise(F.zip_with(a, x, lambda p, q: p + q)))
    whole = sums.groupBy(*by).agg(added.alias("_m")).select(*by, F.sort_array(F.filter("_m", lambda x: ~F.isnan(x))).alias("_m"))
    size = F.size("_m")
    at = lambda q: F.get("_m", F.least(F.floor(size * q), size - 1).cast("int"))
    tail = (1 - confidence) / 2
    return whole.select(*by, size.alias("_valid"), at(tail).alias("lo"), at(1 - tail).alias("hi"))


def chunk_draws(seed: int, resample: int, sizes: np.ndarray, chunk: int) -> int:
    """How many of a resample's draws fall to a chunk of a group: as many draws as values are split down a tree of chunks by seeded binomials.

    Every node has its own generator, so that each chunk finds its number by itself, and the numbers of all chunks add up.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, count = 0, len(sizes), int(upto[-1])
    while high - low > 1 and count:
        mid = (low + high) // 2
        here = np.random.Generator(np.random.Philox(key=np.array([(seed & _MASK) << 32 | resample, low << 32 | high], dtype=np.uint64)))
        left = int(here.binomial(count, (upto[mid] - upto[low]) / (upto[high] - upto[low])))
        low, high, count = (low, mid, left) if chunk < mid else (mid, high, count - left)
    return count


def _chunked_sums(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], resamples: int, seed: int, chunk_rows: int) -> DataFrame:
    """(by, part, sums) of large groups: their rows are dealt into chunks by a hash of the order, each chunk moves once and gives its part of every resample's mean."""
    keys = [F.struct(F.col(c)).alias(f"_g{k}") for k, c in enumerate(by)]  # null keys are groups too
    g = [f"_g{k}" for k in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.xxhash64(*order).alias("_h"), F.col(value).cast("double").alias("_v"))
    # a few rows: groups with a number
    parts = saved(rows.groupBy(*g).agg(F.ceil(F.count("*") / chunk_rows).alias("_k")).withColumn("_id", F.row_number().over(Window.orderBy(*g))), "chunks-a-group")
    dealt = rows.join(small(parts), g).select("_id", F.pmod("_h", "_k").cast("int").alias("_c"), "_h", "_v")
    sizes = saved(dealt.groupBy("_id", "_c").agg(F.count("*").alias("_n")), "chunk-sizes")
    every = sizes.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_c", "_n"))).alias("_s")).select("_id", F.transform("_s", lambda x: x["_c"]).alias("_cs"), F.transform("_s", lambda x: x["_n"]).alias("_ns"))

    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        c, cs, ns = int(told["_c"].iloc[0]), np.asarray(told["_cs"].iloc[0]), np.asarray(told["_ns"].iloc[0])
        v = rows["_v"].to_numpy()[np.lexsort((rows["_v"], rows["_h"]))]
        at, n, means = int(np.searchsorted(cs, c)), ns.sum(), np.empty(resamples)
        for r in range(resamples):
            own = np.random.Generator(np.random.Philox(key=np.array([(seed & _MASK) << 32 | r, 1 << 63 | c], dtype=np.uint64)))
            means[r] = v[own.integers(0, len(v), chunk_draws(seed, r, ns, at), dtype=np.int32)].sum() / n
        return pd.DataFrame({"_id": told["_id"], "part": c, "sums": [means]})

    # a chunk is much work on few bytes: as many tasks as the session shuffles into; groups are sorted on disk where they must, the worker holds one chunk
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_id", "_c")
    sums = dealt.groupBy("_id", "_c").cogroup(sizes.join(every, "_id").groupBy("_id", "_c")).applyInPandas(run, "_id int, part long, sums array<double>")
    return sums.join(small(parts), "_id").select(*[F.col(n)[c].alias(c) for n, c in zip(g, by)], "part", "sums")


def bootstrap_means(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], resamples: int = 1000, seed: int = 1, confidence: float = 0.95, large: int = LARGE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per group: n, mean, lo, hi: the percentile interval of the mean over seeded resamples with replacement.

    Draw resample * n + j picks row floor(u n) of the group in the given order, so that results do not
    depend on partitioning. What moves is a group's values, in rows of bounded size, once; the draws are
    made where they arrive, and each gives one mean. Groups of over large values draw by chunks
    (chunk_draws) of about chunk_rows: another stream of the same distribution, in which no task numbers a group and nothing is copied.
    """
    keys = list(by)
    sizes = saved(df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean")), "group-sizes")
    huge = sizes.where(F.col("n") > large).select(*[F.struct(F.col(c)).alias(f"_b{k}") for k, c in enumerate(by)])
    some = not huge.isEmpty()
    many = df.withColumns({f"_b{k}": F.struct(F.col(c)) for k, c in enumerate(by)})
    split = lambda how: many.join(small(huge), [f"_b{k}" for k in range(len(by))], how).select(*df.columns)
    rows = _numbered(split("left_anti") if some else df, [value], by, order)
    parts = rows.groupBy(*by, "n", F.floor(F.col("_i") / VALUES_A_ROW).alias("part")).agg(F.sort_array(F.collect_list(F.struct("_i", f"_{value}"))).alias("_s")).withColumn("_s", F.transform("_s", lambda x: x[f"_{value}"]))

    def run(batches):
        for pdf in batches:
            out = []
            for n, part, v in zip(pdf["n"], pdf["part"], pdf["_s"]):
                start, means = part * VALUES_A_ROW, []
                step = max(1, DRAWS_A_ROW // 4 // n)
                for r in range(0, resamples, step):
                    m = min(step, resamples - r)
                    at = (draws(seed, r * n, m * n) * n).astype(np.int64) - start
                    inside = (at >= 0) & (at < len(v))
                    picked = np.where(inside, np.asarray(v)[np.where(inside, at, 0)], 0.0)
                    means.append(picked.reshape(m, n).sum(axis=1) / n)
                out.append(np.concatenate(means))
            yield pdf[keys + ["part"]].assign(sums=out)

    kinds = dict(parts.dtypes)
    sums = parts.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", part long, sums array<double>")
    if some:
        sums = sums.unionByName(_chunked_sums(split("left_semi"), value, by, order, resamples, seed, chunk_rows))
    return sizes.join(_interval(sums, by, confidence).drop("_valid"), keys)


def bootstrap_spearman(df: DataFrame, x: str, y: str, by: Sequence[str], order: Sequence[str], resamples: int = 1000, seed: int = 1, confidence: float = 0.95, least: int = 5, least_valid: int = 10) -> DataFrame:
    """One row per group of at least least pairs: n, lo, hi: the percentile interval of the rank correlation over paired resamples.

    Resamples in which a side is constant count for nothing; with under least_valid others the bounds
    are null. Draws are those of bootstrap_means, beyond DRAWS_A_ROW pairs another stream. A group meets in one task as two
    arrays of ranks; a resample counts how often each rank is drawn, so that nothing is sorted or copied again.
    """
    keys = list(by)
    # a cell is much work on few bytes: as many tasks as the session shuffles into
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(df.repartition(tasks, *by), [x, y], by, order).where(F.col("n") >= least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, at_ = len(pdf), np.argsort(pdf["_i"].to_numpy())
        told, (a, b) = pdf[keys].iloc[[0]].reset_index(drop=True), (np.unique(pdf[f"_{c}"].to_numpy(), return_inverse=True)[1].astype(np.int32)[at_] for c in (x, y))
        del pdf, at_
        corr = np.full(resamples, np.nan)
        for r in range(resamples):
            if n <= DRAWS_A_ROW:
                at = (draws(seed, r * n, n) * n).astype(np.int64)
            else:
                at = np.random.Generator(np.random.Philox(key=np.array([seed & _MASK, r], dtype=np.uint64))).integers(0, n, n)
            sides, size = [], 1.0
            for ranks in (a, b):
                own = ranks[at]
                count = np.bincount(own)
                place = np.cumsum(count) - (count - 1) / 2 - (n + 1) / 2
                size *= (count * place * place).sum()
                sides.append(place[own])
            if size > 0:
                corr[r] = (sides[0] * sides[1]).sum() / np.sqrt(size)
        return told.assign(n=n, part=0, sums=[corr])

    kinds = dict(rows.dtypes)
    got = rows.drop("n").groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, part long, sums array<double>")
    return correlation_bounds(got, keys, confidence, least_valid)


def correlation_bounds(got: DataFrame, keys: Sequence[str], confidence: float = 0.95, least_valid: int = 10) -> DataFrame:
    """(keys, n, lo, hi) of rows (keys, n, part, sums: the resamples' correlations, NaN for those that count for nothing)."""
    ends = _interval(got, [*keys, "n"], confidence)
    fine = F.col("_valid") >= least_valid
    return ends.select(*keys, "n", F.when(fine, F.col("lo")).alias("lo"), F.when(fine, F.col("hi")).alias("hi"))


def resampled_correlations(x: np.ndarray, y: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """The rank correlation of every paired resample with replacement, NaN where a side is constant; the same for any order of the pairs.

    Pairs are sorted and equal ones put together once: a resample is how often each distinct pair is drawn, and all ranks follow from those counts.
    """
    n, a, b = len(x), *(np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    pair, sides = (np.cumsum(new) - 1).astype(np.int32), [v[new] for v in (a, b)]
    out = np.full(resamples, np.nan)
    for r in range(resamples):
        drawn = np.random.Generator(np.random.SFC64([seed & _MASK, r])).integers(0, n, n, dtype=np.int32 if n < 2**31 else np.int64)
        times = np.bincount(pair[drawn], minlength=int(pair[-1]) + 1).astype(float)
        product, size = times, 1.0
        for side in sides:
            count = np.bincount(side, weights=times)
            place = np.cumsum(count) - count / 2 - n / 2
            size *= np.einsum("i,i,i", count, place, place)
            product = product * place[side]
        if size > 0:
            out[r] = product.sum() / np.sqrt(size)
    return out
