"""Fair-value ranges from leave-one-out peer medians, a company's own history and cycle averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.timeseries import asof_join
from rankweave.sources.scratch import saved

MULTIPLES = ("pe_ratio", "ev_to_ebitda", "price_to_fcf")


def cap_bucket(cap: Column) -> Column:
    return F.when(cap >= 200e9, "mega").when(cap >= 20e9, "large").otherwise("midSmall")


def leave_one_out_median(df: DataFrame, value: str, by: Sequence[str], tie: str, out: str) -> DataFrame:
    """df with out: the median of the positive values of the row's group without the row's own.

    Removing position p from n sorted values leaves the middle at one or two of three middle elements,
    so one sort of the group is enough: no self-join.
    """
    usable = F.coalesce(F.col(value) > 0, F.lit(False))
    w = Window.partitionBy(*by, usable)
    df = df.withColumns({"_p": F.row_number().over(w.orderBy(value, tie)), "_m": F.when(usable, F.count("*").over(w))})
    whole = Window.partitionBy(*by)
    n = F.max("_m").over(whole)
    at = lambda k: F.max(F.when(usable & (F.col("_p") == k), F.col(value))).over(whole)
    df = df.withColumn("_n", F.coalesce(n, F.lit(0)))
    half = F.floor(F.col("_n") / 2)
    df = df.withColumns({"_a": at(half), "_b": at(half + 1), "_c": at(half + 2)})
    odd = F.col("_n") % 2 == 1
    p, h = F.col("_p"), F.floor(F.col("_n") / 2)
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    # n odd: of n - 1 (even) the elements at h and h + 1; n even: of n - 1 (odd) the element at h
    without_odd = (F.when(p <= h, b).otherwise(a) + F.when(p <= h + 1, c).otherwise(b)) / 2
    without_even = F.when(p <= h, b).otherwise(a)
    plain = F.when(odd, b).otherwise((a + b) / 2)
    own = F.when(F.col("_n") == 1, F.lit(None)).when(odd, without_odd).otherwise(without_even)
    return df.withColumn(out, F.when(usable, own).otherwise(plain).cast("double")).drop("_p", "_m", "_n", "_a", "_b", "_c")


def middle_values(rows: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Per group its size and, of each value column (nulls left out), how many there are and the middle ones: n, lo, hi, a, c as <value>_n and so on.

    Of an even number lo and hi are the two in the middle; of an odd one both are the middle, and a and c its neighbours. Two
    aggregations find them for all columns, without a sort of the rows: the second looks beside the middle that the first found.
    """
    each = lambda f: [x for v in values for x in f(v)]
    disc = lambda v, d: F.expr(f"percentile_disc(0.5) within group (order by `{v}` {d})")
    middle = rows.groupBy(group).agg(F.count("*").alias("_size"), *each(lambda v: (F.count(v).alias(f"{v}_n"), disc(v, "asc").alias(f"{v}_lo"), disc(v, "desc").alias(f"{v}_hi"))))
    beside = lambda v: (
        F.max(F.when(F.col(v) < F.col(f"{v}_lo"), F.col(v))).alias(f"{v}_below"), F.count_if(F.col(v) < F.col(f"{v}_lo")).alias(f"{v}_nb"),
        F.min(F.when(F.col(v) > F.col(f"{v}_lo"), F.col(v))).alias(f"{v}_above"), F.count_if(F.col(v) > F.col(f"{v}_lo")).alias(f"{v}_na"),
    )
    kept = ["_size", *[f"{v}_{x}" for v in values for x in ("n", "lo", "hi")]]
    out = rows.join(middle, group).groupBy(group).agg(*[F.first(c).alias(c) for c in kept], *each(beside))
    half = lambda v: F.floor(F.col(f"{v}_n") / 2)
    # fewer than half stand strictly beside the middle where the neighbour ties with it
    near = lambda v: (F.when(F.col(f"{v}_nb") == half(v), F.col(f"{v}_below")).otherwise(F.col(f"{v}_lo")).alias(f"{v}_a"), F.when(F.col(f"{v}_na") == half(v), F.col(f"{v}_above")).otherwise(F.col(f"{v}_lo")).alias(f"{v}_c"))
    return out.select(group, *kept, *each(near))


def without_own(value: Column, n: Column, lo: Column, hi: Column, a: Column, c: Column) -> Column:
    """The median of a group's values without value, one of them, from middle_values; of all of them where value is null."""
    odd = n % 2 == 1
    rest = F.when(value < lo, hi + c).when(value > lo, a + lo).otherwise(a + c) / 2
    own = F.when(n == 1, F.lit(None)).when(odd, rest).otherwise(F.when(value <= lo, hi).otherwise(lo))
    return F.when(value.isNotNull(), own).otherwise(F.when(odd, lo).otherwise((lo + hi) / 2)).cast("double")


def peer_medians(df: DataFrame, multiples: Sequence[str] = MULTIPLES, enough: int = 8, narrow: int = 3) -> DataFrame:
    """df (d, symbol, industry, sector, market_cap, multiples) with peer_set, peer_count and peer_<multiple>.

    Peers exclude the row itself: its industry and cap bucket if there are enough (cohort) or at least
    narrow (narrow), else its industry if at least narrow (industry), else its sector. Medians are of multiples above 0. The groups of all
    three kinds are aggregated together; their middle values are a row a group, which every member looks up.
    """
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    levels = {"cap": (text("industry"), cap_bucket(F.col("market_cap"))), "ind": (text("industry"), none), "sec": (text("sector"), none)}
    named = {f"_g_{x}": F.struct(F.lit(x).alias("level"), F.col("d").alias("d"), p.alias("p"), q.alias("q")) for x, (p, q) in levels.items()}
    df = saved(df.withColumns(named | {f"_x_{m}": F.when(F.col(m) > 0, F.col(m)) for m in multiples}), "peers")
    values = [f"_x_{m}" for m in multiples]
    each = df.select(F.explode(F.array(*[f"_g_{x}" for x in levels])).alias("_g"), *values)
    found = saved(middle_values(each, "_g", values), "middle-values")
    for x in levels:
        # the middle values of a row's three groups stand side by side, each as one struct
        own = found.where(F.col("_g.level") == x).select(F.col("_g").alias(f"_h_{x}"), F.struct(*[c for c in found.columns if c != "_g"]).alias(f"_s_{x}"))
        df = df.join(own, F.col(f"_g_{x}") == F.col(f"_h_{x}")).drop(f"_h_{x}")
    size = lambda x: F.col(f"_s_{x}")["_size"] - 1
    rest = lambda x, m: without_own(F.col(f"_x_{m}"), *[F.col(f"_s_{x}")[f"_x_{m}_{k}"] for k in ("n", "lo", "hi", "a", "c")])
    by_cap, by_ind = size("cap") >= narrow, size("ind") >= narrow
    pick = lambda a, b, c: F.when(by_cap, a).when(by_ind, b).otherwise(c)
    df = df.withColumns({
        "peer_set": F.when(size("cap") >= enough, "cohort").otherwise(pick(F.lit("narrow"), F.lit("industry"), F.lit("sector"))),
        "peer_count": pick(*[size(x) for x in levels]),
        **{f"peer_{m}": pick(*[rest(x, m) for x in levels]) for m in multiples},
    })
    return df.drop(*[f"_{k}_{x}" for x in levels for k in "gs"], *values)


def normalised(value: Column, age: Column, rank_of_positive: Column, window: int = 7, least: int = 5) -> Column:
    """Aggregate: mean of the newest `least` positive values among the newest `window` periods, else of all non-null ones there."""
    inside = age < window
    good = inside & (value > 0) & (rank_of_positive <= least)
    return F.when(F.count(F.when(good, value)) >= least, F.avg(F.when(good, value))).otherwise(F.avg(F.when(inside, value)))


def own_history(snapshots: DataFrame, periods: DataFrame) -> DataFrame:
    """One row per (d, symbol): normalised EPS, EBITDA and FCF, means of prior positive years, own historical multiples.

    A historical multiple is the median over periods and their three sample prices (end, high, low). One sort and one aggregation
    of the known periods give all of it.
    """
    key = ["d", "symbol"]
    c, age = F.col, F.col("age")
    known = snapshots.select(*key).distinct().join(periods, "symbol").where(c("period_end") <= c("d"))
    newest = Window.partitionBy(*key).orderBy(F.desc("period_end"), *[F.desc(x) for x in ("eps", "ebitda", "fcf", "shares")])
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the number of a positive figure among the positive ones is a running count: one sort gives it for all figures
    known = known.withColumns({"age": F.row_number().over(newest) - 1} | {f"_r_{x}": F.count_if(c(x) > 0).over(upto) for x in ("eps", "ebitda", "fcf")})
    prior = lambda x: F.when(age.between(1, 3) & (c(x) > 0), c(x))
    worth = lambda p: c(p) * c("shares") + F.coalesce("debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0))
    multiples = {
        "pe_ratio": lambda p: F.when((c(p) > 0) & (c("eps") > 0), c(p) / c("eps")),
        "ev_to_ebitda": lambda p: F.when((c(p) > 0) & (c("shares") > 0) & (c("ebitda") > 0) & (worth(p) > 0), worth(p) / c("ebitda")),
        "price_to_fcf": lambda p: F.when((c(p) > 0) & (c("shares") > 0) & (c("fcf") > 0), c(p) * c("shares") / c("fcf")),
    }
    base = known.groupBy(*key).agg(
        *[normalised(c(x), age, c(f"_r_{x}")).alias(f"normal_{x}") for x in ("eps", "ebitda", "fcf")],
        *[F.avg(prior(x)).alias(f"prior_{x}") for x in ("eps", "ebitda")],
        *[F.count(prior(x)).alias(f"n_prior_{x}") for x in ("eps", "ebitda")],
        *[F.max(F.when(age == 0, c(x))).alias(f"{x}0") for x in ("eps", "ebitda", "fcf", "shares", "debt", "cash")],
        *[F.sort_array(F.concat(*[F.collect_list(of(p)) for p in ("price_end", "price_high", "price_low")])).alias(f"_m_{m}") for m, of in multiples.items()],
    )
    at = lambda m, k: F.get(f"_m_{m}", F.floor(k).cast("int"))
    middle = lambda m, n: F.when(n > 0, (at(m, (n - 1) / 2) + at(m, n / 2)) / 2)
    return base.withColumns({f"own_{m}": middle(m, F.size(f"_m_{m}")) for m in multiples}).drop(*[f"_m_{m}" for m in multiples])


def implied_price(per: Column, multiple: Column, shares: Column | None = None, debt: Column | None = None, cash: Column | None = None) -> Column:
    """Price at which a multiple holds: per share, or as a value less debt plus cash over shares; null unless all inputs and the price are above 0."""
    value = per * multiple
    if debt is not None:
        value = value - F.coalesce(debt, F.lit(0.0)) + F.coalesce(cash, F.lit(0.0))
    price = value if shares is None else F.when(shares > 0, value / shares)
    return F.when((per > 0) & (multiple > 0) & (price > 0), price)


def spike_choice(recent: Column, prior_mean: Column, n_prior: Column, forward: Column | None = None, spike: float = 1.5, agree: float = 0.7) -> Column:
    """recent, or prior_mean where recent is above spike times it (of at least two years) and forward does not agree."""
    odd = (n_prior >= 2) & (recent > prior_mean * spike)
    if forward is not None:
        odd = odd & ~F.coalesce((forward > 0) & (forward >= recent * agree), F.lit(False))
    return F.when(odd, prior_mean).otherwise(recent)


ANCHORS = ["peer_pe", "peer_ev", "peer_fcf", "own_pe", "own_ev", "own_fcf", "normal_pe", "normal_ev", "normal_fcf"]


def fair_value(snapshots: DataFrame, periods: DataFrame, skip_outlier_rule: bool = False, diverge: float = 5.0) -> DataFrame:
    """snapshots with nine anchors, their p25, median and p75, upsides, confidence and flags (outlier_fired: the spike rule replaced a figure).

    snapshots: d, symbol, industry, sector, market_cap, price, multiples, enterprise_value, forward_eps;
    periods: symbol, period_end and figures. Trailing figures come from ttm_eps, ttm_ebitda and ttm_fcf
    where snapshots have them, else from the multiples, else from the newest period.
    """
    c = F.col
    df = peer_medians(snapshots).join(own_history(snapshots, periods), ["d", "symbol"], "left")
    has = set(snapshots.columns)
    ttm = lambda x: c(x) if x in has else F.lit(None).cast("double")
    whole = ttm("ttm_eps").isNotNull() | ttm("ttm_ebitda").isNotNull()
    by_ratio = lambda a, m: F.when((c(m) > 0) & (a > 0), a / c(m))
    df = df.withColumns({
        "eps": F.when(whole, ttm("ttm_eps")).otherwise(F.coalesce(by_ratio(c("price"), "pe_ratio"), "eps0")),
        "ebitda": F.when(whole, ttm("ttm_ebitda")).otherwise(F.coalesce(by_ratio(c("enterprise_value"), "ev_to_ebitda"), "ebitda0")),
        "fcf": F.when(whole, ttm("ttm_fcf")).otherwise(F.coalesce(F.when(c("shares0") > 0, by_ratio(c("price"), "price_to_fcf") * c("shares0")), "fcf0")),
    })
    if skip_outlier_rule:
        eps, ebitda = c("eps"), c("ebitda")
    else:
        eps = spike_choice(c("eps"), c("prior_eps"), c("n_prior_eps"), c("forward_eps"))
        ebitda = spike_choice(c("ebitda"), c("prior_ebitda"), c("n_prior_ebitda"))
    own = lambda m, t: F.coalesce(f"own_{m}", F.when(c(t) > 0, c(t)))
    far = F.greatest(c("peer_pe_ratio") / c("pe_ratio"), c("pe_ratio") / c("peer_pe_ratio")) > diverge
    fired = lambda used, x: F.coalesce(used != c(x), F.lit(False))
    df = df.withColumns({"anchor_eps": eps, "anchor_ebitda": ebitda, "outlier_fired": fired(eps, "eps") | fired(ebitda, "ebitda"), "divergent": F.coalesce(F.when((c("pe_ratio") > 0) & (c("peer_pe_ratio") > 0), far), F.lit(False))})
    eps, ebitda, shares, debt, cash = (c(x) for x in ("anchor_eps", "anchor_ebitda", "shares0", "debt0", "cash0"))
    near = lambda x: F.when(~c("divergent"), x)
    df = df.withColumns({
        "peer_pe": near(implied_price(eps, c("peer_pe_ratio"))),
        "peer_ev": near(implied_price(ebitda, c("peer_ev_to_ebitda"), shares, debt, cash)),
        "peer_fcf": near(implied_price(c("fcf"), c("peer_price_to_fcf"), shares)),
        "own_pe": implied_price(eps, own("pe_ratio", "pe_ratio")),
        "own_ev": implied_price(ebitda, own("ev_to_ebitda", "ev_to_ebitda"), shares, debt, cash),
        "own_fcf": implied_price(c("fcf"), own("price_to_fcf", "price_to_fcf"), shares),
        "normal_pe": near(implied_price(c("normal_eps"), c("peer_pe_ratio"))),
        "normal_ev": near(implied_price(c("normal_ebitda"), c("peer_ev_to_ebitda"), shares, debt, cash)),
        "normal_fcf": near(implied_price(c("normal_fcf"), c("peer_price_to_fcf"), shares)),
    })
    # quantiles of at most nine values, inside the row
    df = df.withColumn("_a", F.array_sort(F.filter(F.array(*ANCHORS), lambda x: x.isNotNull())))
    n = F.size("_a")

    def at(q: float) -> Column:
        k = (n - 1) * q
        low = F.floor(k).cast("int")
        a, b = F.get("_a", low), F.get("_a", F.least(low + 1, n - 1))
        return F.when(n > 0, a + (b - a) * (k - low))

    df = df.withColumns({"n_anchors": n, "p25": at(0.25), "median": at(0.5), "p75": at(0.75)})
    spread = c("p75") / c("p25")
    confidence = F.when((c("peer_set") == "cohort") & (n >= 6) & (spread <= 1.5), "high").when(c("peer_set").isin("cohort", "narrow") & (n >= 6) & (spread <= 2.5), "medium").otherwise("low")
    up = lambda x: F.when(c("price") > 0, (c(x) - c("price")) / c("price") * 100)
    df = df.withColumns({"confidence": confidence, "limited": n < 6, "upside_p25": up("p25"), "upside_median": up("median")})
    keep = [*snapshots.columns, "peer_set", "peer_count", *ANCHORS, "n_anchors", "p25", "median", "p75", "upside_p25", "upside_median", "confidence", "limited", "divergent", "outlier_fired"]
    return df.select(*keep)


def peer_picks(companies: DataFrame, most: int = 12, least: int = 2) -> DataFrame:
    """(d, symbol, peer, place, level): the largest other names of a company's industry, or of its sector where the industry has under least.

    No pair is made beyond the largest most + 1 names of a group: a company meets those, itself left out.
    """
    def largest(level: str) -> DataFrame:
        w = Window.partitionBy("d", level).orderBy(F.desc("market_cap"), "symbol")
        top = companies.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most + 1).select("d", level, F.col("symbol").alias("peer"), "_k")
        own = companies.select("d", "symbol", level).join(top, ["d", level]).where("peer <> symbol")
        place = F.row_number().over(Window.partitionBy("d", "symbol").orderBy("_k"))
        return own.select("d", "symbol", "peer", place.alias("place"), F.lit(level).alias("level"), F.count("*").over(Window.partitionBy("d", "symbol")).alias("_n")).where((F.col("place") <= most) & (F.col("_n") >= least)).drop("_n")

    near = largest("industry")
    far = largest("sector").join(near.select("d", "symbol").distinct(), ["d", "symbol"], "left_anti")
    return near.unionByName(far)


def smoothed_multiples(peers: DataFrame, own: DataFrame, trim: float = 0.10, least: int = 5, years: int = 5, lag_days: int = 90) -> DataFrame:
    """(d, symbol, multiple, trimmed): the median over a company's peers of each peer's own median multiple, plain and after cutting trim of them off either end.

    peers: d, symbol, peer; own: symbol, period_end, value (one row a peer and year; null or not above 0 where there is no multiple).
    A peer's multiple is the median of those of its newest `years` years that are public at d, lag_days after their end; nothing later counts.
    It is worked out once a year and symbol, and looked up by the last year public. Under least peers nothing is cut.
    """
    w = Window.partitionBy("symbol").orderBy("period_end").rowsBetween(-(years - 1), 0)
    run = F.array_sort(F.filter(F.collect_list(F.coalesce("value", F.lit(0.0))).over(w), lambda x: x > 0))
    n = F.size("_run")
    middle = lambda k: F.get("_run", F.floor(k).cast("int"))
    told = own.withColumn("_run", run).select(F.col("symbol").alias("peer"), F.col("period_end").alias("_public"), F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2).alias("_m"))
    each = asof_join(peers.select("d", "peer").distinct().withColumn("_cut", F.date_sub("d", lag_days)), told, ["peer"], "_cut", "_public", ["_m"]).where("_m is not null").select("d", "peer", "_m")
    rows = peers.join(each, ["d", "peer"])
    w = Window.partitionBy("d", "symbol")
    rows = rows.withColumns({"_k": F.row_number().over(w.orderBy("_m", "peer")), "_n": F.count("*").over(w)})
    cut = F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.floor(F.col("_n") * trim))).otherwise(0)
    kept = (F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)
    return rows.groupBy("d", "symbol").agg(F.percentile("_m", F.lit(0.5)).alias("multiple"), F.percentile(F.when(kept, F.col("_m")), F.lit(0.5)).alias("trimmed"))


def attach(ranked: DataFrame, values: DataFrame, best: DataFrame | None = None, trend: DataFrame | None = None) -> DataFrame:
    """ranked with its fair value (of values: d, symbol, ...), liquid and trend; every row of ranked stays once.

    liquid is whether the summary of options best (symbol, best_call, best_put) has both a call and a put; a symbol without an entry is
    taken as liquid. trend (of symbol, trend) is insufficient_data without an entry. values has one row a date and symbol, the others one a symbol.
    """
    c = F.col
    out = ranked.join(values, ["d", "symbol"], "left")
    if best is not None:
        out = out.join(best.select("symbol", (c("best_call").isNotNull() & c("best_put").isNotNull()).alias("liquid")), "symbol", "left")
    if trend is not None:
        out = out.join(trend.select("symbol", "trend"), "symbol", "left")
    return out.withColumns({"liquid": F.coalesce(c("liquid") if best is not None else F.lit(None), F.lit(True)), "trend": F.coalesce(c("trend") if trend is not None else F.lit(None), F.lit("insufficient_data"))})


def undervalued(price: Column, p25: Column) -> Column:
    return F.coalesce((price > 0) & (price < p25), F.lit(False))
