"""Factors, cohort percentiles, quality floor, composite ranks and buckets, for many dates at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.stats import finite, midrank_percentile, ranged_percentile, ratio, winsorised_percentile
from rankweave.sources.scratch import saved
from rankweave.operators.timeseries import average_of_newest, cagr, count_above, newest_first


@dataclass(frozen=True)
class Factor:
    """A raw factor: an expression over the panel's columns, its category, and whether low or high is good."""

    name: str
    category: str
    direction: str
    value: Column


def default_factors() -> list[Factor]:
    """The sixteen factors over a panel of snapshot columns and period_features."""
    c = F.col
    above = lambda x: F.when(c(x) >= 0, c(x))
    return [
        Factor("ev_to_ebitda", "valuation", "lower", finite(c("ev_to_ebitda"))),
        Factor("price_to_fcf", "valuation", "lower", finite(c("price_to_fcf"))),
        Factor("pe_ratio", "valuation", "lower", finite(above("pe_ratio"))),
        Factor("price_to_book", "valuation", "lower", finite(above("price_to_book"))),
        Factor("debt_to_ebitda", "health", "lower", finite(c("net_debt_to_ebitda"))),
        Factor("current_ratio", "health", "higher", finite(c("current_ratio"))),
        Factor("interest_coverage", "health", "higher", finite(ratio(c("ebit0"), c("interest0")))),
        Factor("roic", "quality", "higher", finite(c("roic"))),
        Factor("accruals", "quality", "lower", finite(ratio(c("net_income0") - c("cfo0"), c("revenue0")))),
        Factor("dividend_yield", "shareholder_return", "higher", finite(c("dividend_yield"))),
        Factor("buyback_yield", "shareholder_return", "higher", finite(ratio(c("buybacks0"), c("market_cap")))),
        Factor("dividend_growth", "shareholder_return", "higher", finite(c("dividend_growth"))),
        Factor("net_issuance", "shareholder_return", "lower", finite(ratio(c("shares0"), c("shares1")) - 1)),
        Factor("revenue_growth", "growth", "higher", finite(c("revenue_growth"))),
        Factor("eps_growth", "growth", "higher", finite(c("eps_growth"))),
        Factor("momentum", "momentum", "higher", finite(c("momentum_12_1"))),
    ]


#: Shares of the categories in the composite.
DEFAULT_WEIGHTS = {"valuation": 0.50, "health": 0.20, "quality": 0.10, "shareholder_return": 0.10, "growth": 0.10, "momentum": 0.0}
#: Categories whose absence counts when a row is placed in a bucket.
SCORED = ["valuation", "health", "quality", "shareholder_return", "growth"]
#: Industries that the valuation model does not fit.
MODEL_INCOMPATIBLE = ["Banks - Regional", "Banks - Diversified", "Capital Markets", "Insurance - Reinsurance"]


def normalise_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """The default weights overridden by weights, summing to 1."""
    merged = DEFAULT_WEIGHTS | dict(weights or {})
    total = sum(merged.values())
    if total <= 0:
        raise ValueError("the weights must sum to more than zero")
    return {k: v / total for k, v in merged.items()}


def normalise_weight_rows(weights: DataFrame, by: str = "candidate") -> DataFrame:
    """Weight vectors as rows (by, category, w), each scaled to sum to 1; a vector without weight disappears."""
    total = F.sum("w").over(Window.partitionBy(by))
    return weights.withColumn("_t", total).where("_t > 0").withColumn("w", F.col("w") / F.col("_t")).drop("_t")


def period_features(snapshots: DataFrame, periods: DataFrame, lag_days: int = 0, key: Sequence[str] = ("d", "symbol")) -> DataFrame:
    """One row per (d, symbol): the newest period's figures, growth, averages and profitable years from the periods known at d.

    A period is known lag_days after its end. A symbol without one has no row.
    """
    known = snapshots.select(*key).distinct().join(periods, "symbol").where(F.col("period_end") <= F.date_sub("d", lag_days))
    aged = newest_first(known, key, "period_end")
    c, age = F.col, F.col("age")
    at = lambda x, k=0: F.max(F.when(age == k, c(x)))
    return aged.groupBy(*key).agg(
        *[at(x).alias(f"{x}0") for x in ("ebit", "interest", "net_income", "cfo", "revenue", "buybacks", "shares", "debt", "cash", "eps", "ebitda", "fcf")],
        at("shares", 1).alias("shares1"),
        cagr(F.when(c("shares") > 0, c("dividends") / c("shares")), age, 5).alias("dividend_growth"),
        cagr(c("revenue"), age, 7).alias("revenue_growth"),
        cagr(c("eps"), age, 7).alias("eps_growth"),
        average_of_newest(c("roic"), age, 5).alias("avg_roic"),
        count_above(c("net_income"), age, 5).alias("profitable_years"),
        F.count("*").alias("n_periods"),
    )


def quality_floor(panel: DataFrame, years: int = 3, roic_pass: float = 0.08, roic_percentile: float = 33, coverage_pass: float = 5, coverage_percentile: float = 25, least_peers: int = 3) -> DataFrame:
    """panel with floor_reason: null where a row passes, else the first rule it fails. Peers are its sector at d, itself included."""
    by = ["d", "sector"]
    df = panel.withColumn("_cov", ratio(F.col("ebit0"), F.col("interest0")))
    df = df.withColumns({"_rp": midrank_percentile("avg_roic", by), "_cp": midrank_percentile("_cov", by), "_rn": F.count("avg_roic").over(Window.partitionBy(*by)), "_cn": F.count("_cov").over(Window.partitionBy(*by))})
    roic, cov = F.col("avg_roic"), F.col("_cov")
    low_roic = (roic < roic_pass) & F.when(F.col("_rn") >= least_peers, F.col("_rp") < roic_percentile).otherwise(roic <= 0)
    low_cov = (cov < coverage_pass) & F.when(F.col("_cn") >= least_peers, F.col("_cp") < coverage_percentile).otherwise(cov < 1)
    reason = F.when(F.coalesce("profitable_years", F.lit(0)) < years, "few_profitable_years").when(F.coalesce(low_roic, F.lit(False)), "low_avg_roic").when(F.coalesce(low_cov, F.lit(False)), "low_interest_coverage")
    return df.withColumn("floor_reason", reason).drop("_cov", "_rp", "_cp", "_rn", "_cn")


def factor_rows(panel: DataFrame, factors: Sequence[Factor], keep: Sequence[str]) -> DataFrame:
    """Long form: keep, factor, category, direction, raw."""
    each = F.array(*[F.struct(F.lit(f.name).alias("factor"), F.lit(f.category).alias("category"), F.lit(f.direction).alias("direction"), f.value.cast("double").alias("raw")) for f in factors])
    return panel.select(*keep, F.explode(each).alias("_f")).select(*keep, "_f.*")


def saved_values(panel: DataFrame, factors: Sequence[Factor], keep: Sequence[str]) -> tuple[DataFrame, list[Factor]]:
    """keep and the factors' values, written once as one row a row of panel, and the factors over that table: its long form is cheap to read several times."""
    values = saved(panel.select(*keep, *[f.value.cast("double").alias(f"_raw_{f.name}") for f in factors]), "factor-values")
    return values, [replace(f, value=F.col(f"_raw_{f.name}")) for f in factors]


def with_cohorts(panel: DataFrame, levels: Sequence[str] = ("industry", "sector"), least: int = 8, date: str = "d") -> DataFrame:
    """panel with _level, the number of the first level at which a row's group has at least `least` members (the number of levels: everything at
    the date), and _in, the groups (level, name) in which it is needed: its own, and those whose smaller groups fall back on them."""
    sizes = panel.groupBy(date, *levels).agg(F.count("*").alias("_c"))
    chosen = F.lit(len(levels))
    for k in reversed(range(len(levels))):
        w = Window.partitionBy(date, levels[k])
        chosen = F.when((F.sum("_c").over(w) >= least) & F.col(levels[k]).isNotNull(), k).otherwise(chosen)
    sizes = sizes.withColumn("_level", chosen)
    needs = [F.max(F.col("_level") == k).over(Window.partitionBy(date, *([levels[k]] if k < len(levels) else []))) for k in range(len(levels) + 1)]
    name = lambda k: F.col(levels[k]).cast("string") if k < len(levels) else F.lit("")
    groups = [F.when(needs[k], F.struct(F.lit(k).alias("level"), name(k).alias("name"))) for k in range(len(levels) + 1)]
    flagged = sizes.select(F.col(date).alias(f"_{date}"), *[F.col(c).alias(f"_{c}") for c in levels], "_level", F.array_compact(F.array(*groups)).alias("_in"))
    on = [F.col(date) == F.col(f"_{date}"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in levels]]
    return panel.join(flagged, on).drop(f"_{date}", *[f"_{c}" for c in levels])


def cohort_percentiles(panel: DataFrame, factors: Sequence[Factor], levels: Sequence[str] = ("industry", "sector"), least: int = 8, date: str = "d", keep: Sequence[str] = (), ranged: int | None = None) -> DataFrame:
    """Long rows (date, symbol, keep, factor, category, raw, pct, cohort) of a panel's factors.

    The cohort is the first level with at least `least` members at the date, members counted whether or
    not they have the factor, else everything at the date. Cohorts overlap: a row is sent to its own and
    to those that smaller groups beside it fall back on, and all percentiles are taken in one pass. A
    factor where low is good is turned round. With ranged, the values a task ranks, no task holds a cohort
    (ranged_percentile): for dates of very many rows; same result.
    """
    if ranged:
        panel, factors = saved_values(panel, factors, [date, "symbol", *dict.fromkeys([*keep, *levels])])
    rows = factor_rows(with_cohorts(panel, levels, least, date), factors, [date, "symbol", *keep, "_level", "_in"])
    sent = rows.withColumn("_c", F.explode("_in")).drop("_in").select("*", F.col("_c.level").alias("_at"), F.col("_c.name").alias("_name")).drop("_c")
    by = [date, "factor", "_at", "_name"]
    # what a factor is follows from its name: keys too, so that they need not move with every value
    told = ranged_percentile(sent, "raw", [*by, "category", "direction"], "_p", values_a_range=ranged) if ranged else winsorised_percentile(sent, "raw", by, "_p")
    told = told.where("_at = _level")
    cohort = F.get(F.array(*[F.lit(c) for c in (*levels, "universe")]), F.col("_level"))
    pct = F.when(F.col("direction") == "lower", 100 - F.col("_p")).otherwise(F.col("_p"))
    return told.select(date, "symbol", *keep, "factor", "category", "raw", pct.alias("pct"), cohort.alias("cohort"))


def category_scores(percentiles: DataFrame, key: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """One row per key: the mean non-null percentile of every category as a column."""
    return percentiles.groupBy(*key).agg(*[F.avg(F.when(F.col("category") == c, F.col("pct"))).alias(c) for c in categories])


def composite(weights: Mapping[str, float], none: float | None = 0.0) -> Column:
    """Weighted mean of the categories present; none where they have no weight."""
    have = lambda c: F.col(c).isNotNull()
    top = sum((F.when(have(c), F.col(c) * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(have(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(none).cast("double"))


def composite_ranks(scored: DataFrame, out: str = "universe_rank", by: Sequence[str] = ("d",)) -> DataFrame:
    """scored (a saved table: it is read twice) with the rank of composite in its group, ties to quality, shareholder return, market cap, then symbol.

    A group is dealt into its hundredths of the scale of composites, ranked in each, and moved on by how
    many stand in those above: no task holds a whole group.
    """
    order = [F.desc(F.round("composite", 8)), F.desc_nulls_last("quality"), F.desc_nulls_last("shareholder_return"), F.desc("market_cap"), F.asc("symbol")]
    df = scored.withColumn("_cell", F.floor(F.round("composite", 8)))
    counts = df.groupBy(*by, "_cell").agg(F.count("*").alias("_c"))
    above = counts.select(*by, "_cell", (F.sum("_c").over(Window.partitionBy(*by).orderBy(F.desc("_cell"))) - F.col("_c")).alias("_above"))
    inside = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order))
    return df.withColumn("_k", inside).join(above, [*by, "_cell"]).withColumn(out, (F.col("_k") + F.col("_above")).cast("int")).drop("_cell", "_k", "_above")


def rank(panel: DataFrame, factors: Sequence[Factor] | None = None, weights: Mapping[str, float] | None = None, floor: bool = True, least: int = 8, rows_a_task: int = 1_000_000) -> DataFrame:
    """Every row of panel with its category scores, composite, industry_rank and universe_rank.

    Rows that fail the quality floor stay, unscored and unranked, with floor_reason; they are in no
    cohort. Composites equal to eight places tie; ties fall to quality, shareholder return, market cap, then symbol.
    What is read more than once is written to the shared folder on the way. Dates of over rows_a_task rows have their percentiles
    taken by ranges of values, in which no task holds a cohort.
    """
    factors = factors or default_factors()
    weights = normalise_weights(weights)
    df = saved(quality_floor(panel) if floor else panel.withColumn("floor_reason", F.lit(None).cast("string")), "floored")
    fine = df.where(F.col("floor_reason").isNull())
    largest = fine.groupBy("d").count().agg(F.max("count")).first()[0] or 0
    scores = category_scores(cohort_percentiles(fine, factors, least=least, ranged=rows_a_task if largest > rows_a_task else None), ["d", "symbol"], list(weights))
    scored = saved(fine.join(scores, ["d", "symbol"]).withColumn("composite", composite(weights)), "scored")
    scored = composite_ranks(composite_ranks(scored, "industry_rank", ["d", "industry"]), "universe_rank", ["d"])
    return scored.unionByName(df.where(F.col("floor_reason").isNotNull()), allowMissingColumns=True)


def first_bucket() -> Column:
    """The bucket of a row before the lowest share is avoided: ranked, watch or avoid."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in SCORED), F.lit(0))
    return (
        F.when(F.col("industry").isin(MODEL_INCOMPATIBLE) | (missing == len(SCORED)) | F.col("p25").isNull(), "avoid")
        .when(F.coalesce("negative_equity", F.lit(False)), "watch")
        .when(F.round("price", 8) < F.round("p25", 8), "ranked")
        .otherwise("watch")
    )


def bucket(ranked: DataFrame, avoid: float = 0.10, by: Sequence[str] = ("d",)) -> DataFrame:
    """ranked with bucket: ranked, watch or avoid, and bottom: whether the lowest share put it there.

    Needs industry, the five scored categories, negative_equity, price, p25 (null without a fair value)
    and composite. Of the rows that would not be avoided, the lowest share `avoid` by composite is.
    """
    df = saved(ranked.withColumn("_first", first_bucket()), "placed")
    in_play = F.coalesce((F.col("_first") != "avoid") & (F.col("composite") > 0), F.lit(False))
    cut = df.where(in_play).groupBy(*by).agg(F.expr(f"percentile_disc({avoid}) within group (order by composite)").alias("_cut"))
    df = df.join(cut, list(by), "left")
    low = F.coalesce(in_play & (F.col("composite") <= F.col("_cut")) & F.lit(avoid > 0), F.lit(False))
    return df.withColumns({"bucket": F.when(low, "avoid").otherwise(F.col("_first")), "bottom": low}).drop("_first", "_cut")


#: Labels of the categories, and the scores from which one is a strength or a weakness.
LABELS = {"valuation": "Valuation", "health": "Financial health", "quality": "Quality", "shareholder_return": "Shareholder return", "growth": "Growth"}
STRENGTH, WEAKNESS = 65, 35
#: The headline of a reason; {} is the upside, the composite or the industry.
HEADLINES = {
    "actionable-buy": "Buy candidate — trades {} below the conservative fair value (p25).",
    "above-conservative-tail": "Watch — fair value present but the price is at or above the conservative tail (p25). Worth tracking; not actionable today.",
    "negative-equity": "Watch — sustained buybacks have driven shareholders' equity below zero. ROIC nulls out structurally; otherwise the engine still scores the company.",
    "bottom-decile-composite": "Avoid — composite ({}/100) sits in the bottom decile of the eligible cohort. Phase 4A long/short evidence: this tail underperformed SPY by ~25 pp at 3y in COVID-era PIT data.",
    "no-fair-value": "Avoid — couldn't compute a fair value range (insufficient anchors). Without an FV anchor the engine can't tell if the price is cheap or expensive.",
    "failed-quality-floor": "Avoid — failed the §4 quality floor entirely (no category scored). The engine can't size up the business well enough to act.",
    "model-incompatible-industry": "Avoid — {} accounting is outside the model's domain (PE / EV-EBITDA / P-FCF anchors don't apply to banks, capital markets, or reinsurers). Even an attractive-looking FV here would be extrapolation noise.",
}


def bucket_rationale(placed: DataFrame) -> DataFrame:
    """placed (of bucket) with reason, headline, strengths and weaknesses (at most three each).

    Also needs upside_p25, confidence, divergent and trend (of the fair value), null where unknown. The
    best scores come first among strengths, the worst among weaknesses; facts about the value fill up.
    """
    c = F.col
    scored = sum((F.when(c(x).isNotNull(), 1).otherwise(0) for x in SCORED), F.lit(0))
    reason = (
        F.when((c("bucket") == "avoid") & c("bottom"), "bottom-decile-composite")
        .when((c("bucket") == "avoid") & c("industry").isin(MODEL_INCOMPATIBLE), "model-incompatible-industry")
        .when((c("bucket") == "avoid") & (scored == 0), "failed-quality-floor")
        .when(c("bucket") == "avoid", "no-fair-value")
        .when(c("bucket") == "ranked", "actionable-buy")
        .when(F.coalesce("negative_equity", F.lit(False)), "negative-equity")
        .otherwise("above-conservative-tail")
    )

    def texts(good: bool) -> Column:
        items = []
        for k, x in enumerate(SCORED):
            hit = c(x) >= STRENGTH if good else c(x) <= WEAKNESS
            text = F.concat(F.lit(f"{LABELS[x]} score "), F.floor(F.round(c(x), 7) + 0.5).cast("int").cast("string"), F.lit("/100"))
            items.append(F.when(hit, F.struct(F.round(-c(x) if good else c(x), 7).alias("s"), F.lit(k).alias("k"), text.alias("t"))))
        return F.transform(F.sort_array(F.array_compact(F.array(*items))), lambda i: i["t"])

    pct = F.format_number("upside_p25", 1)
    below = F.when((c("price") < c("p25")) & c("upside_p25").isNotNull(), F.concat(F.lit("Trades "), F.replace(pct, F.lit(","), F.lit("")), F.lit("% below conservative fair value (p25)")))
    sure = F.when(c("confidence") == "high", F.lit("High-confidence fair value (full anchor coverage)"))
    lacking = F.array_join(F.array_compact(F.array(*[F.when(c(x).isNull(), F.lit(LABELS[x])) for x in SCORED])), ", ")
    faults = [
        F.when(F.coalesce("negative_equity", F.lit(False)), F.lit("Negative shareholders' equity (sustained buybacks; ROIC nulls structurally)")),
        F.when(c("trend") == "declining", F.lit("Fair value trending down ~2 years (informational; not a demote)")),
        F.when(c("divergent"), F.lit("Peer cohort deemed unreliable — FV uses own history only")),
        F.when(c("confidence") == "low", F.lit("Low-confidence fair value (limited anchor coverage)")),
        F.when(lacking != "", F.concat(F.lit("Missing data for: "), lacking)),
    ]
    three = lambda a, more: F.slice(F.concat(F.slice(a, 1, 3), F.array_compact(F.array(*more))), 1, 3)
    told = {
        "actionable-buy": F.when(c("upside_p25").isNull(), "").otherwise(F.concat(F.replace(pct, F.lit(","), F.lit("")), F.lit("% "))),
        "bottom-decile-composite": F.floor(F.round("composite", 7) + 0.5).cast("int").cast("string"),
        "model-incompatible-industry": c("industry"),
    }
    headline = F.lit(None).cast("string")
    for name, text in HEADLINES.items():
        before, _, after = text.partition("{}")
        said = F.concat(F.lit(before), told[name], F.lit(after.lstrip() if name == "actionable-buy" else after)) if name in told else F.lit(text)
        headline = F.when(reason == name, said).otherwise(headline)
    return placed.withColumns({"reason": reason, "headline": headline, "strengths": three(texts(True), [below, sure]), "weaknesses": three(texts(False), faults)})


def decile(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str = "decile", least: int = 10) -> DataFrame:
    """df with out: 1 (highest value) to 10 by equal runs of ceil(n / 10) rows; null in groups under least."""
    w = Window.partitionBy(*by)
    i = F.row_number().over(w.orderBy(F.desc(value), tie)) - 1
    n = F.count("*").over(w)
    return df.withColumn(out, F.when(n >= least, F.least(F.lit(10), F.floor(i / F.ceil(n / 10)) + 1)).cast("int"))


def yearly_first(df: DataFrame, by: Sequence[str], date: str, prefer: str | None = None) -> DataFrame:
    """The first row of each key and calendar year, rows where prefer holds before others."""
    order = [*([F.desc(prefer)] if prefer else []), F.asc(date)]
    w = Window.partitionBy(*by, F.year(date)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fundamentals_direction(df: DataFrame, trailing: str, forward: str, past: str, threshold: float = 5) -> Column:
    """improving, declining, stable or insufficient_data.

    past is an array of annual figures, newest first, nulls ignored: its trend with the trailing figure
    as the latest point, the forward figure against the trailing one, and decay from the peak of the
    newest three decide, in that order of strength that the when-chain spells out.
    """
    t, f = F.col(trailing), F.col(forward)
    clean = F.filter(past, lambda x: x.isNotNull())
    n = F.size(clean)
    series = F.concat(F.reverse(clean), F.array(t))
    m = n + 1
    mean_x = (m - 1) / 2
    mean_y = F.aggregate(series, F.lit(0.0), lambda a, y: a + y) / m
    num = F.aggregate(F.transform(series, lambda y, i: (i - mean_x) * (y - mean_y)), F.lit(0.0), lambda a, y: a + y)
    den = F.aggregate(F.transform(series, lambda y, i: (i - mean_x) * (i - mean_x)), F.lit(0.0), lambda a, y: a + y)
    start = F.get(series, F.lit(0))
    slope = F.when(F.abs(start) >= 0.01, F.when(den > 0, num / den) / F.abs(start) * 100)
    trend = F.when(slope > threshold, "improving").when(slope < -threshold, "declining").when(slope.isNotNull(), "flat").otherwise("unknown")
    peak = F.array_max(F.slice(clean, 1, 3))
    # from a profitable peak a loss or a fall, from a loss a deeper one
    decay = F.when(peak > 0, (t <= 0) | ((t - peak) / peak * 100 < -threshold)).otherwise(t < peak)
    ahead = F.when(f.isNull(), "unknown").when((t <= 0) & (f > t), "improving").when((t <= 0) & (f < t), "declining").when(t <= 0, "flat").when(f <= 0, "declining").when((f - t) / t * 100 > threshold, "improving").when((f - t) / t * 100 < -threshold, "declining").otherwise("flat")
    return (
        F.when(t.isNull() | (n < 2), "insufficient_data")
        .when((t <= 0) & (f > 0), "improving")
        .when(f <= 0, "declining")
        .when((trend == "improving") & (ahead == "improving"), "improving")
        .when(ahead == "declining", "declining")
        .when(((trend == "declining") | F.coalesce(decay, F.lit(False))) & (ahead != "improving"), "declining")
        .otherwise("stable")
    )
