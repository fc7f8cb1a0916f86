"""Scenario simulation for many portfolios and scenarios at once.

Everything is keyed by (portfolio, scenario) and holds at most one row per fund, so no group can grow
with the data. Impacts (scenarios x sectors) are small and derived from fixed tables; Spark sees their
size at run time and chooses the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C

PS = ("portfolio", "scenario")


def sector_impacts(sens: DataFrame, shocks: DataFrame) -> DataFrame:
    """Impact of every scenario on every sector; a missing coefficient, or a factor nobody knows, counts as zero.

    ``rank`` is the place from worst to best, ties in matrix order; ``sectors`` the number of sectors.
    """
    known = shocks.join(sens, "factor").select("scenario", "sord", "sector", "ord", (F.col("coef") * F.col("change")).alias("_i"))
    # Every scenario meets every sector: as many rows as the result has.
    sectors = sens.groupBy().agg(F.collect_set(F.struct("sector", "ord")).alias("_s"))
    none = shocks.select("scenario", "sord").distinct().withColumn("_s", sectors.scalar())
    none = none.select("scenario", "sord", F.inline("_s")).withColumn("_i", F.lit(0.0))
    hit = known.unionByName(none).groupBy("scenario", "sord", "sector", "ord").agg(F.sum("_i").alias("impact"))
    w = Window.partitionBy("scenario")
    return hit.withColumns(
        {
            "rank": F.row_number().over(w.orderBy("impact", "ord")),
            "sectors": F.count(F.lit(1)).over(w),
            "mean_impact": F.avg("impact").over(w),
        }
    )


def exposures(weights: DataFrame, funds: DataFrame, impacts: DataFrame) -> DataFrame:
    """One row per portfolio, scenario and held fund with its sector's impact.

    ``funds`` maps tickers to sectors; an unknown ticker stands for itself in lower case. Holdings whose sector has no
    impact in a scenario stay, with impact 0 and no rank.
    """
    held = weights.join(funds.select("etf", F.col("sector").alias("_s")), "etf", "left")
    held = held.withColumn("sector", F.coalesce("_s", F.lower("etf"))).drop("_s")
    known = impacts.select("sector").distinct().withColumn("_key", F.col("sector"))
    held = held.join(known, "sector", "left").withColumn("_key", F.coalesce("_key", F.lit("")))
    rest = [c for c in impacts.columns if c not in ("scenario", "sord", "sector", "sectors", "mean_impact", "impact")]
    scenarios = impacts.select("scenario", "sord", "sectors", "mean_impact").distinct()
    other = scenarios.select("*", F.lit("").alias("_key"), F.lit(0.0).alias("impact"), *[F.lit(None).cast(impacts.schema[c].dataType).alias(c) for c in rest])
    full = impacts.withColumnRenamed("sector", "_key").unionByName(other)
    return held.join(full, "_key").drop("_key")


def reweight(exposed: DataFrame) -> DataFrame:
    """Causal weights: the three worst sectors give up 30 % where held above 5 %, shared by held best three."""
    w = Window.partitionBy(*PS)
    give = F.when((F.col("rank") <= 3) & (F.col("w") > 0.05), F.col("w") * 0.3).otherwise(0.0)
    best = F.coalesce(F.col("rank") > F.col("sectors") - 3, F.lit(False))
    df = exposed.withColumns({"_give": give, "_best": best}).withColumns(
        {"_pool": F.sum("_give").over(w), "_k": F.sum(F.col("_best").cast("int")).over(w)}
    )
    gain = F.when(F.col("_best"), F.try_divide("_pool", "_k")).otherwise(0.0)
    df = df.withColumn("_raw", F.col("w") - F.col("_give") + gain).withColumn("_sum", F.sum("_raw").over(w))
    norm = F.when(F.col("_sum") > 0, F.col("_raw") / F.col("_sum")).otherwise(F.col("_raw"))
    return df.withColumn("causal_w", norm).drop("_give", "_best", "_pool", "_k", "_raw", "_sum")


def simulate(exposed: DataFrame) -> DataFrame:
    """Impact of each scenario on each portfolio: as held, re-weighted, and equally weighted.

    ``vs_current`` keeps the sign of its definition: positive means the re-weighted portfolio loses more.
    """
    impact = F.col("impact")
    run = reweight(exposed).groupBy(*PS, "sord").agg(
        F.sum(F.col("w") * impact).alias("current"),
        F.sum(F.col("causal_w") * impact).alias("causal"),
        F.avg(impact).alias("traditional"),
    )
    return run.withColumns(
        {
            "vs_current": (F.col("current") - F.col("causal")) * 100,
            "vs_traditional": (F.col("traditional") - F.col("causal")) * 100,
        }
    )


def breakdown(exposed: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*PS))
    pct = F.col("impact") * 100
    return reweight(exposed).select(
        *PS,
        "etf",
        C.title(F.col("sector")).alias("sector"),
        (F.col("w") * 100).alias("weight"),
        (pct * F.col("w")).alias("current"),
        (pct * F.col("causal_w")).alias("causal"),
        (pct / n).alias("traditional"),
        pct.alias("raw_impact"),
    )


def compare(runs: DataFrame) -> DataFrame:
    """Worst and best scenario of each portfolio and the means over scenarios."""
    return runs.groupBy("portfolio").agg(
        F.min_by("scenario", F.struct("current", "sord")).alias("worst_scenario"),
        F.max_by("scenario", F.struct("current", "sord")).alias("best_scenario"),
        (F.avg("current") * 100).alias("average_impact"),
        F.avg("vs_current").alias("average_causal_improvement"),
    )


def compare_regimes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("portfolio").agg(
        F.max_by("scenario", F.struct("current", -F.col("sord"))).alias("best_regime"),
        F.min_by("scenario", F.struct("current", "sord")).alias("worst_regime"),
        F.avg("vs_current").alias("causal_advantage"),
    )


def immediate_actions(exposed: DataFrame, funds: DataFrame, impacts: DataFrame) -> DataFrame:
    """Reduce the three worst sectors (below -2 %, held above 5 %), increase the two best (above 1 %).

    A portfolio's weights (at most one per fund) become one map per scenario and meet the scenario's few
    candidate sectors, so holdings are read once and sectors that are not held are found too.
    """
    rank, impact = F.col("rank"), F.col("impact")
    low = (rank <= 3) & (impact < -0.02)
    high = (rank > F.col("sectors") - 2) & (impact > 0.01)
    candidates = impacts.filter(low | high).join(funds.select("sector", "etf"), "sector")
    candidates = candidates.select("scenario", "etf", "rank", F.when(high, "increase").otherwise("reduce").alias("action"))
    held = exposed.groupBy(*PS).agg(F.map_from_entries(F.collect_list(F.struct("etf", "w"))).alias("m"))
    j = held.join(candidates, "scenario").withColumn("w", F.coalesce(F.try_element_at("m", "etf"), F.lit(0.0)))
    more = F.col("action") == "increase"
    rows = j.filter(more | (F.col("w") > 0.05)).select(
        *PS,
        "action",
        "etf",
        (F.col("w") * 100).alias("current_weight"),
        F.when(more, 5.0).otherwise(F.col("w") * 30).alias("suggested"),
        F.row_number().over(Window.partitionBy(*PS).orderBy("rank")).alias("place"),
    )
    return rows.filter("place <= 5")


def strategic_shifts(shocks: DataFrame, impacts: DataFrame) -> DataFrame:
    """Up to three strategies per scenario: by factor in the order given, hedging last."""
    change, factor = F.col("change"), F.col("factor")
    strategy = (
        F.when((factor == "interest_rates") & (change > 0.01), "Rate Protection")
        .when((factor == "inflation") & (change > 0.02), "Inflation Hedge")
        .when((factor == "gdp_growth") & (change < -0.01), "Defensive Positioning")
    )
    sure = (factor == "inflation") | (F.abs(change) > 0.02)
    by_factor = shocks.select(
        "scenario", strategy.alias("strategy"), F.when(sure, "high").otherwise("medium").alias("confidence"), "pos"
    ).filter(F.col("strategy").isNotNull())
    hedge = impacts.filter((F.col("rank") == 1) & (F.col("mean_impact") < -0.03)).select(
        "scenario", F.lit("Hedging").alias("strategy"), F.lit("medium").alias("confidence"), F.lit(99).alias("pos")
    )
    w = Window.partitionBy("scenario").orderBy("pos")
    both = by_factor.unionByName(hedge).withColumn("place", F.row_number().over(w))
    return both.filter("place <= 3").drop("pos")


# ---------------------------------------------------------------- what-if requests: plain projections, no shuffle

# fixed values: sectors, weights and tickers of the quick simulator
QUICK = (("technology", 0.35, 0.25, "XLK"), ("healthcare", 0.25, 0.25, "XLV"), ("energy", 0.15, 0.2, "XLE"), ("financials", 0.25, 0.2, "XLF"))


def _quick_impact(sector: str) -> Column:
    r, i, g = K.SENSITIVITY[sector][:3]
    return r * F.col("rates") + i * F.col("inflation") + g * F.col("gdp")


def quick_shift(requests: DataFrame) -> DataFrame:
    """Impact as held, with 30 % of the worst sector moved to the best, and equally weighted."""
    impacts = [_quick_impact(s) for s, *_ in QUICK]
    held = sum(i * w for i, (_, w, *_) in zip(impacts, QUICK))
    equal = sum(i * 0.25 for i in impacts)
    cells = F.array(*[F.struct(i.alias("impact"), F.lit(k).alias("k"), F.lit(w).alias("w")) for k, (i, (_, w, *_)) in enumerate(zip(impacts, QUICK))])
    ranked = requests.withColumns({"current": held, "traditional": equal, "_s": F.array_sort(cells)})
    worst, best = F.col("_s")[0], F.col("_s")[3]
    moved = worst["w"] * 0.3
    causal = F.col("current") + moved * (best["impact"] - worst["impact"])
    return ranked.select("request", "current", causal.alias("causal"), "traditional")


def tilted_weights(requests: DataFrame) -> DataFrame:
    """Weights max(5 %, base + 5 % x impact) for four funds, staples fixed at 10 %, normalised."""
    raw = {etf: F.greatest(F.lit(0.05), base + 0.05 * _quick_impact(s)) for s, _, base, etf in QUICK}
    raw["XLP"] = F.lit(0.1)
    total = sum(raw.values())
    return requests.select("request", *[(w / total).alias(etf) for etf, w in raw.items()])


def quick_advice(requests: DataFrame) -> DataFrame:
    """Up to three sentences per request."""
    rates, infl, gdp = F.col("rates"), F.col("inflation"), F.col("gdp")
    pct = lambda x: F.floor(x + 0.5).cast("string")
    items = F.array_compact(
        F.array(
            F.when(rates > 1, F.concat(F.lit("Reduce Technology exposure by "), pct(F.abs(rates) * 3), F.lit("%"))),
            F.when(rates > 1, F.concat(F.lit("Reduce Financials exposure by "), pct(F.abs(rates) * 2), F.lit("%"))),
            F.when(infl > 1, F.concat(F.lit("Increase Energy allocation by "), pct(infl * 4), F.lit("%"))),
            F.when(gdp < -1, F.lit("Shift to defensive sectors (Healthcare, Utilities)")),
            F.lit("Diversify into rate-resistant assets"),
        )
    )
    return requests.select("request", F.posexplode(F.slice(items, 1, 3)).alias("place", "advice"))


def tilt_by_effect(requests: DataFrame) -> DataFrame:
    """Equal weights over all sectors, +5 % where the effect is positive, -5 % below -0.02, floor 5 %, normalised."""
    n = len(K.SENSITIVITY)
    cells = F.array(*[F.struct(F.lit(s).alias("sector"), F.lit(c[0]).alias("c")) for s, c in K.SENSITIVITY.items()])

    def weight(x):
        ate = C.what_if_effect(x["c"], F.col("rates"))
        tilt = F.when(ate > 0, 0.05).when(ate < -0.02, -0.05).otherwise(0.0)
        return F.struct(x["sector"].alias("sector"), F.greatest(F.lit(0.05), 1.0 / n + tilt).alias("w"))

    w = requests.select("request", F.transform(cells, weight).alias("ws"))
    w = w.withColumn("total", F.aggregate("ws", F.lit(0.0), lambda a, x: a + x["w"]))
    return w.select("request", F.explode("ws").alias("x"), "total").select(
        "request", "x.sector", (F.col("x.w") / F.col("total")).alias("w")
    )


def quick_mean(requests: DataFrame) -> DataFrame:
    """Equal-weight mean over all sectors of rate sensitivity times change."""
    mean = sum(c[0] for c in K.SENSITIVITY.values()) / len(K.SENSITIVITY)
    return requests.select("request", (mean * F.col("rates")).alias("impact"))


def rule_allocation(rate_sensitivity: Column) -> Column:
    """Base 25; -10 below -0.5, +5 above 0; limited to 5..50."""
    move = F.when(rate_sensitivity < -0.5, -10.0).when(rate_sensitivity > 0, 5.0).otherwise(0.0)
    return C.clip(25.0 + move, 5.0, 50.0)


def objective_for(risk: Column) -> Column:
    return F.when(risk <= 0.3, "min_volatility").when(risk >= 0.7, "max_returns").otherwise("max_sharpe")


def regime_tilt(exposed: DataFrame, first: int = 4) -> DataFrame:
    """Equal weights over the first sectors of the matrix that a portfolio holds; x0.7 below -2 %, x1.3 above 2 %."""
    w = Window.partitionBy(*PS)
    top = exposed.withColumn("_i", F.row_number().over(w.orderBy("ord"))).filter(F.col("_i") <= first)
    impact, equal = F.col("impact"), 1.0 / F.count(F.lit(1)).over(w)
    tilt = F.when(impact < -0.02, 0.7).when(impact > 0.02, 1.3).otherwise(1.0)
    rows = top.withColumns({"_t": impact * equal, "_c": impact * equal * tilt})
    return rows.groupBy(*PS).agg(
        (F.sum("_t") * 100).alias("traditional"),
        (F.sum("_c") * 100).alias("causal"),
        ((F.sum("_c") - F.sum("_t")) * 100).alias("improvement"),
    )


def treatment_recommendations(weights: DataFrame, sens: DataFrame, forecast: DataFrame) -> DataFrame:
    """Reduce or increase sectors on expected impact; the five largest suggested changes of each portfolio."""
    hit = sens.join(forecast, "factor").groupBy("sector").agg(
        F.sum(F.col("coef") * F.col("change")).alias("impact"),
        F.sum((F.abs(F.col("coef") * F.col("change")) > 0.01).cast("int")).alias("drivers"),
    )
    i, w = F.col("impact"), F.col("w")
    action = F.when((i < -0.05) & (w > 0.1), "reduce").when((i > 0.05) & (w < 0.3), "increase")
    size = F.when(F.col("action") == "reduce", -i * w).otherwise(i * 0.1)
    rec = weights.join(hit, "sector").withColumn("action", action).filter(F.col("action").isNotNull())
    rec = rec.withColumns(
        {
            "suggested_change": size,
            "confidence": F.when(F.abs(i) > 0.1, "high").otherwise("medium"),
        }
    )
    top = Window.partitionBy("portfolio").orderBy(F.abs("suggested_change").desc(), "sector")
    return rec.withColumn("place", F.row_number().over(top)).filter("place <= 5")
