"""Market regimes: rules, economic cycle, unsupervised states and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import series as W
from tidewise.session import values_table

LABELS = ("bull", "sideways", "bear", "crisis")

# fixed values: thresholds where no rules were fitted (bull return, bear return, volatility)
DEFAULT_RULES = (0.15, -0.10, 0.25)


def features(returns: DataFrame, layout: W.Layout = W.DAILY, r: str = "r") -> DataFrame:
    """Adds 21-day annual volatility and 63-day annual mean return."""
    x = F.col(r)

    def stage(w: WindowSpec):
        return {
            "volatility": C.annual_volatility(W.rolling_std(x, w, 21)),
            "momentum": C.annual_return(W.sma(x, w, 63)),
            "recent_return": C.annual_return(W.sma(x, w, 21)),
        }

    return W.windowed(returns, layout, [stage], back=63)


def fit_rules(feats: DataFrame, r: str = "r") -> DataFrame:
    """Thresholds per series: upper and lower quartile of returns, upper quartile of volatility."""
    return feats.groupBy("symbol").agg(
        (F.percentile(r, 0.75) * K.TRADING_DAYS).alias("bull"),
        (F.percentile(r, 0.25) * K.TRADING_DAYS).alias("bear"),
        F.percentile("volatility", 0.75).alias("vol_limit"),
    )


def classify(ret: Column, vol: Column, bull: Column, bear: Column, limit: Column) -> dict[str, Column]:
    crisis = (vol > limit * 1.5) & (ret < bear)
    regime = F.when(crisis, "crisis").when(ret > bull, "bull").when(ret < bear, "bear").otherwise("sideways")
    prob = F.when(crisis, 0.8).when((ret > bull) | (ret < bear), 0.7).otherwise(0.6)
    return {"regime": regime, "probability": prob}


def predict_rules(feats: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Regime of every row with a full 21-row window."""
    full = feats.filter(F.col("recent_return").isNotNull() & F.col("volatility").isNotNull())
    if rules is None:
        limits = [F.lit(v) for v in DEFAULT_RULES]
    else:
        full, limits = full.join(rules, "symbol"), [F.col(c) for c in ("bull", "bear", "vol_limit")]
    return full.withColumns(classify(F.col("recent_return"), F.col("volatility"), *limits))


def latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.max("ts").alias("ts"), F.max_by("regime", "ts").alias("regime"), F.max_by("probability", "ts").alias("probability")
    )


def detect(returns: DataFrame, lookback: int = 252) -> DataFrame:
    """Fit rules on the whole history, predict on its last ``lookback`` rows, add the advice."""
    rules = fit_rules(features(returns))
    recent = features(W.last_rows(returns, W.DAILY, lookback))
    return with_advice(latest(predict_rules(recent, rules)))


def advice(spark) -> DataFrame:
    rows = [(k, *v) for k, v in K.REGIME_ADVICE.items()]
    cols = [("regime", "string"), ("risk_level", "string"), ("equity", "double"), ("bond", "double"), ("cash", "double"), ("strategy", "string")]
    return values_table(spark, cols, rows)


def tilts(spark) -> DataFrame:
    rows = [(g, s, t) for g, ts in K.REGIME_TILTS.items() for s, t in ts.items()]
    return values_table(spark, [("regime", "string"), ("sector_name", "string"), ("tilt", "string")], rows)


def with_advice(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Advice of the row's regime; an unknown regime gets the sideways advice."""
    known = F.when(F.col(regime).isin(*LABELS), F.col(regime)).otherwise("sideways")
    a = advice(df.sparkSession).withColumnRenamed("regime", "_advice")
    return df.withColumn("_advice", known).join(a, "_advice").drop("_advice")


# ---------------------------------------------------------------- states and statistics


def label_states(states: DataFrame, r: str = "r") -> DataFrame:
    """State -> label by mean return, best first; states beyond four are called regime_i."""
    mean = states.groupBy("state").agg(F.avg(r).alias("mean_return"), F.count(F.lit(1)).alias("n"))
    # one row per state: the window holds a handful of rows
    place = F.row_number().over(Window.orderBy(F.desc("mean_return"), "state"))
    names = F.array(*[F.lit(x) for x in LABELS])
    mean = mean.withColumn("place", place)
    label = F.when(F.col("place") <= 4, F.try_element_at(names, F.col("place"))).otherwise(
        F.concat(F.lit("regime_"), (F.col("place") - 1).cast("string"))
    )
    return mean.withColumn("label", label)


def statistics(states: DataFrame, layout: W.Layout = W.DAILY, r: str = "r") -> DataFrame:
    """Annual mean return, mean of the volatility feature, Sharpe ratio (by the deviation of returns), frequency and mean
    duration of each regime."""
    runs = W.run_lengths(states, layout, "regime").groupBy("regime").agg(F.avg("length").alias("avg_duration"))
    stats = states.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(r) * K.TRADING_DAYS).alias("mean_return"),
        F.avg("volatility").alias("volatility"),
        C.annual_volatility(F.stddev_samp(r)).alias("_deviation"),
    )
    total = Window.partitionBy()
    # at most a handful of regimes: a window over the grouped result
    stats = stats.withColumn("frequency", F.col("n") / F.sum("n").over(total))
    sharpe = F.coalesce(F.try_divide("mean_return", F.when(F.col("_deviation") > 0, F.col("_deviation"))), F.lit(0.0))
    return stats.withColumn("sharpe_ratio", sharpe).drop("_deviation").join(runs, "regime")


def distribution(states: DataFrame) -> DataFrame:
    """Count and share of every label; labels that do not occur count zero."""
    labels = values_table(states.sparkSession, [("regime", "string")], [(x,) for x in LABELS])
    n = states.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    full = labels.join(n, "regime", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("pct", F.round(F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy())), 1))


# ---------------------------------------------------------------- economic cycle


def cycle_score(latest_values: DataFrame) -> DataFrame:
    """Cycle phase from the latest indicator values, one row in and out per group.

    Columns used if present: yield_curve_spread, consumer_sentiment, unemployment_rate,
    industrial_production_change, cpi_change. A missing (null) indicator is left out of its mean.
    """
    have = set(latest_values.columns)

    def vote(name: str, up, down):
        if name not in have:
            return F.lit(None).cast("double")
        x = F.col(name)
        return F.when(x.isNotNull(), F.when(up(x), 1.0).when(down(x), -1.0).otherwise(0.0))

    def mean(*votes):
        n = sum(v.isNotNull().cast("int") for v in votes)
        return F.try_divide(sum(F.coalesce(v, F.lit(0.0)) for v in votes), n)

    leading = mean(
        vote("yield_curve_spread", lambda x: x > 0, lambda x: x < -0.5),
        vote("consumer_sentiment", lambda x: x > 90, lambda x: x < 70),
    )
    coincident = mean(
        vote("unemployment_rate", lambda x: x < 4.5, lambda x: x > 6),
        vote("industrial_production_change", lambda x: x > 0.02, lambda x: x < -0.02),
    )
    lagging = mean(vote("cpi_change", lambda x: (x > 0.01) & (x < 0.03), lambda x: (x > 0.05) | (x < 0)))
    df = latest_values.withColumns({"leading": leading, "coincident": coincident, "lagging": lagging})
    zero = F.lit(0.0)
    score = F.coalesce("leading", zero) * 0.5 + F.coalesce("coincident", zero) * 0.3 + F.coalesce("lagging", zero) * 0.2
    phase = (
        F.when(F.col("composite") > 0.3, "expansion")
        .when(F.col("composite") > 0, "late_expansion")
        .when(F.col("composite") > -0.3, "early_contraction")
        .otherwise("contraction")
    )
    return df.withColumn("composite", score).withColumn("phase", phase)


# ---------------------------------------------------------------- unsupervised states


def mixture_states(feats: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Gaussian states by distributed EM: adds ``state`` and ``probs`` (array) to every complete row."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = feats.dropna(subset=columns)
    vec = VectorAssembler(inputCols=columns, outputCol="_x").transform(whole)
    model = GaussianMixture(featuresCol="_x", k=k, seed=seed, predictionCol="state", probabilityCol="_p").fit(vec)
    return model.transform(vec).withColumn("probs", vector_to_array("_p")).drop("_x", "_p")


def filtered_probabilities(states: DataFrame, layout: W.Layout, k: int) -> DataFrame:
    """Forward filter per series: mixture posteriors smoothed by the counted transitions between states."""
    moves = W.transitions(states, layout, "state")
    cells = moves.select(F.struct("from_state", "to_state", "probability").alias("m")).agg(
        F.collect_list("m").alias("moves")  # k*k entries
    )
    schema = T.StructType(states.schema.fields + [T.StructField("filtered", T.ArrayType(T.DoubleType()))])
    order = list(layout.order)
    fields = [f.name for f in schema.fields]

    def forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        a = np.full((k, k), 1e-12)
        for m in pdf["_moves"].iloc[0]:
            a[m["from_state"], m["to_state"]] += m["probability"]
        a /= a.sum(axis=1, keepdims=True)
        base = np.vstack(pdf["probs"].to_numpy())
        prior = base.mean(axis=0)
        out, prev = [], prior
        for p in base:
            prev = (prev @ a) * (p / np.maximum(prior, 1e-12))
            prev = prev / prev.sum()
            out.append(prev.tolist())
        return pdf.assign(filtered=out)[fields]

    tagged = states.withColumn("_moves", cells.scalar())
    return tagged.groupBy(*layout.keys).applyInPandas(forward, schema)
