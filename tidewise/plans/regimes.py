"""Regimes, market condition and indicator snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.operators import features as X
from tidewise.operators import market as Q
from tidewise.operators import regimes as R
from tidewise.operators import series as W
from tidewise.plans.views import values
from tidewise.plans.windows import full
from tidewise.registry import query
from tidewise.sources import tables as S


def rets(spark, d):
    return X.returns(S.bars(spark, d)).filter(F.col("lr").isNotNull()).select("symbol", "ts", F.col("lr").alias("r"))


FEATS = f"""rr AS (SELECT symbol, ts, lr AS r FROM rets WHERE lr IS NOT NULL),
  ft AS (SELECT symbol, ts, r, {full('stddev_samp', 'r', 21)} * sqrt(252) AS volatility, {full('avg', 'r', 63)} * 252 AS momentum,
         {full('avg', 'r', 21)} * 252 AS recent_return FROM rr),
  ru AS (SELECT symbol, quantile_cont(r, 0.75) * 252 AS bull, quantile_cont(r, 0.25) * 252 AS bear,
         (SELECT quantile_cont(volatility, 0.75) FROM ft f2 WHERE f2.symbol = ft.symbol AND volatility IS NOT NULL) AS vol_limit FROM ft GROUP BY symbol),
  cl AS (SELECT symbol, ts, r, volatility, recent_return, CASE WHEN volatility > vol_limit * 1.5 AND recent_return < bear THEN 'crisis' WHEN recent_return > bull THEN 'bull'
         WHEN recent_return < bear THEN 'bear' ELSE 'sideways' END AS regime,
         CASE WHEN volatility > vol_limit * 1.5 AND recent_return < bear THEN 0.8 WHEN recent_return > bull OR recent_return < bear THEN 0.7 ELSE 0.6 END AS probability
         FROM ft JOIN ru USING (symbol) WHERE recent_return IS NOT NULL)"""
FIXED = f"""rr AS (SELECT symbol, ts, lr / 25 AS r FROM rets WHERE lr IS NOT NULL),
  ft AS (SELECT symbol, ts, r, {full('stddev_samp', 'r', 21)} * sqrt(252) AS volatility, {full('avg', 'r', 21)} * 252 AS recent_return FROM rr),
  cl AS (SELECT symbol, ts, r, volatility, CASE WHEN volatility > 0.25 * 1.5 AND recent_return < -0.10 THEN 'crisis' WHEN recent_return > 0.15 THEN 'bull'
         WHEN recent_return < -0.10 THEN 'bear' ELSE 'sideways' END AS regime FROM ft WHERE recent_return IS NOT NULL)"""


def fixed_regimes(spark, d):
    """Regimes by the default thresholds on returns scaled to everyday size."""
    r = rets(spark, d).withColumn("r", F.col("r") / 25)
    return R.predict_rules(R.features(r), None)


@query("regime_rules", "R1", f"WITH {FEATS} SELECT * FROM ru", r="bull bear vol_limit")
def regime_rules(spark, d):
    return R.fit_rules(R.features(rets(spark, d)))


@query(
    "current_regime",
    "R2",
    f"WITH {FEATS} SELECT symbol, max(ts) AS ts, arg_max(regime, ts) AS regime, arg_max(probability, ts) AS probability FROM cl GROUP BY 1",
    r="probability",
    dates="ts",
)
def current_regime(spark, d):
    f = R.features(rets(spark, d))
    return R.latest(R.predict_rules(f, R.fit_rules(f)))


@query(
    "regime_features",
    "R3",
    f"WITH {FEATS} SELECT symbol, ts, r, volatility, momentum FROM ft",
    r="r volatility momentum",
    dates="ts",
)
def regime_features(spark, d):
    return R.features(rets(spark, d)).drop("recent_return")


_ADVICE = values("regime, risk_level, equity, bond, cash, strategy", [(k, *v) for k, v in K.REGIME_ADVICE.items()], "equity bond cash")


@query(
    "regime_advice",
    "R5",
    f"""WITH {FEATS}, a AS ({_ADVICE}), x AS (SELECT symbol, ts, CASE WHEN day(ts) = 13 THEN 'unknown' ELSE regime END AS regime FROM cl)
        SELECT x.symbol, x.ts, x.regime, a.risk_level, a.equity, a.bond, a.cash, a.strategy FROM x
        JOIN a ON a.regime = CASE WHEN x.regime = 'unknown' THEN 'sideways' ELSE x.regime END""",
    r="equity bond cash",
    dates="ts",
)
def regime_advice(spark, d):
    f = R.features(rets(spark, d))
    p = R.predict_rules(f, R.fit_rules(f)).select("symbol", "ts", "regime")
    p = p.withColumn("regime", F.when(F.dayofmonth("ts") == 13, "unknown").otherwise(F.col("regime")))
    return R.with_advice(p)


@query(
    "regime_tilts",
    "R5",
    f"""WITH {FEATS}, t AS ({values('regime, sector_name, tilt', [(g, s, t) for g, ts in K.REGIME_TILTS.items() for s, t in ts.items()])}),
        l AS (SELECT symbol, arg_max(regime, ts) AS regime FROM cl GROUP BY 1) SELECT symbol, l.regime, sector_name, tilt FROM l JOIN t ON l.regime = t.regime""",
)
def regime_tilts(spark, d):
    f = R.features(rets(spark, d))
    now = R.latest(R.predict_rules(f, R.fit_rules(f))).select("symbol", "regime")
    return now.join(R.tilts(spark), "regime").select("symbol", "regime", "sector_name", "tilt")


@query(
    "detect_current_regime",
    "R8 F3",
    f"""WITH {FEATS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM rr),
        f2 AS (SELECT symbol, ts, {full('stddev_samp', 'r', 21)} * sqrt(252) AS volatility, {full('avg', 'r', 21)} * 252 AS recent_return FROM n WHERE rn <= 252),
        l AS (SELECT symbol, max(ts) AS ts, arg_max(volatility, ts) AS v, arg_max(recent_return, ts) AS rr FROM f2 WHERE recent_return IS NOT NULL GROUP BY 1),
        c AS (SELECT symbol, ts, CASE WHEN v > vol_limit * 1.5 AND rr < bear THEN 'crisis' WHEN rr > bull THEN 'bull' WHEN rr < bear THEN 'bear' ELSE 'sideways' END AS regime FROM l JOIN ru USING (symbol)),
        a AS ({_ADVICE}) SELECT symbol, ts, regime, risk_level, equity, strategy FROM c JOIN a USING (regime)""",
    r="equity",
    dates="ts",
)
def detect_current_regime(spark, d):
    return R.detect(rets(spark, d)).select("symbol", "ts", "regime", "risk_level", "equity", "strategy")


@query(
    "regime_history",
    "R9",
    f"WITH {FEATS} SELECT symbol, ts, regime, probability, volatility, recent_return FROM cl",
    r="probability volatility recent_return",
    dates="ts",
)
def regime_history(spark, d):
    f = R.features(rets(spark, d))
    h = R.predict_rules(f, R.fit_rules(f))
    return h.select("symbol", "ts", "regime", "probability", "volatility", "recent_return")


@query(
    "regime_statistics",
    "A15 W14",
    f"""WITH {FIXED}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS g FROM cl),
        u AS (SELECT regime, avg(n) AS avg_duration FROM (SELECT symbol, regime, g, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1),
        s AS (SELECT regime, count(*) AS n, avg(r) * 252 AS mean_return, avg(volatility) AS volatility, stddev_samp(r) * sqrt(252) AS deviation FROM cl GROUP BY 1)
        SELECT regime, n, mean_return, volatility, n / sum(n) OVER () AS frequency, mean_return / deviation AS sharpe_ratio, avg_duration FROM s JOIN u USING (regime)""",
    r="mean_return volatility frequency sharpe_ratio avg_duration",
)
def regime_statistics(spark, d):
    return R.statistics(fixed_regimes(spark, d).select("symbol", "ts", "regime", "r", "volatility"))


@query(
    "regime_distribution",
    "A16",
    f"""WITH {FIXED}, l(regime) AS (VALUES ('bull'), ('sideways'), ('bear'), ('crisis')), n AS (SELECT regime, count(*) AS n FROM cl GROUP BY 1),
        j AS (SELECT l.regime, coalesce(n, 0) AS n FROM l LEFT JOIN n ON l.regime = n.regime)
        SELECT regime, n, round(n * 100.0 / sum(n) OVER (), 1) AS pct FROM j""",
    r="pct:1",
)
def regime_distribution(spark, d):
    return R.distribution(fixed_regimes(spark, d))


@query(
    "state_labels",
    "W18",
    f"""WITH {FIXED}, s AS (SELECT CAST(floor(least(5, greatest(0, r * 50 + 3))) AS INTEGER) AS state, r FROM rr),
        m AS (SELECT state, avg(r) AS mean_return, count(*) AS n FROM s GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY mean_return DESC, state) AS place FROM m)
        SELECT *, CASE place WHEN 1 THEN 'bull' WHEN 2 THEN 'sideways' WHEN 3 THEN 'bear' WHEN 4 THEN 'crisis' ELSE 'regime_' || (place - 1) END AS label FROM p""",
    r="mean_return",
)
def state_labels(spark, d):
    r = rets(spark, d).withColumn("r", F.col("r") / 25)
    state = F.floor(F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col("r") * 50 + 3))).cast("int")
    return R.label_states(r.withColumn("state", state))


@query("mixture_regimes", "R4 A17")
def mixture_regimes(spark, d):
    f = R.features(rets(spark, d)).dropna(subset=["volatility", "momentum"])
    s = R.mixture_states(f, ["r", "volatility", "momentum"])
    names = R.label_states(s).select("state", "label")
    p = R.filtered_probabilities(s.select("symbol", "ts", "r", "state", "probs"), W.DAILY, 4)
    return p.join(names, "state").select("symbol", "ts", "state", "label", F.array_max("filtered").alias("confidence"))


@query(
    "economic_cycle",
    "R6 W19",
    """WITH m AS (SELECT obs_date, FEDFUNDS - CPIAUCSL AS yield_curve_spread, UNRATE / 3 AS unemployment_rate, GDP / lag(GDP) OVER (ORDER BY obs_date) - 1 AS industrial_production_change,
         CPIAUCSL / lag(CPIAUCSL) OVER (ORDER BY obs_date) - 1 AS cpi_change FROM macro_wide),
       v AS (SELECT obs_date, CASE WHEN yield_curve_spread > 0 THEN 1.0 WHEN yield_curve_spread < -0.5 THEN -1.0 ELSE 0.0 END AS "leading",
         (CASE WHEN unemployment_rate < 4.5 THEN 1.0 WHEN unemployment_rate > 6 THEN -1.0 ELSE 0.0 END + coalesce(CASE WHEN industrial_production_change > 0.02 THEN 1.0 WHEN industrial_production_change < -0.02 THEN -1.0
           WHEN industrial_production_change IS NOT NULL THEN 0.0 END, 0)) / CASE WHEN industrial_production_change IS NULL THEN 1 ELSE 2 END AS coincident,
         CASE WHEN cpi_change > 0.01 AND cpi_change < 0.03 THEN 1.0 WHEN cpi_change > 0.05 OR cpi_change < 0 THEN -1.0 WHEN cpi_change IS NOT NULL THEN 0.0 END AS lagging FROM m),
       c AS (SELECT *, "leading" * 0.5 + coincident * 0.3 + coalesce(lagging, 0) * 0.2 AS composite FROM v)
       SELECT obs_date, "leading", coincident, lagging, composite, CASE WHEN composite > 0.3 THEN 'expansion' WHEN composite > 0 THEN 'late_expansion' WHEN composite > -0.3 THEN 'early_contraction' ELSE 'contraction' END AS phase FROM c""",
    r="leading coincident lagging composite",
    dates="obs_date",
)
def economic_cycle(spark, d):
    m = S.macro_named(spark, d)
    chg = W.windowed(
        m, W.Layout(("series",), ("obs_date",)), [lambda w: {"chg": W.simple_return(F.col("value"), w)}], back=1
    )
    pick = lambda s, c: F.max(F.when(F.col("series") == s, F.col(c)))
    wide = chg.groupBy("obs_date").agg(
        (pick("Fed_Funds_Rate", "value") - pick("CPI", "value")).alias("yield_curve_spread"),
        (pick("Unemployment_Rate", "value") / 3).alias("unemployment_rate"),
        pick("GDP", "chg").alias("industrial_production_change"),
        pick("CPI", "chg").alias("cpi_change"),
    )
    return R.cycle_score(wide).select("obs_date", "leading", "coincident", "lagging", "composite", "phase")


@query(
    "market_condition",
    "R7",
    """WITH w AS (SELECT s.ts, v.value AS vix, s.value / lag(s.value) OVER (ORDER BY s.ts) - 1 AS chg FROM (SELECT * FROM market WHERE series = 'SP500') s
         LEFT JOIN (SELECT * FROM market WHERE series = 'VIX') v ON v.ts = s.ts),
       x AS (SELECT *, CASE WHEN vix < 15 THEN 2 WHEN vix < 20 THEN 1 WHEN vix < 30 THEN -1 ELSE -2 END + CASE WHEN chg > 0 THEN 1 ELSE -1 END AS score FROM w WHERE vix IS NOT NULL AND chg IS NOT NULL)
       SELECT ts, score, CASE WHEN score >= 2 THEN 'bullish' WHEN score <= -2 THEN 'bearish' ELSE 'neutral' END AS state,
         CASE WHEN vix < 15 THEN 'Low volatility (VIX < 15)' WHEN vix < 20 THEN 'Normal volatility' WHEN vix < 30 THEN 'Elevated volatility' ELSE 'High fear (VIX > 30)' END
         || '; ' || CASE WHEN chg > 0 THEN 'S&P 500 positive' ELSE 'S&P 500 negative' END AS factors FROM x""",
    dates="ts",
)
def market_condition(spark, d):
    f = W.windowed(
        S.market(spark, d), W.Layout(("series",), ("ts",)), [lambda w: {"chg": W.simple_return(F.col("value"), w)}], back=1
    )
    vix = f.filter(F.col("series") == "VIX").select("ts", F.col("value").alias("vix"))
    spx = f.filter((F.col("series") == "SP500") & F.col("chg").isNotNull()).select("ts", "chg")
    j = spx.join(vix, "ts").withColumns(Q.condition(F.col("vix"), F.col("chg")))
    return j.select("ts", "score", "state", "factors")


@query(
    "indicator_snapshot",
    "R10 W19",
    """WITH c AS (SELECT series, ts, value, (value / lag(value) OVER (PARTITION BY series ORDER BY ts) - 1) * 100 AS chg FROM market)
       SELECT series, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(chg, ts) AS change, CASE WHEN arg_max(chg, ts) IS NULL THEN 'neutral' WHEN arg_max(chg, ts) > 0 THEN 'up' ELSE 'down' END AS trend
       FROM c GROUP BY 1""",
    r="value:8 change",
    dates="ts",
)
def indicator_snapshot(spark, d):
    return Q.snapshot(S.market(spark, d))
