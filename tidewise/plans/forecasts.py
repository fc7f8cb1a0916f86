"""Forecasts and volatility models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise.operators import features as X
from tidewise.operators import forecast as T
from tidewise.operators import series as W
from tidewise.registry import query
from tidewise.session import values_table
from tidewise.sources import tables as S


def rets(spark, d):
    return X.returns(S.bars(spark, d)).filter(F.col("lr").isNotNull()).select("symbol", "ts", F.col("lr").alias("r"))


@query(
    "unit_root_test",
    "M1",
    """WITH a AS (SELECT symbol, ts, close - lag(close) OVER w AS dy, lag(close) OVER w AS y1 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
       b AS (SELECT *, lag(dy) OVER (PARTITION BY symbol ORDER BY ts) AS d1 FROM a),
       m AS (SELECT symbol, count(*) AS n, count(*) * var_pop(dy) AS syy, count(*) * var_pop(y1) AS s11, count(*) * var_pop(d1) AS s22,
              count(*) * covar_pop(y1, d1) AS s12, count(*) * covar_pop(dy, y1) AS sy1, count(*) * covar_pop(dy, d1) AS sy2 FROM b WHERE d1 IS NOT NULL GROUP BY 1),
       c AS (SELECT *, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m),
       t AS (SELECT symbol, n, b1 / sqrt((syy - b1 * sy1 - b2 * sy2) / (n - 3) * s22 / (s11 * s22 - s12 * s12)) AS adf FROM c)
       SELECT symbol, adf, CASE WHEN adf < -2.86 THEN 0 ELSE 1 END AS d, n FROM t""",
    r="adf",
)
def unit_root_test(spark, d):
    return T.adf(S.bars(spark, d))


@query("arima_forecast", "M2 A22")
def arima_forecast(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", F.ln("close").alias("x"))
    return T.forecast_rows(T.best_order(T.arima_grid(b, "x", T.adf(b, "x"), 3, 3)))


@query("garch_forecast", "M3")
def garch_forecast(spark, d):
    return T.garch_forecast(T.best_garch(T.garch_grid(rets(spark, d))))


@query("all_volatilities", "M8 M4 W16")
def all_volatilities(spark, d):
    return T.all_volatilities(rets(spark, d))


@query(
    "historical_mean_forecast",
    "M5",
    """WITH m AS (SELECT symbol, avg(lr) AS mean, stddev_samp(lr) AS std FROM rets WHERE lr IS NOT NULL GROUP BY 1)
       SELECT symbol, CAST(step AS INTEGER) AS step, mean, std FROM m CROSS JOIN (SELECT unnest(range(1, 22)) AS step)""",
    r="mean:9 std",
)
def historical_mean_forecast(spark, d):
    return T.historical_mean(rets(spark, d))


@query("ridge_sequences", "M6 W15 W13 P20")
def ridge_sequences(spark, d):
    return T.ridge_on_sequences(rets(spark, d))


_SIMPLE = """rk AS (SELECT symbol, lr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM rets WHERE lr IS NOT NULL),
  k(model, n, horizon, weight) AS (VALUES ('last', 1, 5, 0.2), ('month', 21, 10, 0.5), ('quarter', 63, 8, 0.4)),
  fm AS (SELECT symbol, model, horizon, weight, avg(lr) AS forecast FROM rk JOIN k ON rn <= n GROUP BY 1, 2, 3, 4),
  fr AS (SELECT symbol, model, weight, forecast, CAST(unnest(range(1, horizon + 1)) AS INTEGER) AS step FROM fm)"""


@query(
    "weighted_ensemble",
    "M7",
    f"WITH {_SIMPLE} SELECT symbol, step, sum(weight * forecast) / sum(weight) AS forecast, count(*) AS models FROM fr WHERE step <= 5 GROUP BY 1, 2",
    r="forecast",
)
def weighted_ensemble(spark, d):
    w = values_table(spark, [("model", "string"), ("weight", "double")], [("last", 0.2), ("month", 0.5), ("quarter", 0.4)])
    return T.weighted_ensemble(T.simple_models(rets(spark, d)), w)


@query(
    "ensemble_spread",
    "M9",
    f"WITH {_SIMPLE} SELECT symbol, step, avg(forecast) AS mean, stddev_pop(forecast) AS std FROM fr GROUP BY 1, 2",
    r="mean std",
)
def ensemble_spread(spark, d):
    return T.ensemble_spread(T.simple_models(rets(spark, d)))
