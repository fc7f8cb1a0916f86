"""Forecasts for many series at once: stationarity, ARIMA orders, volatility, means and ensembles.

Model search is rows: every (series, order) or (series, parameter) is its own group, so a grid over
thousands of series spreads over the cluster. Series are bars, bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewise.functions import scalar as C
from tidewise.operators import series as W
from tidewise.operators import stats as M

# fixed value: 5 % critical value of the unit-root test with a constant
ADF_CRITICAL = -2.86


# ---------------------------------------------------------------- stationarity


def adf(bars: DataFrame, x: str = "close", lags: int = 1, layout: W.Layout = W.DAILY) -> DataFrame:
    """Unit-root t statistic with a fixed number of lagged differences, and the order d in {0, 1}."""
    v = F.col(x)

    def one(w: WindowSpec):
        return {"_dy": v - F.lag(v).over(w), "_y1": F.lag(v).over(w)}

    def two(w: WindowSpec):
        return {f"_dy{k}": F.lag("_dy", k).over(w) for k in range(1, lags + 1)}

    rows = W.windowed(bars, layout, [one, two], back=lags + 1)
    more = [f"_dy{k}" for k in range(1, lags + 1)]
    fit = M.regress(M.gram(rows, ["_dy", "_y1", *more], F.col(layout.keys[0])), [("_dy", "_y1", more)])
    return fit.select(
        F.col("grp").alias(layout.keys[0]),
        F.col("t_stat").alias("adf"),
        F.when(F.col("t_stat") < ADF_CRITICAL, 0).otherwise(1).alias("d"),
        F.col("sample_size").alias("n"),
    )


# ---------------------------------------------------------------- ARIMA


def _lags(x: np.ndarray, k: int, start: int) -> np.ndarray:
    return np.column_stack([x[start - i : len(x) - i] for i in range(1, k + 1)]) if k else np.empty((len(x) - start, 0))


def _two_stage(y: np.ndarray, p: int, q: int, long: int = 10) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Hannan-Rissanen: residuals of a long autoregression stand in for the shocks."""
    a = np.column_stack([np.ones(len(y) - long), _lags(y, long, long)])
    e = np.zeros(len(y))
    e[long:] = y[long:] - a @ np.linalg.lstsq(a, y[long:], rcond=None)[0]
    start = 2 * long
    x = np.column_stack([np.ones(len(y) - start), _lags(y, p, start), _lags(e, q, start)])
    beta = np.linalg.lstsq(x, y[start:], rcond=None)[0]
    res = y[start:] - x @ beta
    shocks = np.concatenate([e[:start], res])
    return beta, shocks, float(res @ res / len(res)), len(res)


ARIMA = (
    "symbol string, p int, d int, q int, aic double, sigma double, coefficients array<double>, "
    "forecast array<double>, half_width array<double>, n int"
)


def arima_grid(series: DataFrame, x: str, orders: DataFrame, max_p: int = 5, max_q: int = 5, steps: int = 21) -> DataFrame:
    """Fit every (p, q) up to the limits for each series with its d; one group per (series, p, q)."""
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(max_p + 1) for q in range(max_q + 1)])
    rows = series.join(orders.select("symbol", "d"), "symbol").select("symbol", "ts", F.col(x).alias("x"), "d", F.inline(grid))
    names = [c.strip().split(" ")[0] for c in ARIMA.split(", ")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        raw, first = pdf["x"].to_numpy(dtype=float), pdf.iloc[0]
        p, d, q = int(first["p"]), int(first["d"]), int(first["q"])
        y = np.diff(raw, d) if d else raw
        if len(y) < 50:
            return pd.DataFrame([], columns=names)
        beta, e, s2, n = _two_stage(y, p, q)
        ys, es, ahead = list(y), list(e), []
        for _ in range(steps):
            v = beta[0] + sum(beta[i] * ys[-i] for i in range(1, p + 1))
            v += sum(beta[p + j] * es[-j] for j in range(1, q + 1))
            ys.append(v)
            es.append(0.0)
            ahead.append(v)
        psi = [1.0]
        for k in range(1, steps):
            ar = sum(beta[i] * psi[k - i] for i in range(1, min(p, k) + 1))
            psi.append(ar + (beta[p + k] if k <= q else 0.0))
        psi = np.cumsum(psi) if d else np.array(psi)
        half = 1.96 * np.sqrt(max(s2, 0.0) * np.cumsum(psi**2))
        out = np.cumsum(ahead) + raw[-1] if d else np.array(ahead)
        aic = n * np.log(max(s2, 1e-300)) + 2 * (p + q + 1)
        row = (first["symbol"], p, d, q, float(aic), float(np.sqrt(s2)), beta.tolist(), out.tolist(), half.tolist(), n)
        return pd.DataFrame([row], columns=names)

    return rows.groupBy("symbol", "p", "q").applyInPandas(fit, ARIMA)


def best_order(fits: DataFrame) -> DataFrame:
    """Lowest AIC per series; fewer parameters win ties."""
    at = F.struct(F.round("aic", 9), F.col("p") + F.col("q"), "p")
    cols = F.struct("p", "d", "q", "aic", "sigma", "coefficients", "forecast", "half_width", "n")
    return fits.groupBy("symbol").agg(F.min_by(cols, at).alias("b")).select("symbol", "b.*")


def forecast_rows(best: DataFrame, model: str = "arima") -> DataFrame:
    """One row per series and step: (symbol, model, step, forecast, lo, hi)."""
    z = best.select("symbol", F.posexplode(F.arrays_zip("forecast", "half_width")).alias("i", "z"))
    f, h = F.col("z.forecast"), F.col("z.half_width")
    return z.select("symbol", F.lit(model).alias("model"), (F.col("i") + 1).alias("step"), f.alias("forecast"), (f - h).alias("lo"), (f + h).alias("hi"))


# ---------------------------------------------------------------- volatility


GARCH = "symbol string, alpha double, beta double, omega double, loglik double, last_variance double, n int"


def garch_grid(returns: DataFrame, r: str = "r", least: int = 100) -> DataFrame:
    """GARCH(1,1) likelihood on a lattice with the variance target; one group per (series, alpha).

    Returns are in percent. All betas of a group run through the recursion together.
    """
    alphas = F.array(*[F.lit(round(0.02 * i, 2)) for i in range(1, 16)])
    rows = returns.select("symbol", "ts", (F.col(r) * 100).alias("r"), F.explode(alphas).alias("alpha"))
    names = [c.strip().split(" ")[0] for c in GARCH.split(", ")]
    betas_all = np.round(np.arange(0.0, 0.985, 0.02), 2)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("ts")["r"].to_numpy(dtype=float)
        a = float(pdf["alpha"].iloc[0])
        betas = betas_all[betas_all + a < 0.999]
        if len(x) < least or not len(betas):
            return pd.DataFrame([], columns=names)
        e2 = (x - x.mean()) ** 2
        target = e2.mean()
        if not target > 0:
            return pd.DataFrame([], columns=names)
        omega = target * (1 - a - betas)
        v = np.full(len(betas), target)
        ll = np.zeros(len(betas))
        for s in e2:
            ll -= 0.5 * (np.log(2 * np.pi * v) + s / v)
            v = omega + a * s + betas * v
        i = int(np.argmax(ll))
        row = (pdf["symbol"].iloc[0], a, float(betas[i]), float(omega[i]), float(ll[i]), float(v[i]), len(x))
        return pd.DataFrame([row], columns=names)

    return rows.groupBy("symbol", "alpha").applyInPandas(fit, GARCH)


def best_garch(fits: DataFrame) -> DataFrame:
    cols = F.struct("alpha", "beta", "omega", "loglik", "last_variance", "n")
    return fits.groupBy("symbol").agg(F.max_by(cols, F.struct("loglik", "alpha")).alias("b")).select("symbol", "b.*")


def garch_forecast(best: DataFrame, steps: int = 21) -> DataFrame:
    """Analytic volatility forecast (as a fraction): the variance decays to its long-run level; limits +-20 %."""
    persist = F.col("alpha") + F.col("beta")
    longrun = F.col("omega") / (1 - persist)
    h = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    var = longrun + F.pow(persist, F.col("step") - 1) * (F.col("last_variance") - longrun)
    vol = F.sqrt(var) / 100
    return h.select("symbol", F.lit("garch").alias("model"), "step", vol.alias("forecast"), (vol * 0.8).alias("lo"), (vol * 1.2).alias("hi"))


def ewma_forecast(returns: DataFrame, x: str = "r", steps: int = 21) -> DataFrame:
    """Latest exponentially weighted volatility, held for every step (its own decay leaves it unchanged)."""
    v = W.ewm_std(returns.select("symbol", "ts", x), W.DAILY, x, 21.0, "vol")
    last = v.groupBy("symbol").agg(F.max_by(C.annual_volatility(F.col("vol")), "ts").alias("v"))
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    f = F.col("v")
    return rows.select("symbol", F.lit("ewma").alias("model"), "step", f.alias("forecast"), (f * 0.8).alias("lo"), (f * 1.2).alias("hi"))


# ---------------------------------------------------------------- means and ensembles


def historical_mean(returns: DataFrame, x: str = "r", horizon: int = 21) -> DataFrame:
    """Mean and deviation of the history, repeated for every step of the horizon."""
    m = returns.groupBy("symbol").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    return m.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "mean", "std")


def simple_models(returns: DataFrame, x: str = "r", spans: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Flat forecasts from the mean of the last n rows: model -> (n, horizon)."""
    spans = spans or {"last": (1, 5), "month": (21, 10), "quarter": (63, 8)}
    parts = None
    for name, (n, horizon) in spans.items():
        mean = W.last_rows(returns, W.DAILY, n).groupBy("symbol").agg(F.avg(x).alias("forecast"))
        rows = mean.select("symbol", F.lit(name).alias("model"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "forecast")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def weighted_ensemble(forecasts: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean by step over the common length; weights are normalised over the models that delivered."""
    per = forecasts.groupBy("symbol", "model").agg(F.max("step").alias("len")).join(weights, "model")
    total = per.groupBy("symbol").agg(F.sum("weight").alias("_all"), F.min("len").alias("_len"))
    j = forecasts.join(weights, "model").join(total, "symbol").filter(F.col("step") <= F.col("_len"))
    return j.groupBy("symbol", "step").agg(
        (F.sum(F.col("weight") * F.col("forecast")) / F.max("_all")).alias("forecast"), F.count(F.lit(1)).alias("models")
    )


def ensemble_spread(forecasts: DataFrame) -> DataFrame:
    """Mean and population deviation over models per step."""
    return forecasts.groupBy("symbol", "step").agg(F.avg("forecast").alias("mean"), F.stddev_pop("forecast").alias("std"))


def ridge_on_sequences(returns: DataFrame, x: str = "r", length: int = 60, horizon: int = 1, alpha: float = 1.0) -> DataFrame:
    """Ridge on scaled input windows, fitted on the first 80 % of each series and scored on the rest."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    stats = returns.groupBy("symbol").agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = returns.join(stats, "symbol").withColumn("z", (F.col(x) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")))
    seq = W.split_by_time(W.sequences(z.select("symbol", "ts", "z"), W.DAILY, "z", length, horizon), W.DAILY, 0.8)
    data = seq.withColumn("features", array_to_vector("window"))
    train = data.filter("part = 'train'")
    size = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    # the solver scales the label: this penalty equals alpha on the sum of squares
    fit = LinearRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0, regParam=alpha * size[1] / size[0], standardization=False, solver="normal").fit(train)
    return M.forecast_error(fit.transform(data.filter("part = 'test'")), ["symbol"], "label", "prediction")


def all_volatilities(returns: DataFrame, r: str = "r", steps: int = 21) -> DataFrame:
    """GARCH where a series is long enough, EWMA for every series."""
    g = garch_forecast(best_garch(garch_grid(returns, r)), steps)
    return g.unionByName(ewma_forecast(returns, r, steps))
