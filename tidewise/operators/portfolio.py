"""Portfolio returns, performance, backtests and optimisation, for many portfolios at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import optimise as O
from tidewise.operators import series as W

BY_PORTFOLIO = W.Layout(("portfolio",), ("ts",))


def aligned_returns(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Simple returns on common dates: gaps padded forward, dates without every symbol's return dropped.

    The grid (dates x symbols) is bounded by the calendar.
    """
    by_date = bars.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("m"))
    cells = F.array(*[F.struct(F.lit(s).alias("symbol"), F.col("m")[s].alias("close")) for s in symbols])
    padded = W.fill(by_date.select("ts", F.inline(cells)), W.DAILY, ["close"])
    df = W.windowed(padded, W.DAILY, [lambda w: {"r": W.simple_return(F.col("close"), w)}], back=1)
    k = F.count("r").over(Window.partitionBy("ts"))
    return df.withColumn("_k", k).filter(F.col("_k") == len(symbols)).drop("_k")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight x return per portfolio and date; symbols without a weight count zero."""
    return returns.join(weights, "symbol").groupBy("portfolio", "ts").agg(F.sum(F.col("w") * F.col("r")).alias("r"))


def curve(returns: DataFrame, layout: W.Layout = BY_PORTFOLIO) -> DataFrame:
    """Adds growth of one unit and drawdown."""
    return W.drawdown(W.growth(returns, layout), layout)


def performance(curves: DataFrame) -> DataFrame:
    """Total return, annual volatility, their ratio and the deepest drawdown, all in percent but the ratio."""
    last = F.max_by("growth", "ts")
    vol = C.annual_volatility(F.stddev_samp("r"))
    total = last - 1
    return curves.groupBy("portfolio").agg(
        (total * 100).alias("total_return"),
        (vol * 100).alias("volatility"),
        F.coalesce(F.try_divide(total, vol), F.lit(0.0)).alias("sharpe_ratio"),
        (F.min("drawdown") * 100).alias("max_drawdown"),
    )


def backtest(curves: DataFrame) -> DataFrame:
    """Like ``performance``, with the annualised return and its ratio to volatility."""
    last, n = F.max_by("growth", "ts"), F.count(F.lit(1))
    vol = C.annual_volatility(F.stddev_samp("r"))
    yearly = F.pow(last, K.TRADING_DAYS / n) - 1
    return curves.groupBy("portfolio").agg(
        ((last - 1) * 100).alias("total_return"),
        (yearly * 100).alias("annualized_return"),
        (vol * 100).alias("volatility"),
        F.coalesce(F.try_divide(yearly, vol), F.lit(0.0)).alias("sharpe_ratio"),
        (F.min("drawdown") * 100).alias("max_drawdown"),
        n.alias("days"),
    )


def metrics(ret: Column, vol: Column) -> dict[str, Column]:
    """Sharpe ratio over the risk-free rate and the parametric drawdown of a (return, volatility) pair."""
    base = vol * math.sqrt(math.pi / 2)
    cushion = F.greatest(F.lit(0.0), ret - K.RISK_FREE) * 0.5
    return {
        "sharpe_ratio": F.coalesce(F.try_divide(ret - K.RISK_FREE, F.when(vol > 0, vol)), F.lit(0.0)),
        "max_drawdown": F.when(vol > 0, -F.greatest(base - cushion, vol * 0.5)).otherwise(0.0),
    }


def parametric(weights: DataFrame, mean: DataFrame, cov: DataFrame) -> DataFrame:
    """Expected return, volatility, Sharpe ratio and drawdown from weights, means and covariance."""
    ret = weights.join(mean, "symbol").groupBy("portfolio").agg(F.sum(F.col("w") * F.col("mean")).alias("ret"))
    a = weights.select("portfolio", F.col("symbol").alias("a"), F.col("w").alias("wa"))
    b = weights.select("portfolio", F.col("symbol").alias("b"), F.col("w").alias("wb"))
    var = a.join(cov, "a").join(b, ["portfolio", "b"]).groupBy("portfolio")
    var = var.agg(F.sum(F.col("wa") * F.col("cov") * F.col("wb")).alias("var"))
    j = ret.join(var, "portfolio").withColumn("vol", F.sqrt(F.greatest("var", F.lit(0.0))))
    return j.select("portfolio", "ret", "vol").withColumns(metrics(F.col("ret"), F.col("vol")))


# ---------------------------------------------------------------- optimisation


def moments(returns: DataFrame, group: Column, symbols: list[str]) -> DataFrame:
    """Annualised mean vector and covariance matrix (row-major) of each group, in one aggregation."""
    wide = returns.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(s) for s in symbols])
    mu = F.array(*[F.avg(s) * K.TRADING_DAYS for s in symbols])
    sigma = F.array(*[F.covar_samp(a, b) * K.TRADING_DAYS for a in symbols for b in symbols])
    return wide.groupBy(group.alias("grp")).agg(mu.alias("mu"), sigma.alias("sigma"), F.count(F.lit(1)).alias("n"))


def optimise(mom: DataFrame, assets: int, steps: int = 10) -> DataFrame:
    """Long-only weights on a lattice (multiples of 1/steps) that are best for each objective, for a handful of assets.

    For portfolios that may only hold such shares, and as a check of ``optimise.optimal``, which takes any number of assets.

    Each group's candidates are generated and scored by its own row; only the best survive the partial
    aggregation. Objectives: max_sharpe, min_volatility, max_returns. Ties go to the lower candidate number.
    """
    base = steps + 1
    ids = F.sequence(F.lit(0), F.lit(base ** (assets - 1) - 1))
    digits = [F.floor(F.col("id") / base**k) % base for k in range(assets - 1)]
    df = mom.select("*", F.explode(ids).alias("id")).withColumn("d", F.array(*digits))
    used = F.aggregate("d", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("used", used).filter(F.col("used") <= steps)
    df = df.withColumn("w", F.transform(F.concat("d", F.array(steps - F.col("used"))), lambda x: x / steps))
    w = [F.col("w")[i] for i in range(assets)]
    ret = sum(w[i] * F.col("mu")[i] for i in range(assets))
    var = sum(w[i] * w[j] * F.col("sigma")[i * assets + j] for i in range(assets) for j in range(assets))
    df = df.withColumns({"ret": ret, "vol": F.sqrt(F.greatest(var, F.lit(0.0)))})
    df = df.withColumn("sharpe", F.coalesce(F.try_divide(F.col("ret") - K.RISK_FREE, F.when(F.col("vol") > 0, F.col("vol"))), F.lit(0.0)))
    best = lambda score: F.max_by(F.struct("w", "ret", "vol", "sharpe"), F.struct(F.round(score, 9), -F.col("id")))
    top = df.groupBy("grp").agg(
        best(F.col("sharpe")).alias("max_sharpe"),
        best(-F.col("vol")).alias("min_volatility"),
        best(F.col("ret")).alias("max_returns"),
    )
    names = ("max_sharpe", "min_volatility", "max_returns")
    items = F.array(*[F.struct(F.lit(n).alias("objective"), F.col(n).alias("b")) for n in names])
    return top.select("grp", F.inline(items)).select("grp", "objective", "b.*")


def objective_name(name: str) -> str:
    """Unknown objectives mean max_sharpe; max_return is an accepted spelling."""
    known = {"min_volatility": "min_volatility", "max_returns": "max_returns", "max_return": "max_returns"}
    return known.get(name, "max_sharpe")


def economic_forecast(market: DataFrame) -> DataFrame:
    """Directional forecast from the latest market levels (factor, change), rounded to 4 places."""
    layout = W.Layout(("series",), ("ts",))

    def stage(w: WindowSpec):
        return {"chg": W.simple_return(F.col("value"), w) * 100}

    last = W.windowed(market, layout, [stage], back=1).groupBy("series").agg(
        F.max_by("value", "ts").alias("value"), F.max_by("chg", "ts").alias("chg")
    )
    s, v = F.col("series"), F.col("value")
    factor = F.when(s == "Treasury_10Y", "interest_rates").when(s == "VIX", "inflation").when(s == "SP500", "gdp_growth")
    change = F.when(s == "Treasury_10Y", (v - 4) / 100).when(s == "VIX", (v - 18) / 1000).otherwise(F.col("chg") / 100)
    return last.select(factor.alias("factor"), F.round(change, 4).alias("change")).filter(F.col("factor").isNotNull())


def causal_adjustments(sens: DataFrame, forecast: DataFrame) -> DataFrame:
    """Change of expected return per sector: sum of sensitivity x forecast."""
    hit = sens.join(forecast, "factor").groupBy("sector")
    return hit.agg(F.sum(F.col("coef") * F.col("change")).alias("adjustment"))


def compare_causal(mom: DataFrame, adjustments: DataFrame, symbols: list[str]) -> DataFrame:
    """Best Sharpe weights on plain against adjusted means; both are judged by the plain means.

    Groups without enough dates have no row. Any number of symbols; those without an adjustment keep their mean.
    """
    adj = adjustments.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("symbol", "adjustment"))).alias("m"))  # a row per symbol
    names = F.array(*[F.lit(s) for s in symbols])
    shift = F.transform(names, lambda s: F.coalesce(F.element_at(F.col("_m"), s), F.lit(0.0)))
    shifted = mom.withColumn("_m", adj.scalar()).withColumn("mu", F.zip_with("mu", shift, lambda a, b: a + b))
    best = lambda m: O.optimal(m, ("max_sharpe",)).filter("status = 'ok'")
    plain = best(mom).select("grp", "ret", "vol", "sharpe")
    causal = best(shifted).select("grp", F.col("w").alias("cw"), F.col("vol").alias("cvol"))
    j = plain.join(causal, "grp").join(mom.select("grp", "mu"), "grp")
    cret = F.aggregate(F.zip_with("cw", "mu", lambda w, m: w * m), F.lit(0.0), lambda s, x: s + x)
    return j.select(
        F.col("ret").alias("traditional_return"),
        cret.alias("causal_return"),
        ((cret - F.col("ret")) * 100).alias("return_gain"),
        ((F.col("vol") - F.col("cvol")) * 100).alias("volatility_cut"),
        ((cret - K.RISK_FREE) / F.col("cvol") - F.col("sharpe")).alias("sharpe_gain"),
    )


def by_period(returns: DataFrame, as_of: str) -> DataFrame:
    """Performance of every portfolio over each named period that ends at ``as_of``."""
    names = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(n).alias("days")) for p, n in K.PERIOD_DAYS.items()])
    r = returns.select("*", F.inline(names)).filter(F.col("ts") >= F.date_sub(F.to_date(F.lit(as_of)), F.col("days")))
    both = r.withColumn("portfolio", F.struct("portfolio", "period"))
    done = performance(curve(both))
    return done.select("portfolio.*", "total_return", "volatility", "sharpe_ratio", "max_drawdown")
