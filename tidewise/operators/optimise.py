"""Long-only mean-variance portfolios of any number of assets, exactly, for many groups at once.

Both convex objectives are one problem: minimise z'Sz/2 - c'z over z >= 0 and scale z to sum 1. With c = 1 that is the least
volatile portfolio, with c = mean - risk-free rate the one of the largest Sharpe ratio. It is solved by an active set: an
asset whose gradient is positive enters, the held assets are solved for as if unbounded, and what would turn negative leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise import constants as K
from tidewise.operators import stats as M

OBJECTIVES = ("max_sharpe", "min_volatility", "max_returns")
#: Least number of dates of a group, as for the other covariance-based operators.
MIN_DATES = 31
#: Added to the correlations' diagonal, so that assets which are copies of each other have one solution.
RIDGE = 1e-10


def cone(s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """argmin of z'Sz/2 - c'z over z >= 0, for a positive definite S. Zero if no c is positive."""
    n = len(c)
    z, held = np.zeros(n), np.zeros(n, bool)
    tiny = 1e-12 * max(1.0, float(np.abs(c).max(initial=0)))
    for _ in range(30 * n):
        gain = np.where(held, -np.inf, c - s @ z)
        enter = int(gain.argmax())
        if gain[enter] <= tiny:
            break
        held[enter] = True
        while True:
            full = np.zeros(n)
            full[held] = np.linalg.solve(s[np.ix_(held, held)], c[held])
            below = held & (full <= 0)
            if not below.any():
                break
            part = z[below] / (z[below] - full[below])  # how far each may go
            z = z + part.min() * (full - z)
            held &= ~(below & (z <= 1e-15 * max(1.0, float(z.max()))))
            z[~held] = 0.0
            if held[enter] and z[enter] == 0 and full[enter] <= 0:
                held[enter] = False
            if not held.any():
                return z
        z = full
    return z


def weights(mu: np.ndarray, sigma: np.ndarray, objective: str, risk_free: float = K.RISK_FREE) -> np.ndarray:
    """Best long-only weights. Ties go to the first asset.

    If no asset earns more than the risk-free rate, the best Sharpe ratio is that of one asset: a negative excess
    over a convex risk is best at a corner.
    """
    k = len(mu)
    scale = np.sqrt(np.maximum(np.diag(sigma), 0.0))
    scale = np.maximum(scale, 1e-9 * max(float(scale.max(initial=0)), 1e-9))
    excess = mu - risk_free
    w = np.zeros(k)
    if objective == "max_returns":
        w[int(mu.argmax())] = 1.0
        return w
    if objective == "max_sharpe" and excess.max() <= 0:
        w[int((excess / scale).argmax())] = 1.0
        return w
    correlation = sigma / np.outer(scale, scale) + RIDGE * np.eye(k)
    z = cone(correlation, (np.ones(k) if objective == "min_volatility" else excess) / scale) / scale
    return z / z.sum()


def vectors(returns: DataFrame, keys: list[str], name: str, x: str, symbols: list[str]) -> DataFrame:
    """``keys, v``: one array of all symbols' values per key; keys that lack one of them have no row.

    ``returns`` has one row per key and symbol. Arrays rather than a column per symbol: Spark's planner multiplies a
    condition on many renamed columns once for each of them.
    """
    by_key = returns.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, x))).alias("_m"))
    values = F.transform(F.array(*[F.lit(s) for s in symbols]), lambda s: F.col("_m")[s].cast("double"))
    return by_key.select(*keys, values.alias("v")).where(F.forall("v", lambda e: e.isNotNull()))


def moments(rows: DataFrame, group: Column, symbols: list[str]) -> DataFrame:
    """``grp, mu, sigma, n``: annualised means and covariances (row-major) of the arrays ``v``, per group.

    Every task sends one block per group, whatever the number of assets.
    """
    k = len(symbols)
    whole = rows.select(group.cast("string").alias("grp"), "v").where("grp IS NOT NULL")
    average = F.array(*[F.avg(F.col("v")[i]) for i in range(k)])
    mean = whole.groupBy("grp").agg(average.alias("m")).select("grp", F.transform("m", lambda m: m * K.TRADING_DAYS).alias("mu"))
    centre = whole.agg(average.alias("m")).scalar()
    shifted = whole.withColumn("m", centre).select("grp", F.zip_with("v", "m", lambda v, m: v - m).alias("v"))
    schema = "grp string, sigma array<double>, n long"

    def covariance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, s, n in b[["grp", "s", "n"]].itertuples(index=False):
                m = np.asarray(s, dtype=float).reshape(k + 1, k + 1)
                c = (m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n) * (K.TRADING_DAYS / (n - 1) if n > 1 else np.nan)
                out.append((g, c.ravel(), n))
            yield pd.DataFrame(out, columns=["grp", "sigma", "n"])

    return M.vector_gram(shifted, symbols).mapInPandas(covariance, schema).join(mean, "grp")


def optimal(mom: DataFrame, objectives: tuple[str, ...] = OBJECTIVES, least: int = MIN_DATES) -> DataFrame:
    """``grp, objective, status, w, ret, vol, sharpe``: a row for each group and objective.

    ``mom``: ``grp, mu, sigma, n``. Groups of fewer than ``least`` dates, or with a moment that isn't finite, get the status
    ``insufficient_data`` and nulls.
    """
    kinds = [T.StructField("grp", mom.schema["grp"].dataType), T.StructField("objective", T.StringType()), T.StructField("status", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))]
    schema = T.StructType(kinds + [T.StructField(c, T.DoubleType()) for c in ("ret", "vol", "sharpe")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, mu, sigma, n in b[["grp", "mu", "sigma", "n"]].itertuples(index=False):
                mu = np.asarray(mu, dtype=float)
                s = np.asarray(sigma, dtype=float).reshape(len(mu), len(mu))
                good = n >= least and len(mu) > 0 and bool(np.isfinite(mu).all() and np.isfinite(s).all())
                for o in objectives:
                    if not good:
                        out.append((g, o, "insufficient_data", None, None, None, None))
                        continue
                    w = weights(mu, s, o)
                    ret, vol = float(w @ mu), float(np.sqrt(max(w @ s @ w, 0.0)))
                    out.append((g, o, "ok", w, ret, vol, (ret - K.RISK_FREE) / vol if vol > 0 else 0.0))
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return mom.select("grp", "mu", "sigma", "n").mapInPandas(run, schema)
