"""The optimiser against its optimality conditions, a lattice of weights, and odd groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.operators import optimise as O
from tidewise.operators import portfolio as P


def slope(w, mu, s, objective):
    """How fast the objective grows along each asset; at the best weights none is above the held ones'."""
    risk = s @ w
    var = w @ risk
    return -risk if objective == "min_volatility" else (mu - K.RISK_FREE) / np.sqrt(var) - (w @ mu - K.RISK_FREE) * risk / var**1.5


@pytest.mark.parametrize("assets", [1, 2, 11, 20, 40])
def test_no_direction_is_better(assets):
    rng = np.random.default_rng(assets)
    for days in (35, 300):
        x = rng.normal(0.001, 0.01, size=(days, assets)) + rng.normal(0, 0.01, size=(days, 1))
        mu, s = x.mean(0) * 252, np.atleast_2d(np.cov(x.T)) * 252
        for objective in ("max_sharpe", "min_volatility"):
            w = O.weights(mu, s, objective)
            assert w.sum() == pytest.approx(1) and (w >= 0).all()
            if objective == "max_sharpe" and mu.max() <= K.RISK_FREE:
                continue
            g = slope(w, mu, s, objective)
            held = w > 1e-6
            scale = np.abs(g).max()
            assert g[held].min() >= g.max() - 1e-5 * scale


def test_copies_constants_and_losses():
    rng = np.random.default_rng(4)
    x = rng.normal(0.001, 0.01, size=(100, 3))
    x = np.column_stack([x, x[:, 0], np.full(100, 0.0001)])
    mu, s = x.mean(0) * 252, np.cov(x.T) * 252
    for objective in O.OBJECTIVES:
        w = O.weights(mu, s, objective)
        assert np.isfinite(w).all() and w.sum() == pytest.approx(1)
    assert O.weights(mu, s, "min_volatility")[4] == pytest.approx(1, abs=1e-3)
    lost = O.weights(np.array([-0.2, -0.1, -0.3]), np.diag([0.04, 0.01, 0.09]), "max_sharpe")
    assert sorted(lost) == [0, 0, 1]


def test_not_worse_than_the_lattice(spark):
    rng = np.random.default_rng(7)
    names = list("abcd")
    rows = [(g, t, s, float(v)) for g in ("p", "q") for t in range(60) for s, v in zip(names, rng.normal(0.001, 0.01, 4))]
    r = spark.createDataFrame(rows, "g string, ts long, symbol string, r double")
    mom = O.moments(O.vectors(r, ["g", "ts"], "symbol", "r", names), F.col("g"), names)
    pdf = r.toPandas().pivot(index=["g", "ts"], columns="symbol", values="r")
    for m in mom.collect():
        own = pdf.loc[m["grp"]]
        assert m["mu"] == pytest.approx(list(own.mean() * K.TRADING_DAYS)) and m["n"] == 60
        assert m["sigma"] == pytest.approx(list((own.cov() * K.TRADING_DAYS).to_numpy().ravel()))
    best = {(x["grp"], x["objective"]): x for x in O.optimal(mom).collect()}
    for x in P.optimise(mom, 4).collect():
        b = best[x["grp"], x["objective"]]
        key, sign = {"max_sharpe": ("sharpe", 1), "min_volatility": ("vol", -1), "max_returns": ("ret", 1)}[x["objective"]]
        assert sign * b[key] >= sign * x[key] - 1e-9


def test_odd_groups(spark):
    names = [f"s{i}" for i in range(25)]
    rng = np.random.default_rng(1)
    long = [(g, t, s, float(v)) for g, n in (("long", 40), ("short", 30)) for t in range(n) for s, v in zip(names, rng.normal(0, 0.01, 25))]
    long += [("gaps", t, s, None if s == "s3" else 0.01) for t in range(40) for s in names]  # no complete date
    r = spark.createDataFrame(long, "g string, ts long, symbol string, r double")
    got = O.optimal(O.moments(O.vectors(r, ["g", "ts"], "symbol", "r", names), F.col("g"), names)).collect()
    assert {(x["grp"], x["status"]) for x in got} == {("long", "ok"), ("short", "insufficient_data")} and len(got) == 6
    assert all((x["w"] is None) == (x["status"] != "ok") for x in got)
    bad = pd.DataFrame({"grp": ["nan", "empty"], "mu": [[float("nan")], []], "sigma": [[1.0], []], "n": [99, 99]})
    bad = spark.createDataFrame(bad, "grp string, mu array<double>, sigma array<double>, n long")
    assert {x["status"] for x in O.optimal(bad).collect()} == {"insufficient_data"}
    assert O.optimal(bad.limit(0)).count() == 0
