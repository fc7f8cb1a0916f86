"""Planted truths for operators that no SQL can check."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewise.operators import causal as D
from tidewise.operators import effects as E
from tidewise.operators import forecast as T
from tidewise.operators import portfolio as P
from tidewise.operators import regimes as R
from tidewise.operators import series as W
from tidewise.operators import stats as M


def panel(spark, n=600):
    rng = np.random.default_rng(11)
    x, e, z = rng.normal(size=(3, n))
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.5 * y[t - 1] + 0.8 * x[t - 1] + 0.5 * e[t]
    return spark.createDataFrame(pd.DataFrame({"ts": range(n), "x": x, "y": y, "z": z}))


def test_granger_finds_the_planted_direction(spark):
    g = D.best_lag(D.granger_lags(panel(spark), ["x", "y", "z"], 3)).toPandas().set_index(["cause", "effect"])
    assert g.loc[("x", "y"), "p_value"] < 1e-10 and g.loc[("x", "y"), "optimal_lag"] == 1
    assert g.loc[("y", "x"), "p_value"] > 0.01


def test_granger_statistic_matches_direct_least_squares(spark):
    p = panel(spark, 200)
    got = D.granger_lags(p, ["x", "y"], 2).filter("cause = 'x' AND effect = 'y' AND lag = 2").first()["f_statistic"]
    d = p.orderBy("ts").toPandas()
    y, x = d["y"].to_numpy(), d["x"].to_numpy()
    one = np.ones(198)
    own = np.column_stack([one, y[1:-1], y[:-2]])
    full = np.column_stack([own, x[1:-1], x[:-2]])
    ssr = [((y[2:] - m @ np.linalg.lstsq(m, y[2:], rcond=None)[0]) ** 2).sum() for m in (own, full)]
    assert got == pytest.approx((ssr[0] - ssr[1]) / 2 / (ssr[1] / (198 - 5)), rel=1e-8)


def test_lagged_correlation_and_transfer_entropy_point_the_same_way(spark):
    p = panel(spark)
    c = D.lagged_correlation(p, ["x", "y"]).toPandas().set_index("cause")
    assert c.loc["x", "optimal_lag"] == 1 and c.loc["x", "is_causal"] and c.loc["x", "correlation"] > 0.5
    assert abs(c.loc["y", "correlation"]) < 0.2
    counts = D.binned_pairs(p, ["x", "y", "z"])
    t = D.transfer_entropy_test(counts, 200).toPandas().set_index(["source", "target"])
    plain = D.transfer_entropy(counts).toPandas().set_index(["source", "target"])
    assert t["transfer_entropy"].to_dict() == pytest.approx(plain["transfer_entropy"].to_dict(), abs=1e-9)
    value, prob = t["transfer_entropy"], t["p_value"]
    assert value[("x", "y")] > 2 * value[("y", "x")] and prob[("x", "y")] == 0
    assert min(prob[("x", "z")], prob[("z", "y")], prob[("y", "z")]) > 0.05  # z is noise


def test_drawn_tables_have_the_spread_of_real_shuffles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ts": range(120), "x": rng.normal(size=120), "y": rng.normal(size=120)})
    got = D.transfer_entropy_test(D.binned_pairs(spark.createDataFrame(pdf), ["x", "y"], bins=3), 2000, bins=3)
    row = got.filter("source = 'x'").first()
    b = {c: pd.cut(pdf[c], 3, labels=False).to_numpy() for c in "xy"}
    y, yp, xp = b["y"][1:], b["y"][:-1], b["x"][:-1]

    def h(*cols):
        m = np.unique(np.column_stack(cols), axis=0, return_counts=True)[1] / len(y)
        return -(m * np.log2(m + 1e-10)).sum()

    te = lambda x: h(y, yp) - h(yp) - h(y, yp, x) + h(yp, x)
    assert row["transfer_entropy"] == pytest.approx(te(xp))
    shuffled = np.array([te(rng.permutation(xp)) for _ in range(2000)])
    assert row["p_value"] == pytest.approx((shuffled >= te(xp) - 1e-12).mean(), abs=0.05)


def test_pc_finds_a_collider(spark):
    rng = np.random.default_rng(3)
    a, b, e = rng.normal(size=(3, 4000))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + b + 0.4 * e}))
    edges = {tuple(r) for r in D.pc_algorithm(df, ["a", "b", "c"]).collect()}
    assert edges == {("a", "c"), ("b", "c")}


def graphs(spark, edges, nodes):
    e = spark.createDataFrame(edges, "graph string, src string, dst string")
    n = spark.createDataFrame(nodes, "graph string, id string, type string")
    return {r["graph"]: r for r in D.validate(n, e).collect()}


def test_graph_edge_cases(spark):
    node = lambda g, ids: [(g, i, "asset") for i in ids]
    edges = [
        ("loop", "a", "a"), ("two", "a", "b"), ("two", "b", "a"),
        ("diamond", "a", "b"), ("diamond", "a", "c"), ("diamond", "b", "d"), ("diamond", "c", "d"),
        ("ghost", "a", "zz"), *[("chain", str(i), str(i + 1)) for i in range(12)],
    ]
    nodes = node("loop", "a") + node("two", "abx") + node("diamond", "abcd") + node("ghost", "a") + node("empty", "ab")
    nodes += node("chain", [str(i) for i in range(13)]) + [("empty", "c", "odd")]
    g = graphs(spark, edges, nodes)
    assert [g[k]["has_cycle"] for k in ("loop", "two", "diamond", "chain", "empty")] == [True, True, False, False, False]
    assert g["two"]["disconnected"] == 1 and g["ghost"]["unknown_endpoints"] == 1 and not g["ghost"]["is_valid"]
    assert g["empty"]["edge_count"] == 0 and g["empty"]["unknown_types"] == 1 and g["empty"]["is_valid"]


@pytest.fixture(scope="module")
def trial(spark):
    rng = np.random.default_rng(8)
    n = 4000
    c, m = rng.normal(size=(2, n))
    t = 0.7 * c + rng.normal(size=n)
    y = (2.0 + 0.5 * m) * t + 1.5 * c + rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"i": range(n), "t": t, "c": c, "m": m, "y": y})).persist()


def test_bootstrap_covers_the_effect_and_agrees_with_the_analytic_error(trial):
    b = E.bootstrap_ols(trial, "y", "t", ["c"], F.col("i"), 200).first()
    a = E.ols_effects(trial, [("y", "t", ["c"])]).first()
    assert b["ate"] == pytest.approx(a["ate"]) and b["ci_lower"] < 2.0 < b["ci_upper"]
    assert b["standard_error"] == pytest.approx(a["standard_error"], rel=0.5) and b["p_value"] < 1e-6


def test_bootstrap_does_not_depend_on_partitioning(trial):
    one = E.bootstrap_ols(trial.repartition(1), "y", "t", ["c"], F.col("i"), 50).first()
    many = E.bootstrap_ols(trial.repartition(9), "y", "t", ["c"], F.col("i"), 50).first()
    assert one["standard_error"] == pytest.approx(many["standard_error"], rel=1e-9)


def test_placebo_is_null_and_unmeasured_confounder_biases(trial):
    p = {r["treatment"]: r for r in E.placebo(trial, "y", "t", ["c"], F.col("i")).collect()}
    assert abs(p["placebo"]["t_stat"]) < 3 < p["t"]["t_stat"]
    u = E.unmeasured(trial, "y", "t", ["c"], F.col("i")).orderBy("strength").toPandas()
    assert u["strength"].tolist() == [0.1, 0.2, 0.3, 0.5]
    assert u["bias"].abs().is_monotonic_increasing


def test_double_machine_learning_and_modifiers(trial):
    res = E.residuals(trial, ["y", "t"], ["c"], F.col("i"), folds=2, trees=20, depth=6).persist()
    d = E.dml(res, "y", "t").first()
    assert d["ate"] == pytest.approx(2.0, abs=0.15)
    h = E.cate_modifiers(res, "y", "t", ["m"]).first()
    assert h["mean"] == pytest.approx(2.0, abs=0.15) and h["std"] == pytest.approx(0.5, abs=0.1)


def test_weighting_has_the_right_sign(trial):
    w = E.ipw(trial, "y", "t", ["c"], F.col("i"), 50).first()
    assert w["ci_lower"] < w["ate"] < w["ci_upper"] and 2.0 < w["ate"] < 5.5


def test_subgroups_and_small_samples(trial, spark):
    s = {r["subgroup"]: r["ate"] for r in E.cate_subgroups(trial, "y", "t", ["c"], ["m"]).collect()}
    assert s["m_low"] < 1.9 < 2.1 < s["m_high"]
    few = E.estimate(trial.limit(50), "y", "t", ["c"], F.col("i")).first()
    assert few["method"] == "insufficient_data" and few["ate"] == 0 and few["p_value"] == 1


def test_arima_recovers_an_autoregression(spark):
    rng = np.random.default_rng(4)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": range(1500), "x": y, "close": y}))
    order = T.adf(df)
    assert order.first()["d"] == 0
    fits = T.arima_grid(df, "x", order, 2, 1)
    ar1 = fits.filter("p = 1 AND q = 0").first()
    assert ar1["coefficients"][1] == pytest.approx(0.6, abs=0.06) and ar1["sigma"] == pytest.approx(1.0, abs=0.06)
    best = T.best_order(fits).first()
    assert best["p"] + best["q"] >= 1
    rows = T.forecast_rows(T.best_order(fits)).toPandas()
    assert len(rows) == 21 and (rows["lo"] < rows["forecast"]).all()


def test_random_walk_is_differenced(spark):
    walk = np.random.default_rng(5).normal(size=800).cumsum()
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": range(800), "close": walk}))
    assert T.adf(df).first()["d"] == 1


def test_garch_recovers_its_parameters(spark):
    rng = np.random.default_rng(6)
    n, v, r = 6000, 1.0, np.zeros(6000)
    for t in range(n):
        r[t] = np.sqrt(v) * rng.normal() / 100
        v = 0.05 + 0.1 * (r[t] * 100) ** 2 + 0.85 * v
    best = T.best_garch(T.garch_grid(spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": range(n), "r": r}))))
    b = best.first()
    assert b["alpha"] == pytest.approx(0.1, abs=0.041) and b["beta"] == pytest.approx(0.85, abs=0.061)
    f = T.garch_forecast(best, 50).orderBy("step").toPandas()["forecast"]
    assert abs(f.iloc[-1] - 0.01) < 0.003


def test_mixture_separates_two_clusters(spark):
    rng = np.random.default_rng(9)
    r = np.concatenate([rng.normal(0.05, 0.01, 300), rng.normal(-0.05, 0.01, 300)])
    df = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": range(600), "r": r, "v": np.abs(r)}))
    s = R.mixture_states(df, ["r"], 2)
    labels = {row["label"]: row["mean_return"] for row in R.label_states(s).collect()}
    assert labels["bull"] == pytest.approx(0.05, abs=0.01) and labels["sideways"] == pytest.approx(-0.05, abs=0.01)
    f = R.filtered_probabilities(s.select("symbol", "ts", "r", "state", "probs"), W.DAILY, 2)
    assert f.select(F.min(F.aggregate("filtered", F.lit(0.0), lambda a, x: a + x))).first()[0] == pytest.approx(1.0)


def test_optimiser_prefers_the_obvious_asset(spark):
    mom = spark.createDataFrame([("g", [0.2, 0.05], [0.04, 0.0, 0.0, 0.0001], 100)], "grp string, mu array<double>, sigma array<double>, n int")
    o = {r["objective"]: r["w"] for r in P.optimise(mom, 2, 10).collect()}
    assert o["max_returns"] == [1.0, 0.0] and o["min_volatility"] == [0.0, 1.0]
    assert P.objective_name("max_return") == "max_returns" and P.objective_name("?") == "max_sharpe"


def test_pairs_and_estimates_have_one_form(spark):
    names = [f"v{i}" for i in range(8)]
    none = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    few, many = [(a, b) for a in names[:2] for b in names[:2] if a < b], [(a, b) for a in names for b in names if a < b]
    for pairs in (few, many):
        assert sorted((r["a"], r["b"], r["corr"], r["n"]) for r in M.correlation(none, pairs).collect()) == [(a, b, None, 0) for a, b in sorted(pairs)]
    rows = [(float(i % 7), float(i % 5), float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "y double, t double, c double")
    small, large = (E.estimate(d, "y", "t", ["c"], F.xxhash64("y", "t", "c")) for d in (df.limit(50), df))
    assert small.dtypes == large.dtypes and small.first()["method"] == "insufficient_data" and large.first()["sample_size"] == 150


def test_bootstrap_replicates_equal_weighted_least_squares(trial):
    fits = E.bootstrap_fits(trial.repartition(5), "y", "t", ["c"], F.col("i"), 9).toPandas().set_index("rep")["ate"]
    d = trial.orderBy("i").toPandas()
    x, y = np.column_stack([np.ones(len(d)), d["t"], d["c"]]), d["y"].to_numpy()
    for rep, w in enumerate(E.poisson_weights(d["i"].to_numpy(), 9).T, 1):
        root = np.sqrt(w)[:, None]
        assert fits[rep] == pytest.approx(np.linalg.lstsq(x * root, y * root[:, 0], rcond=None)[0][1], rel=1e-9)


def test_placebo_treatment_is_a_permutation_whatever_the_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "exp(pmod(xxhash64(id), 97) / 10.0) AS t")
    one = {r["id"]: r["placebo"] for r in E.permuted(rows.repartition(1), "t", F.col("id")).collect()}
    many = {r["id"]: r["placebo"] for r in E.permuted(rows.repartition(7), "t", F.col("id")).collect()}
    d = {r["id"]: r["t"] for r in rows.collect()}
    assert one == many and sorted(one.values()) == sorted(d.values())
    assert abs(np.corrcoef([d[i] for i in range(5000)], [one[i] for i in range(5000)])[0, 1]) < 0.05
    same = spark.range(300).selectExpr("1 AS id", "id AS t")  # one id for all rows
    assert sorted(r["placebo"] for r in E.permuted(same, "t", F.col("id")).collect()) == list(range(300))
    assert E.permuted(rows.limit(0), "t", F.col("id")).count() == 0


def test_poisson_weights_have_the_shares_of_a_poisson_and_are_independent():
    w = E.poisson_weights(np.arange(50_000), 10)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert np.abs(np.corrcoef(w.T) - np.eye(10)).max() < 0.03


def test_granger_in_blocks_equals_one_window_and_short_panels_give_nothing(spark):
    p = panel(spark, 300)
    rows = lambda g: {(r["cause"], r["effect"], r["lag"]): (r["f_statistic"], r["sample_size"]) for r in g.collect()}
    one = rows(D.granger_lags(p, ["x", "y", "z"], 4))
    many = rows(D.granger_lags(p, ["x", "y", "z"], 4, layout=W.Layout(("panel",), ("ts",), 32)))
    assert len(one) == 24 and one.keys() == many.keys()
    assert all(many[k] == (pytest.approx(one[k][0], rel=1e-7), one[k][1]) for k in one)
    c = lambda **more: {(r["cause"], r["effect"]): (r["optimal_lag"], r["n"], pytest.approx(r["correlation"])) for r in D.lagged_correlation(p, ["x", "y", "z"], 4, **more).collect()}
    assert len(c()) == 6 and c() == {k: (*w[:2], w[2].expected) for k, w in c(layout=W.Layout(("panel",), ("ts",), 32)).items()}
    flat = p.withColumn("z", F.lit(0.1))
    assert {(r["cause"], r["effect"]) for r in D.lagged_correlation(flat, ["x", "y", "z"], 4).collect()} == {("x", "y"), ("y", "x")}
    assert not rows(D.granger_lags(p.limit(11), ["x", "y"], 4)) and not rows(D.granger_lags(p.limit(0), ["x", "y"], 4))
