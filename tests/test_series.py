"""Ordered operators: both layouts agree, and both agree with pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewise.operators import features as X
from tidewise.operators import series as W

PLAIN = W.Layout(("k",), ("t",))
BLOCKS = W.Layout(("k",), ("t",), block=32)


@pytest.fixture(scope="module")
def frame(spark):
    """One key holds most rows, one has two rows, one has a single row."""
    rng = np.random.default_rng(7)
    sizes = {"hot": 500, "b": 40, "two": 2, "one": 1}
    rows = [(k, i, float(v)) for k, n in sizes.items() for i, v in enumerate(rng.normal(100, 5, n))]
    pdf = pd.DataFrame(rows, columns=["k", "t", "x"])
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1))


def collect(df, *cols):
    return df.select("k", "t", *cols).toPandas().sort_values(["k", "t"], ignore_index=True)


def same(a, b, tol=1e-9):
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=tol, atol=tol)


def test_positions_are_exact(frame):
    pdf, df = frame
    got = collect(W.positions(df, PLAIN, slices=7), "pos")
    assert (got["pos"] == got["t"]).all() and len(got) == len(pdf)


def test_windowed_layouts_agree_with_pandas(frame):
    pdf, df = frame
    x = F.col("x")
    stage = lambda w: {"sma": W.sma(x, w, 10), "std": W.rolling_std(x, w, 10), "lag3": F.lag("x", 3).over(w), "lead2": F.lead("x", 2).over(w)}
    a = collect(W.windowed(df, PLAIN, [stage], back=10, ahead=2), "sma", "std", "lag3", "lead2")
    b = collect(W.windowed(df, BLOCKS, [stage], back=10, ahead=2), "sma", "std", "lag3", "lead2")
    same(a, b)
    g = pdf.sort_values(["k", "t"]).groupby("k")["x"]
    same(a[["sma"]], g.rolling(10).mean().reset_index(drop=True).to_frame("sma"))
    same(a[["std"]], g.rolling(10).std().reset_index(drop=True).to_frame("std"))


def test_running_layouts_agree(frame):
    _, df = frame
    df = df.withColumn("gap", F.when(F.col("t") % 7 == 3, F.col("x")))
    specs = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x")), "f": ("last", F.col("gap"))}
    same(collect(W.running(df, PLAIN, specs), *specs), collect(W.running(df, BLOCKS, specs), *specs))


@pytest.mark.parametrize("adjust", [False, True])
def test_ewm_layouts_agree_with_pandas(frame, adjust):
    pdf, df = frame
    spec = [("y", "x", 12.0, adjust)]
    a, b = collect(W.ewm(df, PLAIN, spec), "y"), collect(W.ewm(df, BLOCKS, spec), "y")
    want = pdf.sort_values(["k", "t"]).groupby("k")["x"].transform(lambda s: s.ewm(span=12, adjust=adjust).mean())
    same(a, b)
    same(a[["y"]], want.reset_index(drop=True).to_frame("y"))


@pytest.mark.parametrize("layout", [PLAIN, BLOCKS])
def test_growth_handles_total_loss_and_sign(spark, layout):
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate([0.5, -2.0, 1.0, -1.0, 0.5])], "k string, t int, r double")
    got = collect(W.growth(df, layout), "growth")["growth"].tolist()
    assert got == pytest.approx([1.5, -1.5, -3.0, 0.0, 0.0])


def test_drawdown_of_rising_series_is_zero(spark):
    df = spark.createDataFrame([("k", i, 0.01) for i in range(20)], "k string, t int, r double")
    assert W.drawdown(W.growth(df, PLAIN), PLAIN).agg(F.min("drawdown")).first()[0] == 0


@pytest.mark.parametrize("layout", [PLAIN, BLOCKS])
def test_fill_forward_and_back(spark, layout):
    df = spark.createDataFrame([("k", 0, None), ("k", 1, 1.0), ("k", 2, None), ("k", 3, 3.0)], "k string, t int, v double")
    assert collect(W.fill(df, layout, ["v"]), "v")["v"].tolist()[1:] == [1.0, 1.0, 3.0]
    assert collect(W.fill(df, layout, ["v"], back=True), "v")["v"].tolist() == [1.0, 1.0, 1.0, 3.0]


def test_calendar_fill(spark):
    df = spark.sql("SELECT 'm' k, DATE'2024-01-30' t, 1D v UNION ALL SELECT 'm', DATE'2024-02-02', 2D")
    got = W.calendar_fill(df, "k", "t", "v").orderBy("t").collect()
    assert [r["v"] for r in got] == [1.0, 1.0, 1.0, 2.0]


def test_asof_matches_pandas(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 200), "t": rng.permutation(1000)[:200], "id": range(200)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 50), "rt": rng.permutation(1000)[:50], "v": rng.random(50)})
    want = pd.merge_asof(left.sort_values("t"), right.sort_values("rt"), left_on="t", right_on="rt", by="k")
    for block in (None, 16):
        got = W.asof(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "rt", "v", block).toPandas()
        np.testing.assert_array_equal(got.sort_values("id")["v"].to_numpy(), want.sort_values("id")["v"].to_numpy())


def test_split_thin_and_runs(frame, spark):
    _, df = frame
    for layout in (PLAIN, BLOCKS):
        parts = W.split_by_time(df, layout, 0.8).groupBy("k", "part").count().collect()
        assert {(r["k"], r["part"]): r["count"] for r in parts}[("hot", "train")] == 400
        thin = W.every_kth(df, layout, 50).filter("k = 'hot'").select("t").toPandas()["t"]
        assert sorted(thin) == list(range(0, 500, 10))
    s = spark.createDataFrame([("k", i, c) for i, c in enumerate("aabba")], "k string, t int, state string")
    runs = {(r["state"], r["start"]): r["length"] for r in W.run_lengths(s, PLAIN, "state").collect()}
    assert runs == {("a", 0): 2, ("b", 2): 2, ("a", 4): 1}


def bars_of(spark, closes):
    rows = [("s", i, c, c, c, c, 1) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume long")


def test_rsi_edges(spark):
    rising = X.rsi(bars_of(spark, [float(i) for i in range(1, 31)])).orderBy("ts").toPandas()["rsi_14"]
    assert rising[:13].isna().all() and (rising[13:] == 100).all()
    flat = X.rsi(bars_of(spark, [5.0] * 30)).toPandas()["rsi_14"]
    assert flat.isna().all()
    late = X.rsi(bars_of(spark, [float(i) for i in range(1, 31)]), first_delta=False).orderBy("ts").toPandas()["rsi_14"]
    assert late[:14].isna().all() and late[14] == 100


def test_indicators_match_pandas(spark):
    rng = np.random.default_rng(0)
    c = pd.Series(100 + rng.normal(0, 1, 120).cumsum())
    t = X.technical_indicators(bars_of(spark, c.tolist())).orderBy("ts").toPandas()
    e12, e26 = (c.ewm(span=n, adjust=False).mean() for n in (12, 26))
    np.testing.assert_allclose(t["macd"], e12 - e26, atol=1e-9)
    np.testing.assert_allclose(t["macd_signal"], (e12 - e26).ewm(span=9, adjust=False).mean(), atol=1e-9)
    np.testing.assert_allclose(t["bb_width"], 4 * c.rolling(20).std() / c.rolling(20).mean(), atol=1e-9)
    assert t["atr_14"][12] != t["atr_14"][12] and t["atr_14"][13] == pytest.approx(c.diff().abs().fillna(0)[:14].mean())


def test_zero_price_gives_null(spark):
    r = X.returns(bars_of(spark, [1.0, 0.0, 2.0])).orderBy("ts").toPandas()
    assert r["r"][1] == -1 and np.isnan(r["r"][2]) and r["lr"][1:].isna().all()


def test_frames_longer_than_a_block(spark):
    df = spark.range(1000).selectExpr("'a' AS symbol", "id AS ts", "CAST(id AS DOUBLE) AS x")
    layout = W.Layout(("symbol",), ("ts",), 32)
    got = W.windowed(df, layout, [lambda w: {"m": F.sum("x").over(w.rowsBetween(-299, 0))}], back=299)
    want = W.windowed(df, W.Layout(("symbol",), ("ts",)), [lambda w: {"m": F.sum("x").over(w.rowsBetween(-299, 0))}])
    assert sorted((r["ts"], r["m"]) for r in got.collect()) == sorted((r["ts"], r["m"]) for r in want.collect())
