"""Scalar functions, bins, quantiles and distribution functions."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewise.functions import scalar as C
from tidewise.functions import special
from tidewise.operators import stats as M
from tidewise.sources import jsoncols, lake


def test_bucketize_edges(spark):
    xs = [0.0, 0.1, 15.0, 15.1, 20.0, 30.0, 100.0, 100.1]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", C.bucketize(F.col("x"), [0, 15, 20, 30, 100]).alias("b"))
    got = df.orderBy("x").toPandas()["b"].tolist()
    want = pd.cut(pd.Series(xs), [0, 15, 20, 30, 100], labels=False).tolist()
    np.testing.assert_array_equal(got, want)


def test_width_and_quantile_bins_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = pd.Series(np.round(rng.normal(0, 1, 300), 1))
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "x": x}))
    w = df.select("i", C.width_bin(F.col("x"), F.lit(x.min()), F.lit(x.max()), 10).alias("b")).orderBy("i").toPandas()["b"]
    np.testing.assert_array_equal(w, pd.cut(x, bins=10, labels=False))
    q = M.exact_quantiles(df, [], "x", {f"q{i}": i / 5 for i in range(1, 5)}).first()
    np.testing.assert_allclose(list(q), np.quantile(x, [0.2, 0.4, 0.6, 0.8]))
    b = df.select("i", C.quantile_bin(F.col("x"), F.array(*[F.lit(v) for v in q])).alias("b")).orderBy("i").toPandas()["b"]
    np.testing.assert_array_equal(b, pd.qcut(x, 5, labels=False, duplicates="drop"))


def test_exact_quantiles_with_hot_key_and_hot_value(spark):
    rng = np.random.default_rng(2)
    hot = np.where(rng.random(3000) < 0.6, 5.0, np.round(rng.random(3000) * 10, 2))
    pdf = pd.DataFrame({"k": ["hot"] * 3000 + ["cold"] * 3, "x": [*hot, 1.0, 2.0, 4.0]})
    got = M.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.975}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k], np.quantile(g["x"], [0.1, 0.5, 0.975]))


def test_finite_and_clip_keep_nulls(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(C.finite(F.col("x"))).collect()]
    assert got == [1.0, None, None, None]
    assert [r[0] for r in df.select(C.clip(F.when(F.col("x") < 2, F.col("x")), -0.5, 0.5)).collect()] == [0.5, None, None, None]


def test_column_resolution_order():
    cols = ["CPI_Change", "VIX", "Technology_Return_1d", "Gold_Price"]
    assert C.find_column(cols, "VIX") == "VIX"
    assert C.find_column(cols, "inflation") == "CPI_Change"
    assert C.find_column(cols, "technology") == "Technology_Return_1d"
    assert C.find_column(cols, "gold") == "Gold_Price"
    assert C.find_column(cols, "nothing") is None


def test_distribution_functions():
    assert special.t_two_sided(np.array([2.0]), np.array([10]))[0] == pytest.approx(0.07338803, abs=1e-7)
    assert special.f_upper(np.array([4.0]), np.array([2]), np.array([20]))[0] == pytest.approx(0.034571613, abs=1e-7)
    assert special.chi2_upper(np.array([3.841458820694124]), np.array([1]))[0] == pytest.approx(0.05, abs=1e-9)
    assert special.t_quantile(0.975, 30) == pytest.approx(2.0422725, abs=1e-6)


def test_regression_matches_the_built_in_summary(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    t, c = rng.normal(size=(2, 400))
    pdf = pd.DataFrame({"t": t, "c": c + 0.5 * t, "y": 2 * t - c + rng.normal(size=400)})
    df = spark.createDataFrame(pdf)
    got = M.regress(M.gram(df, ["y", "t", "c"]), [("y", "t", ["c"])]).first()
    s = LinearRegression(solver="normal", labelCol="y").fit(VectorAssembler(inputCols=["t", "c"], outputCol="features").transform(df))
    assert got["ate"] == pytest.approx(s.coefficients[0], rel=1e-9)
    assert got["standard_error"] == pytest.approx(s.summary.coefficientStandardErrors[0], rel=1e-9)
    assert got["p_value"] == pytest.approx(s.summary.pValues[0], abs=1e-9)


def test_lake_and_registry_layouts(spark, tmp_path):
    z = lake.Lake(spark, str(tmp_path))
    assert z.load("x") is None
    z.save(spark.range(5), "x")
    assert z.once("x", lambda: spark.range(9)).count() == 5
    assert z.once("x", lambda: spark.range(9), force_refresh=True).count() == 9
    assert z.info().first()["name"] == "x"
    flat = '{"models": {"a_1": {"type": "causal", "version": "1", "metrics": {"n": 3, "m": ["ols"]}}}, "active_versions": {"causal": "a_1"}}'
    deep = '{"models": {"causal": {"a_2": {"type": "causal", "version": "2", "metrics": {"n": 4}}}}, "active_versions": {}}'
    (tmp_path / "r.json").write_text(flat)
    one = jsoncols.read_registry(spark, str(tmp_path / "r.json")).first()
    assert one["model_id"] == "a_1" and one["metrics"] == {"n": 3.0} and one["is_active"]
    both = jsoncols.parse_registry(spark.createDataFrame([(flat,), (deep,), ("broken",)], "v string"), "v")
    assert sorted((r["model_id"], r["is_active"]) for r in both.collect()) == [("a_1", True), ("a_2", False)]


def test_shapes_list_files_and_folders_of_files(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(5).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(f"{tmp_path}/split.parquet")
    pq.write_table(pa.table({"a": [1, 2], "b": ["x", None], "c": [0.5, 1.5]}), f"{tmp_path}/one.parquet")
    got = {r["name"]: (r["rows"], r["columns"]) for r in lake.shapes(spark, str(tmp_path)).collect()}
    assert got == {"many": (30, 1), "split": (5, 2), "one": (2, 3)}
