"""Treatment effects: regression adjustment, bootstrap, weighting, double machine learning, sensitivity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.functions import scalar as C
from tidewise.functions import special
from tidewise.operators import series as W
from tidewise.operators import stats as M
from tidewise.session import checkpointed
from tidewise.sources import tables as S

MIN_ROWS = 100
#: Rows whose bootstrap weights are held at once.
CHUNK = 1000


def ols_effects(df: DataFrame, jobs: list[tuple[str, str, list[str]]], group: Column | None = None) -> DataFrame:
    """Effects (outcome, treatment, confounders) by least squares over the rows complete in all columns."""
    columns = sorted({c for y, t, conf in jobs for c in (y, t, *conf)})
    return M.regress(M.gram(df, columns, group), jobs)


def macro_sector_effects(matrix: DataFrame, sectors: list[str], treatments: list[str], confounders: list[str]) -> DataFrame:
    """Every treatment on every sector return with the same confounders; missing columns are skipped."""
    have = set(matrix.columns)
    conf = [c for c in confounders if c in have]
    jobs = [
        (f"{s}_Return_1d", t, conf)
        for s in sectors
        for t in treatments
        if f"{s}_Return_1d" in have and t in have
    ]
    # one row per date: stored once, read for the means and again for the cross products
    return ols_effects(checkpointed(matrix.select(*{c for y, t, cs in jobs for c in (y, t, *cs)})), jobs)


def sensitivity_matrix(spark, effects: DataFrame) -> DataFrame:
    """Effects -> long coefficients (sector, factor, coef): 100 x effect limited to [-1, 1], 3 decimals."""
    long = effects.select(
        F.lower(F.regexp_replace("outcome", "_Return_1d$", "")).alias("sector"), F.col("treatment").alias("source"), "ate"
    )
    m = S.to_factor(spark, long, "source")
    return m.select("sector", "factor", F.round(C.clip(F.col("ate") * 100, -1.0, 1.0), 3).alias("coef"))


def wide_matrix(coefs: DataFrame, factors: list[str]) -> DataFrame:
    """Sector x factor, missing cells zero."""
    return coefs.groupBy("sector").pivot("factor", factors).agg(F.max("coef")).fillna(0.0)


def active_matrix(trained: DataFrame, default: DataFrame) -> DataFrame:
    """Trained coefficients where there are any, else the defaults."""
    t = trained.withColumnRenamed("coef", "_t")
    j = default.join(t, ["sector", "factor"], "left")
    return j.select(
        "sector", "ord", "factor", "ford", F.coalesce("_t", "coef").alias("coef"), F.col("_t").isNotNull().alias("is_trained")
    )


def matrix_summary(matrix: DataFrame) -> DataFrame:
    """Mean, population deviation and extreme sectors of each factor; the first sector wins ties."""
    return matrix.groupBy("factor").agg(
        F.avg("coef").alias("mean"),
        F.stddev_pop("coef").alias("std"),
        F.max_by("sector", F.struct("coef", -F.col("ord"))).alias("most_positive"),
        F.min_by("sector", F.struct("coef", "ord")).alias("most_negative"),
    )


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def lookup(requests: DataFrame, trained: DataFrame, matrix: DataFrame) -> DataFrame:
    """Effect of (treatment, outcome): trained estimate first, else the coefficient with a nominal error."""
    r = requests.withColumn("sector", C.resolve_outcome(F.col("outcome")))
    t = trained.select(F.col("factor").alias("treatment"), "sector", F.col("ate").alias("_ate"))
    m = matrix.select(F.col("factor").alias("treatment"), "sector", "coef")
    j = r.join(t, ["treatment", "sector"], "left").join(m, ["treatment", "sector"], "left")
    effect = F.coalesce("_ate", "coef", F.lit(0.0))
    se = 0.15 * F.abs(F.col("effect")) + 0.03
    return (
        j.withColumn("effect", effect)
        .withColumn("source", F.when(F.col("_ate").isNotNull(), "trained").otherwise("coefficients"))
        .withColumn("se", se)
        .withColumns({"ci_lower": F.col("effect") - 1.96 * F.col("se"), "ci_upper": F.col("effect") + 1.96 * F.col("se")})
        .withColumn("p_value", t_p(F.abs("effect") / F.col("se"), F.lit(100.0)))
        .drop("_ate", "coef")
    )


# ---------------------------------------------------------------- bootstrap


def _poisson_table() -> np.ndarray:
    """Poisson(1) values by 16 bits of a hash; a probability is off by less than 1 / 65536."""
    tail = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], dtype=float))
    return np.searchsorted(tail, (np.arange(65536) + 0.5) / 65536).astype(float)


_POISSON = _poisson_table()


def poisson_weights(row: np.ndarray, reps: int, seed: int = 42) -> np.ndarray:
    """Poisson(1) bootstrap weights (rows x replicates).

    One 64-bit hash of (row, k) gives the weights of four replicates: the same row has the same weights wherever it is read.
    """
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (
            np.arange(1, -(-reps // 4) + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return _POISSON[z.astype("<u8", copy=False).view("<u2")[:, :reps]]


def bootstrap_fits(
    df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column, reps: int = 1000
) -> DataFrame:
    """``rep, ate, n``: the effect in every replicate (rep 1 on) and over all rows as they are (rep 0).

    Every task keeps the weighted cross products of all replicates, one half of each symmetric block; rows are never
    copied per replicate. The tasks' sums are added in a tree and all replicates are solved in one call.
    """
    cols = [outcome, treatment, *confounders]
    k = len(cols) + 1
    left, right = np.triu_indices(k)
    src = df.dropna(subset=cols).select(row_id.cast("long").alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, n = np.zeros((reps + 1, len(left))), 0
        for whole in batches:
            for b in (whole.slice(i, CHUNK) for i in range(0, whole.num_rows, CHUNK)):
                x = np.column_stack([np.ones(b.num_rows), b.column("_x").flatten().to_numpy().reshape(b.num_rows, -1)])
                products = x[:, left] * x[:, right]
                acc[0] += products.sum(axis=0)
                acc[1:] += poisson_weights(b.column("_id").to_numpy(zero_copy_only=False), reps).T @ products
            n += whole.num_rows
        if n:
            yield M.vector_rows([(0, n, acc.ravel())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, s in zip(b.column("n").to_pylist(), b.column("s")):
                m = np.zeros((reps + 1, k, k))
                m[:, left, right] = m[:, right, left] = s.values.to_numpy().reshape(reps + 1, -1)
                x = [0, *range(2, k)]
                ate = M.solve_stack(m[:, x][:, :, x], m[:, x, 1])[:, 1]
                fits = [pa.array(np.arange(reps + 1), pa.int32()), pa.array(ate), pa.array(np.full(reps + 1, n, np.int64))]
                yield pa.RecordBatch.from_arrays(fits, names=["rep", "ate", "n"])

    return M.summed(src.mapInArrow(fold, M.VECTORS)).mapInArrow(fit, "rep int, ate double, n long")


def bootstrap_ols(
    df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column, reps: int = 1000
) -> DataFrame:
    """Effect with bootstrap error, interval and p-value."""
    fits = bootstrap_fits(df, outcome, treatment, confounders, row_id, reps)
    rep = F.when(F.col("rep") > 0, F.col("ate"))
    out = fits.agg(
        F.max(F.when(F.col("rep") == 0, F.col("ate"))).alias("ate"),
        F.stddev_pop(rep).alias("standard_error"),
        F.percentile(rep, 0.025).alias("ci_lower"),
        F.percentile(rep, 0.975).alias("ci_upper"),
        F.max("n").alias("sample_size"),
    )
    p = t_p(F.abs(F.col("ate") / F.col("standard_error")), F.col("sample_size").cast("double") - len(confounders) - 2)
    return out.select(F.lit(outcome).alias("outcome"), F.lit(treatment).alias("treatment"), "*", p.alias("p_value"))


def permuted(df: DataFrame, column: str, row_id: Column, out: str = "placebo") -> DataFrame:
    """``df`` with ``out``: the values of ``column`` dealt to the rows by a permutation that hashes of the row ids fix.

    Rows get exact positions in two orders, by two hashes; position p of the first takes the value of position p of
    the second. Both orders are cut into range slices, so no task sees all rows; rows with one id stay apart.
    """
    rows = checkpointed(df.withColumns({"_id": row_id.cast("long"), "_all": F.lit(0), "_row": F.monotonically_increasing_id()}))
    layout = W.Layout(("_all",), ("_turn", "_id", "_row"))

    def order(salt: str, *columns: str) -> DataFrame:
        return W.positions(rows.select("_all", F.xxhash64("_id", F.lit(salt)).alias("_turn"), "_id", "_row", *columns), layout, out="_pos")

    dealt = order("value", column).select("_pos", F.col(column).alias(out))
    return order("place", *df.columns).join(dealt, "_pos").select(*df.columns, out)


def placebo(df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column) -> DataFrame:
    """Effect against the effect of a treatment that cannot matter: the same values, permuted over the rows."""
    cols = [outcome, treatment, *confounders]
    whole = df.dropna(subset=cols).select(*cols, row_id.cast("long").alias("_key"))
    fake = permuted(whole, treatment, F.col("_key"))
    jobs = [(outcome, treatment, confounders), (outcome, "placebo", confounders)]
    return ols_effects(fake, jobs)


# ---------------------------------------------------------------- weighting


def ipw(df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column, reps: int = 500) -> DataFrame:
    """Inverse propensity weighting: treatment split at its median, propensities limited to [.01, .99]."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cols = [outcome, treatment, *confounders]
    whole = df.dropna(subset=cols).withColumn("_id", row_id.cast("long"))
    median = M.column_quantiles(whole, [treatment], [0.5]).select(F.col("q")[treatment][0]).scalar()
    n = whole.count()
    data = VectorAssembler(inputCols=confounders, outputCol="_x").transform(
        whole.withColumn("_t", (F.col(treatment) > median).cast("double"))
    )
    # penalty 1 on the sum of losses is 1/n on their mean
    fit = LogisticRegression(featuresCol="_x", labelCol="_t", probabilityCol="_p", regParam=1.0 / n, standardization=False)
    scored = fit.fit(data).transform(data)
    ps = C.clip(vector_to_array("_p")[1], 0.01, 0.99)
    rows = scored.select("_id", F.col(outcome).alias("y"), "_t", ps.alias("ps"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, m = np.zeros((reps + 1, 4)), 0
        for b in batches:
            t, q, y = (b[c].to_numpy(dtype=float) for c in ("_t", "ps", "y"))
            wt, wc = t / q, (1 - t) / (1 - q)
            w = np.column_stack([np.ones(len(b)), poisson_weights(b["_id"].to_numpy(), reps)])
            acc += w.T @ np.column_stack([wt * y, wt, wc * y, wc])
            m += len(b)
        if m:
            yield pd.DataFrame(acc, columns=["a", "b", "c", "d"]).assign(rep=np.arange(reps + 1), n=m)

    parts = rows.mapInPandas(fold, "a double, b double, c double, d double, rep int, n long")
    s = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in "abcdn"])
    s = s.withColumn("ate", F.try_divide("a", "b") - F.try_divide("c", "d"))
    rep = F.when(F.col("rep") > 0, F.col("ate"))
    return s.agg(
        F.max(F.when(F.col("rep") == 0, F.col("ate"))).alias("ate"),
        F.percentile(rep, 0.025).alias("ci_lower"),
        F.percentile(rep, 0.975).alias("ci_upper"),
        F.max("n").alias("sample_size"),
    ).select(F.lit("ipw").alias("method"), F.lit(outcome).alias("outcome"), F.lit(treatment).alias("treatment"), "*")


def weighted_difference(df: DataFrame, y: Column, t: Column, ps: Column) -> DataFrame:
    """The weighted-mean step of ``ipw`` for given propensities."""
    p = C.clip(ps, 0.01, 0.99)
    wt, wc = t / p, (1 - t) / (1 - p)
    return df.agg((F.sum(wt * y) / F.sum(wt) - F.sum(wc * y) / F.sum(wc)).alias("ate"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- double machine learning


def residuals(
    df: DataFrame, targets: list[str], confounders: list[str], row_id: Column, folds: int = 5, trees: int = 100, depth: int = 5
) -> DataFrame:
    """Out-of-fold residuals ``r_{target}`` of random forests on the confounders; folds by row hash."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    whole = df.dropna(subset=[*targets, *confounders])
    whole = whole.withColumn("_fold", F.pmod(F.xxhash64(row_id), F.lit(folds)))
    data = checkpointed(VectorAssembler(inputCols=confounders, outputCol="_x").transform(whole))
    out = None
    for f in range(folds):
        test = data.filter(F.col("_fold") == f)
        for y in targets:
            rf = RandomForestRegressor(featuresCol="_x", labelCol=y, predictionCol=f"_p_{y}", numTrees=trees, maxDepth=depth, seed=42)
            test = rf.fit(data.filter(F.col("_fold") != f)).transform(test)
        out = test if out is None else out.unionByName(test)
    return out.withColumns({f"r_{y}": F.col(y) - F.col(f"_p_{y}") for y in targets}).drop("_x", *[f"_p_{y}" for y in targets])


def dml(res: DataFrame, outcome: str, treatment: str) -> DataFrame:
    """Residual-on-residual effect with its sandwich error, from sums of one pass."""
    ry, rt = F.col(f"r_{outcome}"), F.col(f"r_{treatment}")
    theta = res.agg(F.sum(ry * rt) / F.sum(rt * rt)).scalar()
    e = res.withColumn("_theta", theta).withColumn("_e", ry - F.col("_theta") * rt)
    s = e.agg(
        F.max("_theta").alias("ate"),
        (F.sqrt(F.sum(F.col("_e") ** 2 * rt**2)) / F.sum(rt * rt)).alias("standard_error"),
        F.count(F.lit(1)).alias("sample_size"),
    )
    z = 1.959963984540054 * F.col("standard_error")
    return s.select(
        F.lit("dml").alias("method"),
        F.lit(outcome).alias("outcome"),
        F.lit(treatment).alias("treatment"),
        "*",
        (F.col("ate") - z).alias("ci_lower"),
        (F.col("ate") + z).alias("ci_upper"),
    )


def cate_modifiers(res: DataFrame, outcome: str, treatment: str, modifiers: list[str]) -> DataFrame:
    """Heterogeneous effect: residuals regressed on residual treatment x (1, modifiers).

    Returns mean, deviation and range of the effect over rows, and each modifier's share of its size.
    """
    rt = F.col(f"r_{treatment}")
    whole = res.dropna(subset=modifiers)
    inter = {f"_i_{m}": rt * F.col(m) for m in modifiers}
    d = whole.withColumns({"_i_1": rt, **inter}).withColumnRenamed(f"r_{outcome}", "_ry")
    names = ["_i_1", *inter]
    gram = d.agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("xtx"),
        F.array(*[F.sum(F.col(a) * F.col("_ry")) for a in names]).alias("xty"),
    )
    k = len(names)

    @F.pandas_udf("array<double>")
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        return pd.Series(
            [np.linalg.lstsq(np.array(a).reshape(k, k), np.array(b), rcond=None)[0].tolist() for a, b in zip(xtx, xty)]
        )

    coef = gram.select(solve("xtx", "xty").alias("c"))
    tagged = whole.withColumn("_c", coef.scalar())
    tau = F.col("_c")[0] + sum(F.col("_c")[i + 1] * F.col(m) for i, m in enumerate(modifiers))
    size = [F.abs(F.max(F.col("_c")[i + 1])) * F.stddev_samp(m) for i, m in enumerate(modifiers)]
    share = [(s / sum(size)).alias(f"importance_{m}") for s, m in zip(size, modifiers)]
    return tagged.withColumn("tau", tau).agg(
        F.avg("tau").alias("mean"),
        F.stddev_samp("tau").alias("std"),
        F.min("tau").alias("min"),
        F.max("tau").alias("max"),
        *share,
        F.count(F.lit(1)).alias("sample_size"),
    )


def cate_subgroups(df: DataFrame, outcome: str, treatment: str, confounders: list[str], modifiers: list[str]) -> DataFrame:
    """Effect in the lower (<= median) and upper half of each modifier, where a half has more than 50 rows."""
    cols = [outcome, treatment, *confounders, *modifiers]
    whole = df.dropna(subset=cols)
    tagged = whole.withColumn("_m", M.column_quantiles(whole, modifiers, [0.5]).scalar())
    halves = F.array(
        *[F.concat(F.lit(f"{m}_"), F.when(F.col(m) <= F.col("_m")[m][0], "low").otherwise("high")) for m in modifiers]
    )
    rows = tagged.withColumn("_half", F.explode(halves))
    out = ols_effects(rows, [(outcome, treatment, confounders)], F.col("_half"))
    return out.filter(F.col("sample_size") > 50).withColumnRenamed("grp", "subgroup")


# ---------------------------------------------------------------- dispatch and sensitivity


#: Columns of an estimate.
ESTIMATE = {
    "method": "string", "outcome": "string", "treatment": "string", "ate": "double", "standard_error": "double",
    "ci_lower": "double", "ci_upper": "double", "p_value": "double", "sample_size": "long",
}


def estimate(df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column, method: str = "auto") -> DataFrame:
    """Effect by the named method; fewer than 100 complete rows give effect 0 with p 1.

    One row in every case, with the columns of ESTIMATE; what a method doesn't give is null.
    """
    n = df.dropna(subset=[outcome, treatment, *confounders]).limit(MIN_ROWS).count()
    if n < MIN_ROWS:
        row = [("insufficient_data", outcome, treatment, 0.0, 1.0, n)]
        found = df.sparkSession.createDataFrame(row, "method string, outcome string, treatment string, ate double, p_value double, sample_size long")
    elif method == "ipw":
        found = ipw(df, outcome, treatment, confounders, row_id)
    elif method == "dml":
        found = dml(residuals(df, [outcome, treatment], confounders, row_id), outcome, treatment)
    elif method == "ols":
        found = bootstrap_ols(df, outcome, treatment, confounders, row_id).withColumn("method", F.lit("ols"))
    else:
        found = ols_effects(df, [(outcome, treatment, confounders)]).withColumn("method", F.lit("backdoor_linear"))
    fixed = {"outcome": F.lit(outcome), "treatment": F.lit(treatment)}
    return found.select(*[(F.col(c) if c in found.columns else fixed.get(c, F.lit(None))).cast(k).alias(c) for c, k in ESTIMATE.items()])


def unmeasured(df: DataFrame, outcome: str, treatment: str, confounders: list[str], row_id: Column, strengths=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Effect after adding a made confounder of each strength, tied to treatment and outcome."""
    cols = [outcome, treatment, *confounders]
    whole = df.dropna(subset=cols)
    sc = whole.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in (outcome, treatment) for n, f in (("m", F.avg), ("s", F.stddev_pop))])).scalar()
    d = whole.withColumn("_s", sc)
    z = {c: (F.col(c) - F.col("_s")[f"m_{c}"]) / F.col("_s")[f"s_{c}"] for c in (outcome, treatment)}
    u1 = (F.pmod(F.xxhash64(row_id, F.lit(1)), F.lit(1000003)) + 0.5) / 1000003
    u2 = (F.pmod(F.xxhash64(row_id, F.lit(2)), F.lit(1000003)) + 0.5) / 1000003
    noise = F.sqrt(-2 * F.ln(u1)) * F.cos(6.283185307179586 * u2)
    made = {f"u_{i}": s * z[treatment] + s * z[outcome] + (1 - s) * noise for i, s in enumerate(strengths)}
    jobs = [(outcome, treatment, confounders)] + [(outcome, treatment, [*confounders, u]) for u in made]
    res = ols_effects(d.withColumns(made), jobs)
    base = res.filter(F.col("confounders") == ",".join(confounders)).select("ate").scalar()
    labels = F.create_map(*[v for i, s in enumerate(strengths) for v in (F.lit(f"u_{i}"), F.lit(s))])
    last = F.element_at(F.split("confounders", ","), -1)
    adj = res.withColumns({"_base": base, "strength": F.try_element_at(labels, last)}).filter(F.col("strength").isNotNull())
    return adj.select(
        "outcome",
        "treatment",
        "strength",
        F.col("_base").alias("baseline_ate"),
        F.col("ate").alias("adjusted_ate"),
        (F.col("_base") - F.col("ate")).alias("bias"),
        (F.try_divide(F.col("ate") - F.col("_base"), "_base") * 100).alias("percent_change"),
    )
