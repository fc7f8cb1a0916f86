"""Moments, covariances, quantiles, entropy and regression from one pass over the rows.

All regressions over the same rows are sub-blocks of one cross-product matrix. Each task folds its
rows to one k x k block with numpy, the blocks are summed in Spark, and only then is anything solved.
What leaves a task is k*k numbers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise import constants as K
from tidewise.functions import special
from tidewise.operators import series as W

# fixed values: least number of rows per method
MIN_SAMPLES = {
    "granger": 30,
    "pc": 100,
    "transfer_entropy": 11,
    "arima": 50,
    "garch": 100,
    "hmm": 252,
    "subgroup": 51,
    "rule_regime": 21,
    "lagged_correlation": 31,
}


def sample_status(df: DataFrame, keys: list[str]) -> DataFrame:
    """Which methods have enough rows, per series: a status instead of an error."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    needs = F.array(*[F.struct(F.lit(k).alias("op"), F.lit(v).alias("need")) for k, v in MIN_SAMPLES.items()])
    status = F.when(F.col("n") >= F.col("need"), "ok").otherwise("insufficient_data")
    return n.select(*keys, "n", F.inline(needs)).withColumn("status", status)


def varying_columns(df: DataFrame, columns: list[str], least: float = 1e-10) -> DataFrame:
    """Standard deviation of every column in one pass; near-constant columns are left out."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "std").filter(F.col("std") > least)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of the rows, 12 hex digits, from partial xors."""
    h = F.xxhash64(*columns)
    return df.agg(
        F.lower(F.substring(F.hex(F.bit_xor(h)), 1, 12)).alias("fingerprint"), F.count(F.lit(1)).alias("n")
    )


# ---------------------------------------------------------------- covariance and correlation


def unstack(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Wide rows -> (row, i, name, x)."""
    items = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).alias("x")) for i, c in enumerate(columns)]
    )
    return df.select(F.col(row).alias("row"), F.inline(items))


def pair_columns(columns: list[str], others: list[str] | None = None, ordered: bool = False) -> list[tuple[str, str]]:
    """Pairs of variable names: i < j, or all i != j, or the rectangle columns x others."""
    if others is not None:
        return [(a, b) for a in columns for b in others if a != b]
    n = range(len(columns))
    return [(columns[i], columns[j]) for i in n for j in n if (i != j if ordered else i < j)]


def pairwise(df: DataFrame, pairs: list[tuple[str, str]], aggs: dict[str, callable]) -> DataFrame:
    """One row per pair (a, b) with the aggregates, from one pass with map-side partial sums.

    Few pairs are aggregated side by side; many are turned into rows first, which keeps the generated
    code small. Either way only one partial result per pair and task is shuffled.
    """
    if len(pairs) > 24:
        items = F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y")) for a, b in pairs]
        )
        none = df.sparkSession.range(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        # A row without values for each pair, so that pairs appear whatever the table holds.
        long = df.unionByName(none).select(F.inline(items))
        return long.groupBy("a", "b").agg(*[fn(F.col("_x"), F.col("_y")).alias(n) for n, fn in aggs.items()])
    exprs = [
        fn(F.col(a), F.col(b)).alias(f"{name}_{k}") for k, (a, b) in enumerate(pairs) for name, fn in aggs.items()
    ]
    one = df.agg(*exprs)
    items = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *[F.col(f"{n}_{k}").alias(n) for n in aggs])
            for k, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(items))


def pair_count(a: Column, b: Column) -> Column:
    return F.count(F.when(a.isNotNull() & b.isNotNull(), 1))


def correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation over pairwise complete rows."""
    return pairwise(df, pairs, {"corr": F.corr, "n": pair_count})


def covariance_annual(df: DataFrame, columns: list[str]) -> DataFrame:
    """Annualised sample covariance over complete rows: (a, b, cov), both triangles and the diagonal."""
    pairs = [(a, b) for a in columns for b in columns]
    cov = lambda a, b: F.covar_samp(a, b) * K.TRADING_DAYS
    return pairwise(df.dropna(subset=columns), pairs, {"cov": cov})


def mean_annual(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.dropna(subset=columns).agg(*[(F.avg(c) * K.TRADING_DAYS).alias(c) for c in columns])
    return row.unpivot([], columns, "symbol", "mean")


def covariance_long(df: DataFrame, keys: list[str], row: str, name: str, x: str) -> DataFrame:
    """Covariance of long series that share rows: (keys, a, b, cov, n). Pairs exist within one row only."""
    pairs = (
        df.groupBy(*keys, row)
        .agg(F.collect_list(F.struct(F.col(name).alias("n"), F.col(x).alias("x"))).alias("v"))
        .select(*keys, F.explode("v").alias("p"), "v")
        .select(*keys, "p", F.explode("v").alias("q"))
    )
    return pairs.groupBy(*keys, F.col("p.n").alias("a"), F.col("q.n").alias("b")).agg(
        (F.covar_samp("p.x", "q.x") * K.TRADING_DAYS).alias("cov"), F.count(F.lit(1)).alias("n")
    )


def vector_covariance(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Covariance of array columns: each task folds its rows to one block of sums (i, j, cov, corr)."""
    schema = "i int, j int, s double, n long"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc, n = np.zeros((dim + 1, dim + 1)), 0
        for b in batches:
            if len(b):
                m = np.ones((len(b), dim + 1))
                m[:, :dim] = np.vstack(b[vec].to_numpy())
                acc += m.T @ m
                n += len(b)
        if n:
            i, j = np.indices(acc.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": acc.ravel(), "n": n})

    s = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInPandas(fold, schema)
    s = s.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = s.filter(F.col("j") == dim).select("i", (F.col("s") / F.col("n")).alias("m"))
    left, right = mean.withColumnsRenamed({"m": "mi"}), mean.withColumnsRenamed({"i": "j", "m": "mj"})
    cov = (F.col("s") - F.col("n") * F.col("mi") * F.col("mj")) / (F.col("n") - 1)
    return (
        s.filter((F.col("i") < dim) & (F.col("j") < dim))
        .join(left, "i")
        .join(right, "j")
        .select("i", "j", cov.alias("cov"), "n")
    )


# ---------------------------------------------------------------- quantiles


def exact_quantiles(df: DataFrame, keys: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of raw rows, one column per probability.

    Equal values are counted first; the distinct values are then placed by range slices, so neither a
    hot key nor a hot value ends in one task. The two values around each rank are interpolated.
    """
    keys = keys or ["_all"]
    src = df if keys != ["_all"] else df.withColumn("_all", F.lit(1))
    values = src.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    values = W.checkpointed(values)
    layout = W.block_layout(values, tuple(keys), (x,))
    ranked = W.running(values, layout, {"_to": ("sum", F.col("_m"))})
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_m"))
    size = values.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    ranked = ranked.join(size, keys)
    picks = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * p
        hit = lambda r: (F.col("_from") <= r) & (r < F.col("_to"))
        picks += [
            F.max(F.when(hit(F.floor(h)), F.col(x))).alias(f"_lo_{name}"),
            F.max(F.when(hit(F.ceil(h)), F.col(x))).alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_fr_{name}"),
        ]
    got = ranked.groupBy(*keys).agg(*picks)
    out = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n) for n in probs
    ]
    return got.select(*[k for k in keys if k != "_all"], *out)


def forecast_error(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    e = F.col(actual) - F.col(forecast)
    return (
        df.filter(e.isNotNull())
        .groupBy(*keys)
        .agg(
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.avg(e).alias("residual_mean"),
            F.stddev_samp(e).alias("residual_std"),
        )
    )


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row: a struct ``q`` with an array of exact quantiles for every column. Columns share one sort."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    )
    q = exact_quantiles(long, ["name"], "x", {f"q{i}": p for i, p in enumerate(probs)})
    each = q.select("name", F.array(*[F.col(f"q{i}") for i in range(len(probs))]).alias("v"))
    return each.agg(F.struct(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in columns]).alias("q"))


# ---------------------------------------------------------------- entropy


def entropy(df: DataFrame, groups: list[str], cells: list[str], out: str) -> DataFrame:
    """Entropy in bits of the joint cells within each group, from counts only."""
    counts = df.groupBy(*groups, *cells).agg(F.count(F.lit(1)).alias("_m"))
    groups = groups or [F.lit("all").alias("grp")]
    names = [g if isinstance(g, str) else "grp" for g in groups]
    counts = df.groupBy(*groups, *cells).agg(F.count(F.lit(1)).alias("_m"))
    size = counts.groupBy(*names).agg(F.sum("_m").alias("_n"))
    p = F.col("_m") / F.col("_n")
    return counts.join(size, names).groupBy(*names).agg((-F.sum(p * F.log2(p + 1e-10))).alias(out))


# ---------------------------------------------------------------- cross products and regressions


GRAM = "grp string, names array<string>, s array<double>, n long"


def gram(df: DataFrame, columns: list[str], group: Column | None = None) -> DataFrame:
    """Cross products of [1, columns] per group: (grp, names, s = row-major (k+1)^2, n).

    Every task folds its rows to one block per group, passes full batches of groups on, and Spark sums the blocks.
    Columns are shifted by their means first, so that the sums stay well conditioned.
    """
    columns = list(dict.fromkeys(columns))
    whole = df.dropna(subset=columns)
    centre = whole.agg(F.array(*[F.avg(c) for c in columns]).alias("m")).scalar()
    shifted = whole.select(
        (F.lit("all") if group is None else group.cast("string")).alias("grp"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("raw"),
        centre.alias("m"),
    ).select("grp", F.array(*[F.col("raw")[i] - F.col("m")[i] for i in range(len(columns))]).alias("v"))
    return vector_gram(shifted, columns)


def vector_gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cross products of [1, v] per group, as ``gram`` gives them, from rows ``grp string, v array<double>``."""
    k = len(columns) + 1

    room = max(1, 4_000_000 // (k * k))  # groups held at once: at most 32 MB of sums in a task

    def emit(acc: dict[str, list]) -> pd.DataFrame:
        rows = [(g, i, v, n) for g, (s, n) in acc.items() for i, v in enumerate(s.ravel())]
        return pd.DataFrame(rows, columns=["grp", "i", "v", "n"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, list] = {}
        for b in batches:
            for g, part in b.groupby("grp", sort=False):
                m = np.ones((len(part), k))
                m[:, 1:] = np.vstack(part["v"].to_numpy())
                a = acc.setdefault(g, [np.zeros((k, k)), 0])
                a[0] += m.T @ m
                a[1] += len(part)
            if len(acc) >= room:
                yield emit(acc)
                acc = {}
        if acc:
            yield emit(acc)

    cells = df.select("grp", "v").mapInPandas(fold, "grp string, i int, v double, n long")
    cells = cells.groupBy("grp", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    # k*k cells per group: bounded by the number of columns
    rows = cells.groupBy("grp").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("s"),
        F.max("n").alias("n"),
    )
    return rows.select("grp", F.array(*[F.lit(c) for c in columns]).alias("names"), "s", "n")


def summed(parts: DataFrame) -> DataFrame:
    """Sums of ``n`` and of the vectors ``s`` by ``key``, from rows ``key int, n long, s array<double>``.

    For a bounded number of keys: a task holds one vector of each. Tasks of a first step add up what the tasks before sent,
    a last task adds their sums, so it reads one vector a key and task whatever the number of rows was.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            for key, n, s in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("s")):
                v = s.values.to_numpy()
                if key in acc:
                    acc[key][0] += n
                    acc[key][1] += v
                else:
                    acc[key] = [n, v.copy()]
        if acc:
            yield vector_rows([(key, n, s) for key, (n, s) in acc.items()])

    fan = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(fan).mapInArrow(add, VECTORS).repartition(1).mapInArrow(add, VECTORS)


VECTORS = "key int, n long, s array<double>"


def vector_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    key, n, s = zip(*rows)
    ends = np.cumsum([0, *map(len, s)]).astype(np.int32)
    vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(s)))
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(n, pa.int64()), vectors], names=["key", "n", "s"])


def solve_stack(xtx: np.ndarray, xty: np.ndarray) -> np.ndarray:
    """Least-squares coefficients of many systems of normal equations (m, k, k) and (m, k), scaled to a unit diagonal."""
    d = np.sqrt(np.diagonal(xtx, axis1=1, axis2=2))
    d = np.where(d > 0, d, 1.0)
    inverse = np.linalg.pinv(xtx / (d[:, :, None] * d[:, None, :]), rcond=1e-14, hermitian=True)
    return (inverse @ (xty / d)[:, :, None])[:, :, 0] / d


def solve(names: list[str], s: np.ndarray, n: int, y: str, x: list[str]) -> dict:
    """Least squares of y on x (with constant) from a cross-product matrix."""
    idx = [0] + [1 + names.index(c) for c in x]
    j = 1 + names.index(y)
    xtx, xty, yty = s[np.ix_(idx, idx)], s[idx, j], s[j, j]
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    ssr = max(float(yty - beta @ xty), 0.0)
    df = n - len(idx)
    inv = np.linalg.pinv(xtx)
    se = np.sqrt(np.maximum(np.diag(inv) * ssr / df, 0.0)) if df > 0 else np.full(len(idx), np.nan)
    return {"beta": beta[1:], "se": se[1:], "ssr": ssr, "df": df}


REGRESSIONS = (
    "grp string, outcome string, treatment string, confounders string, ate double, standard_error double, "
    "t_stat double, p_value double, ci_lower double, ci_upper double, ssr double, df int, sample_size long"
)


def regress(grams: DataFrame, jobs: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Solve many regressions (outcome, treatment, confounders) on each group's cross products.

    The jobs are sub-blocks of matrices of k*k numbers; each costs a small solve and no pass over rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for g, names, s, n in b[["grp", "names", "s", "n"]].itertuples(index=False):
                names = list(names)
                m = np.asarray(s, dtype=float).reshape(len(names) + 1, -1)
                for y, t, conf in jobs:
                    r = solve(names, m, n, y, [t, *conf])
                    b0, se = float(r["beta"][0]), float(r["se"][0])
                    tv = b0 / se if se > 0 else np.nan
                    p = float(special.t_two_sided(np.array([tv]), np.array([r["df"]]))[0]) if se > 0 else np.nan
                    q = special.t_quantile(0.975, r["df"]) if r["df"] > 0 else np.nan
                    out.append(
                        (g, y, t, ",".join(conf), b0, se, tv, p, b0 - q * se, b0 + q * se, r["ssr"], r["df"], n)
                    )
            yield pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in REGRESSIONS.split(",")])

    return grams.mapInPandas(run, REGRESSIONS)
