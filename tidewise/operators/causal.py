"""Causal discovery: Granger tests, lagged correlation, conditional independence, transfer entropy, graphs.

Rows are folded once to cross products or counts whose size depends on the number of variables and bins
only; all pairs are then tested on those. No pair costs a pass over the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.functions import scalar as C
from tidewise.functions import special
from tidewise.operators import series as W
from tidewise.operators import stats as M
from tidewise.session import checkpointed

ALPHA = 0.05
PANEL = W.Layout(("panel",), ("ts",))


def lagged_panel(panel: DataFrame, variables: list[str], lags: range, layout: W.Layout = PANEL) -> DataFrame:
    """Complete rows of a panel (one row per time) with lag columns ``{name}__{k}`` and the position ``pos``."""
    df = checkpointed(panel.dropna(subset=variables)).withColumn("panel", F.lit(1))
    df = W.numbered(df, layout).drop("_n")

    def stage(w):
        return {f"{v}__{k}": F.lag(v, k).over(w) for v in variables for k in lags}

    return W.windowed(df, layout, [stage], back=max(lags))


# ---------------------------------------------------------------- Granger


GRANGER = (
    "cause string, effect string, method string, lag int, f_statistic double, p_value double, sample_size long"
)


def lag_blocks(panel: DataFrame, variables: list[str], max_lag: int, layout: W.Layout = PANEL) -> DataFrame:
    """Cross products of [1, now, lag 1, ..., lag max_lag] of a panel's rows (one per time), ``key int, n long, s array``.

    Key ``max_lag`` holds the block (row-major) of all rows that have all lags. The few rows before them come as they
    are: key p is the row at position p, lags that it doesn't have as 0. A shorter lag L adds the rows L, ...,
    max_lag - 1 to the block. Values are shifted by their means, so that sums stay well conditioned.
    """
    df = checkpointed(panel.dropna(subset=variables).select("ts", F.array(*[F.col(v).cast("double") for v in variables]).alias("raw")))
    mean = df.agg(F.array(*[F.avg(F.col("raw")[i]) for i in range(len(variables))])).scalar()
    df = df.select("*", mean.alias("mean"))
    df = df.select(F.lit(1).alias("panel"), "ts", F.zip_with("raw", "mean", lambda x, m: x - m).alias("now"))
    none = F.array_repeat(F.lit(0.0), len(variables))

    def past(w):
        return {"row": F.flatten(F.array("now", *[F.coalesce(F.lag("now", k).over(w), none) for k in range(1, max_lag + 1)]))}

    rows = W.windowed(W.numbered(df, layout), layout, [past], back=max_lag).filter("pos > 0").select("pos", "row")
    k = len(variables) * (max_lag + 1) + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, n = np.zeros((k, k)), 0
        for b in batches:
            if not b.num_rows:
                continue
            pos = b.column("pos").to_numpy()
            m = np.column_stack([np.ones(len(pos)), b.column("row").flatten().to_numpy().reshape(len(pos), -1)])
            early = np.flatnonzero(pos < max_lag)
            if len(early):
                yield M.vector_rows([(int(pos[i]), 1, m[i]) for i in early])
            m = m[pos >= max_lag]
            acc += m.T @ m
            n += len(m)
        if n:
            yield M.vector_rows([(max_lag, n, acc.ravel())])

    return M.summed(rows.mapInArrow(fold, M.VECTORS))


def _by_effect(blocks: DataFrame, effects: list[str]) -> DataFrame:
    """``effect, parts``: the parts of ``lag_blocks`` (max_lag rows at most) for each effect, spread over tasks."""
    parts = blocks.agg(F.collect_list(F.struct("key", "n", "s")).alias("parts"))
    return parts.withColumn("effect", F.explode(F.array(*[F.lit(e) for e in effects]))).repartition(len(effects), "effect")


def _each_lag(parts, variables: list[str], max_lag: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Lag, number of rows and their block, from max_lag down: each lag adds its first row to the block of the lag above."""
    found = {p["key"]: (p["n"], np.asarray(p["s"], dtype=float)) for p in parts}
    k = len(variables) * (max_lag + 1) + 1
    n, block = found.get(max_lag, (0, np.zeros(k * k)))
    block = block.reshape(k, k).copy()
    for lag in range(max_lag, 0, -1):
        if lag < max_lag and lag in found:
            n += 1
            block += np.outer(found[lag][1], found[lag][1])
        yield lag, n, block


def granger_lags(panel: DataFrame, variables: list[str], max_lag: int = 10, causes=None, effects=None, layout: W.Layout = PANEL) -> DataFrame:
    """F test of every (cause, effect) pair at every lag 1..max_lag.

    For lag L the rows are those with L predecessors. One block serves all lags (``lag_blocks``), so no row is copied per
    lag; effects are spread over tasks, which solve the small systems of all causes at once. A panel beyond the
    calendar's size takes a ``layout`` in blocks.
    """
    causes, effects = causes or variables, effects or variables
    spread = _by_effect(lag_blocks(panel, variables, max_lag, layout), effects)

    def left_over(block: np.ndarray, y: int, used: np.ndarray) -> np.ndarray:
        """Residual sum of squares of y on each row of ``used``."""
        xtx, xty = block[used[:, :, None], used[:, None, :]], block[used, y]
        return np.maximum(block[y, y] - (M.solve_stack(xtx, xty) * xty).sum(axis=1), 0.0)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for y, parts in b[["effect", "parts"]].itertuples(index=False):
                at = variables.index(y)
                others = [x for x in causes if x != y]
                for lag, n, block in _each_lag(parts, variables, max_lag):
                    free = n - 2 * lag - 1
                    if free <= 0 or n + lag < 3 * max_lag or not others:
                        continue
                    steps = 1 + np.arange(1, lag + 1) * len(variables)
                    own = np.concatenate([[0], steps + at])
                    both = np.array([np.concatenate([own, steps + variables.index(x)]) for x in others])
                    restricted, full = left_over(block, 1 + at, own[None, :])[0], left_over(block, 1 + at, both)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        f = np.where(full > 0, (restricted - full) / lag / (full / free), np.inf)
                    p = special.f_upper(f, np.full(len(f), lag), np.full(len(f), free))
                    out += [(x, y, "granger_causality", lag, fx, px, n + lag) for x, fx, px in zip(others, f.tolist(), p.tolist())]
            yield pd.DataFrame(out, columns=["cause", "effect", "method", "lag", "f_statistic", "p_value", "sample_size"])

    return spread.mapInPandas(test, GRANGER)


def best_lag(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The lag with the lowest p-value of each pair, the smallest of equals."""
    at = F.struct("p_value", "lag")
    return tests.groupBy("cause", "effect", "method").agg(
        F.min_by("lag", at).alias("optimal_lag"),
        F.min_by("f_statistic", at).alias("f_statistic"),
        F.min("p_value").alias("p_value"),
        F.max("sample_size").alias("sample_size"),
        (F.min("p_value") < alpha).alias("is_causal"),
    )


def granger_matrix(tests: DataFrame, variables: list[str], alpha: float = ALPHA) -> DataFrame:
    """One row per cause with flags and p-values per effect; untested cells are 0 and 1."""
    best = best_lag(tests, alpha)
    flags = [F.coalesce(F.max(F.when(F.col("effect") == v, F.col("is_causal").cast("int"))), F.lit(0)).alias(f"{v}_flag") for v in variables]
    ps = [F.coalesce(F.max(F.when(F.col("effect") == v, F.col("p_value"))), F.lit(1.0)).alias(f"{v}_p") for v in variables]
    return best.groupBy("cause").agg(*flags, *ps)


# ---------------------------------------------------------------- lagged correlation


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a Pearson correlation of n rows."""
    free = (n - 2).clip(lower=1).to_numpy(dtype=float)
    rr = r.to_numpy(dtype=float)
    t = rr * np.sqrt(free / np.maximum(1.0 - rr * rr, 1e-300))
    return pd.Series(special.t_two_sided(t, free))


def lagged_correlation(panel: DataFrame, variables: list[str], max_lag: int = 10, least: int = 30, layout: W.Layout = PANEL) -> DataFrame:
    """For each ordered pair the lag with the largest absolute correlation of cause(t-lag) with effect(t), the smallest of equals.

    All lags come from one block of cross products. Lags with ``least`` rows or fewer, or on which either side is constant,
    don't count.
    """
    v = len(variables)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for effect, parts in b[["effect", "parts"]].itertuples(index=False):
                y = 1 + variables.index(effect)
                best: dict[str, tuple] = {}
                for lag, n, block in _each_lag(parts, variables, max_lag):
                    if n <= least:
                        continue
                    x = 1 + lag * v + np.arange(v)
                    squares = np.append(block[x, x], block[y, y])
                    spread = squares - np.append(block[0, x], block[0, y]) ** 2 / n
                    spread = np.where(spread > 1e-12 * squares, spread, 0.0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        r = (block[x, y] - block[0, x] * block[0, y] / n) / np.sqrt(spread[:-1] * spread[-1])
                    for cause, c in zip(variables, r.tolist()):
                        at = (round(abs(c), 12), -lag)
                        if cause != effect and np.isfinite(c) and (cause not in best or at > best[cause][0]):
                            best[cause] = (at, lag, c, n)
                out += [(cause, effect, lag, c, n) for cause, (_, lag, c, n) in best.items()]
            yield pd.DataFrame(out, columns=["cause", "effect", "optimal_lag", "correlation", "n"])

    blocks = _by_effect(lag_blocks(panel, variables, max_lag, layout), variables)
    best = blocks.mapInPandas(pick, "cause string, effect string, optimal_lag int, correlation double, n long")
    p = correlation_p("correlation", "n")
    return best.withColumn("p_value", p).withColumn(
        "is_causal", (F.col("p_value") < ALPHA) & (F.abs("correlation") > 0.1)
    )


def correlation_structure(df: DataFrame, variables: list[str], threshold: float = 0.3) -> DataFrame:
    """Edges between variables whose absolute correlation over complete rows is above the threshold."""
    c = M.correlation(df.dropna(subset=variables), M.pair_columns(variables))
    return c.filter(F.abs("corr") > threshold).select(
        F.col("a").alias("cause"), F.col("b").alias("effect"), F.col("corr").alias("correlation"), F.col("n").alias("sample_size")
    )


# ---------------------------------------------------------------- transfer entropy


def binned_pairs(panel: DataFrame, variables: list[str], lag: int = 1, bins: int = 10) -> DataFrame:
    """Counts of (y_t, y_past, x_past) bins for every ordered pair: at most bins^3 rows per pair."""
    whole = checkpointed(panel.dropna(subset=variables))
    lo_hi = whole.agg(F.array(*[F.min(v) for v in variables]).alias("lo"), F.array(*[F.max(v) for v in variables]).alias("hi"))
    ranged = whole.withColumn("_r", lo_hi.select(F.struct("lo", "hi")).scalar())
    binned = ranged.select(
        "ts",
        *[C.width_bin(F.col(v), F.col("_r.lo")[i], F.col("_r.hi")[i], bins).alias(v) for i, v in enumerate(variables)],
    )
    lagged = lagged_panel(binned, variables, range(lag, lag + 1)).filter(F.col("pos") >= lag)
    items = F.array(
        *[
            F.struct(
                F.lit(x).alias("source"),
                F.lit(y).alias("target"),
                F.col(y).alias("y"),
                F.col(f"{y}__{lag}").alias("yp"),
                F.col(f"{x}__{lag}").alias("xp"),
            )
            for x, y in M.pair_columns(variables, ordered=True)
        ]
    )
    return lagged.select(F.inline(items)).groupBy("source", "target", "y", "yp", "xp").agg(F.count(F.lit(1)).alias("m"))


def transfer_entropy(counts: DataFrame) -> DataFrame:
    """H(y|y_past) - H(y|y_past, x_past) in bits from the counts, with the true joint entropies.

    Each row adds its share of log2 of its marginal cells; a pair has at most bins^3 rows.
    """
    pair = ["source", "target"]

    def log_p(*cells: str) -> Column:
        w = Window.partitionBy(*pair, *cells)
        return F.log2(F.sum("m").over(w) / F.sum("m").over(Window.partitionBy(*pair)) + 1e-10)

    rows = counts.withColumns(
        {
            "_n": F.sum("m").over(Window.partitionBy(*pair)),
            "_l": log_p("y", "yp", "xp") - log_p("yp", "xp") - log_p("y", "yp") + log_p("yp"),
        }
    )
    return rows.groupBy(*pair).agg(
        F.sum(F.col("m") / F.col("_n") * F.col("_l")).alias("transfer_entropy"), F.max("_n").alias("n")
    )


def transfer_entropy_test(counts: DataFrame, shuffles: int = 100, bins: int = 10, seed: int = 42) -> DataFrame:
    """Permutation p-value. Shuffling x_past only redraws the (y, y_past) x x_past table with fixed margins,
    so each shuffle is drawn from the counts: the cost does not depend on the number of rows."""
    schema = "source string, target string, transfer_entropy double, p_value double, is_causal boolean, n long"

    def plogp(c: np.ndarray, n: float) -> float:
        p = c[c > 0] / n
        return float(-(p * np.log2(p + 1e-10)).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["source"].iloc[0], pdf["target"].iloc[0]
        table = np.zeros((bins * bins, bins), dtype=np.int64)
        np.add.at(table, (pdf["y"].to_numpy() * bins + pdf["yp"].to_numpy(), pdf["xp"].to_numpy()), pdf["m"].to_numpy())
        n = float(table.sum())
        cube = table.reshape(bins, bins, bins)
        own = plogp(cube.sum(axis=2).ravel(), n) - plogp(cube.sum(axis=(0, 2)), n)

        def te(t: np.ndarray) -> float:
            c = t.reshape(bins, bins, bins)
            return own - plogp(c.ravel(), n) + plogp(c.sum(axis=0).ravel(), n)

        value = te(table)
        rng = np.random.default_rng([seed, zlib.crc32(f"{src}\0{dst}".encode())])
        rows, left = table.sum(axis=1), table.sum(axis=0)
        hits = 0
        for _ in range(shuffles):
            rest, drawn = left.copy(), np.zeros_like(table)
            for i in np.flatnonzero(rows):
                drawn[i] = rng.multivariate_hypergeometric(rest, rows[i])
                rest -= drawn[i]
            hits += te(drawn) >= value
        p = hits / shuffles
        return pd.DataFrame([(src, dst, value, p, p < ALPHA and value > 0.01, int(n))], columns=["source", "target", "transfer_entropy", "p_value", "is_causal", "n"])

    return counts.groupBy("source", "target").applyInPandas(run, schema)


# ---------------------------------------------------------------- conditional independence and the PC algorithm


def quantile_cells(panel: DataFrame, variables: list[str], q: int = 5) -> DataFrame:
    """Quantile bins of every variable and the count ``m`` of each distinct combination.

    Later tests read this table of counts, never the rows.
    """
    whole = panel.dropna(subset=variables)
    edges = M.column_quantiles(whole, variables, [i / q for i in range(1, q)])
    tagged = whole.withColumn("_e", edges.scalar())
    cells = tagged.select(*[C.quantile_bin(F.col(v), F.col("_e")[v]).alias(v) for v in variables])
    return cells.groupBy(*variables).agg(F.count(F.lit(1)).alias("m"))


def independence_tests(cells: DataFrame, tests: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    """Chi-square tests of x and y given z, all in one job: (test, x, y, z, statistic, dof, n)."""
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("test"),
                F.col(x).alias("xv"),
                F.col(y).alias("yv"),
                (F.concat_ws("|", *[F.col(c).cast("string") for c in z]) if z else F.lit("")).alias("zv"),
            )
            for i, (x, y, z) in enumerate(tests)
        ]
    )
    c = cells.select("m", F.inline(items)).groupBy("test", "zv", "xv", "yv").agg(F.sum("m").cast("double").alias("o"))
    zk = ["test", "zv"]
    rx = c.groupBy(*zk, "xv").agg(F.sum("o").alias("r"))
    cy = c.groupBy(*zk, "yv").agg(F.sum("o").alias("c"))
    # sum of o^2/e - n equals the sum of (o-e)^2/e over all cells, empty ones included
    shape = rx.groupBy(*zk).agg(F.sum("r").alias("nz"), (F.count(F.lit(1)) - 1).alias("dx"))
    shape = shape.join(cy.groupBy(*zk).agg((F.count(F.lit(1)) - 1).alias("dy")), zk)
    stat = c.join(rx, [*zk, "xv"]).join(cy, [*zk, "yv"]).join(shape.select(*zk, "nz"), zk)
    part = stat.groupBy(*zk).agg(F.sum(F.col("o") * F.col("o") * F.col("nz") / (F.col("r") * F.col("c"))).alias("q"))
    done = part.join(shape, zk).groupBy("test").agg(
        F.sum(F.col("q") - F.col("nz")).alias("statistic"),
        F.sum(F.col("dx") * F.col("dy")).alias("dof"),
        F.sum("nz").alias("n"),
    )
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(",".join(z)).alias("z")) for x, y, z in tests])
    return done.withColumn("_t", F.element_at(names, F.col("test") + 1)).select("test", "_t.*", "statistic", "dof", "n")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_upper(x.to_numpy(dtype=float), dof.to_numpy(dtype=float)))


def pc_algorithm(panel: DataFrame, variables: list[str], alpha: float = 0.01, max_given: int | None = None) -> DataFrame:
    """Stable PC: one Spark job per level holds all its tests; only test results reach the driver.

    Levels go on until no vertex has neighbours enough, or to ``max_given`` conditions where that is named.

    Returns directed edges (src, dst); edges left undirected point from the earlier to the later variable.
    """
    cells = checkpointed(quantile_cells(panel, variables))
    near = {v: set(variables) - {v} for v in variables}
    apart: dict[frozenset, set] = {}
    for level in range(max(1, len(variables) - 1) if max_given is None else max_given + 1):
        frozen = {v: set(s) for v, s in near.items()}  # stable: neighbours are fixed within a level
        tests = sorted(
            {
                (min(x, y), max(x, y), z)
                for x in variables
                for y in frozen[x]
                for z in combinations(sorted(frozen[x] - {y}), level)
            }
        )
        if not tests:
            break
        res = independence_tests(cells, tests).withColumn("p", chi2_p("statistic", "dof")).filter(F.col("p") >= alpha)
        for r in sorted(res.select("test").collect()):
            x, y, z = tests[r["test"]]
            if y in near[x]:
                near[x].discard(y)
                near[y].discard(x)
                apart[frozenset((x, y))] = set(z)
    return panel.sparkSession.createDataFrame(_orient(variables, near, apart), "src string, dst string")


def _orient(variables: list[str], near: dict[str, set], apart: dict[frozenset, set]) -> list[tuple[str, str]]:
    """Colliders first, then the two rules that avoid new colliders and cycles; the rest by variable order."""
    arrows: set[tuple[str, str]] = set()
    for mid in variables:
        for a, b in combinations(sorted(near[mid]), 2):
            if b not in near[a] and mid not in apart.get(frozenset((a, b)), set()):
                for end in (a, b):
                    if (mid, end) not in arrows:
                        arrows.add((end, mid))
    open_edges = {frozenset((a, b)) for a in variables for b in near[a]} - {frozenset(e) for e in arrows}
    changed = True
    while changed:
        changed = False
        for edge in sorted(open_edges, key=sorted):
            for a, b in (tuple(sorted(edge)), tuple(sorted(edge, reverse=True))):
                chain = any((c, a) in arrows and c not in near[b] and c != b for c in variables)
                path = any((a, c) in arrows and (c, b) in arrows for c in variables)
                if chain or path:
                    arrows.add((a, b))
                    open_edges.discard(edge)
                    changed = True
                    break
    place = {v: i for i, v in enumerate(variables)}
    return sorted(arrows | {tuple(sorted(e, key=place.get)) for e in open_edges})


# ---------------------------------------------------------------- evidence and graphs


def all_evidence(panel: DataFrame, variables: list[str], max_lag: int = 10, shuffles: int = 100) -> DataFrame:
    """Relationships by all methods in one long table, missing fields null. Plain correlation is never causal."""
    g = best_lag(granger_lags(panel, variables, max_lag))
    c = correlation_structure(panel, variables).withColumns(
        {"method": F.lit("correlation_threshold"), "is_causal": F.lit(False)}
    )
    t = transfer_entropy_test(binned_pairs(panel, variables), shuffles).select(
        F.col("source").alias("cause"),
        F.col("target").alias("effect"),
        F.lit("transfer_entropy").alias("method"),
        "p_value",
        "is_causal",
        F.col("n").alias("sample_size"),
    )
    p = pc_algorithm(panel, variables).select(
        F.col("src").alias("cause"), F.col("dst").alias("effect"), F.lit("pc").alias("method"), F.lit(True).alias("is_causal")
    )
    parts = g.unionByName(c, allowMissingColumns=True).unionByName(t, allowMissingColumns=True)
    return parts.unionByName(p, allowMissingColumns=True)


def consensus(evidence: DataFrame, min_methods: int = 1) -> DataFrame:
    """Edges supported by causal evidence: count, distinct methods, mean p and strength 1 - mean p."""
    g = evidence.filter("is_causal").groupBy("cause", "effect")
    out = g.agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.count_distinct("method").alias("methods"),
        F.avg("p_value").alias("mean_p"),
    )
    return out.filter(F.col("evidence_count") >= min_methods).withColumn("strength", 1 - F.col("mean_p"))


def vote_share(evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """Edges by votes relative to the most voted edge."""
    votes = evidence.filter("is_causal").groupBy("cause", "effect").agg(F.count(F.lit(1)).alias("votes"))
    top = votes.agg(F.max("votes")).scalar()
    share = votes.withColumn("confidence", F.col("votes") / top)
    return share.filter(F.col("confidence") >= least)


def unknown_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("graph", "src").withColumnRenamed("src", "id").withColumn("side", F.lit("source"))
    ends = ends.unionByName(edges.select("graph", F.col("dst").alias("id"), F.lit("target").alias("side")))
    return ends.join(nodes, ["graph", "id"], "left_anti").distinct()


def disconnected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select("graph", F.col("src").alias("id")).unionByName(edges.select("graph", F.col("dst").alias("id")))
    return nodes.join(used, ["graph", "id"], "left_anti")


def cyclic_graphs(edges: DataFrame, every: int = 4) -> DataFrame:
    """Graphs that hold a cycle. Edges that start at a source or end at a sink are peeled until none is left.

    Peeling from both ends takes half as many rounds as the longest path; lineage is cut every few rounds.
    """
    left = checkpointed(edges.select("graph", "src", "dst").distinct())
    size, rounds = left.count(), 0
    while size:
        heads = left.select("graph", F.col("dst").alias("src")).distinct()
        tails = left.select("graph", F.col("src").alias("dst")).distinct()
        left = left.join(heads, ["graph", "src"], "left_semi").join(tails, ["graph", "dst"], "left_semi")
        rounds += 1
        if rounds % every == 0 or rounds <= 2:
            left = checkpointed(left)
            now = left.count()
            if now == size:
                break
            size = now
    return left.select("graph").distinct()


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Errors and warnings of many graphs: one row per graph.

    Errors: unknown endpoints, a cycle (looked for only if all endpoints are known). Warnings: no edges,
    unknown node types, disconnected nodes.
    """
    n = nodes.groupBy("graph").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if(~F.coalesce("type", F.lit("")).isin("economic", "asset", "outcome")).alias("unknown_types"),
    )
    e = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edge_count"))
    u = unknown_endpoints(nodes, edges).groupBy("graph").agg(F.count(F.lit(1)).alias("unknown_endpoints"))
    dis = disconnected(nodes, edges).groupBy("graph").agg(F.count(F.lit(1)).alias("disconnected"))
    cyc = cyclic_graphs(edges).withColumn("cyclic", F.lit(True))
    out = n
    for part in (e, u, dis):
        out = out.join(part, "graph", "left")
    counts = ["edge_count", "unknown_endpoints", "disconnected"]
    out = out.join(cyc, "graph", "left").fillna(0, subset=counts)
    out = out.withColumn("has_cycle", F.coalesce("cyclic", F.lit(False)) & (F.col("unknown_endpoints") == 0)).drop("cyclic")
    return out.withColumn("is_valid", ~F.col("has_cycle") & (F.col("unknown_endpoints") == 0))
