"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into parts of equal size with few cut edges. A small classifier
learns the parts from the vectors. It puts every row of the table into its most probable part, and sends a query to the
several parts it thinks most probable, where all rows are compared exactly. How many parts a query visits is set on the
sample, so that the parts hold a wanted share of the true neighbours.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.common import stored

#: Rows a part should have, the most parts, and the bounded sample for the partitions: vectors, and bytes of vectors.
PART_ROWS, MOST_PARTS, SAMPLE, SAMPLE_BYTES = 4096, 1024, 8192, 64_000_000
#: Neighbours in the graph, and the share of them that the visited parts must hold on the sample.
GRAPH_DEGREE, COVER = 10, 0.95
#: Rows of a part that one task compares, and queries that it holds; larger parts are dealt to several tasks.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
HIDDEN, EPOCHS, RATE = 128, 30, 0.005


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    d = v.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(d, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Rows of equal length from an Arrow list column or a pandas column of arrays."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def neighbour_graph(x: np.ndarray, degree: int = GRAPH_DEGREE) -> np.ndarray:
    """Indices of the nearest others of each unit vector of the sample."""
    degree = min(degree, len(x) - 1)
    out = np.empty((len(x), degree), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree] if degree else out[lo : lo + 1024]
    return out


def _halve(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, left: int, r) -> tuple[np.ndarray, np.ndarray]:
    """Cut a set of nodes so that ``left`` are on one side and few edges (a, b; local numbers) cross.

    The second eigenvector of the smoothed graph gives the order, exchanges of the best pairs improve the cut.
    """
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1.0
    root = np.sqrt(degree)
    flat = root / np.linalg.norm(root)
    v = r.normal(size=n)
    for _ in range(60):
        w = v / root
        s = (w + np.bincount(a, w[b], n) + np.bincount(b, w[a], n)) / root
        v = s + v
        v -= flat * (flat @ v)
        v /= np.linalg.norm(v) + 1e-300
    side = np.ones(n, bool)
    side[np.argsort(v / root, kind="stable")[:left]] = False
    for _ in range(20):
        other = side[a] != side[b]
        weight = np.where(other, 1.0, -1.0)
        gain = np.bincount(a, weight, n) + np.bincount(b, weight, n)
        p, q = np.flatnonzero(~side), np.flatnonzero(side)
        p, q = p[np.argsort(-gain[p], kind="stable")], q[np.argsort(-gain[q], kind="stable")]
        m = min(len(p), len(q), max(1, n // 50))
        good = int((gain[p[:m]] + gain[q[:m]] > 0).sum())
        if not good:
            break
        trial = side.copy()
        trial[p[:good]], trial[q[:good]] = True, False
        if (trial[a] != trial[b]).sum() >= other.sum():
            break
        side = trial
    return np.flatnonzero(~side), np.flatnonzero(side)


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Part of each node: recursive halving, sizes equal but for rounding."""
    r = np.random.default_rng(seed)
    out = np.zeros(len(graph), np.int64)
    source, target = np.repeat(np.arange(len(graph)), graph.shape[1]), graph.ravel()
    todo = [(np.arange(len(graph)), source, target, 0, parts)]
    while todo:
        nodes, a, b, first, k = todo.pop()
        if k == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        sides = _halve(nodes, a, b, len(nodes) * (k // 2) // k, r)
        for chosen, start, n in ((sides[0], first, k // 2), (sides[1], first + k // 2, k - k // 2)):
            place = np.full(len(nodes), -1)
            place[chosen] = np.arange(len(chosen))
            inside = (place[a] >= 0) & (place[b] >= 0)
            todo.append((nodes[chosen], place[a[inside]], place[b[inside]], start, n))
    return out


class Router:
    """One hidden layer and a softmax over the parts."""

    def __init__(self, x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, seed: int = 0):
        r = np.random.default_rng(seed)
        d = x.shape[1]
        p = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        scaled = x * d**0.5
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for lo in range(0, len(x), 256):
                i = order[lo : lo + 256]
                goal = np.zeros((len(i), parts))  # a vector's own part and those of its neighbours
                goal[np.arange(len(i)), part[i]] = 0.5
                np.add.at(goal, (np.arange(len(i))[:, None], part[graph[i]]), 0.5 / max(1, graph.shape[1]))
                h = np.maximum(scaled[i] @ p[0] + p[1], 0)
                e = (_softmax(h @ p[2] + p[3]) - goal) / len(i)
                back = (e @ p[2].T) * (h > 0)
                step += 1
                for w, g, a, b in zip(p, (scaled[i].T @ back, back.sum(0), h.T @ e, e.sum(0)), m, v):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self.weights, self.parts = p, parts
        ranks = np.argsort(np.argsort(-self.probabilities(x), axis=1, kind="stable"), axis=1)
        home = ranks.argmin(axis=1)
        need = np.sort(ranks[np.arange(len(x))[:, None], home[graph]].ravel())
        #: Parts to visit: enough for the wanted share of the sample's neighbours.
        self.visits = parts if not len(need) else int(min(parts, need[min(len(need) - 1, int(COVER * len(need)))] + 1))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return _softmax(np.maximum(x * x.shape[1] ** 0.5 @ a + b, 0) @ c + d)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(vectors: DataFrame, rows: int, part_rows: int = PART_ROWS, most_parts: int = MOST_PARTS, most: int = SAMPLE) -> Router | None:
    """Partitions from the first vectors in order of a hash, at most ``most``. None where one part will do."""
    parts = min(most_parts, rows // part_rows)
    if parts < 2:
        return None
    d = vectors.select(F.size("_v")).first()[0]
    size = max(64, min(most, SAMPLE_BYTES // (4 * d)))
    found = vectors.select("_id", "_v", F.xxhash64("_id").alias("_h")).orderBy("_h", "_id").limit(size).toPandas()
    x = _unit(_matrix(found["_v"]))
    parts = min(parts, len(x) // 8)
    if parts < 2:
        return None
    graph = neighbour_graph(x)
    return Router(x, graph, balanced_parts(graph, parts), parts)


def _routed(df: DataFrame, router: Router | None, visits: int) -> DataFrame:
    """``_id, _v, _part``: a row for each of the ``visits`` most probable parts."""
    if router is None:
        return df.select("_id", "_v", F.lit(0).alias("_part"))
    shared = df.sparkSession.sparkContext.broadcast(router)  # its size is bounded by the most parts and the dimension

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p = shared.value.probabilities(_unit(_matrix(b.column("_v"))))
            best = np.argsort(-p, axis=1, kind="stable")[:, :visits].astype(np.int32)
            again = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("_id").take(again), b.column("_v").take(again), pa.array(best.ravel())], names=["_id", "_v", "_part"])

    return df.select("_id", "_v").mapInArrow(run, "_id long, _v array<float>, _part int")


def _pieces(df: DataFrame, most: int) -> dict[int, int]:
    """Number of blocks of each part; as many entries as parts."""
    return {r["_part"]: -(-r["count"] // most) for r in df.groupBy("_part").count().collect()}


def _number(part: Column, counts: dict[int, int]) -> Column:
    table = [counts.get(i, 1) for i in range(max(counts, default=0) + 1)]
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in table]), part), F.lit(1))


def search(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row that fulfils ``queries`` the ``k`` nearest found by cosine.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids, nor vectors of
    another length than the one that most rows have. Rows with a query's id are not its neighbours. Ties go to smaller
    ids. Of equal vectors only the k + 1 smallest ids can ever be among the nearest, so only these are kept. Repeated rows
    count once; an id with several vectors is one neighbour, by its best score, and one query with all of them.
    """
    clean = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<float>").alias("_v"), queries.alias("_q")).where(F.col("_id").isNotNull() & usable(F.col(vector_col)) & usable(F.col("_v")))
    lengths = clean.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 0
    clean = clean.where(F.size("_v") == d)
    same = Window.partitionBy("_v").orderBy("_id")
    kept = stored(clean.select("_id", "_v").distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).select("_id", "_v"))
    asked = stored(clean.where("_q").select("_id", "_v").distinct())
    router = fit(kept, kept.count(), part_rows)
    index = stored(_routed(kept, router, 1))
    visits = stored(_routed(asked, router, router.visits if router else 1))
    blocks, groups = _pieces(index, BLOCK_ROWS), _pieces(visits, BLOCK_QUERIES)
    n, m = _number(F.col("_part"), blocks), _number(F.col("_part"), groups)
    spread = lambda c, count: F.explode(F.sequence(F.lit(0), count - 1)).alias(c)
    deal = lambda c, count: F.pmod(F.xxhash64("_id"), count).cast("int").alias(c)
    left = index.select("_id", "_v", "_part", deal("_block", n), spread("_group", m))
    right = visits.select("_id", "_v", "_part", spread("_block", n), deal("_group", m))

    def compare(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            rows = rows.sort_values("_id", kind="stable")
            ids, c = rows["_id"].to_numpy(), _matrix(rows["_v"])
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            most = min(k, len(first))
            unit, norm = _unit(c), np.sqrt((c * c).sum(axis=1))
            q_ids, q = asks["_id"].to_numpy(), _matrix(asks["_v"])
            q_unit, q_norm = _unit(q), np.sqrt((q * q).sum(axis=1))
            for lo in range(0, len(q), 256):
                s = q_unit[lo : lo + 256] @ unit.T
                s[q_ids[lo : lo + 256, None] == ids[None, :]] = -np.inf
                best = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)  # of each id
                least = np.partition(best, -most, axis=1)[:, -most] - 1e-9
                for i in range(len(s)):
                    near = np.flatnonzero((s[i] >= least[i]) & np.isfinite(s[i]))
                    # Once more, row by row, so that equal vectors have equal scores wherever they are compared.
                    score = (c[near] * q[lo + i]).sum(axis=1) / (norm[near] * q_norm[lo + i])
                    order = np.lexsort((ids[near], -score))
                    if len(first) < len(ids):
                        order = order[np.sort(np.unique(ids[near[order]], return_index=True)[1])]
                    for j in order[:k]:
                        out.append((int(q_ids[lo + i]), int(ids[near[j]]), float(score[j])))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["_part", "_block", "_group"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # ids may have several vectors
    return unique.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
