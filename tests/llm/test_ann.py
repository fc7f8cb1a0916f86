"""Nearest neighbours: scores and order against brute force, recall, odd vectors."""

import numpy as np

from tidewise.llm import ann, queries
from tidewise.llm.ann import F

SF = "/root/testdata/sf0.01"


def brute(rows, k=5):
    """(query, rank) -> (id, score) over usable vectors."""
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in use:
        if i % 50 == 0:
            near = sorted({(-round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 12), j) for j, v in use if j != i})[:k]
            out |= {(i, r): (j, -s) for r, (s, j) in enumerate(near, 1)}
    return out


def compared(rows, df, **more):
    want = brute(rows)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 50 == 0, **more).collect()}
    assert got.keys() == want.keys()
    hits = sum(got[k][0] in {want[q][0] for q in want if q[0] == k[0]} for k in got)
    return hits / max(1, len(got)), got, want


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.op3_nearest_neighbours(spark, SF).collect()}
    want = brute(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_learned_parts(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    rows = [(i, (centres[r.integers(40)] + 0.35 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    recall, got, want = compared(rows, df, part_rows=200)
    assert recall >= 0.9
    router = ann.fit(df.selectExpr("vec_id AS _id", "embedding AS _v"), 4000, 200)
    assert router.parts == 20 and router.visits < 15  # it visits some of the parts only


def test_balanced_parts():
    r = np.random.default_rng(1)
    x = ann._unit(r.normal(size=(500, 8)))
    sizes = np.bincount(ann.balanced_parts(ann.neighbour_graph(x), 7), minlength=7)
    assert sizes.sum() == 500 and sizes.max() - sizes.min() <= 3
    two = np.concatenate([r.normal(size=(60, 8)) * 0.1 + 5, r.normal(size=(60, 8)) * 0.1 - 5])
    part = ann.balanced_parts(ann.neighbour_graph(ann._unit(two)), 2)
    assert len(set(part[:60])) == 1 and len(set(part[60:])) == 1


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 2.0]) for i in range(300, 460)] + [(500 + i, [0.5 * 2**i, 0.0, 0.0]) for i in range(5)]
    rows += [(1000, None), (1050, []), (1100, [0.0, 0.0, 0.0]), (1150, [1.0, None, 2.0]), (1200, [float("nan"), 1.0, 1.0]), (1250, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS _id", "2 AS score")
    recall, got, want = compared(rows, df)
    assert recall == 1 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(df.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0
    few = [(50, [1.0, 0.0]), (51, [1.0, 1.0]), (52, [1.0, 2.0, 3.0])]
    assert len(ann.search(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()) == 1


def test_repeated_rows_in_one_block(spark):
    """Copies of rows take no places of other ids; an id with two vectors is one neighbour."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=3).astype(np.float32).tolist()) for i in range(1, 120)]
    rows += [(200 + i, [1.0, 2.0, 2.0]) for i in range(8)]
    df = spark.createDataFrame(rows + rows + 6 * [(200, [1.0, 2.0, 2.0])], "vec_id long, embedding array<float>")
    recall, got, want = compared(rows, df)
    assert recall == 1 and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    two = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [1.0, 0.3]), (3, [0.4, 1.0]), (4, [1.0, 0.5]), (5, [-1.0, 0.1]), (6, [0.9, 1.0])]
    out = ann.search(spark.createDataFrame(two, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert [(x["rank"], x.vec_id) for x in out.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 6)]
