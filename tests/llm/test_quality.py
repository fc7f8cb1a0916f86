"""Quality scores: held-out documents, the curve, and odd rows."""

import zlib

import numpy as np

from tidewise.llm import quality, queries

SF = "/root/testdata/sf0.01"


def area(score, label):
    """Chance that a document of label 1 scores above one of label 0."""
    good, bad = score[label == 1], score[label == 0]
    return ((good[:, None] > bad[None, :]) + (good[:, None] == bad[None, :]) / 2).mean()


def test_held_out_documents(spark):
    docs = [d.doc_id for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = queries.op11_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in labels]
    label = np.array([labels[r.doc_id] for r in test])
    assert len(test) > 50 and area(np.array([r.score for r in test]), label) > 0.93
    assert np.mean([r.predicted == labels[r.doc_id] for r in test]) > 0.9
    assert sorted(map(tuple, out)) == sorted(map(tuple, queries.op11_quality(spark, SF).collect()))


def test_curve_meets_the_shares():
    r = np.random.default_rng(0)
    y = (r.random(3000) < 0.7).astype(float)
    x = r.normal(0, 1e-3, 3000) + 2e-3 * y
    slope, offset = quality.curve(x, y, np.ones(len(x)))
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert slope > 0 and abs(p.mean() - y.mean()) < 0.01
    for lo, hi in ((0.0, 0.4), (0.4, 0.8), (0.8, 1.0)):
        inside = (p >= lo) & (p < hi)
        assert abs(p[inside].mean() - y[inside].mean()) < 0.05
    slope, offset = quality.curve(np.array([-1.0, 1.0]), np.array([0.0, 1.0]), np.ones(2))
    assert np.isfinite([slope, offset]).all() and slope > 0


def test_odd_rows(spark):
    good, bad = "the river runs past the old mill and on to the sea. ", "BUY!!! $$$ || NOW ### "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 7) + str(i)) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)] + [(None, 1), (900, 0), (3, None), (4, 7), (1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, known)
    odd = [(1, None), (2, ""), (None, good * 3), (3, bad * 3), (3, bad * 3), (4, good * 50_000), (5, "퟿日本"), (6, "a")]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS _text", "2 AS _x", "3 AS _label")
    got = quality.score(df, model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "score", "_text", "_x", "_label"] and len(got) == len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[None, good * 3] > 0.8 and by[4, good * 50_000] > 0.5 and by[3, bad * 3] < 0.2 and by[1, None] == by[2, ""] == model.share
    one = quality.fit(docs, known.where("quality = 1"))
    none = quality.fit(docs, known.limit(0))
    assert one.share > 0.9 and none.share == 0.5
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert quality.fit(docs.limit(0), known).dictionaries is None
    assert quality.score(df.limit(0), model).count() == 0
    few = quality.fit(docs, known, docs_per_label=20)
    assert few.dictionaries is not None
