"""Language identification: held-out accuracy, gradients' effect, and odd rows."""

import zlib

import numpy as np

from tidewise.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_over_all_documents(spark):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op9_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    test = [r for r in out if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in test) / len(test)
    assert len(test) > 200 and right > 0.95, right
    again = queries.op9_language_id(spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_tables_equal_filters():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    pooled = []
    for w in langid.WIDTHS:
        span = langid.WINDOW - w + 1
        pooled.append(sum(net.filters[w][j][x[:, j : j + span]] for j in range(w)).max(axis=1))
    want = net._softmax(np.maximum(np.concatenate(pooled, axis=1), 0))
    assert np.allclose(net.probabilities(x), want, atol=1e-5)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 9 if i % 2 else "le chat et le chien " * 9, "en" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(df.where(~langid.held_out()))
    assert net.labels == ["en", "fr"]
    odd = [(1, None), (2, ""), (3, "123 _ !?"), (4, "the dog"), (None, "le chien"), (4, "the dog"), (5, "the cat " * 100_000), (6, "é")]
    got = langid.identify(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS lang"), net).collect()
    by = sorted((str(r.doc_id), r.lang_pred) for r in got)
    assert by == sorted([("1", "und"), ("2", "und"), ("3", "und"), ("4", "en"), ("None", "fr"), ("4", "en"), ("5", "en"), ("6", by[-2][1])])
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    frame = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS lang")
    apart = frame.withColumn("told", langid.told(net, frame["text"])).select("doc_id", "told.lang_pred", "told.score").collect()
    assert sorted(map(str, apart)) == sorted(map(str, got))
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), net).count() == 0
