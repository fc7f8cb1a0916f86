"""Removal of repeated strings against a table of all 400-byte strings."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from tidewise.llm import queries
from tidewise.llm import suffix as S

SF = "/root/testdata/sf0.001"


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + 400] for _, t in texts for k in range(len(t) - 399))
    out = []
    for i, t in texts:
        gone, upto, runs = bytearray(len(t)), 0, 0
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[max(k, upto) : k + 400] = b"\1" * (k + 400 - max(k, upto))
                runs += k > upto or upto == 0
                upto = k + 400
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def fixture(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(400), prose(110)
    texts = [base, base, passage, passage[:399], passage[:401], "x" * 399, "y" * 400, "z" * 401, "ab" * 700, "abc" * 400]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(r.randint(1, 5)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(30):
        a = r.randrange(0, 150)
        texts.append(prose(r.randint(0, 80)) + passage[a : a + r.choice([380, 400, 401, 420, 500, 900])] + prose(r.randint(0, 80)))
    texts += [passage * 3, prose(30) + base[500:1000] + prose(5) + base[200:900], prose(300)]
    rows = list(enumerate(texts)) + [(None, None), (None, prose(90)), (7, ""), (7, texts[12]), (900, prose(3000) + passage)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_repeats(spark, seed):
    sizes = S.Sizes(segment=1000, blob=20, run=3000) if seed == 2 else S.SIZES  # many segments, blobs and runs
    rows = fixture(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS t1", "2 AS spans").repartition(5)
    assert got(S.report(df, sizes=sizes)) == brute(rows)


def test_anchors_are_dealt_to_all_fragments():
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(600)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["_text"])
    rows = Counter()
    for out in S._stretches(16, S.SIZES)(iter([batch])):
        for f, data in zip(out.column("fragment").to_pylist(), out.column("data").to_pylist()):
            rows[f] += len(data)
    assert len(rows) == 16 and max(rows.values()) < 2 * min(rows.values())


def test_query_over_all_documents(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op8_repeated_strings(spark, SF)) == brute(rows)


def test_a_filter_that_passes_all(spark):
    rows = fixture(3)
    assert got(S.report(spark.createDataFrame(rows, "doc_id long, text string"), sizes=S.Sizes(bits=32))) == brute(rows)


def test_removal_keeps_characters_and_columns(spark):
    rows = fixture(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS _key")
    out = S.remove(df).collect()
    assert out[0].__fields__ == df.columns and len(out) == len(rows)
    size = {(i, h): n - m for i, n, m, _, h in brute(rows)}
    total = sum(size.values())
    assert 0 <= sum(len((r.text or "").encode()) for r in out) - sum(n - m for _, n, m, _, _ in brute(rows)) < 8 * len(rows) and total >= 0
    assert sum(r.text is None for r in out) == 1


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.report(none).count() == 0 and S.remove(none).count() == 0
    short = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert got(S.report(short)) == brute([(1, "a"), (2, None)])


def test_merge():
    r = random.Random(5)
    for _ in range(60):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 7))]
        coded = [S.front_decoded(S.front_coded(x))[:2] for x in runs]
        assert [c[0] for c in coded] == runs
        order = list(S.merge(coded))
        items = [runs[i][k] for i, k, _ in order]
        assert items == sorted(x for run in runs for x in run)
        assert [n for *_, n in order][1:] == [S.common(a, b, 0) for a, b in zip(items, items[1:])]
