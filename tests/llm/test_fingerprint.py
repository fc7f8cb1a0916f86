"""Fingerprints: chunk properties, and the query against a plain program."""

import hashlib
import random

from tidewise.llm import fingerprint as fp
from tidewise.llm import queries

SF = "/root/testdata/sf0.001"


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = fp.chunk_set(t), fp.chunk_set(e), fp.chunk_set(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_chunks_cover_the_text():
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 64, 255, 256, 257, 5000):
        data = bytes(r.randrange(256) for _ in range(n))
        ends = fp.boundaries(data)
        assert ends == sorted(set(ends)) and (ends[-1:] == [n] if n else ends == [])
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert all(s <= fp.LARGEST for s in sizes) and all(s >= fp.SMALLEST for s in sizes[:-1])
    assert fp.boundaries(b"x" * 1000)[-1] == 1000


def test_insertion_changes_little():
    r = random.Random(2)
    text = " ".join(r.choice("the of and to in is that it was for".split()) + str(r.randrange(999)) for _ in range(2000))
    moved = text[:700] + "inserted words" + text[700:]
    assert fp.likeness(fp.chunk_set(text), fp.chunk_set(moved)) > 0.95
    half = text[: len(text) // 2]
    assert fp.likeness(fp.chunk_set(half), fp.chunk_set(text)) > 0.95
    other = " ".join(str(r.random()) for _ in range(500))
    assert fp.likeness(fp.chunk_set(text), fp.chunk_set(other)) < 0.02
    assert fp.from_text(fp.as_text(fp.chunk_set(text))) == fp.chunk_set(text)
    assert fp.likeness(frozenset(), frozenset()) == 1 and fp.likeness(frozenset(), fp.chunk_set("a")) == 0


def test_query_over_all_documents(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op6_fingerprints(spark, SF).collect()), key=str) == expected(rows)


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(None, "no id"), (None, None), (5, None), (5, ""), (7, "same"), (7, "same"), (8, "é" * 99), (-3, "中" * 7)]
    rows += [(r.randrange(40), "".join(r.choice("abé ") for _ in range(r.randrange(400)))) for _ in range(200)] + [(900, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _part", "2 AS _id").repartition(6)
    assert sorted(map(tuple, fp.compare_with_next(df).collect()), key=str) == expected(rows)
    one = spark.createDataFrame(rows[2:3], "doc_id long, text string")
    assert [tuple(x) for x in fp.compare_with_next(one).collect()] == expected(rows[2:3])
    nulls = spark.createDataFrame(rows[:2], "doc_id long, text string")
    assert sorted(map(tuple, fp.compare_with_next(nulls).collect()), key=str) == expected(rows[:2])
    assert fp.compare_with_next(df.limit(0)).count() == 0
    assert fp.fingerprints(df).count() == len(rows)
