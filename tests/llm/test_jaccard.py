"""The Jaccard join against all pairs, with groups large enough for every path."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest

from tidewise.llm import jaccard as J
from tidewise.llm import queries

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 3 * min(len(a), len(b)) <= 4 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    up[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    name = {r: min((i for i in v if i is not None), default=None) for r, v in least.items()}
    return sorted(((i, len(s), name[find(x)] if s else i) for x, (i, s) in enumerate(sets)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_texts_leave_arrow_in_pieces(monkeypatch):
    texts = ["a" * 30, "", "é" * 70, "b" * 300, "c", ""]
    monkeypatch.setattr(J, "PIECE", 100)
    got = list(J._pieces(pa.array(texts)))
    assert [(lo, hi) for lo, hi, _ in got] == [(0, 3), (3, 4), (4, 6)] and [t for *_, part in got for t in part] == texts


def test_query_over_all_documents(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op5_jaccard_join(spark, SF)) == brute(rows)


@pytest.mark.parametrize("small,seen", [(16, 8), (2, 3), (3, 10**9)])
def test_large_groups(spark, small, seen):
    """Near copies of one text (edits on both sides of the threshold), chains, a passage in many texts, short texts."""
    r = random.Random(small)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    base = [word() for _ in range(60)]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            text[r.randrange(len(text))] = word()
        return text

    texts = [" ".join(base)] * 5 + [" ".join(edited(base, r.randint(1, 6))) for _ in range(80)]
    chain = base
    for _ in range(40):
        chain = edited(chain, 1)
        texts.append(" ".join(chain))
    passage = [word() for _ in range(12)]
    texts += [" ".join([*[word() for _ in range(r.randint(1, 40))], *passage, *[word() for _ in range(r.randint(0, 9))]]) for _ in range(60)]
    texts += [" ".join(passage[i : i + r.randint(3, 9)]) for i in range(8)] * 3
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(J.join(df, small=small, seen=seen)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "One"), (5, "  oNE\n"), (None, "one"), (6, "É é"), (7, "é é"), (8, "a\x85b"), (9, "a b c d"), (10, "A  B\tc\nd"), (10, "x y z"), (12, long), (13, long + " 1"), (14, "a b c d e a b c d e a b c d e"), (15, "a b c d e a b c d e"), (None, None), (12, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n", "3 AS _id")
    assert got(J.join(df)) == brute(rows)
    assert J.join(df.limit(0)).count() == 0
    assert got(J.join(df.where("doc_id < 4"))) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


@pytest.mark.parametrize("small", [2, 4])
def test_texts_inside_longer_ones(spark, small):
    """Families of parts of one text, all shingles equally rare: a prefix may end before shingles that its partner has."""
    r, rows = random.Random(small), []
    for _ in range(60):
        base = ["%06x" % r.randrange(1 << 24) for _ in range(104)]
        for n in [79, 79, 104, *[r.randint(79, 104) for _ in range(small)]]:  # 75 to 100 shingles
            at = r.randint(0, 104 - n)
            rows.append((len(rows), " ".join(base[at : at + n])))
    out = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), small=small, seen=10**9)
    assert got(out) == brute(rows)


def test_very_long_texts(spark):
    """Sizes on both sides of 1.05 ** 256, beyond which size classes are not told apart."""
    word = [str(i) for i in range(266_004)]
    rows = [(1, " ".join(word[:265_004])), (2, " ".join(word)), (3, " ".join(word[:190_004]))]
    out = J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got(out) == [(1, 265_000, 1), (2, 266_000, 1), (3, 190_000, 3)]


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4100)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    out = J.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, out.collect())) == sorted(up.items())
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0
