"""Spelling variants against a comparison of all words with all, and odd rows."""

import random
import re
import zlib
from collections import Counter

from tidewise.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, every=199, least=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= least}


def brute_groups(words, times=5):
    by_half = {}
    for w in words:
        for side, x in ((0, w), (1, w[::-1])):
            for h in {len(w) // 2, max(len(w) - 1, 1) // 2}:
                by_half.setdefault((side, x[:h]), []).append(w)
    near = {w: set() for w in words}
    for group in by_half.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_query_equals_brute_force(spark):
    got = rows(queries.op13_spelling(spark, SF))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = brute_groups(brute_words([tuple(d) for d in docs]))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500
    assert any(r[1] for r in got)


def test_words_of_all_lengths_and_crowded_ranges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "ASKERS", 20)
    monkeypatch.setattr(spelling, "SAMPLES", 3)
    monkeypatch.setattr(spelling, "ASKED", 16)
    r = random.Random(3)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 9))): r.choice([5, 6, 30, 200, 2000]) for _ in range(900)}
    words |= {"hotprefix" + "".join(r.choice("xyz") for _ in range(5)): r.choice([5, 26, 140]) for _ in range(120)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    pairs = [(a, b) for a in words for b in words if one_edit(a, b)]
    got = [(x.a, x.b) for x in spelling.near(df).collect()]
    assert sorted(got) == sorted(pairs)
    groups = rows(spelling.group(df))
    assert len(groups) == len(words)
    for w, form, root, n, n_near, form_n in groups:
        near = [b for a, b in pairs if a == w]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        assert n_near == len(near) and form == (best if best and words[best] >= 5 * n else None) and form_n == words.get(form)
    form = {g[0]: g[1] for g in groups}
    for g in groups:
        x = g[0]
        while form[x]:
            x = form[x]
        assert g[2] == x


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "HELD", 3)
    long = "Straße-" * 40 + "x" * 300 + " ÀÉÎÕÜß " * 9
    data = [(1, None), (2, ""), (None, "Banana " * 7), (3, "banana BANANA bananas " * 5), (3, "banana BANANA bananas " * 5), (4, long), (5, "12 _ 日本 ×÷abcd"), (6, "cabana " * 60)]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, word string, n long")
    for every in (199, 2):
        got = {r.word: r.n for r in spelling.vocabulary(df, every=every).collect()}
        assert got == brute_words(data, every)
    assert rows(spelling.group(spelling.vocabulary(df.limit(0)))) == []
    assert set(rows(spelling.group(spelling.vocabulary(df)))) == brute_groups(brute_words(data))
