"""Mixtures: targets against a plain program, words taken near the targets, agreement of reruns."""

import random
import re
from collections import defaultdict

import pytest

from tidewise.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def plain_targets(sizes):
    """Share by weight, cut at the limit, share the excess again."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def check(rows, out, near):
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    goal, taken, source = plain_targets(total), defaultdict(int), {i: s for i, _, s in rows}
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(i), n) for (i, _, _), n in zip(rows, size))
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(goal[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in goal:
        assert abs(taken[s] - goal[s]) <= near * max(size), (s, taken[s], goal[s])


def test_query_over_all_documents(spark):
    rows = [(d.doc_id, d.text, d.source) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op10_mixing(spark, SF).collect()
    check(rows, out, 1)
    again = queries.op10_mixing(spark, SF).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_odd_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, "w " * min(400, int(r.paretovariate(0.8))), "big" if i % 3 else r.choice(["a", "é", "Z", None, "~"])) for i in range(1, 400)]
    rows += [(1000, None, "a"), (1001, "", "empty source"), (1002, " \t\n", None), (1003, "one", "single"), (1004, "x " * 30_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS _size", "2 AS _n", "3 AS target")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    check(rows, queries.op10_mixing(spark, str(tmp_path)).collect(), 1)
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op10_mixing(spark, str(tmp_path / "none")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s"), (None, "e", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, keep=("text",)).collect()
    assert sorted(x.text for x in out) == ["a b", "a b", "c d", "e"] and all(0 <= x._copies <= 2 for x in out)
