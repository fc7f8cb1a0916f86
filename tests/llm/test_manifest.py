"""Merkle manifest against trees that are built whole, and odd rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidewise.llm import manifest, queries

SF = "/root/testdata/sf0.01"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and the (left, right) siblings of every node on its way up."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, at in enumerate(place):
            run, inside = runs[at // 3], at % 3
            paths[k].append(("".join(run[:inside]), "".join(run[inside + 1 :])))
        nodes, place = [H(*r) for r in runs], [at // 3 for at in place]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the query's rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for n in names:
        groups[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {n: tree([x[1] for x in groups[n]]) for n in names}
    root, above = tree([trees[n][0] for n in names])
    out = []
    for n, up in zip(names, above):
        for (doc, d, row), own in zip(groups[n], trees[n][1]):
            steps, now = own + up, d
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and row[4] is not None:
                now = leaf((*row[:4], row[4].replace("\n", "")))
            for left, right in steps:
                now = H(left, now, right)
            out.append((doc, d, trees[n][0], root, H(*[x for s in steps for x in s]), now, now == root))
    return sorted(out, key=str)


def rows(df):
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()], key=str)


def test_query_equals_whole_trees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    want = brute([tuple(d) for d in docs])
    got = rows(queries.op12_manifest(spark, SF))
    assert got == want
    assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_frontier_of_any_length(depth):
    for n in [*range(1, 30), 81, 82, 100]:
        leaves = [H(str(i)) for i in range(n)]
        f = manifest.Frontier()
        for x in leaves:
            f.append(x)
        assert (f.close(), f.witness) == tree(leaves)
        nodes, witness = leaves, [[] for _ in leaves]
        place = list(range(n))
        while True:  # blocks, and blocks of their roots
            size = 3**depth
            grown = [manifest.grown(nodes[i : i + size], i // size, depth) for i in range(0, len(nodes), size)]
            for k, at in enumerate(place):
                witness[k] += grown[at // size].witness[at % size]
            nodes, place = [g.root for g in grown], [at // size for at in place]
            if len(nodes) == 1:
                break
        assert (nodes[0], witness) == tree(leaves)


def test_odd_rows_and_many_groups(spark, tmp_path):
    data = [(i, f"s{i % 37}", "en", i, f"line {i}\nend") for i in range(300)]
    data += [(i, "hot", None, None, None if i % 3 else "a\nb\n") for i in range(1000, 1400)]
    data += [(None, None, None, None, None), (None, None, "x", 1, "é\n日本"), (5, None, "en", 0, ""), (7, "", "en", -3, "\n" * 9), (8, "Ü", "en", 2, "x" * 300_000 + "\n")]
    data += [(1000, "hot", None, None, None)] * 40 + [(9, "same", "en", 1, "a\nb")] * 50
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    df.withColumns({c: F.lit(0) for c in ("tree", "node", "pos", "row", "leaf", "tampered", "witness", "root")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(manifest.documents(spark, str(tmp_path))) == brute(data)
    for depth in (1, 2):
        got = manifest.build(df, F.col("source"), [F.col("doc_id")], manifest.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]), ["doc_id"], depth)
        found = sorted([(r.doc_id, r.node, r.subroot, r.root, r.p) for r in got.withColumn("p", F.sha2(manifest.proof(F.col("witness")), 256)).collect()], key=str)
        assert found == sorted([r[:5] for r in brute(data)], key=str)
    df.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert manifest.documents(spark, f"{tmp_path}/empty").count() == 0
