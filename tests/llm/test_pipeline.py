"""The pipeline's stages against plain programs, each on its own input."""

import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from tests.llm import test_jaccard, test_mixing, test_suffix
from tidewise.llm import bpe

SF = "/root/testdata/sf0.001"


def test_stages_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, frames = docs, []
    for _, stage in C.STAGES:
        before = C.stored(stage(spark, before, SF))
        frames.append(before.collect())
    for f in frames[:-1]:
        assert list(f[0].__fields__) == docs.columns
    start, lang, near, cut, mixed, tokens = docs.collect(), *frames
    # Rejected: texts without letters only, in these data.
    kept = {r.doc_id for r in lang}
    assert kept <= {r.doc_id for r in start} and all(not any(c.isalpha() for c in r.text or "") for r in start if r.doc_id not in kept)
    want = test_jaccard.brute([(r.doc_id, r.text) for r in lang])
    assert sorted(r.doc_id for r in near) == sorted(i for i, _, c in want if i == c)
    spans = {i: (n - m) for i, n, m, _, _ in test_suffix.brute([(r.doc_id, r.text) for r in near])}
    assert sorted(r.doc_id for r in cut) == sorted(spans)
    assert all(0 <= len(r.text.encode()) - spans[r.doc_id] < 8 and r.n_chars == len(r.text) for r in cut)
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 2 and set(copies) <= set(spans)
    goal = test_mixing.plain_targets(_sizes(cut))
    taken = _sizes(mixed)
    most = max(len(r.text.split()) for r in cut)
    assert all(abs(taken.get(s, 0) - goal[s]) <= most for s in goal)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in tokens) == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)


def _sizes(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len(r.text.encode().split())
    return out


ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "12 34", None, "a", 5), (4, "the same text of eight words stands here", "en", "b", 1), (4, "the same text of eight words stands here", "en", "b", 1), (None, "no id for this text", "en", "b", 1), (5, "le texte " * 3000, "fr", "row", 1), (None, None, None, None, None)]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS row", "'x' AS lang_pred", "0.5D AS score", "2 AS _copies", "3 AS component_id")
    for frame in (df, df.limit(0)):
        before = frame
        for _, stage in C.STAGES[:-1]:
            before = C.stored(stage(spark, before, SF))
            assert before.columns == df.columns
        last = C.STAGES[-1][1](spark, before, SF).collect()
        assert {r.doc_id for r in last} <= {4, 5, None}
    near = C.drop_near_duplicates(spark, df, SF).collect()
    assert Counter(r.doc_id for r in near) == Counter([1, 2, 3, 4, 5, None, None])


def _shuffles_of(df, column):
    """Exchanges of a plan whose rows carry a column, by the text of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].split("\n")
    return [a for a, b in zip(lines, lines[1:]) if "Exchange" in a and "Reused" not in a and f"{column}#" in b]


def test_documents_travel_once_in_the_mixture(spark):
    rows = [(i, f"a text of {i % 7} words" * (i % 7), None if i % 5 == 0 else f"s{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "struct(doc_id, text) AS whole")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = C.mixing.mix(df, keep=("whole",))
        assert len(_shuffles_of(mixed, "k_whole")) == 1
        assert mixed.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_only_touched_documents_travel(spark):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, words(i, 200), "src") for i in range(100)] + [(100, words(0, 200), "src"), (None, words(3, 200), "src"), (101, None, "src")]
    df = C.stored(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    near = C.drop_near_duplicates(spark, df, SF)
    assert Counter(r.doc_id for r in near.collect()) == Counter([*range(100), None, 101])
    moved = C.stored(spark.createDataFrame([(i, t + " tail " + words(500, 100)) if i in (5, 6) else (i, t) for i, t, _ in rows], "doc_id long, text string"))
    cut = C.suffix.remove(moved)
    want = test_suffix.brute([tuple(r) for r in moved.collect()])
    assert sorted((len((r.text or "").encode()) for r in cut.collect())) == sorted(n - m for _, n, m, _, _ in want)
    for frame in (near, cut):
        rest = frame._jdf.queryExecution().optimizedPlan().toString()
        assert rest.lstrip().startswith("Union")  # rows that no key can touch go around the joins


def test_bit_map(spark):
    keys = spark.range(-50, 50).selectExpr("id * 7919 AS k")
    words = spark.sparkContext.broadcast(C.bit_map(keys, "k", 1 << 20))
    asked = keys.unionByName(spark.createDataFrame([(None,), (3,)], "k long"))
    got = asked.select("k", C.may_be_in(words, C.F.col("k")).alias("may")).collect()
    assert all(r.may == (r.k is not None and r.k % 7919 == 0) for r in got)
