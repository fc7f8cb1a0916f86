"""Token-id files: exact round trips, and ids as the tokenizers library gives them."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from tidewise.llm import queries, tokenfile
from tidewise.llm.common import scratch

SF = "/root/testdata/sf0.001"
FILE = P.path("byte_bpe_50k.json")


def expected(rows):
    t, start, out = Tokenizer.from_file(FILE), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    docs = [r.zipf(1.3, r.integers(0, 3000)).clip(0, 60000).astype(np.uint32) for _ in range(30)] + [np.zeros(5000, np.uint32), np.empty(0, np.uint32)]
    keys = [None, *range(1, len(docs))]
    s = tokenfile.Shard(tokenfile.pack(keys, docs, 0 if seed % 2 else None, 50257))
    assert s.doc_ids == keys
    tail = [0] if seed % 2 else []
    assert [d.tolist() for _, d in s.documents()] == [d.tolist() + tail for d in docs]
    assert all(s.document(i).tolist() == d.tolist() + tail for i, d in enumerate(docs))
    assert len(s.rules) and len(s.symbols) < sum(map(len, docs))


def test_nothing_to_pack():
    s = tokenfile.Shard(tokenfile.pack([], [], 0, 5))
    assert list(s.documents()) == []


def test_plain_parts_are_never_odd():
    parts = ["", "\n", "a", "\na", "a b", "\n\ta", "a\t", "é", "aé", "a\x85", "\u2003a", "\x1ca", "a\u00a0", "中", "\n.", "x\x85y", "~!", "\n!x~"]
    plain = pc.match_substring_regex(pa.array(parts), tokenfile.PLAIN).to_pylist()
    assert [p for p, x in zip(parts, plain) if x] == ["a", "\na", "a b", "\n.", "x\x85y", "~!", "\n!x~"]
    assert not any(tokenfile.Encoder._odd(p) for p, x in zip(parts, plain) if x)


def test_query_over_all_documents(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op7_token_files(spark, SF)) == expected(rows)


def test_odd_rows(spark, monkeypatch):
    r = random.Random(3)
    words = ["a", "the", "  ", "\n", "\t\t ", "naïve", "'s", "12", "<|endoftext|>", "\x85", " ", "中文", "x" * 50]
    rows = [(None, "null id"), (5, None), (5, ""), (7, "same"), (7, "same"), (-3, "minus")] + [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)] + [(500, "long text " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _id", "2 AS shard").repartition(5)
    path = scratch(spark)
    tokenfile.write(df, path, FILE, shard_ids=500)
    assert got(tokenfile.read(spark, path)) == expected(rows)


def test_words_forgotten():
    e, t = tokenfile.Encoder(FILE), Tokenizer.from_file(FILE)
    tokenfile.WORDS_KEPT, kept = 5, tokenfile.WORDS_KEPT
    try:
        for text in ["one two three four", "five six one two", "seven eight nine ten eleven", "one  two\n three"] * 3:
            assert e.encode([text, text])[1].tolist() == t.encode(text, add_special_tokens=False).ids
    finally:
        tokenfile.WORDS_KEPT = kept


def test_empty_table(spark):
    path = scratch(spark)
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, FILE)
    assert tokenfile.read(spark, path).count() == 0
