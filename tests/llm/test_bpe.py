"""Byte-level BPE against tiktoken, token for token."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewise.llm import bpe, queries
from tidewise.llm.bpe import F

SF = "/root/testdata/sf0.001"
FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
SIGNS = "abcdehinorst THE  \n\t\x85\xa0 ​\x1c0123456789''''streéüñ中文字日本語한국어हिन्दी🎉👨‍👩‍👧.,;!?-_=+/"


def reference(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(name)), special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    v, ref, r = bpe.vocabulary(P.path(name), P.PATTERN), reference(name), random.Random(7)
    for i in range(1500):
        n = r.randint(0, 300)
        text = "".join(r.choice(SIGNS) for _ in range(n)) if i % 3 else r.choice(SIGNS) * n
        ids = v.encode(text)
        assert ids.tolist() == ref.encode_ordinary(text), repr(text)
        assert v.decode(ids.tolist()) == text.encode()


def test_small_memories_change_nothing(monkeypatch):
    v, ref = bpe.Vocabulary(bpe.read_ranks(P.path(FILES[0])), P.PATTERN), reference(FILES[0])
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 3)
    text = "Thereinthat andoftion the sthandre ouor. " * 20 + "unbelievability" * 50
    assert v.encode(text).tolist() == ref.encode_ordinary(text)


def test_query_over_all_documents(spark):
    ref = reference(FILES[0])
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d in docs:
        ids = ref.encode_ordinary(d.text or "")
        want[d.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, SF).collect()}
    assert got == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " " * 5000), (None, "x"), (3, "a b"), (3, "a b"), (4, "long" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("_id", F.lit(0))
    got = bpe.encode(df, P.path(FILES[0]), P.PATTERN, keep=("doc_id",), decoded=True)
    back = sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in got.collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    again = bpe.decode(got.select("doc_id", "ids"), P.path(FILES[0]), P.PATTERN, keep=("doc_id",))
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in again.collect()) == back
    assert bpe.encode(df.limit(0), P.path(FILES[0]), P.PATTERN).count() == 0
