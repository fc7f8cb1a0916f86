"""Corpus pipeline: language, near duplicates, repeated passages, mixture, tokens.

Every stage takes all documents that the stage before kept. All but the last return the columns of documents, whatever
these are; ``doc_id``, ``text``, ``lang``, ``source`` must be among them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm import bpe, jaccard, langid, mixing, suffix
from tidewise.llm.common import bit_map, may_be_in, stored, table

#: Documents of which less than this share speaks for any one language go. Clean ones in a known language score far above.
LEAST_SCORE = 0.3
#: Bits of the map of ids that near duplicates touch. Whatever passes it wrongly is dropped by a join.
ID_BITS = 1 << 24


def _packed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """Whole rows as one column, so that no name of theirs can clash, and the columns that an operator needs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: no text, no letter, or no language that stands out. It learns
    from documents with a language that aren't held out; where there are none, nothing can be rejected for its language."""
    net = langid.fit(docs.where(F.col("lang").isNotNull() & ~langid.held_out()))
    if not net.labels:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = _packed(docs, langid.told(net, F.col("text")).alias("told"))
    return found.where((F.col("told.lang_pred") != langid.UNKNOWN) & (F.col("told.score") >= LEAST_SCORE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join the one with the smallest id stays. Rows with one id and text count as one document;
    documents without an id stay, for they can't be told apart."""
    groups = stored(jaccard.join(docs.select("doc_id", "text")))
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("component_id") == F.col("doc_id")).alias("_first"), F.count("*").alias("_rows"))
    touched = stored(ids.where("NOT _first OR _rows > 1"))
    # Rows travel only if their id may be one of these.
    may = may_be_in(spark.sparkContext.broadcast(bit_map(touched, "doc_id", ID_BITS)), F.col("doc_id").cast("long"))
    rest = docs.where(~may)
    kept = docs.where(may).join(touched.where("NOT _first").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    again = touched.where("_first").select("doc_id")
    if again.isEmpty():
        return rest.unionByName(kept)
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return rest.unionByName(once).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that are there more than once are taken out of the texts; ``n_chars`` follows."""
    out = suffix.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    mixed = mixing.mix(_packed(docs, "doc_id", "text", "source"), keep=("row",))
    return mixed.where("_copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: byte-level BPE ids, and the digest of the bytes they decode to."""
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",), decoded=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: Learned models, grouping by links and rounding have no SQL; tests hold the stages against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
