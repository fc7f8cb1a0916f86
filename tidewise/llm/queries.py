"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise.llm.common import scratch, table

#: Fixed values of the URL query: host, path, verdict.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filters(spark, sf_dir):
    from tidewise.llm import urls

    rules = spark.createDataFrame(list(URL_RULES), urls.RULE_SCHEMA)
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op8_repeated_strings(spark, sf_dir):
    from tidewise.llm import suffix

    return suffix.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_id(spark, sf_dir):
    from tidewise.llm import langid

    docs = table(spark, sf_dir, "documents")
    learn = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull())
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(learn))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_mixing(spark, sf_dir):
    from tidewise.llm import mixing

    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP4_SQL = rf"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, row_number() OVER () AS rid,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE k = 1
"""

def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from tidewise.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id",), decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark, sf_dir):
    from tidewise.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_nearest_neighbours(spark, sf_dir):
    from tidewise.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op5_jaccard_join(spark, sf_dir):
    from tidewise.llm import jaccard

    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_fingerprints(spark, sf_dir):
    from tidewise.llm import fingerprint

    return fingerprint.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_files(spark, sf_dir):
    import public_tokenizers

    from tidewise.llm import tokenfile

    path = scratch(spark)
    tokenfile.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, path)


def op11_quality(spark, sf_dir):
    from tidewise.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    done = quality.score(docs, quality.fit(docs, labels))
    return done.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.PREDICT_FROM).cast("int").alias("predicted"))


def op12_manifest(spark, sf_dir):
    from tidewise.llm import manifest

    return manifest.documents(spark, sf_dir)


def op13_spelling(spark, sf_dir):
    from tidewise.llm import spelling

    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc": op2_warc,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_url_filters": op4_url_filters,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_repeated_strings": op8_repeated_strings,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_quality": op11_quality,
    "op12_manifest": op12_manifest,
    "op13_spelling": op13_spelling,
}
SQL = {"op4_url_filters": OP4_SQL}
