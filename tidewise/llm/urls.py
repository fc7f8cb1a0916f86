"""URL filters by rule lists, in DataFrame functions only.

Every URL becomes the expressions that a rule could equal: host suffixes at label borders times path prefixes of the
lengths that occur in the rules. Expressions and rules meet on the first four bytes of a SHA-256 digest; the full digest
confirms, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.common import lower_ascii

RULE_SCHEMA = "host string, path string, verdict string"
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_lengths(rules: DataFrame) -> list[int]:
    """Distinct lengths of rule paths. At most as many numbers as the longest rule path has characters."""
    return sorted(r[0] for r in rules.select(F.length("path")).where("path IS NOT NULL").distinct().collect())


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Columns ``page_id, host, path, rule, verdict``, one row per input row.

    A rule fits its host and every subdomain when the path starts with the rule's path. The rule with most characters
    wins; among equals the longer host (two rules of equal length and host would be the same rule). Repeated rules with opposite verdicts block. No rule:
    ``rule`` is null and the verdict is ``default``. Null URLs, and those without ``://``, have an empty host and path;
    no rule fits them, nor an URL whose path is empty unless a rule's path is. Rules with a null part are ignored.
    Repeated pages and null ids stay as they are; other columns of ``pages`` are not looked at.
    """
    url = F.col("_url")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).select(
        F.monotonically_increasing_id().alias("_row"), "_id", host_of(url).alias("_host"), path_of(url).alias("_path")
    )
    lengths = rule_lengths(rules)
    ruled = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(lower_ascii(F.col("host")).alias("_r_host"), F.col("path").alias("_r_path"))
        .agg(F.max("verdict").alias("_verdict"))
        .withColumn("_r_full", _digest(F.col("_r_host"), F.col("_r_path")))
        .withColumn("_r_short", F.substring("_r_full", 1, PREFIX_HEX))
    )
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    prefixes = F.transform(fitting, lambda n: F.substr(F.col("_path"), F.lit(1), n))
    expressions = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), _digest(h, p).alias("d"))))
    )
    spread = base.select("_row", "_id", "_host", "_path", F.explode_outer(F.when(F.col("_host") != "", expressions)).alias("_e")).select(
        "_row", "_id", "_host", "_path", F.col("_e.d").alias("_full"), F.substring("_e.d", 1, PREFIX_HEX).alias("_short")
    )
    found = spread.join(ruled, (F.col("_short") == F.col("_r_short")) & (F.col("_full") == F.col("_r_full")), "left")
    text = F.concat("_r_host", "_r_path")
    order = F.when(
        F.col("_r_full").isNotNull(),
        F.struct(F.length(text).alias("n"), F.length("_r_host").alias("h"), text.alias("t"), F.col("_verdict").alias("v")),
    )
    best = found.groupBy("_row", "_id", "_host", "_path").agg(F.max(order).alias("_best"))
    return best.select(
        F.col("_id").alias("page_id"),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.t").alias("rule"),
        F.coalesce("_best.v", F.lit(default)).alias("verdict"),
    )
