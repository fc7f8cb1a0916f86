"""Market lists, summaries and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.session import checkpointed


def top(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows in a total order with their place.

    Each task keeps its own first n rows (take-ordered); only those are ranked, so the ranking window
    never holds more than n rows.
    """
    first = df.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def ranked(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """All rows with their place in a total order. Slices of the order are numbered on their own and then shifted."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id()))
    size = cut.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    start = size.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    numbered = cut.withColumn("_k", place).join(start, "_slice")
    return numbered.withColumn("place", F.col("_k") + F.col("_start")).drop("_slice", "_k", "_start")


def search(quotes: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Instruments whose symbol or name contains the text; exact symbol first, then market value."""
    up, low = text.upper(), text.lower()
    hits = quotes.filter(F.upper("symbol").contains(up) | F.lower("name").contains(low))
    return top(hits, [F.when(F.col("symbol") == up, 0).otherwise(1), F.desc("market_cap"), "symbol"], limit)


def user_summary(users: DataFrame, portfolios: DataFrame, portfolio: str, metric: str) -> DataFrame:
    """Every user with the number of portfolios and the sum of a metric; missing metrics count zero."""
    j = users.join(portfolios, "user_id", "left")
    value = F.when(F.col(metric) > 0, F.col(metric))
    return j.groupBy("user_id").agg(
        F.count(portfolio).alias("portfolio_count"), F.coalesce(F.sum(value), F.lit(0.0)).alias("expected")
    )


def distinct_in_order(df: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct names with the place where each was seen first."""
    return df.groupBy(name).agg(F.min(order).alias("first_seen"))


def condition(vix: Column, sp500_change: Column) -> dict[str, Column]:
    """Market score from volatility level and index direction, its state and the supporting factors."""
    level = F.when(vix < 15, 2).when(vix < 20, 1).when(vix < 30, -1).otherwise(-2)
    score = level + F.when(sp500_change > 0, 1).otherwise(-1)
    words = (
        F.when(vix < 15, "Low volatility (VIX < 15)")
        .when(vix < 20, "Normal volatility")
        .when(vix < 30, "Elevated volatility")
        .otherwise("High fear (VIX > 30)")
    )
    trend = F.when(sp500_change > 0, "S&P 500 positive").otherwise("S&P 500 negative")
    return {
        "score": score,
        "state": F.when(score >= 2, "bullish").when(score <= -2, "bearish").otherwise("neutral"),
        "factors": F.array_join(F.array(words, trend), "; "),
    }


# ---------------------------------------------------------------- registry


def registry_summary(models: DataFrame) -> DataFrame:
    """Count and span of registrations per type. Listing the ids is ``models.filter(...)``, not an array."""
    return models.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def best_models(models: DataFrame, metric: str, higher: bool) -> DataFrame:
    """Best model of each type by a metric; models without it are skipped, the first of equals wins."""
    has = models.filter(F.col(metric).isNotNull())
    pick = (
        F.max_by("model_id", F.struct(metric, -F.col("seq"))) if higher else F.min_by("model_id", F.struct(metric, "seq"))
    )
    return has.groupBy("model_type").agg(pick.alias(f"best_{metric}"))


def active_models(models: DataFrame) -> DataFrame:
    """The model activated last in each type."""
    on = models.filter("activated").groupBy("model_type")
    return on.agg(F.max_by("model_id", "seq").alias("model_id"), F.max_by("version", "seq").alias("version"))


def snapshot(series: DataFrame) -> DataFrame:
    """Latest value of each series, its change in percent and direction."""
    from tidewise.operators import series as W

    def stage(w):
        return {"chg": W.simple_return(F.col("value"), w) * 100}

    df = W.windowed(series, W.Layout(("series",), ("ts",)), [stage], back=1)
    last = F.max_by("chg", "ts")
    return df.groupBy("series").agg(
        F.max("ts").alias("ts"),
        F.max_by("value", "ts").alias("value"),
        last.alias("change"),
        F.when(last.isNull(), "neutral").when(last > 0, "up").otherwise("down").alias("trend"),
    )
