"""Tables and the financial views that are derived from them.

Raw tables are Parquet under one folder. Every view below is a plain DataFrame: Catalyst prunes
columns and pushes filters to the scan. No side is hinted as broadcast: dimension tables may grow,
and Spark broadcasts by itself where the size it measures allows it.

Hot keys: the views group raw rows by (symbol, calendar period) with algebraic aggregates only, so
each map task folds its rows first and one row per (symbol, period) and task is shuffled. A symbol
with a third of all rows costs no more than any other. What comes out has at most one row per
symbol and period, i.e. a series of daily bars is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.session import values_table

# fixed values: market segment -> fund ticker of the sector that stands for it
SEGMENT_ETF = {
    "AUTOMOBILE": "XLK",
    "BUILDING": "XLV",
    "FURNITURE": "XLE",
    "HOUSEHOLD": "XLF",
    "MACHINERY": "XLI",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(df: DataFrame, keys: list[str], period, price, order, volume=None) -> DataFrame:
    """Rows -> open/high/low/close/volume per key and period. ``order`` must be unique in a group."""
    return df.groupBy(*keys, period.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        (F.count(F.lit(1)) if volume is None else F.sum(volume)).alias("volume"),
    )


def orders_by_segment(spark, sf_dir, start=None, end=None) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if start is not None:
        orders = orders.filter(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def bars(spark, sf_dir, start=None, end=None) -> DataFrame:
    """Daily bars per symbol: symbol = market segment, price = order value. Days in [start, end)."""
    df = orders_by_segment(spark, sf_dir, start, end).withColumnRenamed("c_mktsegment", "symbol")
    return ohlcv(df, ["symbol"], F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def ticks(spark, sf_dir) -> DataFrame:
    """Raw prices: one row per event, symbol = event type. Unbounded per symbol."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price")
    )


def bars_hourly(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    return ohlcv(t, ["symbol"], F.date_trunc("hour", "ts"), F.col("price"), F.struct("ts", "event_id"))


def macro(spark, sf_dir) -> DataFrame:
    """Monthly macro observations in long form (series_id, obs_date, value)."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("obs_date")).agg(
        (F.avg("l_discount") * 100).alias("FEDFUNDS"),
        (F.avg("l_tax") * 100).alias("CPIAUCSL"),
        F.sum("l_quantity").alias("GDP"),
        F.stddev_samp("l_quantity").alias("UNRATE"),
    )
    return wide.unpivot("obs_date", ["FEDFUNDS", "CPIAUCSL", "GDP", "UNRATE"], "series_id", "value").select(
        "series_id", "obs_date", "value"
    )


def macro_named(spark, sf_dir) -> DataFrame:
    names = values_table(spark, [("series_id", "string"), ("series", "string")], list(K.MACRO_SERIES.items()))
    return macro(spark, sf_dir).join(names, "series_id").select("series", "obs_date", "value")


def market(spark, sf_dir) -> DataFrame:
    """Daily market series in long form (series, ts, value). Days without a value have no row."""
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("ts"))
        .agg(
            (F.avg("o_totalprice") / 100).alias("SP500"),
            (F.stddev_samp("o_totalprice") / F.avg("o_totalprice") * 30).alias("VIX"),
            (F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))) / 60000).alias("Treasury_10Y"),
        )
    )
    return (
        daily.unpivot("ts", ["SP500", "VIX", "Treasury_10Y"], "series", "value")
        .filter(F.col("value").isNotNull())
        .select("series", "ts", "value")
    )


def sector_dim(spark) -> DataFrame:
    rows = [(i, etf, name, name.lower()) for i, (etf, name) in enumerate(K.SECTOR_ETFS.items())]
    return values_table(
        spark, [("ord", "int"), ("etf", "string"), ("sector_name", "string"), ("sector", "string")], rows
    )


def segment_dim(spark) -> DataFrame:
    rows = [(seg, etf, K.SECTOR_ETFS[etf], K.SECTOR_ETFS[etf].lower()) for seg, etf in SEGMENT_ETF.items()]
    return values_table(
        spark, [("symbol", "string"), ("etf", "string"), ("sector_name", "string"), ("sector", "string")], rows
    )


def sensitivity(spark) -> DataFrame:
    """Default coefficients in long form (sector, ord, factor, ford, coef)."""
    rows = [
        (s, i, f, j, c)
        for i, (s, cs) in enumerate(K.SENSITIVITY.items())
        for j, (f, c) in enumerate(zip(K.FACTORS, cs))
    ]
    return values_table(
        spark,
        [("sector", "string"), ("ord", "int"), ("factor", "string"), ("ford", "int"), ("coef", "double")],
        rows,
    )


def shocks(spark, sets: dict[str, dict[str, float]]) -> DataFrame:
    """Scenario shocks in long form (scenario, sord, pos, factor, change)."""
    rows = [(n, i, j, f, float(c)) for i, (n, fs) in enumerate(sets.items()) for j, (f, c) in enumerate(fs.items())]
    cols = [("scenario", "string"), ("sord", "int"), ("pos", "int"), ("factor", "string"), ("change", "double")]
    return values_table(spark, cols, rows)


def brand_etf(brand):
    """Brand number modulo the number of sector funds -> fund ticker."""
    etfs = F.array(*[F.lit(e) for e in K.SECTOR_ETFS])
    return F.element_at(etfs, (F.substring_index(brand, "#", -1).cast("int") % len(K.SECTOR_ETFS)) + 1)


def brand_lines(spark, sf_dir) -> DataFrame:
    """lineitem with its buyer and brand."""
    li = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey)


def fund_weights(spark, sf_dir) -> DataFrame:
    """Portfolio = customer, weight = share of its spend per sector fund (portfolio, etf, w)."""
    spend = (
        brand_lines(spark, sf_dir)
        .groupBy(F.col("o_custkey").alias("portfolio"), brand_etf(F.col("p_brand")).alias("etf"))
        .agg(F.sum("l_extendedprice").alias("spend"))
    )
    return spend.select("portfolio", "etf", share(F.col("spend")).alias("w"))


def nation_weights(spark, sf_dir) -> DataFrame:
    """Portfolio = nation, weight = share of its spend per segment (portfolio, symbol, w)."""
    spend = (
        orders_by_segment(spark, sf_dir)
        .groupBy(F.col("c_nationkey").alias("portfolio"), F.col("c_mktsegment").alias("symbol"))
        .agg(F.sum("o_totalprice").alias("spend"))
    )
    return spend.select("portfolio", "symbol", share(F.col("spend")).alias("w"))


def share(x):
    """Share of a portfolio's total; the rows are already one per portfolio and symbol."""
    return x / F.sum(x).over(Window.partitionBy("portfolio"))


TRADE_ORDER = (
    "ts",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "shares",
    "price",
    "l_discount",
    "l_tax",
    "side",
    "l_linestatus",
    "l_shipdate",
)


def trades(spark, sf_dir) -> DataFrame:
    """Paper trades of a portfolio (= customer). Whole rows are unique, so TRADE_ORDER is total."""
    return as_trades(brand_lines(spark, sf_dir))


def as_trades(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("o_custkey").alias("portfolio"),
        F.to_date("o_orderdate").alias("ts"),
        F.col("p_brand").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("shares"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_discount",
        "l_tax",
        "l_linestatus",
        "l_shipdate",
    )


def quotes(spark, sf_dir) -> DataFrame:
    """One quote per brand (symbol, name, price, previous_close, market_cap)."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("symbol"))
        .agg(
            F.min("p_name").alias("name"),
            F.max("p_retailprice").alias("price"),
            F.max(F.when(F.col("p_size") <= 25, F.col("p_retailprice"))).alias("previous_close"),
            F.sum(F.col("p_retailprice") * F.col("p_size")).alias("market_cap"),
        )
    )


def activities(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("event_type").alias("activity_type"),
        F.col("event_id").alias("activity_id"),
        F.col("ts").alias("created_at"),
        F.col("props").alias("activity_metadata"),
        F.col("value").alias("amount"),
    )


def sector_bars(spark, sf_dir, start=None, end=None) -> DataFrame:
    """Bars tagged with fund ticker and sector; the date range reaches the orders scan."""
    return bars(spark, sf_dir, start, end).join(segment_dim(spark), "symbol")


def registrations(spark, sf_dir) -> DataFrame:
    """Model registrations (seq, model_type, model_id, version, rmse, r2, activated): one per part."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.lower("p_type").alias("model_type"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_id"),
        F.col("p_brand").alias("version"),
        F.when(F.col("p_size") <= 40, F.abs(F.col("p_retailprice") - 950) / 100).alias("rmse"),
        F.when(F.col("p_size") >= 5, F.col("p_size") / 50.0).alias("r2"),
        (F.col("p_size") % 10 == 0).alias("activated"),
    )


def registry_documents(spark, sf_dir) -> DataFrame:
    """Registry documents as JSON text, one per supplier: even keys flat, odd keys nested by type."""
    types = F.array(*[F.lit(t) for t in ("causal", "treatment", "forecast", "regime")])
    s = table(spark, sf_dir, "supplier").select(
        F.element_at(types, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("type"),
        F.concat(F.lit("model_"), F.col("s_suppkey").cast("string")).alias("id"),
        F.col("s_name").alias("version"),
        F.col("s_acctbal").alias("rmse"),
        (F.col("s_suppkey") % 2 == 0).alias("is_flat"),
        (F.col("s_suppkey") % 3 == 0).alias("on"),
    )
    metrics = F.create_map(F.lit("rmse"), F.col("rmse").cast("string"), F.lit("note"), F.lit("n/a"))
    entry = F.create_map("id", F.struct("type", "version", metrics.alias("metrics")))
    active = F.create_map("type", F.when(F.col("on"), F.col("id")).otherwise("none")).alias("active_versions")
    return s.select(
        F.when(F.col("is_flat"), F.to_json(F.struct(entry.alias("models"), active)))
        .otherwise(F.to_json(F.struct(F.create_map("type", entry).alias("models"), active)))
        .alias("value")
    )


def region_graphs(spark, sf_dir) -> DataFrame:
    """One causal graph per region as JSON: nations point at their region. Bounded by the nations of a region."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    node = F.struct(F.col("n_name").alias("id"), F.col("n_name").alias("label"), F.lit("economic").alias("type"))
    edge = F.struct(
        F.col("n_name").alias("from"), F.col("r_name").alias("to"), (F.col("n_nationkey") / 10).alias("strength")
    )
    hub = F.struct(F.col("r_name").alias("id"), F.col("r_name").alias("label"), F.lit("outcome").alias("type"))
    g = j.groupBy("r_name").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    return g.select(
        F.col("r_name").alias("graph"),
        F.to_json(F.struct(F.array_append("nodes", hub).alias("nodes"), "edges")).alias("dag"),
    )


def to_factor(spark, effects: DataFrame, source: str) -> DataFrame:
    """Macro change column -> sensitivity factor; of two columns for one factor the later mapping wins."""
    rows = [(i, c, f) for i, (c, f) in enumerate(K.MACRO_TO_FACTOR)]
    m = values_table(spark, [("ford", "int"), (source, "string"), ("factor", "string")], rows)
    keep = [c for c in effects.columns if c not in (source, "sector")]
    keys = (["sector"] if "sector" in effects.columns else []) + ["factor"]
    j = effects.join(m, source)
    return j.groupBy(*keys).agg(*[F.max_by(c, "ford").alias(c) for c in (source, *keep)])


def what_ifs(spark, sf_dir) -> DataFrame:
    """What-if requests, one per customer: changes in percent (request, rates, inflation, gdp)."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request"),
        (F.col("c_custkey") % 7 - 3).cast("double").alias("rates"),
        (F.col("c_nationkey") % 5 - 2).cast("double").alias("inflation"),
        (F.col("c_acctbal") / 2500 - 2).alias("gdp"),
    )
