"""Sources, sinks and schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewise.operators import features as X
from tidewise.registry import query
from tidewise.session import scratch_dir
from tidewise.sources import jsoncols as J
from tidewise.sources import lake as L
from tidewise.sources import tables as S


@query(
    "sector_bars_scan",
    "S1 J3",
    """SELECT symbol, etf, sector, ts, open, high, low, close, volume FROM bars JOIN segment_dim USING (symbol)
       WHERE ts >= DATE '1996-01-01' AND ts < DATE '1999-01-01'""",
    dates="ts",
)
def sector_bars_scan(spark, d):
    df = S.sector_bars(spark, d, "1996-01-01", "1999-01-01")
    return df.select("symbol", "etf", "sector", "ts", "open", "high", "low", "close", "volume")


@query(
    "market_wide",
    "S2",
    """SELECT a.ts, a.value AS SP500, v.value AS VIX, t.value AS Treasury_10Y
       FROM (SELECT ts, value FROM market WHERE series = 'SP500') a
       LEFT JOIN (SELECT ts, value FROM market WHERE series = 'VIX') v ON a.ts = v.ts
       LEFT JOIN (SELECT ts, value FROM market WHERE series = 'Treasury_10Y') t ON a.ts = t.ts""",
    r="SP500:8 VIX:8 Treasury_10Y:10",
    dates="ts",
)
def market_wide(spark, d):
    return X.wide_by_anchor(S.market(spark, d), "ts", ["SP500", "VIX", "Treasury_10Y"], "SP500")


@query(
    "macro_wide_named",
    "S3 A1",
    """SELECT obs_date, Fed_Funds_Rate, CPI, GDP, Unemployment_Rate FROM (
         SELECT obs_date, max(value) FILTER (series = 'Fed_Funds_Rate') AS Fed_Funds_Rate,
           max(value) FILTER (series = 'CPI') AS CPI, max(value) FILTER (series = 'GDP') AS GDP,
           max(value) FILTER (series = 'Unemployment_Rate') AS Unemployment_Rate
         FROM macro_named GROUP BY obs_date) WHERE Fed_Funds_Rate IS NOT NULL""",
    r="Fed_Funds_Rate CPI GDP:2 Unemployment_Rate",
    dates="obs_date",
)
def macro_wide_named(spark, d):
    names = ["Fed_Funds_Rate", "CPI", "GDP", "Unemployment_Rate"]
    return X.wide_by_anchor(S.macro_named(spark, d), "obs_date", names, "Fed_Funds_Rate")


@query("save_and_load", "S4 S5", "SELECT symbol, ts, close, volume FROM bars", dates="ts")
def save_and_load(spark, d):
    lake = L.Lake(spark, scratch_dir(spark, "lake"))
    lake.save(S.bars(spark, d).select("symbol", "ts", "close", "volume"), "bars")
    missing = lake.load("no_such_table")
    assert missing is None
    return lake.load("bars")


@query(
    "materialise_once",
    "S10",
    "SELECT symbol, count(*) AS n FROM bars GROUP BY symbol",
)
def materialise_once(spark, d):
    lake = L.Lake(spark, scratch_dir(spark, "lake"))
    lake.once("bars", lambda: S.bars(spark, d))
    again = lake.once("bars", lambda: spark.range(0).toDF("never"))
    return again.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


#: Tables of the folder, for the oracle; the queries list the folder itself.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("data_info", "S6")
def data_info(spark, d):
    info = L.file_info(spark, d)
    return L.shapes(spark, d).join(info, "name").withColumn("modified", F.col("modified").cast("string"))


@query(
    "table_shapes",
    "S6",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS "rows", (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS "columns\""""
        for t in TABLES
    ),
)
def table_shapes(spark, d):
    return L.shapes(spark, d)


@query(
    "history_daily",
    "S7",
    """SELECT symbol, ts, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low,
              round(close, 2) AS close, volume
       FROM bars WHERE ts >= DATE '2000-08-01' AND ts < DATE '2001-08-01'""",
    dates="ts",
)
def history_daily(spark, d):
    return X.history(S.bars(spark, d, "2000-08-01", "2001-08-01"), "day")


@query(
    "history_weekly",
    "S7",
    """SELECT symbol, CAST(date_trunc('week', b.ts) AS DATE) AS ts, arg_min(open, b.ts) AS open, max(high) AS high,
              min(low) AS low, arg_max(close, b.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
       FROM bars b GROUP BY symbol, date_trunc('week', b.ts)""",
    r="open:2 high:2 low:2 close:2",
    dates="ts",
)
def history_weekly(spark, d):
    return X.history(S.bars(spark, d), "week")


@query(
    "history_monthly",
    "S7",
    """SELECT symbol, CAST(date_trunc('month', b.ts) AS DATE) AS ts, arg_min(open, b.ts) AS open, max(high) AS high,
              min(low) AS low, arg_max(close, b.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
       FROM bars b GROUP BY symbol, date_trunc('month', b.ts)""",
    r="open:2 high:2 low:2 close:2",
    dates="ts",
)
def history_monthly(spark, d):
    return X.history(S.bars(spark, d), "month")


@query("history_hourly", "S7", "SELECT * FROM bars_hourly", stamps="ts")
def history_hourly(spark, d):
    return S.bars_hourly(spark, d)


@query(
    "registry_documents",
    "S8",
    """SELECT ['causal', 'treatment', 'forecast', 'regime'][s_nationkey % 4 + 1] AS model_type,
              'model_' || s_suppkey AS model_id, s_name AS version, s_acctbal AS rmse, 1 AS n_metrics,
              s_suppkey % 3 = 0 AS is_active FROM supplier""",
)
def registry_documents(spark, d):
    m = J.parse_registry(S.registry_documents(spark, d), "value")
    return m.select(
        "model_type",
        "model_id",
        "version",
        F.col("metrics")["rmse"].alias("rmse"),
        F.size("metrics").alias("n_metrics"),
        "is_active",
    )


@query(
    "json_weights",
    "S9",
    """SELECT event_id AS portfolio, 'k' AS symbol,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS w FROM events WHERE json_extract(props, '$.k') IS NOT NULL""",
)
def json_weights(spark, d):
    ev = S.table(spark, d, "events").select(F.col("event_id").alias("portfolio"), "props")
    return J.explode_weights(ev, "props", ["portfolio"])


@query(
    "json_holdings",
    "S9",
    """SELECT o_orderkey AS portfolio, o_orderpriority AS symbol, CAST(o_custkey AS DOUBLE) AS shares,
              o_totalprice AS avg_cost FROM orders""",
)
def json_holdings(spark, d):
    o = S.table(spark, d, "orders")
    holding = F.struct(F.col("o_custkey").cast("double").alias("shares"), F.col("o_totalprice").alias("avg_cost"))
    docs = o.select(
        F.col("o_orderkey").alias("portfolio"),
        F.to_json(F.create_map("o_orderpriority", holding)).alias("holdings"),
    )
    return J.explode_holdings(docs, "holdings", ["portfolio"])


@query(
    "graph_from_json_nodes",
    "S11",
    """SELECT r_name AS graph, n_name AS id, 'economic' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT r_name, r_name, 'outcome' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
)
def graph_from_json_nodes(spark, d):
    return J.graph_nodes(S.region_graphs(spark, d), "dag", ["graph"]).select("graph", "id", "type")


@query(
    "graph_from_json_edges",
    "S11",
    """SELECT r_name AS graph, n_name AS src, r_name AS dst, n_nationkey / 10 AS strength
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
    r="strength",
)
def graph_from_json_edges(spark, d):
    return J.graph_edges(S.region_graphs(spark, d), "dag", ["graph"]).select("graph", "src", "dst", "strength")


@query(
    "instrument_union",
    "U1",
    """SELECT symbol, count(*) AS n, max(close) AS top FROM (
         SELECT symbol, close FROM bars UNION ALL SELECT symbol, close FROM bars_hourly) GROUP BY symbol""",
)
def instrument_union(spark, d):
    a = S.bars(spark, d).select("symbol", "close")
    b = S.bars_hourly(spark, d).select("symbol", "close")
    return a.unionByName(b).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("top"))
