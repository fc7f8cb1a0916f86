"""Window functions, aggregations over series, alignment joins and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import features as X
from tidewise.operators import series as W
from tidewise.operators import stats as M
from tidewise.registry import query
from tidewise.sources import tables as S

WS = " WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
TICK = ("symbol",), ("ts", "event_id")


def frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, part: str = "symbol", order: str = "ts") -> str:
    f = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {f} = {n} THEN {agg}({x}) OVER {f} END"


@query(
    "moving_averages",
    "W3",
    "SELECT symbol, ts, " + ", ".join(f"{full('avg', 'close', n)} AS sma_{n}" for n in (10, 20, 50, 200)) + " FROM bars",
    r="sma_10:7 sma_20:7 sma_50:7 sma_200:7",
    dates="ts",
)
def moving_averages(spark, d):
    return X.moving_averages(S.bars(spark, d)).select("symbol", "ts", *[f"sma_{n}" for n in (10, 20, 50, 200)])


@query(
    "moving_averages_ticks",
    "W3 W4",
    f"""SELECT symbol, event_id, {full('avg', 'price', 20, order='ts, event_id')} AS sma_20,
        {full('stddev_samp', 'price', 20, order='ts, event_id')} AS std_20 FROM ticks""",
    r="sma_20 std_20",
)
def moving_averages_ticks(spark, d):
    t = S.ticks(spark, d)
    p = F.col("price")
    df = W.windowed(
        t,
        W.block_layout(t, *TICK),
        [lambda w: {"sma_20": W.sma(p, w, 20), "std_20": W.rolling_std(p, w, 20)}],
        back=20,
    )
    return df.select("symbol", "event_id", "sma_20", "std_20")


@query(
    "rolling_volatility",
    "W4",
    "SELECT symbol, ts, "
    + ", ".join(f"{full('stddev_samp', 'lr', n)} * sqrt(252) AS volatility_{n}d" for n in (21, 63, 252))
    + " FROM rets",
    r="volatility_21d volatility_63d volatility_252d",
    dates="ts",
)
def rolling_volatility(spark, d):
    return X.volatility(S.bars(spark, d)).select("symbol", "ts", *[f"volatility_{n}d" for n in (21, 63, 252)])


def _ema_sql(x: str, span: float) -> str:
    a = repr(2.0 / (span + 1.0))
    return f"list_reduce(list({x}) OVER (PARTITION BY symbol ORDER BY ts), lambda y, x: (1 - {a}) * y + {a} * x)"


@query(
    "exponential_means",
    "W5",
    f"SELECT symbol, ts, {_ema_sql('close', 10)} AS ema_10, {_ema_sql('close', 50)} AS ema_50 FROM bars",
    r="ema_10:3 ema_50:3",
    dates="ts",
)
def exponential_means(spark, d):
    return X.ema(S.bars(spark, d), spans=(10, 50)).select("symbol", "ts", "ema_10", "ema_50")


@query(
    "exponential_mean_adjusted",
    "W5",
    """WITH l AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 400 PRECEDING AND CURRENT ROW) AS v FROM bars)
       SELECT symbol, ts, list_sum(list_transform(v, lambda x, i: x * pow(11.0 / 13.0, len(v) - i)))
         / list_sum(list_transform(v, lambda x, i: pow(11.0 / 13.0, len(v) - i))) AS ema_12 FROM l""",
    r="ema_12:3",
    dates="ts",
)
def exponential_mean_adjusted(spark, d):
    return X.ema(S.bars(spark, d), spans=(12,), adjust=True).select("symbol", "ts", "ema_12")


@query(
    "exponential_mean_ticks",
    "W5",
    """SELECT symbol, event_id, list_reduce(list(price) OVER (PARTITION BY symbol ORDER BY ts, event_id),
         lambda y, x: (1 - 0.2) * y + 0.2 * x) AS ema_9 FROM ticks""",
    r="ema_9",
)
def exponential_mean_ticks(spark, d):
    t = S.ticks(spark, d)
    df = W.ewm(t, W.block_layout(t, *TICK), [("ema_9", "price", 9.0, False)])
    return df.select("symbol", "event_id", "ema_9")


def _rsi_sql(missing: str) -> str:
    return f"""WITH a AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars),
      b AS (SELECT symbol, ts, CASE WHEN d IS NULL THEN {missing} ELSE greatest(d, 0) END AS g,
              CASE WHEN d IS NULL THEN {missing} ELSE greatest(-d, 0) END AS l FROM a),
      c AS (SELECT symbol, ts, {full('avg', 'g', 14)} AS gm, {full('avg', 'l', 14)} AS lm FROM b)
      SELECT symbol, ts, CASE WHEN lm = 0 AND gm > 0 THEN 100.0 WHEN lm = 0 THEN NULL ELSE 100 - 100 / (1 + gm / lm) END AS rsi_14 FROM c"""


@query("rsi", "W6", _rsi_sql("0"), r="rsi_14", dates="ts")
def rsi(spark, d):
    return X.rsi(S.bars(spark, d)).select("symbol", "ts", "rsi_14")


@query("rsi_late_start", "W6", _rsi_sql("NULL"), r="rsi_14", dates="ts")
def rsi_late_start(spark, d):
    return X.rsi(S.bars(spark, d), first_delta=False).select("symbol", "ts", "rsi_14")


@query(
    "macd",
    "W7",
    f"""WITH m AS (SELECT symbol, ts, {_ema_sql('close', 12)} - {_ema_sql('close', 26)} AS macd FROM bars)
        SELECT symbol, ts, macd, {_ema_sql('macd', 9)} AS macd_signal FROM m""",
    r="macd:3 macd_signal:3",
    dates="ts",
)
def macd(spark, d):
    return X.macd(S.bars(spark, d)).select("symbol", "ts", "macd", "macd_signal")


@query(
    "bollinger",
    "W8",
    f"""WITH b AS (SELECT symbol, ts, {full('avg', 'close', 20)} AS m, {full('stddev_samp', 'close', 20)} AS s FROM bars)
        SELECT symbol, ts, m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / m AS bb_width FROM b""",
    r="bb_upper:3 bb_lower:3 bb_width",
    dates="ts",
)
def bollinger(spark, d):
    return X.bollinger(S.bars(spark, d)).select("symbol", "ts", "bb_upper", "bb_lower", "bb_width")


@query(
    "growth_and_drawdown",
    "W9 A8",
    """WITH g AS (SELECT symbol, ts, product(1 + r) OVER w AS growth FROM rets WHERE r IS NOT NULL"""
    + WS
    + """), p AS (SELECT symbol, ts, growth, growth / max(growth) OVER w - 1 AS drawdown FROM g"""
    + WS
    + """) SELECT * FROM p""",
    r="growth drawdown",
    dates="ts",
)
def growth_and_drawdown(spark, d):
    r = X.returns(S.bars(spark, d)).filter(F.col("r").isNotNull())
    return W.drawdown(W.growth(r, W.DAILY), W.DAILY).select("symbol", "ts", "growth", "drawdown")


@query(
    "growth_ticks",
    "W9",
    """WITH g AS (SELECT symbol, ts, event_id, product(1 + price / 10000) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS growth FROM ticks)
       SELECT symbol, event_id, growth, max(growth) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS peak FROM g""",
    r="growth:3 peak:3",
)
def growth_ticks(spark, d):
    t = S.ticks(spark, d).withColumn("r", F.col("price") / 10000)
    layout = W.block_layout(t, *TICK)
    g = W.growth(t, layout)
    return W.running(g, layout, {"peak": ("max", F.col("growth"))}).select("symbol", "event_id", "growth", "peak")


@query(
    "atr",
    "W10",
    f"""WITH t AS (SELECT symbol, ts, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {WS})
        SELECT symbol, ts, {full('avg', 'tr', 14)} AS atr_14 FROM t""",
    r="atr_14:3",
    dates="ts",
)
def atr(spark, d):
    return X.atr(S.bars(spark, d)).select("symbol", "ts", "atr_14")


_GAPPY = """SELECT symbol, ts, CASE WHEN volume > 1 THEN close END AS v FROM bars"""


@query(
    "forward_fill",
    "W11",
    f"""SELECT symbol, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v
        FROM ({_GAPPY})""",
    dates="ts",
)
def forward_fill(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", F.when(F.col("volume") > 1, F.col("close")).alias("v"))
    return W.fill(b, W.DAILY, ["v"])


@query(
    "forward_backward_fill",
    "W11",
    f"""WITH f AS (SELECT symbol, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v
        FROM ({_GAPPY}))
        SELECT symbol, ts, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM f""",
    dates="ts",
)
def forward_backward_fill(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", F.when(F.col("volume") > 1, F.col("close")).alias("v"))
    return W.fill(b, W.DAILY, ["v"], back=True)


@query(
    "forward_fill_ticks",
    "W11",
    """SELECT symbol, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v
       FROM (SELECT symbol, ts, event_id, CASE WHEN price > 60 THEN price END AS v FROM ticks)""",
)
def forward_fill_ticks(spark, d):
    t = S.ticks(spark, d).withColumn("v", F.when(F.col("price") > 60, F.col("price")))
    return W.fill(t, W.block_layout(t, *TICK), ["v"]).select("symbol", "event_id", "v")


@query(
    "volume_ratio",
    "W12",
    f"""WITH v AS (SELECT symbol, ts, volume, {full('avg', 'volume', 20)} AS m FROM bars)
        SELECT symbol, ts, m AS volume_sma_20, volume / m AS volume_ratio FROM v""",
    r="volume_sma_20 volume_ratio",
    dates="ts",
)
def volume_ratio(spark, d):
    return X.volume_ratio(S.bars(spark, d)).select("symbol", "ts", "volume_sma_20", "volume_ratio")


@query(
    "time_split",
    "W13",
    """WITH n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
       SELECT symbol, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first_day, max(ts) AS last_day
       FROM n GROUP BY 1, 2""",
    dates="first_day last_day",
)
def time_split(spark, d):
    s = W.split_by_time(S.bars(spark, d), W.DAILY, 0.8)
    return s.groupBy("symbol", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_day"), F.max("ts").alias("last_day")
    )


@query(
    "time_split_ticks",
    "W13",
    """WITH n AS (SELECT symbol, event_id, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
       SELECT symbol, CASE WHEN i <= floor(n * 0.85) THEN 'train' ELSE 'test' END AS part, count(*) AS n, max(event_id) AS last FROM n GROUP BY 1, 2""",
)
def time_split_ticks(spark, d):
    t = S.ticks(spark, d)
    s = W.split_by_time(t, W.block_layout(t, *TICK), 0.85)
    return s.groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


_STATE = """SELECT symbol, ts, CASE WHEN r > 0.5 THEN 'up' WHEN r < -0.3 THEN 'down' ELSE 'flat' END AS state FROM rets WHERE r IS NOT NULL"""


def _states(spark, d):
    r = F.col("r")
    state = F.when(r > 0.5, "up").when(r < -0.3, "down").otherwise("flat")
    return X.returns(S.bars(spark, d)).filter(r.isNotNull()).select("symbol", "ts", state.alias("state"))


@query(
    "state_runs",
    "W14",
    f"""WITH s AS ({_STATE}), g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts)
          - row_number() OVER (PARTITION BY symbol, state ORDER BY ts) AS g FROM s),
        runs AS (SELECT symbol, state, count(*) AS n FROM g GROUP BY symbol, state, g)
        SELECT symbol, state, count(*) AS runs, avg(n) AS mean_length, max(n) AS longest FROM runs GROUP BY 1, 2""",
    r="mean_length",
)
def state_runs(spark, d):
    runs = W.run_lengths(_states(spark, d), W.DAILY, "state")
    return runs.groupBy("symbol", "state").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("length").alias("mean_length"), F.max("length").alias("longest")
    )


@query(
    "transition_matrix",
    "A17",
    f"""WITH s AS ({_STATE}), m AS (SELECT lag(state) OVER (PARTITION BY symbol ORDER BY ts) AS from_state, state AS to_state FROM s),
        c AS (SELECT from_state, to_state, count(*) AS moves FROM m WHERE from_state IS NOT NULL GROUP BY 1, 2)
        SELECT *, moves / sum(moves) OVER (PARTITION BY from_state) AS probability FROM c""",
    r="probability",
)
def transition_matrix(spark, d):
    return W.transitions(_states(spark, d), W.DAILY, "state")


@query(
    "sequence_windows",
    "W15",
    """WITH l AS (SELECT symbol, ts, list(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v,
                    lead(lr, 5) OVER (PARTITION BY symbol ORDER BY ts) AS label FROM rets WHERE lr IS NOT NULL)
       SELECT symbol, ts, len(v) AS steps, v[1] AS first_value, v[60] AS last_value, label FROM l WHERE len(v) = 60 AND label IS NOT NULL""",
    r="first_value last_value label",
    dates="ts",
)
def sequence_windows(spark, d):
    r = X.returns(S.bars(spark, d)).filter(F.col("lr").isNotNull())
    s = W.sequences(r, W.DAILY, "lr", 60, 5)
    w = F.col("window")
    return s.select(
        "symbol", "ts", F.size(w).alias("steps"), w[0].alias("first_value"), w[59].alias("last_value"), "label"
    )


@query(
    "exponential_volatility",
    "W16 M4",
    """WITH l AS (SELECT symbol, ts, list(lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 500 PRECEDING AND CURRENT ROW) AS v FROM rets WHERE lr IS NOT NULL),
       w AS (SELECT *, list_transform(v, lambda x, i: pow(10.0 / 11.0, len(v) - i)) AS g FROM l),
       m AS (SELECT *, list_sum(g) AS s, list_sum(list_transform(g, lambda x: x * x)) AS s2, list_sum(list_transform(v, lambda x, i: x * g[i])) / list_sum(g) AS mean FROM w)
       SELECT symbol, ts, CASE WHEN len(v) > 1 THEN sqrt(list_sum(list_transform(v, lambda x, i: g[i] * (x - mean) * (x - mean))) / s * s * s / (s * s - s2)) * sqrt(252) END AS vol,
              v[len(v)] AS lr FROM m""",
    r="vol lr",
    dates="ts",
)
def exponential_volatility(spark, d):
    r = X.returns(S.bars(spark, d)).filter(F.col("lr").isNotNull()).select("symbol", "ts", "lr")
    v = W.ewm_std(r, W.DAILY, "lr", 21.0, "vol")
    return v.withColumn("vol", C.annual_volatility(F.col("vol")))


@query(
    "thinned_series",
    "W17",
    """WITH n AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
       SELECT symbol, ts, close FROM n WHERE i % greatest(1, n // 50) = 0""",
    dates="ts",
)
def thinned_series(spark, d):
    return W.every_kth(S.bars(spark, d), W.DAILY, 50).select("symbol", "ts", "close")


@query(
    "latest_rows",
    "W19",
    "SELECT symbol, max(ts) AS ts, arg_max(v, ts) AS v FROM (SELECT symbol, ts, CASE WHEN volume > 1 THEN close END AS v FROM bars) WHERE v IS NOT NULL GROUP BY 1",
    dates="ts",
)
def latest_rows(spark, d):
    b = S.bars(spark, d).select("symbol", "ts", F.when(F.col("volume") > 1, F.col("close")).alias("v"))
    return b.filter(F.col("v").isNotNull()).groupBy("symbol").agg(
        F.max("ts").alias("ts"), F.max_by("v", "ts").alias("v")
    )


@query(
    "lag_matrix",
    "W20",
    "SELECT * FROM (SELECT symbol, ts, lr AS y, lag(lr, 1) OVER w AS y1, lag(lr, 2) OVER w AS y2, lag(r, 1) OVER w AS x1, lag(r, 2) OVER w AS x2 FROM rets"
    + WS
    + ") WHERE y2 IS NOT NULL AND x2 IS NOT NULL",
    r="y y1 y2 x1 x2",
    dates="ts",
)
def lag_matrix(spark, d):
    r = X.returns(S.bars(spark, d)).withColumnRenamed("lr", "y")

    def stage(w):
        return {f"{v}{k}": F.lag(c, k).over(w) for v, c in (("y", "y"), ("x", "r")) for k in (1, 2)}

    df = W.windowed(r, W.DAILY, [stage], back=2)
    return df.select("symbol", "ts", "y", "y1", "y2", "x1", "x2").dropna(subset=["y2", "x2"])


@query(
    "day_change",
    "W21",
    "SELECT symbol, ts, coalesce(close - lag(close) OVER w, 0) AS day_change, coalesce((close - lag(close) OVER w) / lag(close) OVER w * 100, 0) AS day_change_pct FROM bars"
    + WS,
    r="day_change:4 day_change_pct",
    dates="ts",
)
def day_change(spark, d):
    prev = lambda w: F.lag("close").over(w)

    def stage(w):
        change = F.col("close") - prev(w)
        return {
            "day_change": F.coalesce(change, F.lit(0.0)),
            "day_change_pct": F.coalesce(F.try_divide(change, prev(w)) * 100, F.lit(0.0)),
        }

    return W.windowed(S.bars(spark, d), W.DAILY, [stage], back=1).select("symbol", "ts", "day_change", "day_change_pct")


# ---------------------------------------------------------------- aggregations over series


@query(
    "closes_wide",
    "A1",
    "SELECT ts, "
    + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in S.SEGMENT_ETF)
    + " FROM bars GROUP BY ts",
    dates="ts",
)
def closes_wide(spark, d):
    return S.bars(spark, d).groupBy("ts").pivot("symbol", list(S.SEGMENT_ETF)).agg(F.max_by("close", "ts"))


@query(
    "calendar_upsample",
    "A2",
    """WITH s AS (SELECT series, min(obs_date) AS lo, max(obs_date) AS hi FROM macro_named GROUP BY 1),
       g AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM s)
       SELECT g.series, g.ts, last_value(m.value IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS value
       FROM g LEFT JOIN macro_named m ON m.series = g.series AND m.obs_date = g.ts""",
    r="value",
    dates="ts",
)
def calendar_upsample(spark, d):
    m = S.macro_named(spark, d).withColumnRenamed("obs_date", "ts")
    return W.calendar_fill(m, "series", "ts", "value").select("series", "ts", "value")


_WIDE_R = (
    "SELECT ts, " + ", ".join(f"max(r) FILTER (symbol = '{s}') AS {s}" for s in S.SEGMENT_ETF) + " FROM rets GROUP BY ts"
)
_ALL_IN = " AND ".join(f"{s} IS NOT NULL" for s in S.SEGMENT_ETF)


@query(
    "mean_and_covariance",
    "A3",
    f"""WITH c AS (SELECT * FROM ({_WIDE_R}) WHERE {_ALL_IN}) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) * 252 AS cov, avg({a}) * 252 AS mean_a FROM c"
        for a in S.SEGMENT_ETF
        for b in S.SEGMENT_ETF
    ),
    r="cov mean_a",
)
def mean_and_covariance(spark, d):
    wide = X.returns_wide(X.returns(S.bars(spark, d)), "r", list(S.SEGMENT_ETF))
    names = list(S.SEGMENT_ETF)
    pairs = [(a, b) for a in names for b in names]
    return M.pairwise(
        wide.dropna(subset=names),
        pairs,
        {"cov": lambda a, b: F.covar_samp(a, b) * K.TRADING_DAYS, "mean_a": lambda a, b: F.avg(a) * K.TRADING_DAYS},
    )


@query(
    "correlation_matrix",
    "A4",
    f"""WITH c AS ({_WIDE_R}) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM c"
        for i, a in enumerate(S.SEGMENT_ETF)
        for b in list(S.SEGMENT_ETF)[i + 1 :]
    ),
    r="corr",
)
def correlation_matrix(spark, d):
    names = list(S.SEGMENT_ETF)
    return M.correlation(X.returns_wide(X.returns(S.bars(spark, d)), "r", names), M.pair_columns(names))


@query(
    "correlation_block",
    "A4",
    """SELECT 'l_' || a AS a, 'l_' || b AS b, corr, n FROM (
       SELECT 'quantity' AS a, 'extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr, count(*) AS n FROM lineitem
       UNION ALL SELECT 'quantity', 'tax', corr(l_quantity, l_tax), count(*) FROM lineitem
       UNION ALL SELECT 'discount', 'extendedprice', corr(l_discount, l_extendedprice), count(*) FROM lineitem
       UNION ALL SELECT 'discount', 'tax', corr(l_discount, l_tax), count(*) FROM lineitem)""",
    r="corr",
)
def correlation_block(spark, d):
    li = S.table(spark, d, "lineitem")
    return M.correlation(li, M.pair_columns(["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]))


@query(
    "embedding_covariance",
    "A3 A4",
    """WITH p AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings),
            x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM p)
       SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j, covar_samp(a.v, b.v) AS cov, count(*) AS n
       FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2""",
    r="cov:8",
)
def embedding_covariance(spark, d):
    return M.vector_covariance(S.table(spark, d, "embeddings"), "embedding", 64)


@query(
    "benchmark_summary",
    "A10",
    """SELECT symbol, arg_max(close, ts) AS current_price, (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) * 100 AS total_return,
              stddev_samp(r) * sqrt(252) * 100 AS volatility FROM rets GROUP BY 1""",
    r="total_return:4 volatility:4",
)
def benchmark_summary(spark, d):
    r = X.returns(S.bars(spark, d))
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    return r.groupBy("symbol").agg(
        last.alias("current_price"),
        ((last - first) / first * 100).alias("total_return"),
        (C.annual_volatility(F.stddev_samp("r")) * 100).alias("volatility"),
    )


@query(
    "benchmark_series",
    "A10",
    "SELECT symbol, ts, (close - first_value(close) OVER w) / first_value(close) OVER w * 100 AS return_pct FROM bars" + WS,
    r="return_pct",
    dates="ts",
)
def benchmark_series(spark, d):
    b = S.bars(spark, d)
    base = b.groupBy("symbol").agg(F.min_by("close", "ts").alias("base"))
    return b.join(base, "symbol").select(
        "symbol", "ts", ((F.col("close") - F.col("base")) / F.col("base") * 100).alias("return_pct")
    )


@query(
    "sector_performance",
    "A11",
    """SELECT symbol, sector_name AS name, arg_max(close, ts) AS price, arg_max(close, ts) - arg_min(close, ts) AS change,
              (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) * 100 AS change_percent, arg_max(volume, ts) AS volume
       FROM bars JOIN segment_dim USING (symbol) WHERE ts >= DATE '2001-08-01' - INTERVAL 90 DAY GROUP BY 1, 2""",
    r="price:2 change:4 change_percent:4",
)
def sector_performance(spark, d):
    return X.sector_performance(S.sector_bars(spark, d), "2001-08-01", "3M")


@query(
    "forecast_error",
    "A22",
    """WITH f AS (SELECT symbol, close, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f FROM bars)
       SELECT symbol, sqrt(avg((close - f) * (close - f))) AS rmse, avg(abs(close - f)) AS mae, avg(close - f) AS residual_mean,
              stddev_samp(close - f) AS residual_std FROM f WHERE f IS NOT NULL GROUP BY 1""",
    r="rmse:3 mae:3 residual_mean:3 residual_std:3",
)
def forecast_error(spark, d):
    df = W.windowed(
        S.bars(spark, d), W.DAILY, [lambda w: {"forecast": F.avg("close").over(w.rowsBetween(-5, -1))}], back=5
    )
    return M.forecast_error(df, ["symbol"], "close", "forecast")


@query("training_fingerprint", "A24")
def training_fingerprint(spark, d):
    return M.fingerprint(S.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])


@query(
    "sample_quantiles",
    "A25",
    """SELECT symbol, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.75) AS q75, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi
       FROM rets WHERE r IS NOT NULL GROUP BY 1""",
    r="q25 q75 lo hi",
)
def sample_quantiles(spark, d):
    r = X.returns(S.bars(spark, d))
    q = F.percentile("r", F.array(*[F.lit(p) for p in (0.25, 0.75, 0.025, 0.975)]))
    out = r.groupBy("symbol").agg(q.alias("q"))
    return out.select("symbol", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q75", "lo", "hi"))])


@query(
    "exact_quantiles_raw",
    "A25",
    """SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.975) AS hi
       FROM events GROUP BY 1""",
    r="q25 median hi",
)
def exact_quantiles_raw(spark, d):
    ev = S.table(spark, d, "events").select("event_type", "value")
    return M.exact_quantiles(ev, ["event_type"], "value", {"q25": 0.25, "median": 0.5, "hi": 0.975})


@query(
    "entropies",
    "A26",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS m FROM lineitem GROUP BY 1, 2),
       t AS (SELECT sum(m) AS n FROM c),
       j AS (SELECT -sum(m / n * log2(m / n + 1e-10)) AS h FROM c, t),
       bb AS (SELECT b, sum(m) AS m FROM c GROUP BY 1),
       hb AS (SELECT -sum(m / n * log2(m / n + 1e-10)) AS h FROM bb, t)
       SELECT 'all' AS grp, j.h AS joint, hb.h AS marginal, j.h - hb.h AS conditional FROM j, hb""",
    r="joint marginal conditional",
)
def entropies(spark, d):
    li = S.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    joint = M.entropy(li, [], ["l_returnflag", "l_linestatus"], "joint")
    marginal = M.entropy(li, [], ["l_linestatus"], "marginal")
    return joint.join(marginal, "grp").withColumn("conditional", F.col("joint") - F.col("marginal"))


@query(
    "cross_section_mean",
    "A27",
    "SELECT ts, avg(r) AS mean_r, count(r) AS n FROM rets GROUP BY ts HAVING count(r) > 0",
    r="mean_r",
    dates="ts",
)
def cross_section_mean(spark, d):
    r = X.returns(S.bars(spark, d))
    return r.filter(F.col("r").isNotNull()).groupBy("ts").agg(F.avg("r").alias("mean_r"), F.count("r").alias("n"))


# ---------------------------------------------------------------- alignment


@query(
    "outer_alignment",
    "J1",
    """WITH s AS (SELECT ts, avg(close) AS sector FROM bars GROUP BY 1), m AS (SELECT obs_date AS ts, FEDFUNDS AS macro FROM macro_wide),
            k AS (SELECT ts, value AS vix FROM market WHERE series = 'VIX')
       SELECT coalesce(s.ts, m.ts, k.ts) AS ts, sector, macro, vix FROM s FULL JOIN m ON s.ts = m.ts FULL JOIN k ON k.ts = coalesce(s.ts, m.ts)""",
    r="sector:7 macro vix:8",
    dates="ts",
)
def outer_alignment(spark, d):
    s = S.bars(spark, d).groupBy("ts").agg(F.avg("close").alias("sector"))
    m = S.macro(spark, d).filter(F.col("series_id") == "FEDFUNDS").select(F.col("obs_date").alias("ts"), F.col("value").alias("macro"))
    k = S.market(spark, d).filter(F.col("series") == "VIX").select("ts", F.col("value").alias("vix"))
    return s.join(m, "ts", "full_outer").join(k, "ts", "full_outer")


@query(
    "macro_as_of",
    "J2",
    """WITH m AS (SELECT series_id, obs_date, value FROM macro WHERE series_id = 'CPIAUCSL')
       SELECT b.symbol, b.ts, b.close, m.value, m.obs_date AS as_of FROM bars b ASOF LEFT JOIN m ON b.ts >= m.obs_date""",
    r="value",
    dates="ts as_of",
)
def macro_as_of(spark, d):
    m = S.macro(spark, d).filter(F.col("series_id") == "CPIAUCSL").select("obs_date", "value")
    return X.with_macro(S.bars(spark, d).select("symbol", "ts", "close"), m)


@query(
    "ticks_as_of_quotes",
    "J2",
    """WITH p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
            v AS (SELECT user_id, ts AS vts, value AS seen FROM events WHERE event_type = 'view')
       SELECT p.event_id, p.value, v.seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.vts""",
)
def ticks_as_of_quotes(spark, d):
    ev = S.table(spark, d, "events")
    p = ev.filter(F.col("event_type") == "purchase").select("user_id", "ts", "event_id", "value")
    v = ev.filter(F.col("event_type") == "view").select("user_id", F.col("ts").alias("vts"), F.col("value").alias("seen"))
    size = W.block_layout(ev, ("user_id",), ("ts",)).block
    return W.asof(p, v, ["user_id"], "ts", "vts", "seen", block=size).select("event_id", "value", "seen")


@query(
    "benchmark_by_position",
    "J8",
    """WITH a AS (SELECT row_number() OVER (ORDER BY ts) AS i, ts, close FROM bars WHERE symbol = 'BUILDING'),
            b AS (SELECT row_number() OVER (ORDER BY ts) AS i, close AS other FROM bars WHERE symbol = 'MACHINERY')
       SELECT a.i AS pos, a.ts, close / first_value(close) OVER (ORDER BY a.i) * 100 AS benchmark,
              other / first_value(other) OVER (ORDER BY a.i) * 100 AS portfolio FROM a LEFT JOIN b USING (i)""",
    r="benchmark portfolio",
    dates="ts",
)
def benchmark_by_position(spark, d):
    return X.by_position(S.bars(spark, d), "BUILDING", "MACHINERY")


# ---------------------------------------------------------------- feature matrix


def _feature_sql() -> dict[str, str]:
    cols = []
    for s in X.SECTORS:
        for n in (1, 5, 21):
            cols.append((f"{s}_Return_{n}d", f"SELECT ts, v{n} AS value FROM sr WHERE sector_name = '{s}'"))
    for m in X.MACROS:
        for suffix, c in (("", "value"), ("_Change", "c1"), ("_Change_21d", "c21")):
            cols.append((f"{m}{suffix}", f"SELECT ts, {c} AS value FROM mc WHERE series = '{m}'"))
    for m in ("SP500", "VIX", "Treasury_10Y"):
        cols.append((m, f"SELECT ts, value FROM market WHERE series = '{m}'"))
    cols += [
        ("VIX_Change", "SELECT ts, chg AS value FROM kc WHERE series = 'VIX'"),
        ("VIX_MA_10", "SELECT ts, ma AS value FROM kc WHERE series = 'VIX'"),
        ("SP500_Return", "SELECT ts, lr AS value FROM kc WHERE series = 'SP500'"),
        ("SP500_Volatility_21d", "SELECT ts, vol AS value FROM kv WHERE series = 'SP500'"),
    ]
    long = " UNION ALL ".join(f"SELECT ts, '{n}' AS feature, value FROM ({q}) WHERE value IS NOT NULL" for n, q in cols)
    return f"""sr AS (SELECT sector_name, ts, {', '.join(f'ln(close / lag(close, {n}) OVER w) AS v{n}' for n in (1, 5, 21))}
          FROM bars JOIN segment_dim USING (symbol) {WS}),
      ms AS (SELECT series, min(obs_date) AS lo, max(obs_date) AS hi FROM macro_named GROUP BY 1),
      mg AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ts FROM ms),
      md AS (SELECT mg.series, mg.ts, last_value(m.value IGNORE NULLS) OVER (PARTITION BY mg.series ORDER BY mg.ts ROWS UNBOUNDED PRECEDING) AS value
          FROM mg LEFT JOIN macro_named m ON m.series = mg.series AND m.obs_date = mg.ts),
      mc AS (SELECT series, ts, value, value / lag(value) OVER w - 1 AS c1, value / lag(value, 21) OVER w - 1 AS c21 FROM md
          WINDOW w AS (PARTITION BY series ORDER BY ts)),
      kc AS (SELECT series, ts, value, value / nullif(lag(value) OVER w, 0) - 1 AS chg, {full('avg', 'value', 10, 'series')} AS ma,
          ln(value / nullif(lag(value) OVER w, 0)) AS lr FROM market WINDOW w AS (PARTITION BY series ORDER BY ts)),
      kv AS (SELECT series, ts, {full('stddev_samp', 'lr', 21, 'series')} * sqrt(252) AS vol FROM kc WHERE series = 'SP500'),
      lf AS ({long})"""


def matrix_sql(back_fill: bool = False, anchor: bool = True) -> str:
    """CTEs that end in ``fm``, the wide feature matrix."""
    back = (
        ", first_value(value IGNORE NULLS) OVER (PARTITION BY feature ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        if back_fill
        else ""
    )
    wide = ", ".join(f"max(value) FILTER (feature = '{f}') AS {f}" for f in X.FEATURES)
    whole = " AND ".join(f"{f} IS NOT NULL" for f in X.FEATURES)
    on = "WHERE ts IN (SELECT ts FROM market WHERE series = 'SP500')" if anchor else ""
    return f"""{_feature_sql()},
      fg AS (SELECT d.ts, f.feature, lf.value FROM (SELECT DISTINCT ts FROM lf) d CROSS JOIN (SELECT DISTINCT feature FROM lf) f
             LEFT JOIN lf ON lf.ts = d.ts AND lf.feature = f.feature),
      ff AS (SELECT ts, feature, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY feature ORDER BY ts ROWS UNBOUNDED PRECEDING){back}) AS value FROM fg),
      fw AS (SELECT ts, {wide} FROM ff {on} GROUP BY ts),
      fm AS (SELECT * FROM fw WHERE {whole})"""


R = " ".join(f"{f}:{10 if f in ('SP500', 'Treasury_10Y') else 7}" for f in X.FEATURES)


@query("feature_matrix", "P14 F1 J1 J2 W11", f"WITH {matrix_sql()} SELECT * FROM fm", r=R, dates="ts")
def feature_matrix(spark, d):
    return X.feature_matrix(spark, d)


@query(
    "feature_matrix_outer",
    "J1 W11",
    f"WITH {matrix_sql(back_fill=True, anchor=False)} SELECT * FROM fm",
    r=R,
    dates="ts",
)
def feature_matrix_outer(spark, d):
    return X.feature_matrix(spark, d, anchor=None, back_fill=True)


_TARGET = [f for f in X.FEATURES if "Technology" in f]


@query(
    "training_set",
    "M10 F3 W2 P14 F2",
    f"""WITH {matrix_sql()}, n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n,
          lead(Technology_Return_1d, 21) OVER (ORDER BY ts) AS label FROM fm)
        SELECT * EXCLUDE (n, {', '.join(_TARGET)}) FROM n WHERE pos >= n - 1260 AND label IS NOT NULL""",
    r=" ".join(x for x in R.split() if "Technology" not in x) + " label",
    dates="ts",
)
def training_set(spark, d):
    return X.training_set(X.feature_matrix(spark, d), "Technology")


@query("technical_table", "W3 W5 W6 W7 W8 W10 W12 P3")
def technical_table(spark, d):
    return X.technical_indicators(S.bars(spark, d))
