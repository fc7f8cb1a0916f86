"""Projections, scalar functions, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import features as X
from tidewise.operators import ledger as L
from tidewise.operators import series as W
from tidewise.operators import stats as M
from tidewise.registry import query
from tidewise.sources import tables as S

WS = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def _lag_ratio(n: int, col: str = "close") -> str:
    return f"{col} / nullif(lag({col}, {n}) OVER w, 0)"


@query(
    "log_returns",
    "P1 W1",
    "SELECT symbol, ts, "
    + ", ".join(f"ln({_lag_ratio(n)}) AS return_{n}d" for n in K.RETURN_PERIODS)
    + f" FROM bars {WS}",
    r=" ".join(f"return_{n}d" for n in K.RETURN_PERIODS),
    dates="ts",
)
def log_returns(spark, d):
    return X.log_returns(S.bars(spark, d)).select("symbol", "ts", *[f"return_{n}d" for n in K.RETURN_PERIODS])


@query(
    "simple_returns",
    "P2",
    f"SELECT symbol, ts, {_lag_ratio(1)} - 1 AS r1, {_lag_ratio(21)} - 1 AS r21 FROM bars {WS}",
    r="r1 r21",
    dates="ts",
)
def simple_returns(spark, d):
    c = F.col("close")
    df = W.windowed(
        S.bars(spark, d), W.DAILY, [lambda w: {"r1": W.simple_return(c, w), "r21": W.simple_return(c, w, 21)}], back=21
    )
    return df.select("symbol", "ts", "r1", "r21")


@query(
    "simple_returns_ticks",
    "P2 P1 W1",
    """SELECT symbol, event_id, price / nullif(lag(price) OVER w, 0) - 1 AS r1,
              price / nullif(lag(price, 5) OVER w, 0) - 1 AS r5
       FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)""",
    r="r1 r5",
)
def simple_returns_ticks(spark, d):
    t = S.ticks(spark, d)
    p = F.col("price")
    layout = W.block_layout(t, ("symbol",), ("ts", "event_id"))
    df = W.windowed(t, layout, [lambda w: {"r1": W.simple_return(p, w), "r5": W.simple_return(p, w, 5)}], back=5)
    return df.select("symbol", "event_id", "r1", "r5")


@query(
    "momentum",
    "P3",
    f"SELECT symbol, ts, {', '.join(f'{_lag_ratio(n)} - 1 AS momentum_{n}' for n in (10, 20, 21))} FROM bars {WS}",
    r="momentum_10 momentum_20 momentum_21",
    dates="ts",
)
def momentum(spark, d):
    return X.momentum(S.bars(spark, d)).select("symbol", "ts", "momentum_10", "momentum_20", "momentum_21")


@query(
    "spread_and_inversion",
    "P4",
    """SELECT obs_date, FEDFUNDS - CPIAUCSL AS spread, CASE WHEN FEDFUNDS - CPIAUCSL < 0 THEN 1.0 ELSE 0.0 END AS inverted
       FROM macro_wide""",
    r="spread inverted",
    dates="obs_date",
)
def spread_and_inversion(spark, d):
    wide = X.wide_by_anchor(S.macro_named(spark, d), "obs_date", ["Fed_Funds_Rate", "CPI"])
    spread = F.col("Fed_Funds_Rate") - F.col("CPI")
    return wide.select("obs_date", spread.alias("spread"), (spread < 0).cast("double").alias("inverted"))


@query(
    "vix_buckets",
    "P5",
    """SELECT ts, value AS vix, CASE WHEN value > 0 AND value <= 15 THEN 0.0 WHEN value > 15 AND value <= 20 THEN 1.0
       WHEN value > 20 AND value <= 30 THEN 2.0 WHEN value > 30 AND value <= 100 THEN 3.0 END AS bucket
       FROM market WHERE series = 'VIX'""",
    r="vix:8 bucket",
    dates="ts",
)
def vix_buckets(spark, d):
    vix = S.market(spark, d).filter(F.col("series") == "VIX")
    return vix.select("ts", F.col("value").alias("vix"), C.bucketize(F.col("value"), [0, 15, 20, 30, 100]).alias("bucket"))


@query(
    "quantile_bins",
    "P6 A25",
    """WITH e AS (SELECT l_returnflag AS flag, quantile_cont(l_extendedprice, 0.2) AS q1, quantile_cont(l_extendedprice, 0.4) AS q2,
         quantile_cont(l_extendedprice, 0.6) AS q3, quantile_cont(l_extendedprice, 0.8) AS q4
         FROM lineitem GROUP BY 1)
       SELECT flag, (CASE WHEN l_extendedprice > q1 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > q2 THEN 1 ELSE 0 END
         + CASE WHEN l_extendedprice > q3 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > q4 THEN 1 ELSE 0 END) AS bin,
         count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
       FROM lineitem JOIN e ON flag = l_returnflag GROUP BY 1, 2""",
)
def quantile_bins(spark, d):
    li = S.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"))
    edges = M.exact_quantiles(li, ["flag"], "x", {"q1": 0.2, "q2": 0.4, "q3": 0.6, "q4": 0.8})
    binned = li.join(edges, "flag").withColumn("bin", C.quantile_bin(F.col("x"), F.array("q1", "q2", "q3", "q4")))
    return binned.groupBy("flag", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )


@query(
    "width_bins",
    "P7",
    """WITH e AS (SELECT symbol, min(price) AS lo, max(price) AS hi FROM ticks GROUP BY 1)
       SELECT symbol, CAST(least(9, greatest(0, ceil((price - lo) / ((hi - lo) / 10)) - 1)) AS INTEGER) AS bin, count(*) AS n
       FROM ticks JOIN e USING (symbol) GROUP BY 1, 2""",
)
def width_bins(spark, d):
    t = S.ticks(spark, d)
    e = t.groupBy("symbol").agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    b = C.width_bin(F.col("price"), F.col("lo"), F.col("hi"), 10)
    return t.join(e, "symbol").groupBy("symbol", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "finite_values",
    "P8",
    """SELECT p_brand, count(*) AS n, count(CASE WHEN p_size <> 25 THEN 1 END) AS finite,
              sum(CASE WHEN p_size <> 25 THEN p_retailprice / (p_size - 25) END) AS total FROM part GROUP BY 1""",
    r="total:4",
)
def finite_values(spark, d):
    p = S.table(spark, d, "part")
    # a zero base gives infinity, which counts as missing
    raw = F.when(F.col("p_size") == 25, F.lit(float("inf"))).otherwise(F.col("p_retailprice") / (F.col("p_size") - 25))
    x = p.select("p_brand", C.finite(raw).alias("x"))
    return x.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("finite"), F.sum("x").alias("total")
    )


@query(
    "clipped",
    "P9",
    """SELECT l_returnflag AS flag, sum(least(greatest(l_discount, 0.02), 0.08)) AS total,
              count(CASE WHEN l_discount < 0.02 OR l_discount > 0.08 THEN 1 END) AS moved FROM lineitem GROUP BY 1""",
    r="total:4",
)
def clipped(spark, d):
    x = F.col("l_discount")
    li = S.table(spark, d, "lineitem").select("l_returnflag", x, C.clip(x, 0.02, 0.08).alias("c"))
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.sum("c").alias("total"), F.count(F.when(F.col("c") != x, 1)).alias("moved")
    )


@query(
    "half_even_rounding",
    "P10",
    "SELECT l_discount * 100 AS pct, round_even(l_quantity / 4, 1) AS rounded, count(*) AS n FROM lineitem GROUP BY 1, 2",
    r="pct:4 rounded:4",
)
def half_even_rounding(spark, d):
    li = S.table(spark, d, "lineitem")
    return li.groupBy(
        (F.col("l_discount") * 100).alias("pct"), F.bround(F.col("l_quantity") / 4, 1).alias("rounded")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalised_names",
    "P11",
    """WITH n AS (SELECT p_name, translate(lower(p_name), ' -', '__') AS key FROM part)
       SELECT p_name, key, CASE key WHEN 'tech' THEN 'technology' ELSE key END AS outcome, count(*) AS n FROM n GROUP BY 1, 2""",
)
def normalised_names(spark, d):
    p = S.table(spark, d, "part")
    return p.groupBy(
        "p_name",
        C.normalise_name(F.col("p_name")).alias("key"),
        C.resolve_outcome(F.col("p_name")).alias("outcome"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("column_resolution", "P12")
def column_resolution(spark, d):
    m = X.feature_matrix(spark, d)
    wanted = ["interest_rates", "inflation", "vix", "technology", "SP500_Return", "gdp growth", "Treasury"]
    hits = [(n, C.find_column(m.columns, n)) for n in wanted]
    aggs = [F.struct(F.lit(n).alias("name"), F.lit(c).alias("column"), F.avg(c).alias("mean")) for n, c in hits if c]
    return m.agg(F.array(*aggs).alias("z")).select(F.inline("z"))


@query(
    "columns_by_suffix",
    "P13",
    """WITH m AS (SELECT sector_name || '_Return_1d' AS feature, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS v
                  FROM bars JOIN segment_dim USING (symbol))
       SELECT feature, count(v) AS n FROM m GROUP BY 1""",
)
def columns_by_suffix(spark, d):
    long = X.sector_features(S.sector_bars(spark, d))
    return long.filter(F.col("feature").endswith("_Return_1d")).groupBy("feature").agg(F.count("value").alias("n"))


@query(
    "target_columns_dropped",
    "P14",
    """WITH r AS (SELECT sector_name, ts, ln(close / lag(close, 1) OVER w) AS r1, ln(close / lag(close, 5) OVER w) AS r5,
                    ln(close / lag(close, 21) OVER w) AS r21 FROM bars JOIN segment_dim USING (symbol) """
    + WS
    + """)
       SELECT 'Healthcare' AS other, max(r5) FILTER (sector_name = 'Healthcare') AS top5,
              max(r1) FILTER (sector_name = 'Energy') AS top1 FROM r""",
    r="top5 top1",
)
def target_columns_dropped(spark, d):
    long = X.sector_features(S.sector_bars(spark, d))
    names = ["Technology_Return_1d", "Healthcare_Return_5d", "Energy_Return_1d"]
    wide = long.groupBy("ts").pivot("feature", names).agg(F.max("value"))
    kept = C.drop_target(wide, "Technology")
    assert "Technology_Return_1d" not in kept.columns
    return kept.agg(F.max("Healthcare_Return_5d").alias("top5"), F.max("Energy_Return_1d").alias("top1")).select(
        F.lit("Healthcare").alias("other"), "top5", "top1"
    )


@query(
    "effect_sentences",
    "P15",
    """WITH e AS (SELECT symbol, CAST(close - open AS DOUBLE) / 400000 AS effect, ts FROM bars)
       SELECT symbol, ts, 'A 1% increase in Interest Rates ' || CASE WHEN abs(effect) > 0.5 THEN 'significantly'
         WHEN abs(effect) > 0.2 THEN 'moderately' ELSE 'slightly' END || ' ' || CASE WHEN effect > 0 THEN 'increases'
         ELSE 'decreases' END || ' ' || upper(symbol[1]) || lower(symbol[2:]) || ' returns by ' ||
         printf('%.1f', round(abs(effect) * 100, 1)) || '%' AS sentence FROM e WHERE effect <> 0""",
    dates="ts",
)
def effect_sentences(spark, d):
    e = S.bars(spark, d).select("symbol", "ts", ((F.col("close") - F.col("open")) / 400000).alias("effect"))
    effect = F.col("effect")
    return e.filter(effect != 0).select(
        "symbol", "ts", C.effect_sentence(F.lit("interest_rates"), F.col("symbol"), effect).alias("sentence")
    )


@query(
    "sensitivity_levels",
    "P16",
    """WITH x AS (SELECT c_custkey, c_acctbal / 10000 AS s FROM customer)
       SELECT CASE WHEN abs(s) < 0.1 THEN 'Minimal' WHEN abs(s) < 0.3 THEN 'Low' WHEN abs(s) < 0.5 THEN 'Moderate'
         WHEN abs(s) < 0.7 THEN 'High' ELSE 'Very High' END AS level, count(*) AS n FROM x GROUP BY 1""",
)
def sensitivity_levels(spark, d):
    c = S.table(spark, d, "customer").select((F.col("c_acctbal") / 10000).alias("s"))
    return c.groupBy(C.sensitivity_level(F.col("s")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "annualised",
    "P17",
    "SELECT symbol, avg(lr) * 252 AS mean, stddev_samp(lr) * sqrt(252) AS vol FROM rets GROUP BY symbol",
    r="mean vol",
)
def annualised(spark, d):
    r = X.returns(S.bars(spark, d))
    return r.groupBy("symbol").agg(
        C.annual_return(F.avg("lr")).alias("mean"), C.annual_volatility(F.stddev_samp("lr")).alias("vol")
    )


@query(
    "macro_factor_map",
    "P18",
    """WITH m(ford, col, factor) AS (VALUES """
    + ", ".join(f"({i}, '{c}', '{f}')" for i, (c, f) in enumerate(K.MACRO_TO_FACTOR))
    + """), o AS (SELECT series || '_Change' AS col, count(*) AS n FROM macro_named GROUP BY 1),
       j AS (SELECT * FROM o JOIN m USING (col))
       SELECT factor, arg_max(col, ford) AS source, arg_max(n, ford) AS n FROM j GROUP BY 1""",
)
def macro_factor_map(spark, d):
    n = S.macro_named(spark, d).groupBy(F.concat("series", F.lit("_Change")).alias("source")).count()
    return S.to_factor(spark, n, "source").select("factor", "source", F.col("count").alias("n"))


@query(
    "rebased",
    "P19",
    "SELECT symbol, ts, 100 * close / first_value(close) OVER w AS idx FROM bars " + WS,
    r="idx",
    dates="ts",
)
def rebased(spark, d):
    b = S.bars(spark, d)
    base = b.groupBy("symbol").agg(F.min_by("close", "ts").alias("base"))
    return b.join(base, "symbol").select("symbol", "ts", (100 * F.col("close") / F.col("base")).alias("idx"))


@query(
    "standard_scaled",
    "P20",
    """WITH s AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS sd FROM bars GROUP BY symbol)
       SELECT symbol, ts, (close - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS z FROM bars JOIN s USING (symbol)""",
    r="z",
    dates="ts",
)
def standard_scaled(spark, d):
    b = S.bars(spark, d)
    s = b.groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("sd"))
    z = (F.col("close") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return b.join(s, "symbol").select("symbol", "ts", z.alias("z"))


@query(
    "what_if_confidence",
    "P21",
    """SELECT symbol, sector, s.coef * avg_r * 0.01 AS effect, least(0.95, 0.85 + abs(s.coef) * 0.1) AS confidence
       FROM (SELECT symbol, avg(r) AS avg_r FROM rets GROUP BY 1) JOIN segment_dim USING (symbol)
       JOIN (SELECT sector, coef FROM sensitivity WHERE factor = 'interest_rates') s USING (sector)""",
    r="effect:9 confidence",
)
def what_if_confidence(spark, d):
    r = X.returns(S.bars(spark, d)).groupBy("symbol").agg(F.avg("r").alias("avg_r"))
    coef = S.sensitivity(spark).filter(F.col("factor") == "interest_rates").select("sector", "coef")
    j = r.join(S.segment_dim(spark), "symbol").join(coef, "sector")
    return j.select(
        "symbol",
        "sector",
        C.what_if_effect(F.col("coef"), F.col("avg_r")).alias("effect"),
        C.confidence(F.col("coef")).alias("confidence"),
    )


@query(
    "dates_and_labels",
    "P22",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%b') AS month, count(*) AS n
       FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY 1, 2""",
)
def dates_and_labels(spark, d):
    o = S.table(spark, d, "orders")
    start = C.window_start("2001-08-01", "1Y")
    return (
        o.filter(F.col("o_orderdate") >= start)
        .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "MMM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "trade_costs",
    "P23",
    """SELECT symbol, side, count(*) AS n, sum(price * shares) AS cost, max(price * shares) AS top FROM trades GROUP BY 1, 2""",
    r="cost:2 top:2",
)
def trade_costs(spark, d):
    t = S.trades(spark, d).withColumn("cost", F.col("price") * F.col("shares"))
    return t.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.max("cost").alias("top")
    )


# ---------------------------------------------------------------- filters


@query(
    "complete_rows",
    "F1",
    "SELECT symbol, ts, lr FROM rets WHERE lr IS NOT NULL AND close IS NOT NULL",
    r="lr",
    dates="ts",
)
def complete_rows(spark, d):
    return X.returns(S.bars(spark, d)).dropna(subset=["lr", "close"]).select("symbol", "ts", "lr")


@query(
    "labelled_rows",
    "F2 W2",
    """SELECT symbol, ts, label FROM (SELECT symbol, ts, lead(lr, 21) OVER (PARTITION BY symbol ORDER BY ts) AS label FROM rets)
       WHERE label IS NOT NULL""",
    r="label",
    dates="ts",
)
def labelled_rows(spark, d):
    r = X.returns(S.bars(spark, d))
    df = W.windowed(r, W.DAILY, [lambda w: {"label": F.lead("lr", 21).over(w)}], ahead=21)
    return df.filter(F.col("label").isNotNull()).select("symbol", "ts", "label")


@query(
    "last_252_rows",
    "F3",
    """SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars)
       WHERE rn <= 252""",
    dates="ts",
)
def last_252_rows(spark, d):
    return W.last_rows(S.bars(spark, d), W.DAILY, 252).select("symbol", "ts", "close")


@query(
    "sample_guards",
    "F4",
    """SELECT op, symbol, n, CASE WHEN n >= need THEN 'ok' ELSE 'insufficient_data' END AS status
       FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1 UNION ALL SELECT symbol, count(*) FROM bars_hourly GROUP BY 1)
       CROSS JOIN (VALUES """
    + ", ".join(f"('{k}', {v})" for k, v in M.MIN_SAMPLES.items())
    + ") AS g(op, need)",
)
def sample_guards(spark, d):
    both = S.bars(spark, d).select("symbol").unionByName(S.bars_hourly(spark, d).select("symbol"))
    return M.sample_status(both, ["symbol"]).select("op", "symbol", "n", "status")


@query(
    "owner_filter",
    "F5",
    "SELECT c_nationkey AS owner, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 12 GROUP BY 1",
)
def owner_filter(spark, d):
    c = S.table(spark, d, "customer").filter((F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 12))
    return c.groupBy(F.col("c_nationkey").alias("owner")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "varying_columns",
    "F7",
    """SELECT 'l_discount' AS "column", stddev_samp(l_discount) AS std FROM lineitem
       UNION ALL SELECT 'l_quantity', stddev_samp(l_quantity) FROM lineitem
       UNION ALL SELECT 'l_tax', stddev_samp(l_tax) FROM lineitem""",
    r="std",
)
def varying_columns(spark, d):
    li = S.table(spark, d, "lineitem").withColumn("flat", F.lit(1.0))
    return M.varying_columns(li, ["l_quantity", "l_discount", "l_tax", "flat"])


@query(
    "trade_validation",
    "F8",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = '' THEN 'symbol_required'
         WHEN event_type NOT IN ('purchase', 'view') THEN 'bad_action' WHEN value <= 20 THEN 'bad_shares' ELSE 'ok' END AS reason
         FROM events) GROUP BY 1""",
)
def trade_validation(spark, d):
    ev = S.table(spark, d, "events")
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "view", "sell").otherwise("hold")
    reason = L.trade_reason(F.col("event_type"), side, F.col("value") - 20)
    return ev.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "deposit_validation",
    "F8",
    """SELECT CASE WHEN c_acctbal <= 0 THEN 'not_positive' WHEN c_acctbal * 120 > 1000000 THEN 'above_maximum' ELSE 'ok' END AS reason,
       count(*) AS n, sum(c_acctbal * 120) AS amount FROM customer GROUP BY 1""",
    r="amount:2",
)
def deposit_validation(spark, d):
    c = S.table(spark, d, "customer").select((F.col("c_acctbal") * 120).alias("amount"))
    reason = F.coalesce(L.deposit_reason(F.col("amount")), F.lit("ok"))
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query(
    "threshold_filters",
    "F9",
    "SELECT symbol, ts, lr FROM rets WHERE abs(lr) > 0.3 AND abs(r) > 0.01",
    r="lr",
    dates="ts",
)
def threshold_filters(spark, d):
    r = X.returns(S.bars(spark, d))
    return r.filter((F.abs("lr") > 0.3) & (F.abs("r") > 0.01)).select("symbol", "ts", "lr")


@query(
    "weights_sum_check",
    "F10",
    """SELECT portfolio, sum(w) AS total, sum(w) BETWEEN 0.99 AND 1.01 AS is_valid
       FROM (SELECT portfolio, CASE WHEN portfolio % 7 = 0 THEN w * 0.98 ELSE w END AS w FROM fund_weights) GROUP BY 1""",
    r="total",
)
def weights_sum_check(spark, d):
    w = S.fund_weights(spark, d)
    w = w.withColumn("w", F.when(F.col("portfolio") % 7 == 0, F.col("w") * 0.98).otherwise(F.col("w")))
    return L.check_weights(w)
