"""Portfolio performance, backtests, optimisation and small relational operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewise.functions import scalar as C
from tidewise.operators import features as X
from tidewise.operators import ledger as L
from tidewise.operators import market as Q
from tidewise.operators import optimise as O
from tidewise.operators import portfolio as P
from tidewise.operators import series as W
from tidewise.operators import stats as M
from tidewise.registry import query
from tidewise.sources import tables as S

SYMBOLS = list(S.SEGMENT_ETF)


def returns(spark, d):
    return P.aligned_returns(S.bars(spark, d), SYMBOLS)


def curves(spark, d):
    return P.curve(P.portfolio_returns(returns(spark, d), S.nation_weights(spark, d)))


CURVE = """pr AS (SELECT portfolio, ts, sum(w * r) AS r FROM aligned JOIN nation_weights USING (symbol) GROUP BY 1, 2),
  cg AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY ts)) AS growth FROM pr),
  cv AS (SELECT *, growth / max(growth) OVER (PARTITION BY portfolio ORDER BY ts) - 1 AS drawdown FROM cg)"""


@query("portfolio_returns", "A5", f"WITH {CURVE} SELECT * FROM pr", r="r:8", dates="ts")
def portfolio_returns(spark, d):
    return P.portfolio_returns(returns(spark, d), S.nation_weights(spark, d))


@query(
    "portfolio_performance",
    "A6 A8 X4",
    f"""WITH {CURVE}, m AS (SELECT portfolio, ln(arg_max(growth, ts)) AS log_growth, stddev_samp(r) * sqrt(252) AS vol, min(drawdown) AS dd FROM cv
        WHERE ts >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY 1)
        SELECT portfolio, log_growth, vol * 100 AS volatility, dd * 100 AS max_drawdown FROM m""",
    r="log_growth volatility max_drawdown",
)
def portfolio_performance(spark, d):
    c = curves(spark, d).filter(F.col("ts") >= C.window_start("2001-08-01", "1Y"))
    p = P.performance(c)
    return p.select("portfolio", F.ln(F.col("total_return") / 100 + 1).alias("log_growth"), "volatility", "max_drawdown")


@query(
    "portfolio_periods",
    "A6 X4 P22",
    """WITH pr AS (SELECT portfolio, ts, sum(w * r) AS r FROM aligned JOIN nation_weights USING (symbol) GROUP BY 1, 2),
       k(period, days) AS (VALUES ('1M', 30), ('3M', 90), ('1Y', 365), ('ALL', 1825)),
       x AS (SELECT portfolio, period, ts, r / 1000 AS r FROM pr JOIN k ON ts >= DATE '2001-08-01' - days),
       g AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY portfolio, period ORDER BY ts)) AS growth FROM x),
       v AS (SELECT *, growth / max(growth) OVER (PARTITION BY portfolio, period ORDER BY ts) - 1 AS dd FROM g),
       m AS (SELECT portfolio, period, arg_max(growth, ts) - 1 AS t, stddev_samp(r) * sqrt(252) AS vol, min(dd) AS dd FROM v GROUP BY 1, 2)
       SELECT portfolio, period, t * 100 AS total_return, vol * 100 AS volatility, t / vol AS sharpe_ratio, dd * 100 AS max_drawdown FROM m""",
    r="total_return volatility sharpe_ratio max_drawdown",
)
def portfolio_periods(spark, d):
    r = P.portfolio_returns(returns(spark, d), S.nation_weights(spark, d)).withColumn("r", F.col("r") / 1000)
    return P.by_period(r, "2001-08-01")


@query(
    "backtest",
    "A7 X5 A8",
    f"""WITH {CURVE}, m AS (SELECT portfolio, ln(arg_max(growth, ts)) AS g, stddev_samp(r) * sqrt(252) AS vol, min(drawdown) AS dd, count(*) AS n FROM cv GROUP BY 1)
        SELECT portfolio, ln(exp(g * 252 / n)) AS log_annual, vol * 100 AS volatility, ln((exp(g * 252 / n) - 1) / vol) AS log_sharpe, dd * 100 AS max_drawdown, n AS days FROM m""",
    r="log_annual:5 volatility log_sharpe:5 max_drawdown",
)
def backtest(spark, d):
    b = P.backtest(curves(spark, d))
    return b.select(
        "portfolio",
        F.ln(F.col("annualized_return") / 100 + 1).alias("log_annual"),
        "volatility",
        F.ln("sharpe_ratio").alias("log_sharpe"),
        "max_drawdown",
        "days",
    )


@query(
    "backtest_series",
    "X5 W17",
    f"""WITH {CURVE}, n AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY portfolio) AS n FROM cv)
        SELECT portfolio, ts, ln(growth) AS log_value FROM n WHERE i % greatest(1, n // 100) = 0""",
    r="log_value",
    dates="ts",
)
def backtest_series(spark, d):
    thin = W.every_kth(curves(spark, d), P.BY_PORTFOLIO, 100)
    return thin.select("portfolio", "ts", F.ln("growth").alias("log_value"))


_COV = """mu AS (SELECT symbol, avg(r) * 252 AS mean FROM aligned GROUP BY 1),
  cov AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.r, b.r) * 252 AS cov FROM aligned a JOIN aligned b USING (ts) GROUP BY 1, 2)"""


@query(
    "parametric_metrics",
    "A9",
    f"""WITH {_COV}, rt AS (SELECT portfolio, sum(w * mean) AS ret FROM nation_weights JOIN mu USING (symbol) GROUP BY 1),
        vr AS (SELECT x.portfolio, sqrt(sum(x.w * cov * y.w)) AS vol FROM nation_weights x JOIN cov ON x.symbol = cov.a
               JOIN nation_weights y ON y.portfolio = x.portfolio AND y.symbol = cov.b GROUP BY 1)
        SELECT portfolio, ret, vol, (ret - 0.04) / vol AS sharpe_ratio,
               -greatest(vol * {math.sqrt(math.pi / 2)!r} - 0.5 * greatest(0, ret - 0.04), vol * 0.5) AS max_drawdown FROM rt JOIN vr USING (portfolio)""",
    r="ret vol sharpe_ratio max_drawdown",
)
def parametric_metrics(spark, d):
    wide = X.returns_wide(returns(spark, d), "r", SYMBOLS)
    return P.parametric(S.nation_weights(spark, d), M.mean_annual(wide, SYMBOLS), M.covariance_annual(wide, SYMBOLS))


BRANDS = [f"Brand{i}" for i in range(1, 26)]


def _solver(means: str, shift: str = "0.0", rounds: int = 4000) -> str:
    """SQL of the optimum, by another method than the library's: projected gradient steps on the scaled problem.

    ``means``: CTEs that end in ``mo(grp, a, m, n)`` and ``co(grp, a, b, c)``. Gives ``op(grp, objective, w, ret, vol, sharpe)``.
    """
    return f"""{means},
      sd AS (SELECT mo.grp, mo.a, m, m + {shift} AS ms, n, sqrt(c) AS d FROM mo JOIN co ON co.grp = mo.grp AND co.a = mo.a AND co.b = mo.a WHERE n > 30),
      rr AS (SELECT x.grp, x.a, list(c / (x.d * y.d) ORDER BY y.a) AS r, sum(abs(c / (x.d * y.d))) AS bound FROM sd x JOIN co ON co.grp = x.grp AND co.a = x.a
             JOIN sd y ON y.grp = x.grp AND y.a = co.b GROUP BY x.grp, x.a),
      gg AS (SELECT sd.grp, list(d ORDER BY sd.a) AS d, list(m ORDER BY sd.a) AS m, list(ms ORDER BY sd.a) AS ms, list(r ORDER BY sd.a) AS r, max(bound) AS l, count(*) AS k
             FROM sd JOIN rr ON rr.grp = sd.grp AND rr.a = sd.a GROUP BY sd.grp),
      st AS (SELECT grp, o AS objective, r, l, k, CASE o WHEN 'min_volatility' THEN list_transform(d, lambda x: 1 / x)
             ELSE list_transform(range(1, k + 1), lambda i: (ms[i] - 0.04) / d[i]) END AS c FROM gg CROSS JOIN (VALUES ('max_sharpe'), ('min_volatility')) v(o)),
      it(grp, objective, r, l, k, c, z, t) AS (SELECT grp, objective, r, l, k, c, list_transform(c, lambda x: greatest(x, 0) / l), 0 FROM st
        UNION ALL SELECT grp, objective, r, l, k, c, list_transform(range(1, k + 1), lambda i: greatest(0, z[i] + (c[i] - list_dot_product(r[i], z)) / l)), t + 1 FROM it WHERE t < {rounds}),
      zz AS (SELECT it.grp, objective, list_transform(range(1, it.k + 1), lambda i: z[i] / d[i]) AS v FROM it JOIN gg ON gg.grp = it.grp WHERE t = {rounds}),
      ww AS (SELECT zz.grp, objective, CASE WHEN list_sum(v) > 0 THEN list_transform(v, lambda x: x / list_sum(v))
             ELSE list_transform(range(1, k + 1), lambda i: CASE WHEN i = list_position(list_transform(range(1, k + 1), lambda j: (ms[j] - 0.04) / d[j]),
               list_max(list_transform(range(1, k + 1), lambda j: (ms[j] - 0.04) / d[j]))) THEN 1.0 ELSE 0.0 END) END AS w FROM zz JOIN gg ON gg.grp = zz.grp
             UNION ALL SELECT grp, 'max_returns', list_transform(range(1, k + 1), lambda i: CASE WHEN i = list_position(ms, list_max(ms)) THEN 1.0 ELSE 0.0 END) FROM gg),
      rv AS (SELECT ww.grp, objective, w, list_dot_product(w, m) AS ret, sqrt(list_dot_product(w, list_transform(range(1, k + 1), lambda i: d[i] * list_dot_product(r[i], list_transform(range(1, k + 1), lambda j: d[j] * w[j]))))) AS vol
             FROM ww JOIN gg ON gg.grp = ww.grp),
      op AS (SELECT grp, objective, w, ret, vol, (ret - 0.04) / vol AS sharpe FROM rv)"""


def _segment_means(grp: str) -> str:
    order = "CASE symbol " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SYMBOLS)) + " END"
    return f"""al AS (SELECT {grp} AS grp, ts, {order} AS a, r FROM aligned), mo AS (SELECT grp, a, avg(r) * 252 AS m, count(*) AS n FROM al GROUP BY 1, 2),
      co AS (SELECT x.grp, x.a, y.a AS b, covar_samp(x.r, y.r) * 252 AS c FROM al x JOIN al y ON x.grp = y.grp AND x.ts = y.ts GROUP BY 1, 2, 3)"""


_ALL_ROWS = """SELECT g.grp, o.objective, CASE WHEN n > 30 THEN 'ok' ELSE 'insufficient_data' END AS status, {columns} FROM (SELECT grp, max(n) AS n FROM mo GROUP BY 1) g
    CROSS JOIN (VALUES ('max_sharpe'), ('min_volatility'), ('max_returns')) o(objective) LEFT JOIN op ON op.grp = g.grp AND op.objective = o.objective"""


@query(
    "optimal_weights",
    "X1",
    f"WITH RECURSIVE {_solver(_segment_means('year(ts)'))} " + _ALL_ROWS.format(columns=", ".join(f"w[{i + 1}] AS w{i}" for i in range(5)) + ", ret, vol, sharpe"),
    r="w0 w1 w2 w3 w4 ret vol sharpe",
)
def optimal_weights(spark, d):
    o = O.optimal(P.moments(returns(spark, d), F.year("ts"), SYMBOLS))
    return o.select("grp", "objective", "status", *[F.col("w")[i].alias(f"w{i}") for i in range(5)], "ret", "vol", "sharpe").withColumn(
        "grp", F.col("grp").cast("long")
    )


_BRAND_MEANS = """pr AS (SELECT l_linestatus AS grp, date_trunc('month', l_shipdate) AS ts, replace(p_brand, '#', '') AS brand, avg(l_extendedprice / l_quantity) AS p
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
      rt AS (SELECT grp, ts, brand, p / lag(p) OVER (PARTITION BY grp, brand ORDER BY ts) - 1 AS r FROM pr),
      al AS (SELECT grp, ts, brand AS a, r FROM (SELECT *, count(r) OVER (PARTITION BY grp, ts) AS k FROM rt) WHERE k = 25 AND r IS NOT NULL),
      mo AS (SELECT grp, a, avg(r) * 252 AS m, count(*) AS n FROM al GROUP BY 1, 2),
      co AS (SELECT x.grp, x.a, y.a AS b, covar_samp(x.r, y.r) * 252 AS c FROM al x JOIN al y ON x.grp = y.grp AND x.ts = y.ts GROUP BY 1, 2, 3)"""


@query(
    "optimal_weights_many",
    "X1",
    f"WITH RECURSIVE {_solver(_BRAND_MEANS)} " + _ALL_ROWS.format(columns="len(list_filter(w, lambda x: x > 0.001)) AS held, ret, vol, sharpe"),
    r="ret:4 vol:5 sharpe:4",
)
def optimal_weights_many(spark, d):
    """25 assets (brands), monthly: one group for each line status."""
    li = S.table(spark, d, "lineitem").select("l_partkey", "l_linestatus", "l_shipdate", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    part = S.table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "").alias("brand"))
    month = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.col("l_linestatus").alias("grp"), F.trunc("l_shipdate", "month").alias("ts"), "brand")
    bars = month.agg(F.avg("price").alias("p"))
    r = W.windowed(bars, W.Layout(("grp", "brand"), ("ts",)), [lambda w: {"r": W.simple_return(F.col("p"), w)}], back=1)
    o = O.optimal(O.moments(O.vectors(r, ["grp", "ts"], "brand", "r", BRANDS), F.col("grp"), BRANDS))
    held = F.size(F.filter("w", lambda x: x > 0.001)).cast("long")
    return o.select("grp", "objective", "status", F.when(F.col("w").isNotNull(), held).alias("held"), "ret", "vol", "sharpe")


_FC = """lm AS (SELECT series, ts, value, (value / lag(value) OVER (PARTITION BY series ORDER BY ts) - 1) * 100 AS chg FROM market),
  ll AS (SELECT series, arg_max(value, ts) AS value, arg_max(chg, ts) AS chg FROM lm GROUP BY 1),
  fc AS (SELECT CASE series WHEN 'Treasury_10Y' THEN 'interest_rates' WHEN 'VIX' THEN 'inflation' ELSE 'gdp_growth' END AS factor,
         round(CASE series WHEN 'Treasury_10Y' THEN (value - 4) / 100 WHEN 'VIX' THEN (value - 18) / 1000 ELSE chg / 100 END, 4) AS change FROM ll),
  ad AS (SELECT sector, sum(coef * change) AS adjustment FROM sensitivity JOIN fc USING (factor) GROUP BY 1)"""


@query(
    "causal_adjustments",
    "X2",
    f"""WITH {_FC}, mu AS (SELECT symbol, avg(r) * 252 AS mean FROM aligned GROUP BY 1)
        SELECT symbol, sector, mean * 100 AS original_return, (mean + adjustment) * 100 AS adjusted_return, adjustment * 100 AS adjustment
        FROM mu JOIN segment_dim USING (symbol) JOIN ad USING (sector) WHERE abs(adjustment) > 0.001""",
    r="original_return:5 adjusted_return:5 adjustment:5",
)
def causal_adjustments(spark, d):
    adj = P.causal_adjustments(S.sensitivity(spark), P.economic_forecast(S.market(spark, d)))
    mean = returns(spark, d).groupBy("symbol").agg((F.avg("r") * 252).alias("mean"))
    j = mean.join(S.segment_dim(spark), "symbol").join(adj, "sector").filter(F.abs("adjustment") > 0.001)
    m, a = F.col("mean"), F.col("adjustment")
    return j.select(
        "symbol",
        "sector",
        (m * 100).alias("original_return"),
        ((m + a) * 100).alias("adjusted_return"),
        (a * 100).alias("adjustment"),
    )


_SHIFT = "(SELECT coalesce(max(adjustment), 0) FROM av WHERE av.a = mo.a)"
_SYMBOL_NO = "CASE symbol " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SYMBOLS)) + " END"


@query(
    "traditional_versus_causal",
    "X3",
    f"""SELECT p.ret AS traditional_return, c.ret AS causal_return, (c.ret - p.ret) * 100 AS return_gain, (p.vol - c.vol) * 100 AS volatility_cut,
          c.sharpe - p.sharpe AS sharpe_gain FROM (WITH RECURSIVE {_solver(_segment_means("'all'"))} SELECT * FROM op WHERE objective = 'max_sharpe') p
        CROSS JOIN (WITH RECURSIVE {_FC}, av AS (SELECT {_SYMBOL_NO} AS a, adjustment FROM segment_dim JOIN ad USING (sector)),
          {_solver(_segment_means("'all'"), _SHIFT)} SELECT * FROM op WHERE objective = 'max_sharpe') c""",
    r="traditional_return causal_return return_gain:5 volatility_cut:5 sharpe_gain",
)
def traditional_versus_causal(spark, d):
    m = P.moments(returns(spark, d), F.lit("all"), SYMBOLS)
    adj = P.causal_adjustments(S.sensitivity(spark), P.economic_forecast(S.market(spark, d)))
    adj = adj.join(S.segment_dim(spark), "sector").select("symbol", "adjustment")
    return P.compare_causal(m, adj, SYMBOLS)


# ---------------------------------------------------------------- ledger


@query(
    "holdings_fold",
    "L1",
)
def holdings_fold(spark, d):
    return L.holdings(S.trades(spark, d), S.TRADE_ORDER)


@query(
    "holdings_buys_only",
    "L1",
    "SELECT portfolio, symbol, sum(shares) AS shares, sum(shares * price) / sum(shares) AS avg_cost FROM trades WHERE side = 'buy' GROUP BY 1, 2",
    r="shares avg_cost:10",
)
def holdings_buys_only(spark, d):
    return L.buys_only(S.trades(spark, d))


@query(
    "net_positions",
    "L1 L3",
    """SELECT portfolio, symbol, sum(CASE WHEN side = 'buy' THEN shares ELSE -shares END) AS shares,
              sum(CASE WHEN side = 'buy' THEN -shares * price ELSE shares * price END) AS cash_flow, count(*) AS trades FROM trades GROUP BY 1, 2""",
    r="shares cash_flow:3",
)
def net_positions(spark, d):
    return L.net_positions(S.trades(spark, d))


_HELD = "h AS (SELECT portfolio, symbol, sum(shares) AS shares, sum(shares * price) / sum(shares) / 20 AS avg_cost FROM trades WHERE side = 'buy' GROUP BY 1, 2)"
_QUOTED = "qq AS (SELECT symbol, CASE WHEN symbol IN ('Brand#3', 'Brand#7') THEN 0 ELSE price END AS price, previous_close FROM quotes WHERE symbol <> 'Brand#11')"
_VALUED = f"""{_HELD}, {_QUOTED}, v1 AS (SELECT portfolio, h.symbol, shares, avg_cost, CASE WHEN coalesce(price, 0) = 0 THEN avg_cost ELSE price END AS px, previous_close AS pc
   FROM h LEFT JOIN qq ON h.symbol = qq.symbol),
   va AS (SELECT portfolio, symbol, shares, avg_cost, px AS current_price, coalesce(px - pc, 0) AS day_change, coalesce((px - pc) / pc * 100, 0) AS day_change_pct,
     px * shares AS market_value, avg_cost * shares AS cost_basis, px * shares - avg_cost * shares AS gain_loss, (px - avg_cost) / avg_cost * 100 AS gain_loss_pct FROM v1)"""


def _valued(spark, d):
    h = L.buys_only(S.trades(spark, d)).withColumn("avg_cost", F.col("avg_cost") / 20)
    q = S.quotes(spark, d).filter(F.col("symbol") != "Brand#11")
    q = q.withColumn("price", F.when(F.col("symbol").isin("Brand#3", "Brand#7"), 0.0).otherwise(F.col("price")))
    return L.valuation(h, q.select("symbol", "price", "previous_close"))


@query(
    "holdings_valuation",
    "L2 J7 W21",
    f"WITH {_VALUED} SELECT * FROM va",
    r="shares avg_cost:10 current_price:10 day_change:9 day_change_pct:9 market_value:6 cost_basis:6 gain_loss:6 gain_loss_pct:7",
)
def holdings_valuation(spark, d):
    return _valued(spark, d)


@query(
    "total_equity",
    "A21 L2",
    f"""WITH {_VALUED}, t AS (SELECT portfolio, sum(market_value) AS v FROM va GROUP BY 1)
        SELECT c_custkey AS portfolio, c_acctbal AS cash, coalesce(v, 0) AS total_value, c_acctbal + coalesce(v, 0) AS total_equity
        FROM customer LEFT JOIN t ON portfolio = c_custkey""",
    r="total_value:5 total_equity:5",
)
def total_equity(spark, d):
    cash = S.table(spark, d, "customer").select(F.col("c_custkey").alias("portfolio"), F.col("c_acctbal").alias("cash"))
    return L.equity(_valued(spark, d), cash)


_MOVES = "mv AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS amount FROM events)"


@query(
    "running_balance",
    "L3",
    f"WITH {_MOVES} SELECT user_id, event_id, sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS balance FROM mv",
    r="balance:5",
)
def running_balance(spark, d):
    m = _moves(spark, d)
    layout = W.block_layout(m, ("user_id",), ("ts", "event_id"))
    return L.running_balance(m, layout, "amount").select("user_id", "event_id", "balance")


def _moves(spark, d):
    ev = S.table(spark, d, "events")
    out = F.col("event_type").isin("purchase", "error")
    return ev.select("user_id", "ts", "event_id", F.when(out, -F.col("value")).otherwise(F.col("value")).alias("amount"))


@query(
    "cash_fold",
    "L3 F8",
    f"""WITH RECURSIVE {_MOVES}, m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM mv),
        f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 0.0::DOUBLE AS amount, '' AS status, 0.0::DOUBLE AS balance FROM (SELECT DISTINCT user_id FROM m)
          UNION ALL SELECT m.user_id, m.i, m.event_id, m.amount,
            CASE WHEN m.amount = 0 OR m.amount > 1000000 THEN 'invalid' WHEN m.amount < 0 AND -m.amount > f.balance THEN 'insufficient_funds' ELSE 'ok' END,
            CASE WHEN m.amount = 0 OR m.amount > 1000000 OR (m.amount < 0 AND -m.amount > f.balance) THEN f.balance ELSE f.balance + m.amount END
          FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1)
        SELECT user_id, event_id, amount, status, balance FROM f WHERE i > 0""",
    r="balance:5",
)
def cash_fold(spark, d):
    return L.cash_fold(_moves(spark, d), ["user_id"], ("ts", "event_id"))


@query(
    "activity_feed",
    "L4 T6",
    """SELECT user_id, activity_id, activity_type, created_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, activity_id DESC) AS rank
       FROM activities) WHERE rank <= 20""",
    stamps="created_at",
)
def activity_feed(spark, d):
    return L.feed(S.activities(spark, d)).select("user_id", "activity_id", "activity_type", "created_at", "rank")


@query("activity_counts", "L4", "SELECT user_id, activity_type, count(*) AS n FROM activities GROUP BY 1, 2")
def activity_counts(spark, d):
    return L.activity_counts(S.activities(spark, d))


# ---------------------------------------------------------------- market lists and relational operators


@query(
    "instrument_search",
    "F6 T1",
    """SELECT symbol, name, price, market_cap, place FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN symbol = 'BRAND#1' THEN 0 ELSE 1 END, market_cap DESC, symbol) AS place
       FROM (SELECT upper(symbol) AS symbol, name, price, market_cap FROM quotes) WHERE contains(symbol, 'BRAND#1') OR contains(lower(name), 'brand#1')) WHERE place <= 10""",
    r="price market_cap:2",
)
def instrument_search(spark, d):
    q = S.quotes(spark, d).withColumn("symbol", F.upper("symbol"))
    return Q.search(q, "brand#1", 10).select("symbol", "name", "price", "market_cap", "place")


@query(
    "trending",
    "T2",
    """WITH c AS (SELECT symbol, (price - previous_close) / previous_close * 100 AS change FROM quotes WHERE previous_close IS NOT NULL)
       SELECT *, row_number() OVER (ORDER BY round(abs(change), 9) DESC, symbol) AS place FROM c""",
    r="change",
)
def trending(spark, d):
    q = S.quotes(spark, d).filter(F.col("previous_close").isNotNull())
    change = (F.col("price") - F.col("previous_close")) / F.col("previous_close") * 100
    top = Q.ranked(q.select("symbol", change.alias("change")), [F.round(F.abs("change"), 9).desc(), F.col("symbol")])
    return top.select("symbol", "change", "place")


@query(
    "newest_first",
    "T9",
    """SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders""",
    dates="o_orderdate",
)
def newest_first(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return Q.ranked(o, [F.desc("o_orderdate"), F.col("o_orderkey")])


@query(
    "user_portfolios",
    "J10 L6",
    """SELECT n_nationkey AS user_id, count(c_custkey) AS portfolio_count, coalesce(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 0) AS expected
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 500 GROUP BY 1""",
    r="expected:2",
)
def user_portfolios(spark, d):
    users = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"))
    held = S.table(spark, d, "customer").filter(F.col("c_acctbal") > 500)
    held = held.select(F.col("c_nationkey").alias("user_id"), "c_custkey", F.col("c_acctbal").alias("metric"))
    return Q.user_summary(users, held, "c_custkey", "metric")


@query(
    "prediction_error",
    "J11",
    """WITH p AS (SELECT symbol, ts, CAST(ts + 1 AS DATE) AS target, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS predicted FROM bars)
       SELECT p.symbol, target, predicted, b.close AS actual, b.close - predicted AS error FROM p JOIN bars b ON b.symbol = p.symbol AND b.ts = p.target""",
    r="predicted error",
    dates="target",
)
def prediction_error(spark, d):
    b = S.bars(spark, d)
    p = W.windowed(b, W.DAILY, [lambda w: {"predicted": F.avg("close").over(w.rowsBetween(-4, 0))}], back=5)
    p = p.select("symbol", F.date_add("ts", 1).alias("target"), "predicted")
    real = b.select("symbol", F.col("ts").alias("target"), F.col("close").alias("actual"))
    return p.join(real, ["symbol", "target"]).withColumn("error", F.col("actual") - F.col("predicted"))


@query(
    "held_assets",
    "J12",
    "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
)
def held_assets(spark, d):
    p = S.table(spark, d, "part")
    sold = S.table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(sold, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "node_difference",
    "U4 J9",
    "SELECT c_custkey AS node FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def node_difference(spark, d):
    nodes = S.table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    used = S.table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("node"))
    return nodes.join(used, "node", "left_anti")


@query(
    "ordered_distinct",
    "U5",
    "SELECT event_type || ':' || CAST(user_id AS VARCHAR) AS name, min(event_id) AS first_seen FROM events GROUP BY 1",
)
def ordered_distinct(spark, d):
    ev = S.table(spark, d, "events").select(F.concat_ws(":", "event_type", "user_id").alias("name"), "event_id")
    return Q.distinct_in_order(ev, "name", "event_id")


@query(
    "key_union",
    "U6",
    "SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem UNION SELECT o_orderstatus FROM orders)",
)
def key_union(spark, d):
    a = S.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"))
    b = S.table(spark, d, "orders").select(F.col("o_orderstatus").alias("name"))
    return Q.ranked(a.unionByName(b).distinct(), [F.col("name")])


# ---------------------------------------------------------------- model registry


@query(
    "registry_summary",
    "A18 L5",
    "SELECT model_type, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT p_partkey AS seq, lower(p_type) AS model_type FROM part) GROUP BY 1",
)
def registry_summary(spark, d):
    return Q.registry_summary(S.registrations(spark, d))


_REG = """rg AS (SELECT p_partkey AS seq, lower(p_type) AS model_type, 'm' || p_partkey AS model_id, p_brand AS version,
  CASE WHEN p_size <= 40 THEN abs(p_retailprice - 950) / 100 END AS rmse, CASE WHEN p_size >= 5 THEN p_size / 50 END AS r2, p_size % 10 = 0 AS activated FROM part)"""


@query(
    "best_models",
    "A19 L5",
    f"""WITH {_REG} SELECT model_type, arg_min(model_id, (rmse, seq)) FILTER (rmse IS NOT NULL) AS best_rmse,
        arg_max(model_id, (r2, -seq)) FILTER (r2 IS NOT NULL) AS best_r2 FROM rg GROUP BY 1""",
)
def best_models(spark, d):
    r = S.registrations(spark, d)
    return Q.best_models(r, "rmse", False).join(Q.best_models(r, "r2", True), "model_type")


@query(
    "active_models",
    "L5",
    f"WITH {_REG} SELECT model_type, arg_max(model_id, seq) AS model_id, arg_max(version, seq) AS version FROM rg WHERE activated GROUP BY 1",
)
def active_models(spark, d):
    return Q.active_models(S.registrations(spark, d))
