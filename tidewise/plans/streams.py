"""Streams, drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewise.registry import query
from tidewise.sources import tables as S
from tidewise.streaming import market as M


@query(
    "stream_bars",
    "ST1 S7",
    """SELECT * FROM bars_hourly WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    stamps="ts",
)
def stream_bars(spark, d):
    return M.drain(M.bars(M.tick_stream(M.read_table(spark, d, "events")))).drop("_batch")


@query(
    "stream_quotes",
    "ST2",
    """WITH q AS (SELECT event_type AS symbol, arg_max(value, ts) AS price, max(ts) AS quoted_at FROM events GROUP BY 1)
       SELECT symbol, price, quoted_at, CAST(epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(quoted_at)) AS BIGINT) AS age,
              epoch(TIMESTAMP '2024-01-30 00:00:00') - floor(epoch(quoted_at)) BETWEEN 0 AND 30 AS is_fresh FROM q""",
    stamps="quoted_at",
)
def stream_quotes(spark, d):
    every = M.drain(M.latest_quotes(M.tick_stream(M.read_table(spark, d, "events"))), "complete")
    last = every.groupBy("symbol").agg(
        F.max_by("price", "_batch").alias("price"), F.max_by("quoted_at", "_batch").alias("quoted_at")
    )
    return M.freshness(last, "2024-01-30 00:00:00")


@query("stream_ledger", "ST3 L1")
def stream_ledger(spark, d):
    trades = _trades(spark, d)
    done = M.with_state_store(spark, lambda: M.drain(M.ledger(trades, S.TRADE_ORDER), "update"))
    return done.groupBy("portfolio").agg(
        *[F.max_by(c, "_batch").alias(c) for c in ("cash", "accepted", "rejected")],
        F.max_by(F.size("positions"), "_batch").alias("held"),
    )


def _trades(spark, d):
    """Line items as a stream, joined to the static orders and parts."""
    li = M.read_table(spark, d, "lineitem")
    orders = S.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = S.table(spark, d, "part").select("p_partkey", "p_brand")
    return S.as_trades(li.join(part, li.l_partkey == part.p_partkey).join(orders, li.l_orderkey == orders.o_orderkey))
