"""SQL text of the derived views, for the oracle side. Same definitions as ``sources.tables``."""

from __future__ import annotations

import re

from tidewise import constants as K
from tidewise.sources.tables import SEGMENT_ETF


def _rows(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def values(columns: str, rows, doubles: str = "") -> str:
    cast = "".join(f", CAST({c} AS DOUBLE) AS {c}" for c in doubles.split())
    skip = f" EXCLUDE ({', '.join(doubles.split())})" if doubles else ""
    return f"SELECT *{skip}{cast} FROM (VALUES {_rows(rows)}) AS v({columns})"


def shock_values(sets) -> str:
    rows = [(n, i, j, f, float(c)) for i, (n, fs) in enumerate(sets.items()) for j, (f, c) in enumerate(fs.items())]
    return values("scenario, sord, pos, factor, change", rows, "change")


_ETF_LIST = "[" + ", ".join(f"'{e}'" for e in K.SECTOR_ETFS) + "]"

VIEWS: dict[str, str] = {
    "bars": """
        SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts,
               arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
               min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "ticks": "SELECT event_type AS symbol, ts, event_id, value AS price FROM events",
    "bars_hourly": """
        SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
               arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, ts) AS close, count(*) AS volume
        FROM events e GROUP BY event_type, date_trunc('hour', e.ts)""",
    "macro_wide": """
        SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS obs_date, avg(l_discount) * 100 AS FEDFUNDS,
               avg(l_tax) * 100 AS CPIAUCSL, sum(l_quantity) AS GDP, stddev_samp(l_quantity) AS UNRATE
        FROM lineitem GROUP BY 1""",
    "macro": """
        SELECT 'FEDFUNDS' AS series_id, obs_date, FEDFUNDS AS value FROM macro_wide
        UNION ALL SELECT 'CPIAUCSL', obs_date, CPIAUCSL FROM macro_wide
        UNION ALL SELECT 'GDP', obs_date, GDP FROM macro_wide
        UNION ALL SELECT 'UNRATE', obs_date, UNRATE FROM macro_wide""",
    "macro_names": values("series_id, series", list(K.MACRO_SERIES.items())),
    "macro_named": "SELECT series, obs_date, value FROM macro JOIN macro_names USING (series_id)",
    "market_daily": """
        SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 100 AS SP500,
               CASE WHEN count(*) > 1 THEN stddev_samp(o_totalprice) / avg(o_totalprice) * 30 END AS VIX,
               avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 60000 AS Treasury_10Y
        FROM orders GROUP BY 1""",
    "market": """
        SELECT * FROM (SELECT 'SP500' AS series, ts, SP500 AS value FROM market_daily
        UNION ALL SELECT 'VIX', ts, VIX FROM market_daily
        UNION ALL SELECT 'Treasury_10Y', ts, Treasury_10Y FROM market_daily) WHERE value IS NOT NULL""",
    "sector_dim": values(
        "ord, etf, sector_name, sector",
        [(i, e, n, n.lower()) for i, (e, n) in enumerate(K.SECTOR_ETFS.items())],
    ),
    "segment_dim": values(
        "symbol, etf, sector_name, sector",
        [(s, e, K.SECTOR_ETFS[e], K.SECTOR_ETFS[e].lower()) for s, e in SEGMENT_ETF.items()],
    ),
    "sensitivity": values(
        "sector, ord, factor, ford, coef",
        [
            (s, i, f, j, c)
            for i, (s, cs) in enumerate(K.SENSITIVITY.items())
            for j, (f, c) in enumerate(zip(K.FACTORS, cs))
        ],
        "coef",
    ),
    "presets": shock_values(K.PRESETS),
    "regime_shocks": shock_values(K.REGIME_SHOCKS),
    "fund_spend": f"""
        SELECT o_custkey AS portfolio,
               list_extract({_ETF_LIST}, CAST(split_part(p_brand, '#', 2) AS INTEGER) % 11 + 1) AS etf,
               sum(l_extendedprice) AS spend
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "fund_weights": """
        SELECT portfolio, etf, spend / sum(spend) OVER (PARTITION BY portfolio) AS w FROM fund_spend""",
    "nation_weights": """
        SELECT portfolio, symbol, spend / sum(spend) OVER (PARTITION BY portfolio) AS w FROM (
          SELECT c_nationkey AS portfolio, c_mktsegment AS symbol, sum(o_totalprice) AS spend
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "trades": """
        SELECT o_custkey AS portfolio, CAST(o_orderdate AS DATE) AS ts, p_brand AS symbol,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS shares,
               l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               l_discount, l_tax, l_linestatus, l_shipdate
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "quotes": """
        SELECT p_brand AS symbol, min(p_name) AS name, max(p_retailprice) AS price,
               max(CASE WHEN p_size <= 25 THEN p_retailprice END) AS previous_close,
               sum(p_retailprice * p_size) AS market_cap
        FROM part GROUP BY 1""",
    "what_ifs": """
        SELECT c_custkey AS request, CAST(c_custkey % 7 - 3 AS DOUBLE) AS rates,
               CAST(c_nationkey % 5 - 2 AS DOUBLE) AS inflation, c_acctbal / 2500 - 2 AS gdp FROM customer""",
    "aligned": """
        SELECT symbol, ts, close, r FROM (
          SELECT *, count(r) OVER (PARTITION BY ts) AS k, 5 AS n FROM (
            SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM (
              SELECT g.symbol, g.ts, last_value(b.close IGNORE NULLS) OVER (
                       PARTITION BY g.symbol ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS close
              FROM (SELECT symbol, ts FROM (SELECT DISTINCT ts FROM bars) CROSS JOIN (SELECT symbol FROM segment_dim)) g
              LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts))) WHERE k = n""",
    "preset_impacts": """
        SELECT scenario, sord, sector, ord, sum(coef * change) AS impact FROM presets JOIN sensitivity USING (factor)
        GROUP BY 1, 2, 3, 4""",
    "regime_impacts": """
        SELECT scenario, sord, sector, ord, sum(coef * change) AS impact FROM regime_shocks JOIN sensitivity USING (factor)
        GROUP BY 1, 2, 3, 4""",
    "activities": """
        SELECT user_id, event_type AS activity_type, event_id AS activity_id, ts AS created_at,
               props AS activity_metadata, value AS amount FROM events""",
    "rets": """
        SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
}


def statement(sql: str, replace: str) -> str:
    """Prefix ``sql`` with the views it names (and the views those name), and apply the output rules."""
    needed: list[str] = []

    def need(text: str):
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT *{replace} FROM ({sql}) AS answer"
