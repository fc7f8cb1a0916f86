"""Ledger folds, scenario edge cases and streams."""

import datetime as dt
import pickle

import pytest
from pyspark.sql import functions as F

from tidewise.operators import ledger as L
from tidewise.operators import regimes as R
from tidewise.operators import scenario as N
from tidewise.sources import tables as S
from tidewise.streaming import market as M

TRADES = [
    ("p", 1, "A", "buy", 10.0, 10.0),
    ("p", 2, "A", "buy", 10.0, 11.115),
    ("p", 3, "A", "sell", 25.0, 12.0),  # more than held
    ("p", 4, "A", "sell", 5.0, 12.0),
    ("p", 5, "B", "buy", 1000.0, 10.0),  # more than cash
    ("p", 6, "B", "buy", 0.5, 10.0),
    ("p", 7, "B", "buy", 0.0, 10.0),  # nothing
    ("p", 8, "B", "sell", 0.5, 20.0),  # all of it
    ("q", 1, "A", "sell", 1.0, 1.0),  # never held
]
SCHEMA = "portfolio string, n int, symbol string, side string, shares double, price double"


def test_fold(spark):
    got = {(r["portfolio"], r["symbol"]): r for r in L.holdings(spark.createDataFrame(TRADES, SCHEMA), ("n",), 1000.0).collect()}
    p = got[("p", "A")]
    assert p["shares"] == 15 and p["avg_cost"] == 10.56
    assert p["cash"] == pytest.approx(1000 - 100 - 111.15 + 60 - 5 + 10)
    assert (p["accepted"], p["rejected"]) == (5, 3) and ("p", "B") not in got
    q = got[("q", None)]
    assert q["cash"] == 1000 and q["rejected"] == 1 and q["shares"] is None


def test_accounts_without_rejects_equal_the_fold(spark):
    rows = [(f"c{i % 3}", i, "AB"[i % 2], "buy" if i % 5 else "sell", 1.0 + i % 3, 5.0 + i % 7) for i in range(1, 200)]
    df = spark.createDataFrame(rows + TRADES, SCHEMA)
    key = lambda d: sorted((r["portfolio"], r["symbol"] or "", r["shares"], r["avg_cost"], round(r["cash"], 6), r["accepted"], r["rejected"]) for r in d.collect())
    assert key(L.holdings(df, ("n",), 5000.0, hot_rows=5)) == key(L.fold_all(df, ("n",), 5000.0))


ODD_TRADES = [
    ("h", 1, "a", "buy", 10.0, 5.0),
    ("h", 2, "A", "Buy", 2.0, 5.0),
    ("h", 3, "A", "BUY", 1.0, None),
    ("h", 4, "A", "buy", float("nan"), 5.0),
    ("h", 5, None, "buy", 1.0, 5.0),
    ("h", 6, "", "sell", 1.0, 5.0),
    ("h", 7, "A", None, 1.0, 5.0),
    ("h", 8, "A", "hold", 1.0, 5.0),
    ("h", 9, "A", "Sell", 0.0, 5.0),
    ("h", 10, "A", "sELL", 3.0, 6.0),
    ("h", 11, "A", "buy", None, 6.0),
    ("h", 12, "A", "buy", 1.0, float("nan")),
]


def test_size_of_an_account_changes_no_result(spark):
    df = spark.createDataFrame(ODD_TRADES + TRADES, SCHEMA)
    key = lambda d: sorted((r["portfolio"], r["symbol"] or "", r["shares"], r["avg_cost"], round(r["cash"], 6), r["accepted"], r["rejected"]) for r in d.collect())
    small, large = (key(L.holdings(df, ("n",), 1000.0, hot_rows=n)) for n in (10**9, 1))
    assert small == large and ("h", "A", 9.0, 5.0, 958.0, 3, 9) in small
    moves = spark.createDataFrame([(1, i, a) for i, a in enumerate([10.0, None, 5.0, float("nan"), -3.0, 0.0, 2e6])], "user_id long, event_id long, amount double")
    rows = lambda n: sorted((r["event_id"], r["status"], r["balance"]) for r in L.cash_fold(moves, ["user_id"], ("event_id",), hot_rows=n).collect())
    assert rows(1) == rows(10**9) and [b for *_, b in rows(1)] == [10, 10, 15, 15, 12, 12, 12]


def test_unmapped_holdings_and_unknown_factors_stay(spark):
    shocks = S.shocks(spark, {"s": {"oil_price": 0.5}, "nobody": {"no_such_factor": 1.0}})
    impacts = N.sector_impacts(S.sensitivity(spark), shocks)
    held = spark.createDataFrame([("p", "XLK", 0.5), ("p", "SPY", 0.5)], "portfolio string, etf string, w double")
    runs = {r["scenario"]: r for r in N.simulate(N.exposures(held, S.sector_dim(spark), impacts)).collect()}
    xlk = {r["scenario"]: r["impact"] for r in impacts.filter("sector = 'technology'").collect()}
    assert runs["s"]["current"] == pytest.approx(xlk["s"] / 2) == pytest.approx(runs["s"]["traditional"])
    assert xlk["nobody"] == 0 and runs["nobody"]["current"] == 0


def test_cash_fold(spark):
    moves = spark.createDataFrame([(1, 1, 50.0), (1, 2, -80.0), (1, 3, -20.0), (1, 4, 2e6), (2, 5, -1.0)], "user_id long, event_id long, amount double")
    got = {r["event_id"]: (r["status"], r["balance"]) for r in L.cash_fold(moves, ["user_id"], ("event_id",)).collect()}
    assert got == {1: ("ok", 50.0), 2: ("insufficient_funds", 50.0), 3: ("ok", 30.0), 4: ("invalid", 30.0), 5: ("insufficient_funds", 0.0)}


def test_hot_cash_accounts_equal_the_stream(spark):
    rows = [(u, 10 * u + i, a) for u in (1, 2) for i, a in enumerate([5.0, 3e6, 7.0, -4.0, -3.0 - 6 * u, 2.0, 0.0])]
    m = spark.createDataFrame(rows, "user_id long, event_id long, amount double")
    key = lambda d: sorted((r["event_id"], r["status"], r["balance"]) for r in d.collect())
    assert key(L.cash_fold(m, ["user_id"], ("event_id",), hot_rows=2)) == key(L.cash_fold(m, ["user_id"], ("event_id",)))


def test_weight_check(spark):
    w = spark.createDataFrame([("a", 0.98), ("b", 0.99), ("c", 1.01), ("d", 1.02)], "portfolio string, w double")
    assert [r["is_valid"] for r in L.check_weights(w).orderBy("portfolio").collect()] == [False, True, True, False]


def test_reweighting_without_a_held_best_sector(spark):
    shocks = S.shocks(spark, {"s": {"oil_price": 0.5}})
    impacts = N.sector_impacts(S.sensitivity(spark), shocks)
    ranks = {r["sector"]: r["rank"] for r in impacts.collect()}
    assert ranks["energy"] == 11 and ranks["industrials"] == 1
    held = spark.createDataFrame([("p", "XLI", 0.5), ("p", "XLV", 0.5), ("p", "ZZZ", 0.0)], "portfolio string, etf string, w double")
    e = N.exposures(held, S.sector_dim(spark), impacts)
    w = {r["etf"]: r["causal_w"] for r in N.reweight(e).collect()}
    assert w["XLI"] == pytest.approx(0.35 / 0.85) and w["XLV"] == pytest.approx(0.5 / 0.85)


def test_default_rules(spark):
    df = spark.createDataFrame([(0.2, 0.1), (-0.2, 0.2), (-0.2, 0.5), (0.0, 0.5)], "recent_return double, volatility double")
    got = [r["regime"] for r in R.predict_rules(df, None).orderBy("recent_return", "volatility").collect()]
    assert got == ["bear", "crisis", "sideways", "bull"]


def test_stream_ledger_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(TRADES, SCHEMA)
    for part in range(3):
        df.filter((F.col("n") - 1) / 3 >= part).filter((F.col("n") - 1) / 3 < part + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = M.with_state_store(spark, lambda: M.drain(M.ledger(stream, ("n",), 1000.0), "update"))
    last = done.groupBy("portfolio").agg(*[F.max_by(c, "_batch").alias(c) for c in ("cash", "accepted", "rejected", "positions")])
    got = {r["portfolio"]: r for r in last.collect()}
    want = {r["portfolio"]: r for r in L.holdings(df, ("n",), 1000.0).collect()}
    for k in ("p", "q"):
        assert got[k]["cash"] == pytest.approx(want[k]["cash"]) and got[k]["rejected"] == want[k]["rejected"]
    assert [(x["symbol"], x["shares"], x["avg_cost"]) for x in got["p"]["positions"]] == [("A", 15.0, 10.56)]


def test_stream_ledger_packs_an_account_into_one_row(spark, tmp_path):
    trades = [(p, n, f"S{(n * 7 + i) % 4}", "sell" if (n + i) % 3 == 0 else "buy", None if n == 5 else 1.0 + n % 4, 10.0 + i % 9) for i, p in enumerate([None, *range(120)]) for n in range(1, 13)]
    schema = "portfolio long, n long, symbol string, side string, shares double, price double"
    df = spark.createDataFrame(trades, schema)
    packed = M._packed(L.checked(df.repartition(5)), ("shares", "n")).collect()
    assert len(packed) == 121 and len({r["bucket"] for r in packed}) > 60
    one = next(pickle.loads(r["trades"]) for r in packed if r["portfolio"] == 7)
    assert one[3] == sorted(x for x in one[3] if x is not None) + [None] and one[0].count(False) == 1
    for part in range(2):  # the second batch finds what the first one left
        df.filter((F.col("n") > 6) == (part == 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{part}"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in*"))
        done = M.with_state_store(spark, lambda: M.drain(M.ledger(stream, ("n",), 200.0), "update", checkpoint=str(tmp_path / "ck")))
    got = {r["portfolio"]: (r["cash"], [tuple(x) for x in r["positions"]], r["accepted"], r["rejected"]) for r in done.collect()}
    want = {}
    for r in L.holdings(df.fillna({"portfolio": -1}), ("n",), 200.0).collect():
        held = want.setdefault(None if r["portfolio"] == -1 else r["portfolio"], (r["cash"], [], r["accepted"], r["rejected"]))[1]
        held += [(r["symbol"], r["shares"], r["avg_cost"])] if r["symbol"] else []
    assert len(want) == 121 and got == want


def test_a_stream_reads_its_table_only(spark, tmp_path):
    whole = spark.range(40).selectExpr("id AS n")
    whole.repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).selectExpr("id AS n").write.parquet(str(tmp_path / "a_old.parquet"))
    assert M.drain(M.read_table(spark, str(tmp_path), "a", files=1)).count() == 40


def test_late_ticks_are_dropped(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "symbol string, ts timestamp, event_id long, price double"
    batches = ([(5, 1.0), (20, 3.0)], [(200, 9.0)], [(10, 50.0), (300, 1.0)])
    seen = []
    for ticks in batches:  # one run per file: the order of arrival is then certain
        rows = [("a", base + dt.timedelta(minutes=m), m, p) for m, p in ticks]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        seen += M.drain(M.bars(stream), checkpoint=str(tmp_path / "ck")).collect()
    first = min(seen, key=lambda r: r["ts"])
    assert first["high"] == 3.0 and first["volume"] == 2
