"""Paper trading: validation, holdings, valuation, cash and the activity log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.operators import series as W
from tidewise.session import checkpointed

MAX_DEPOSIT = 1_000_000
OPENING_CASH = 1_000_000.0


# ---------------------------------------------------------------- validation


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def trade_reason(symbol: Column, side: Column, shares: Column, price: Column | None = None) -> Column:
    """Why a trade is rejected before any balance is looked at; null if it is not."""
    reason = (
        F.when(symbol.isNull() | (symbol == ""), "symbol_required")
        .when(~F.lower(side).isin("buy", "sell") | side.isNull(), "bad_action")
        .when(~(_number(shares) & (shares > 0)), "bad_shares")
    )
    return reason if price is None else reason.when(~(_number(price) & (price >= 0)), "bad_price")


def checked(trades: DataFrame) -> DataFrame:
    """Trades as every path applies them: symbols in upper case, sides in lower case, and ``is_valid``."""
    if "is_valid" in trades.columns:
        return trades
    reason = trade_reason(F.col("symbol"), F.col("side"), F.col("shares"), F.col("price"))
    return trades.withColumns({"is_valid": reason.isNull(), "symbol": F.upper("symbol"), "side": F.lower("side")})


def move_valid(amount: Column) -> Column:
    """Whether a cash move (deposit above zero, withdrawal below) may be applied at all."""
    return _number(amount) & (amount != 0) & (amount <= MAX_DEPOSIT)


def deposit_reason(amount: Column) -> Column:
    return F.when(~(_number(amount) & (amount > 0)), "not_positive").when(amount > MAX_DEPOSIT, "above_maximum")


def check_weights(weights: DataFrame) -> DataFrame:
    """Portfolios whose weights add up to one within one percent."""
    total = weights.groupBy("portfolio").agg(F.sum("w").alias("total"))
    return total.withColumn("is_valid", F.col("total").between(0.99, 1.01))


# ---------------------------------------------------------------- the fold


def step(cash: float, held: dict, valid: bool, symbol: str, side: str, shares: float, price: float) -> tuple[float, str]:
    """Apply one checked trade to the state in place; returns the new cash and the outcome."""
    if not valid:
        return cash, "invalid"
    cost = price * shares
    have, avg = held.get(symbol, (0.0, 0.0))
    if side == "buy":
        if cash < cost:
            return cash, "insufficient_funds"
        held[symbol] = (have + shares, round((have * avg + shares * price) / (have + shares), 2))
        return cash - cost, "ok"
    if have < shares:
        return cash, "insufficient_shares"
    if have - shares <= 0:
        del held[symbol]
    else:
        held[symbol] = (have - shares, avg)
    return cash + cost, "ok"


HOT_ROWS = 1_000_000
FOLDED = "cash double, symbol string, shares double, avg_cost double, accepted long, rejected long"


def holdings(
    trades: DataFrame, order: tuple[str, ...], opening: float = OPENING_CASH, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Trades in order -> one row per portfolio and held symbol, with cash and counts.

    Whether a trade is accepted depends on all trades before it, so an account is folded in order. An account
    of ordinary size is one small group. A hot one is first replayed in parallel as if everything were
    accepted: running cash and positions come from block scans, and if they never fall below zero nothing is
    rejected and the result is sums. Only hot accounts that do reject something are streamed in order.
    """
    trades = checked(trades)
    sizes = trades.groupBy("portfolio").agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(sizes.filter(F.col("_n") > hot_rows).select("portfolio"))
    if hot.isEmpty():
        return fold_all(trades, order, opening)
    big = checkpointed(trades.join(hot, "portfolio", "left_semi"))
    bad = checkpointed(_rejecting(big, order, opening))
    clean = big.join(bad, "portfolio", "left_anti")
    rest = trades.join(hot.join(bad, "portfolio", "left_anti"), "portfolio", "left_anti")
    return fold_all(rest, order, opening).unionByName(_accepted(clean, order, opening))


def _moves(trades: DataFrame) -> DataFrame:
    """Signed shares and cash of valid trades; invalid ones move nothing."""
    valid = F.col("is_valid")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return trades.withColumns(
        {
            "_shares": F.when(valid, sign * F.col("shares")).otherwise(0.0),
            "_cash": F.when(valid, -sign * F.col("shares") * F.col("price")).otherwise(0.0),
        }
    )


def _rejecting(trades: DataFrame, order: tuple[str, ...], opening: float) -> DataFrame:
    """Portfolios where accepting everything would overdraw cash or a position, or come too close to tell."""
    moves = _moves(trades)
    by_account = W.block_layout(moves, ("portfolio",), order)
    cash = W.running(moves, by_account, {"_run": ("sum", F.col("_cash"))}).filter(F.col("_run") + opening < 1e-6)
    by_symbol = W.Layout(("portfolio", "symbol"), order, by_account.block)
    held = W.running(moves.filter("is_valid"), by_symbol, {"_run": ("sum", F.col("_shares"))})
    short = held.filter((F.col("_run") < 0) | ((F.col("_run") != 0) & (F.abs("_run") < 1e-9)))
    return cash.select("portfolio").unionByName(short.select("portfolio")).distinct()


def _accepted(trades: DataFrame, order: tuple[str, ...], opening: float) -> DataFrame:
    """State of accounts in which every valid trade is accepted.

    Cash and shares are sums. The average cost is rounded at each purchase, so it is folded, but only per
    symbol and only over the trades since the position was last empty.
    """
    moves = _moves(trades)
    account = moves.groupBy("portfolio").agg(
        (F.sum("_cash") + opening).alias("cash"),
        F.count_if("is_valid").alias("accepted"),
        F.count_if(~F.col("is_valid")).alias("rejected"),
    )
    layout = W.block_layout(moves, ("portfolio", "symbol"), order)
    run = W.running(moves.filter("is_valid"), layout, {"_run": ("sum", F.col("_shares"))})
    empty = run.filter(F.col("_run") == 0).groupBy("portfolio", "symbol").agg(F.max("pos").alias("_zero"))
    live = run.join(empty, ["portfolio", "symbol"], "left").filter(F.col("pos") > F.coalesce("_zero", F.lit(-1)))
    bought = live.select("portfolio", "symbol", "side", "shares", "price", "pos")
    ordered = bought.repartition("portfolio", "symbol").sortWithinPartitions("portfolio", "symbol", "pos").drop("pos")

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}
        for b in batches:
            out = []
            for p, sym, side, n, price in b.itertuples(index=False):
                if (p, sym) != key:
                    if key is not None:
                        out.append((*key, *held[key[1]]))
                    key, held = (p, sym), {}
                step(float("inf"), held, True, sym, side, n, price)
            if out:
                yield pd.DataFrame(out, columns=["portfolio", "symbol", "shares", "avg_cost"])
        if key is not None:
            yield pd.DataFrame([(*key, *held[key[1]])], columns=["portfolio", "symbol", "shares", "avg_cost"])

    kind = trades.schema["portfolio"].dataType.simpleString()
    held = ordered.mapInPandas(cost, f"portfolio {kind}, symbol string, shares double, avg_cost double")
    return account.join(held, "portfolio", "left").select(
        "portfolio", "cash", "symbol", "shares", "avg_cost", "accepted", "rejected"
    )


def fold_all(trades: DataFrame, order: tuple[str, ...], opening: float = OPENING_CASH) -> DataFrame:
    """The plain fold: each portfolio is read as a stream of sorted Arrow batches; memory holds its positions."""
    cols = ["portfolio", "is_valid", "symbol", "side", "shares", "price"]
    ordered = (
        checked(trades)
        .select(*cols, F.struct(*order).alias("_o"))
        .repartition("portfolio")
        .sortWithinPartitions("portfolio", "_o")
        .select(*cols)
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cash, held, good, bad = None, opening, {}, 0, 0

        def rows():
            syms = sorted(held) or [None]
            return [(key, cash, s, *held.get(s, (None, None)), good, bad) for s in syms]

        names = ["portfolio", "cash", "symbol", "shares", "avg_cost", "accepted", "rejected"]
        for b in batches:
            out = []
            for p, valid, sym, side, n, price in b.itertuples(index=False):
                if p != key:
                    if key is not None:
                        out += rows()
                    key, cash, held, good, bad = p, opening, {}, 0, 0
                cash, what = step(cash, held, valid, sym, side, n, price)
                good, bad = good + (what == "ok"), bad + (what != "ok")
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame(rows(), columns=names)

    kind = trades.schema["portfolio"].dataType.simpleString()
    return ordered.mapInPandas(fold, f"portfolio {kind}, {FOLDED}")


def net_positions(trades: DataFrame) -> DataFrame:
    """Shares and cash flow per portfolio and symbol where every trade is accepted: sums only."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return trades.groupBy("portfolio", "symbol").agg(
        F.sum(sign * F.col("shares")).alias("shares"),
        F.sum(-sign * F.col("shares") * F.col("price")).alias("cash_flow"),
        F.count(F.lit(1)).alias("trades"),
    )


def buys_only(trades: DataFrame) -> DataFrame:
    """Holdings from purchases alone: weighted-average cost without rounding between trades."""
    return (
        trades.filter(F.col("side") == "buy")
        .groupBy("portfolio", "symbol")
        .agg(
            F.sum("shares").alias("shares"),
            F.try_divide(F.sum(F.col("shares") * F.col("price")), F.sum("shares")).alias("avg_cost"),
        )
    )


def running_balance(moves: DataFrame, layout: W.Layout, amount: str) -> DataFrame:
    """Balance after each cash move, where none is rejected."""
    return W.running(moves, layout, {"balance": ("sum", F.col(amount))})


CASH = "event_id long, amount double, status string, balance double"


def cash_fold(moves: DataFrame, keys: list[str], order: tuple[str, ...], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deposits (positive) and withdrawals (negative) in order; a rejected move leaves the balance alone.

    As for trades: hot accounts are first summed in blocks as if every valid move were accepted, and only
    those that would go below zero are streamed in order.
    """
    key = keys[0]
    sizes = moves.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = checkpointed(sizes.filter(F.col("_n") > hot_rows).select(key))
    if hot.isEmpty():
        return _cash_stream(moves, key, order)
    amount = F.col("amount")
    valid = move_valid(amount)
    big = checkpointed(moves.join(hot, key, "left_semi"))
    run = checkpointed(
        W.running(big, W.block_layout(big, (key,), order), {"balance": ("sum", F.when(valid, amount).otherwise(0.0))})
    )
    bad = run.filter(F.col("balance") < 1e-6).select(key).distinct()
    clean = run.join(bad, key, "left_anti").select(
        key, "event_id", "amount", F.when(valid, "ok").otherwise("invalid").alias("status"), "balance"
    )
    rest = moves.join(clean.select(key).distinct(), key, "left_anti")
    return _cash_stream(rest, key, order).unionByName(clean)


def _cash_stream(moves: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Streams each account in sorted batches; the state is one number."""
    ordered = (
        moves.select(key, "event_id", "amount", move_valid(F.col("amount")).alias("is_valid"), F.struct(*order).alias("_o"))
        .repartition(key)
        .sortWithinPartitions(key, "_o")
        .drop("_o")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, balance = None, 0.0
        for b in batches:
            states, balances = [], []
            for k, _, a, valid in b.itertuples(index=False):
                if k != who:
                    who, balance = k, 0.0
                if not valid:
                    states.append("invalid")
                elif a < 0 and -a > balance:
                    states.append("insufficient_funds")
                else:
                    balance += a
                    states.append("ok")
                balances.append(balance)
            yield b.drop(columns="is_valid").assign(status=states, balance=balances)

    kind = moves.schema[key].dataType.simpleString()
    return ordered.mapInPandas(fold, f"{key} {kind}, {CASH}")


# ---------------------------------------------------------------- valuation


def valuation(held: DataFrame, quotes: DataFrame) -> DataFrame:
    """Holdings at market: missing or zero quotes fall back to the average cost."""
    j = held.join(quotes, "symbol", "left")
    price = F.when(F.coalesce("price", F.lit(0.0)) == 0, F.col("avg_cost")).otherwise(F.col("price"))
    prev = F.when(F.coalesce("previous_close", F.lit(0.0)) == 0, None).otherwise(F.col("previous_close"))
    value, cost = price * F.col("shares"), F.col("avg_cost") * F.col("shares")
    change = F.coalesce(price - prev, F.lit(0.0))
    gain_pct = F.when(F.col("avg_cost") > 0, (price - F.col("avg_cost")) / F.col("avg_cost") * 100).otherwise(0.0)
    return j.select(
        "portfolio",
        "symbol",
        "shares",
        "avg_cost",
        price.alias("current_price"),
        change.alias("day_change"),
        F.coalesce(F.try_divide(change, prev) * 100, F.lit(0.0)).alias("day_change_pct"),
        value.alias("market_value"),
        cost.alias("cost_basis"),
        (value - cost).alias("gain_loss"),
        gain_pct.alias("gain_loss_pct"),
    )


def equity(valued: DataFrame, cash: DataFrame) -> DataFrame:
    """Market value, cash and total equity per portfolio."""
    v = valued.groupBy("portfolio").agg(F.sum("market_value").alias("total_value"))
    j = cash.join(v, "portfolio", "left").withColumn("total_value", F.coalesce("total_value", F.lit(0.0)))
    return j.withColumn("total_equity", F.col("total_value") + F.col("cash"))


# ---------------------------------------------------------------- activity log


def feed(activities: DataFrame, limit: int = 20) -> DataFrame:
    """Newest activities of each user, at most 100. Tasks keep only their own newest rows before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("activity_id"))
    return activities.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(limit, 100))


def activity_counts(activities: DataFrame) -> DataFrame:
    return activities.groupBy("user_id", "activity_type").agg(F.count(F.lit(1)).alias("n"))
