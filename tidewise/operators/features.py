"""Feature engineering on bars, macro and market series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewise import constants as K
from tidewise.functions import scalar as C
from tidewise.operators import series as W
from tidewise.sources import tables as S


def wide_by_anchor(long: DataFrame, ts: str, names: list[str], anchor: str | None = None) -> DataFrame:
    """Long series -> one column per name. With an anchor only the anchor's dates are kept."""
    wide = long.groupBy(ts).pivot("series", names).agg(F.max("value"))
    return wide.filter(F.col(anchor).isNotNull()) if anchor else wide


def history(bars: DataFrame, interval: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Price history by day, week or month; prices with 2 decimals."""
    if start:
        bars = bars.filter(F.col("ts") >= F.to_date(F.lit(start)))
    if end:
        bars = bars.filter(F.col("ts") < F.to_date(F.lit(end)))
    if interval != "day":
        period = F.to_date(F.date_trunc(interval, "ts"))
        bars = bars.groupBy("symbol", period.alias("period")).agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        bars = bars.withColumnRenamed("period", "ts")
    return bars.select("symbol", "ts", *[F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")], "volume")


def returns(bars: DataFrame, layout: W.Layout = W.DAILY, price: str = "close") -> DataFrame:
    """Adds simple return ``r`` and log return ``lr``."""
    p = F.col(price)

    def stage(w: WindowSpec):
        return {"r": W.simple_return(p, w), "lr": W.log_return(p, w)}

    return W.windowed(bars, layout, [stage], back=1)


def log_returns(bars: DataFrame, layout: W.Layout = W.DAILY, periods=K.RETURN_PERIODS) -> DataFrame:
    close = F.col("close")
    return W.windowed(
        bars, layout, [lambda w: {f"return_{n}d": W.log_return(close, w, n) for n in periods}], back=max(periods)
    )


def volatility(bars: DataFrame, layout: W.Layout = W.DAILY, windows=(21, 63, 252)) -> DataFrame:
    """Annualised rolling volatility of daily log returns."""
    close = F.col("close")
    stages = [
        lambda w: {"lr": W.log_return(close, w)},
        lambda w: {f"volatility_{n}d": C.annual_volatility(W.rolling_std(F.col("lr"), w, n)) for n in windows},
    ]
    return W.windowed(bars, layout, stages, back=max(windows))


def moving_averages(bars: DataFrame, layout: W.Layout = W.DAILY, windows=(10, 20, 50, 200)) -> DataFrame:
    close = F.col("close")
    return W.windowed(bars, layout, [lambda w: {f"sma_{n}": W.sma(close, w, n) for n in windows}], back=max(windows))


def rsi(bars: DataFrame, layout: W.Layout = W.DAILY, n: int = 14, first_delta: bool = True) -> DataFrame:
    """Relative strength from simple means of gains and losses.

    ``first_delta`` counts the missing change of the first row as zero, so values start at row n;
    without it they start one row later. No losses: 100; no change at all: null.
    """
    missing = 0.0 if first_delta else None

    def moves(w: WindowSpec):
        delta = F.col("close") - F.lag("close").over(w)
        side = lambda x: F.when(delta.isNull(), missing).otherwise(F.greatest(x, F.lit(0.0)))
        return {"_gain": side(delta), "_loss": side(-delta)}

    def means(w: WindowSpec):
        return {"_gain_mean": W.sma(F.col("_gain"), w, n), "_loss_mean": W.sma(F.col("_loss"), w, n)}

    def index(w: WindowSpec):
        g, loss = F.col("_gain_mean"), F.col("_loss_mean")
        value = F.when((loss == 0) & (g > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(g, loss)))
        return {f"rsi_{n}": value}

    df = W.windowed(bars, layout, [moves, means, index], back=n)
    return df.drop("_gain", "_loss", "_gain_mean", "_loss_mean")


def bollinger(bars: DataFrame, layout: W.Layout = W.DAILY, n: int = 20) -> DataFrame:
    close = F.col("close")

    def stage(w: WindowSpec):
        mean, std = W.sma(close, w, n), W.rolling_std(close, w, n)
        return {"bb_upper": mean + 2 * std, "bb_lower": mean - 2 * std, "bb_width": F.try_divide(4 * std, mean)}

    return W.windowed(bars, layout, [stage], back=n)


def atr(bars: DataFrame, layout: W.Layout = W.DAILY, n: int = 14) -> DataFrame:
    """Mean true range. The first row has no previous close: its range is high - low."""

    def true_range(w: WindowSpec):
        prev = F.lag("close").over(w)
        return {
            "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
        }

    return W.windowed(bars, layout, [true_range, lambda w: {f"atr_{n}": W.sma(F.col("_tr"), w, n)}], back=n).drop("_tr")


def volume_ratio(bars: DataFrame, layout: W.Layout = W.DAILY, n: int = 20) -> DataFrame:
    def stage(w: WindowSpec):
        mean = W.sma(F.col("volume").cast("double"), w, n)
        return {f"volume_sma_{n}": mean, "volume_ratio": F.try_divide(F.col("volume").cast("double"), mean)}

    return W.windowed(bars, layout, [stage], back=n)


def momentum(bars: DataFrame, layout: W.Layout = W.DAILY, periods=(10, 20, 21)) -> DataFrame:
    close = F.col("close")
    return W.windowed(
        bars, layout, [lambda w: {f"momentum_{n}": W.simple_return(close, w, n) for n in periods}], back=max(periods)
    )


def ema(bars: DataFrame, layout: W.Layout = W.DAILY, spans=(10, 20, 50, 200), adjust: bool = False) -> DataFrame:
    return W.ewm(bars, layout, [(f"ema_{n}", "close", float(n), adjust) for n in spans])


def macd(bars: DataFrame, layout: W.Layout = W.DAILY) -> DataFrame:
    df = W.ewm(bars, layout, [("_ema12", "close", 12.0, False), ("_ema26", "close", 26.0, False)])
    df = df.withColumn("macd", F.col("_ema12") - F.col("_ema26")).drop("_ema12", "_ema26")
    return W.ewm(df, layout, [("macd_signal", "macd", 9.0, False)])


def technical_indicators(bars: DataFrame, layout: W.Layout = W.DAILY) -> DataFrame:
    """All indicators on one row per bar. Equal window specs share one sort."""
    df = macd(ema(bars, layout), layout)
    for step in (moving_averages, rsi, bollinger, atr, volume_ratio, momentum):
        df = step(df, layout)
    return df


# ---------------------------------------------------------------- feature matrix

SECTORS = tuple(K.SECTOR_ETFS[e] for e in S.SEGMENT_ETF.values())
MACROS = ("Fed_Funds_Rate", "CPI", "GDP", "Unemployment_Rate")
MARKET_FEATURES = (
    "SP500",
    "VIX",
    "Treasury_10Y",
    "VIX_Change",
    "VIX_MA_10",
    "SP500_Return",
    "SP500_Volatility_21d",
)
RETURN_FEATURES = tuple(f"{s}_Return_{n}d" for s in SECTORS for n in (1, 5, 21))
MACRO_FEATURES = tuple(f"{m}{x}" for m in MACROS for x in ("", "_Change", "_Change_21d"))
FEATURES = (*RETURN_FEATURES, *MACRO_FEATURES, *MARKET_FEATURES)


def stack(df: DataFrame, ts: str, columns: dict[str, Column]) -> DataFrame:
    """Columns -> long rows (ts, feature, value) without a second pass; nulls and infinities are dropped."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), C.finite(c).alias("value")) for n, c in columns.items()])
    long = df.select(F.col(ts).alias("ts"), F.explode(items).alias("f")).select("ts", "f.feature", "f.value")
    return long.filter(F.col("value").isNotNull())


def sector_features(bars: DataFrame) -> DataFrame:
    """Long (ts, feature, value) sector returns over 1, 5 and 21 rows."""
    df = log_returns(bars, periods=(1, 5, 21))
    names = F.array(*[F.lit(f"_Return_{n}d") for n in (1, 5, 21)])
    vals = F.array(*[F.col(f"return_{n}d") for n in (1, 5, 21)])
    long = df.select("ts", "sector_name", F.explode(F.arrays_zip(names.alias("n"), vals.alias("v"))).alias("z"))
    return long.select("ts", F.concat("sector_name", F.col("z.n")).alias("feature"), F.col("z.v").alias("value")).filter(
        F.col("value").isNotNull()
    )


def macro_features(macro: DataFrame) -> DataFrame:
    """Monthly observations -> daily values carried forward, with 1- and 21-day changes, in long form."""
    daily = W.calendar_fill(macro.withColumnRenamed("obs_date", "ts"), "series", "ts", "value")
    v = F.col("value")

    def stage(w: WindowSpec):
        return {"_c1": W.simple_return(v, w), "_c21": W.simple_return(v, w, 21)}

    df = W.windowed(daily, W.Layout(("series",), ("ts",)), [stage], back=21)
    items = F.array(
        F.struct(F.col("series").alias("feature"), v.alias("value")),
        F.struct(F.concat("series", F.lit("_Change")).alias("feature"), F.col("_c1").alias("value")),
        F.struct(F.concat("series", F.lit("_Change_21d")).alias("feature"), F.col("_c21").alias("value")),
    )
    long = df.select("ts", F.explode(items).alias("f")).select("ts", "f.feature", "f.value")
    return long.filter(F.col("value").isNotNull())


def market_features(market: DataFrame) -> DataFrame:
    v = F.col("value")

    def one(w: WindowSpec):
        return {"_chg": W.simple_return(v, w), "_ma": W.sma(v, w, 10), "_lr": W.log_return(v, w)}

    def two(w: WindowSpec):
        return {"_vol": C.annual_volatility(W.rolling_std(F.col("_lr"), w, 21))}

    df = W.windowed(market, W.Layout(("series",), ("ts",)), [one, two], back=21)
    sp, vix = F.col("series") == "SP500", F.col("series") == "VIX"
    items = F.array(
        F.struct(F.col("series").alias("feature"), v.alias("value")),
        F.struct(F.lit("VIX_Change").alias("feature"), F.when(vix, F.col("_chg")).alias("value")),
        F.struct(F.lit("VIX_MA_10").alias("feature"), F.when(vix, F.col("_ma")).alias("value")),
        F.struct(F.lit("SP500_Return").alias("feature"), F.when(sp, F.col("_lr")).alias("value")),
        F.struct(F.lit("SP500_Volatility_21d").alias("feature"), F.when(sp, F.col("_vol")).alias("value")),
    )
    long = df.select("ts", F.explode(items).alias("f")).select("ts", "f.feature", "f.value")
    return long.filter(F.col("value").isNotNull())


def long_features(spark, sf_dir) -> DataFrame:
    """All features in long form (ts, feature, value): the store from which every wide table is cut."""
    parts = [
        sector_features(S.sector_bars(spark, sf_dir)),
        macro_features(S.macro_named(spark, sf_dir)),
        market_features(S.market(spark, sf_dir)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feature_matrix(spark, sf_dir, anchor: str | None = "SP500", back_fill: bool = False) -> DataFrame:
    """One row per date, one column per feature, gaps carried forward, incomplete rows dropped.

    Dates are the full outer union of all inputs, or the anchor's trading dates. The fill runs in long
    form, one window per feature (bounded by the calendar), never over one window for everything.
    """
    long = long_features(spark, sf_dir)
    # one map per date (at most one entry per feature) spans the grid, so the inputs are computed once
    by_date = long.groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("m"))
    cells = ", ".join(f"struct('{f}' AS feature, m['{f}'] AS value)" for f in FEATURES)
    grid = by_date.select("ts", F.expr(f"inline(array({cells}))")).withColumn("_seen", F.col("value").isNotNull())
    filled = W.fill(grid, W.Layout(("feature",), ("ts",)), ["value"], back=back_fill)
    # plain conditional aggregates: completeness is a count, not 34 null checks that slow the optimizer down
    wide = filled.groupBy("ts").agg(
        *[F.expr(f"max(CASE WHEN feature = '{f}' THEN value END) AS {f}") for f in FEATURES],
        F.count("value").alias("_n"),
        F.bool_or((F.col("feature") == (anchor or "")) & F.col("_seen")).alias("_on"),
    )
    keep = F.col("_n") == len(FEATURES)
    return wide.filter(keep & F.col("_on") if anchor else keep).drop("_n", "_on")


def training_set(matrix: DataFrame, sector: str, lookback: int | None = 1260, horizon: int = 21) -> DataFrame:
    """Features without the sector's own returns, and the sector's daily return ``horizon`` rows on.

    The matrix has one row per date; its date column is ranked in slices, not in one window.
    """
    target = f"{sector}_Return_1d"
    numbered = W.positions(matrix.withColumn("_all", F.lit(1)), W.Layout(("_all",), ("ts",)), slices=4)
    label = numbered.select((F.col("pos") - horizon).alias("pos"), F.col(target).alias("label"))
    kept = numbered.join(label, "pos")
    if lookback:
        kept = kept.filter(F.col("pos") > numbered.agg(F.max("pos")).scalar() - lookback)
    return C.drop_target(kept, sector).filter(F.col("label").isNotNull()).drop("_all")


# ---------------------------------------------------------------- small series operators


def returns_wide(returns: DataFrame, value: str, names: list[str], key: str = "symbol") -> DataFrame:
    return returns.groupBy("ts").pivot(key, names).agg(F.max(value))


def sector_performance(bars: DataFrame, as_of: str, period: str) -> DataFrame:
    """First and last close of each symbol in the period that ends at ``as_of``."""
    first, last = F.min_by("close", "ts"), F.max_by("close", "ts")
    return (
        bars.filter(F.col("ts") >= C.window_start(as_of, period))
        .groupBy("symbol", F.col("sector_name").alias("name"))
        .agg(
            last.alias("price"),
            (last - first).alias("change"),
            ((last - first) / first * 100).alias("change_percent"),
            F.max_by("volume", "ts").alias("volume"),
        )
    )


def with_macro(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Each bar with the last macro observation on or before its day.

    The as-of search runs on distinct days only; bars then join by day.
    """
    days = bars.select("ts").distinct().withColumn("_all", F.lit(1))
    seen = W.asof(days, macro.withColumn("_all", F.lit(1)), ["_all"], "ts", "obs_date", "value").drop("_all")
    return bars.join(seen, "ts")


def by_position(bars: DataFrame, benchmark: str, portfolio: str) -> DataFrame:
    """Two series joined by row number, both rebased to 100."""
    both = W.numbered(bars.filter(F.col("symbol").isin(benchmark, portfolio)), W.DAILY)
    base = both.filter(F.col("pos") == 0).select("symbol", F.col("close").alias("_base"))
    both = both.join(base, "symbol").withColumn("idx", F.col("close") / F.col("_base") * 100)
    a = both.filter(F.col("symbol") == benchmark).select("pos", "ts", F.col("idx").alias("benchmark"))
    b = both.filter(F.col("symbol") == portfolio).select("pos", F.col("idx").alias("portfolio"))
    return a.join(b, "pos", "left").withColumn("pos", (F.col("pos") + 1).cast("long"))
