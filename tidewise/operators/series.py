"""Ordered computations over many series.

Two physical layouts give the same result:

* whole series: one window per key. Right for bars, whose length is bounded by the calendar
  (one row per period), however many raw rows stand behind them.
* blocks: for raw rows, where one key may hold any share of the data. Rows get an exact position in
  their series (``positions``), positions are cut into blocks of fixed length, and each block is a
  task-sized group. Frames that look ``back`` rows get copies of the last rows of the block before;
  running values get the fold of all blocks before. No task ever sees a whole hot series.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.session import checkpointed

Stage = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    block: int | None = None

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)


DAILY = Layout()


def block_layout(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> Layout:
    """Blocks for raw rows: about as many rows in a block as there are blocks, so neither level grows large.

    Counting a Parquet table reads its footers only.
    """
    return Layout(keys, order, max(256, math.isqrt(df.count())))


# ---------------------------------------------------------------- positions and blocks


def positions(df: DataFrame, layout: Layout, slices: int | None = None, out: str = "pos") -> DataFrame:
    """Exact 0-based position of every row in its series, without one task per series.

    Rows are range-partitioned by (key, order): a hot series simply spans many slices. The slices are
    materialised, since their borders are sampled and must not differ between the two uses below.
    The order must be unique within a series.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if layout.block is not None:
        # block_layout made blocks about the square root of the rows: no more slices than the rows can fill
        n = min(n, 2 + layout.block * layout.block // 50_000)
    n = slices or n
    cut = df.repartitionByRange(n, *layout.keys, *layout.order).withColumn("_slice", F.spark_partition_id())
    cut = checkpointed(cut)
    size = cut.groupBy(*layout.keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*layout.keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = size.select(*layout.keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = Window.partitionBy(*layout.keys, "_slice").orderBy(*layout.order)
    return (
        cut.withColumn(out, F.row_number().over(local) - 1)
        .join(start, [*layout.keys, "_slice"])
        .withColumn(out, F.col(out) + F.col("_start"))
        .drop("_slice", "_start")
    )


def windowed(df: DataFrame, layout: Layout, stages: list[Stage], back: int = 0, ahead: int = 0) -> DataFrame:
    """Add columns whose frames reach at most ``back`` rows back and ``ahead`` rows on.

    Each stage maps a window to columns; later stages may use the columns of earlier ones.
    """
    if layout.block is None:
        w = layout.window()
        for stage in stages:
            df = df.withColumns(stage(w))
        return df
    size = max(layout.block, back, ahead)  # a frame reaches into one neighbouring block at most
    if "pos" not in df.columns:
        df = positions(df, layout)
    home = F.floor(F.col("pos") / size)
    inside = F.col("pos") % size
    copies = [home]
    if back:
        copies.append(F.when(inside >= size - back, home + 1))
    if ahead:
        copies.append(F.when((inside < ahead) & (home > 0), home - 1))
    spread = df.withColumn("_blk", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy(*layout.keys, "_blk").orderBy("pos")
    for stage in stages:
        spread = spread.withColumns(stage(w))
    return spread.filter(F.col("_blk") == home).drop("_blk")


# ---------------------------------------------------------------- frames


def full(agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int) -> Column:
    """Aggregate over the last ``n`` rows; null until all of them are present and not null."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.avg, x, w, n)


def rolling_std(x: Column, w: WindowSpec, n: int) -> Column:
    return full(F.stddev_samp, x, w, n)


def log_return(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """ln(x_t / x_{t-n}); null where it is not defined."""
    return F.ln(F.try_divide(x, F.lag(x, n).over(w)))


def simple_return(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


# ---------------------------------------------------------------- running values

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, layout: Layout, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running folds from the start of each series up to the row: ``out -> (sum|max|min|last, x)``.

    ``last`` carries the last non-null value forward.
    """
    if layout.block is None:
        w = layout.window().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns(
            {
                out: F.last(x, ignorenulls=True).over(w) if kind == "last" else _FOLDS[kind](x).over(w)
                for out, (kind, x) in specs.items()
            }
        )
    if "pos" not in df.columns:
        df = positions(df, layout)
    df = df.withColumn("_blk", F.floor(F.col("pos") / layout.block))
    keys = [*layout.keys, "_blk"]
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    folds, totals, carries = {}, [], []
    before = Window.partitionBy(*layout.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    for out, (kind, x) in specs.items():
        if kind == "last":
            folds[out] = F.last(x, ignorenulls=True).over(w)
            totals.append(F.max_by(x, F.when(x.isNotNull(), F.col("pos"))).alias(f"_t_{out}"))
            carries.append(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_c_{out}"))
        else:
            folds[out] = _FOLDS[kind](x).over(w)
            totals.append(_FOLDS[kind](x).alias(f"_t_{out}"))
            carries.append(_FOLDS[kind](F.col(f"_t_{out}")).over(before).alias(f"_c_{out}"))
    carry = df.groupBy(*keys).agg(*totals).select(*keys, *carries)
    res = df.withColumns(folds).join(carry, keys)
    done = {}
    for out, (kind, _) in specs.items():
        here, prev = F.col(out), F.col(f"_c_{out}")
        if kind == "last":
            done[out] = F.coalesce(here, prev)
        elif kind == "sum":
            done[out] = F.when(here.isNull() & prev.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0.0)) + F.coalesce(prev, F.lit(0.0))
            )
        else:
            done[out] = F.greatest(here, prev) if kind == "max" else F.least(here, prev)
    return res.withColumns(done).drop("_blk", *[f"_c_{o}" for o in specs])


def growth(df: DataFrame, layout: Layout, r: str = "r", out: str = "growth") -> DataFrame:
    """Running product of (1 + r). A return of -100 % makes it zero for good; below that the sign flips."""
    g = 1 + F.col(r)
    df = running(
        df,
        layout,
        {
            "_log": ("sum", F.when(g != 0, F.ln(F.abs(g)))),
            "_neg": ("sum", (g < 0).cast("double")),
            "_zero": ("max", (g == 0).cast("double")),
        },
    )
    value = F.exp("_log") * F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    return df.withColumn(
        out, F.when(F.col("_zero") == 1, 0.0).otherwise(F.coalesce(value, F.when(g.isNotNull(), 1.0)))
    ).drop("_log", "_neg", "_zero")


def drawdown(df: DataFrame, layout: Layout, growth_col: str = "growth", out: str = "drawdown") -> DataFrame:
    df = running(df, layout, {"_peak": ("max", F.col(growth_col))})
    return df.withColumn(out, F.try_divide(growth_col, "_peak") - 1).drop("_peak")


def fill(df: DataFrame, layout: Layout, cols: list[str], back: bool = False) -> DataFrame:
    """Carry values forward over nulls; ``back`` then fills what is left at the start from later rows.

    Filling backward looks into the future: use it for parity of a finished table, not for training.
    """
    if back and layout.block is None:
        rest = layout.window().rowsBetween(0, Window.unboundedFollowing)
        df = df.withColumns({f"_b_{c}": F.first(c, ignorenulls=True).over(rest) for c in cols})
        df = running(df, layout, {c: ("last", F.col(c)) for c in cols})
        return df.withColumns({c: F.coalesce(c, f"_b_{c}") for c in cols}).drop(*[f"_b_{c}" for c in cols])
    df = running(df, layout, {c: ("last", F.col(c)) for c in cols})
    if back:
        at = F.struct(*layout.order)
        firsts = df.groupBy(*layout.keys).agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in cols]
        )
        df = df.join(firsts, list(layout.keys)).withColumns({c: F.coalesce(c, f"_f_{c}") for c in cols})
        df = df.drop(*[f"_f_{c}" for c in cols])
    return df


# ---------------------------------------------------------------- exponential means


def ewm(df: DataFrame, layout: Layout, specs: list[tuple[str, str, float, bool]]) -> DataFrame:
    """Exponentially weighted means: ``(out, x, span, adjust)``, computed in order.

    ``adjust=False`` is the recursion y = (1-a) y' + a x seeded with the first value, a = 2/(span+1);
    ``adjust=True`` divides by the sum of the weights. A later spec may use an earlier output.
    """
    if layout.block is not None:
        if "pos" not in df.columns:
            df = positions(df, layout)
        for out, x, span, adjust in specs:
            df = _ewm_blocks(df, layout, out, x, 2.0 / (span + 1.0), adjust)
        return df
    schema = T.StructType(df.schema.fields + [T.StructField(o, T.DoubleType()) for o, *_ in specs])
    order = list(layout.order)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        for out, x, span, adjust in specs:
            pdf[out] = pdf[x].ewm(span=span, adjust=adjust).mean()
        return pdf

    return df.groupBy(*layout.keys).applyInPandas(smooth, schema)


def _ewm_blocks(df: DataFrame, layout: Layout, out: str, x: str, a: float, adjust: bool) -> DataFrame:
    """Each block folds to an affine map of the state before it; maps compose, so blocks are independent."""
    d = 1.0 - a
    df = df.withColumn("_blk", F.floor(F.col("pos") / layout.block))
    keys = [*layout.keys, "_blk"]
    local_schema = T.StructType(
        df.schema.fields + [T.StructField(c, T.DoubleType()) for c in ("_num", "_den", "_decay")]
    )

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        k = np.arange(len(pdf))
        weight = (1.0 - d ** (k + 1)) / (1.0 - d)
        gain = np.ones(len(pdf)) if adjust else np.where(pdf["pos"] == 0, 1.0, a)
        v = pdf[x] * gain
        pdf["_num"] = v.ewm(alpha=a, adjust=True).mean() * weight
        pdf["_den"] = weight
        pdf["_decay"] = d ** (k + 1)
        return pdf

    part = df.groupBy(*keys).applyInPandas(local, local_schema)
    ends = part.groupBy(*keys).agg(
        *[F.max_by(c, "pos").alias(c + "_end") for c in ("_num", "_den", "_decay")]
    )
    key_fields = [f for f in ends.schema.fields if f.name in keys]
    carry_schema = T.StructType(key_fields + [T.StructField(c, T.DoubleType()) for c in ("_cn", "_cd")])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        cn, cd, n, m = 0.0, 0.0, [], []
        for num, den, dec in zip(pdf["_num_end"], pdf["_den_end"], pdf["_decay_end"]):
            n.append(cn)
            m.append(cd)
            cn, cd = num + dec * cn, den + dec * cd
        pdf["_cn"], pdf["_cd"] = n, m
        return pdf[[f.name for f in carry_schema.fields]]

    carry = ends.groupBy(*layout.keys).applyInPandas(chain, carry_schema)
    num = F.col("_num") + F.col("_decay") * F.col("_cn")
    den = F.col("_den") + F.col("_decay") * F.col("_cd")
    return (
        part.join(carry, keys)
        .withColumn(out, num / den if adjust else num)
        .drop("_blk", "_num", "_den", "_decay", "_cn", "_cd")
    )


def ewm_std(df: DataFrame, layout: Layout, x: str, span: float, out: str) -> DataFrame:
    """Bias-corrected exponentially weighted standard deviation (adjusted weights)."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    order = list(layout.order)

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        pdf[out] = pdf[x].ewm(span=span).std()
        return pdf

    return df.groupBy(*layout.keys).applyInPandas(smooth, schema)


# ---------------------------------------------------------------- other ordered operators


def last_rows(df: DataFrame, layout: Layout, n: int) -> DataFrame:
    """The ``n`` most recent rows of each series."""
    latest = Window.partitionBy(*layout.keys).orderBy(*[F.col(c).desc() for c in layout.order])
    return df.withColumn("_rn", F.row_number().over(latest)).filter(F.col("_rn") <= n).drop("_rn")


def numbered(df: DataFrame, layout: Layout) -> DataFrame:
    """Adds the position ``pos`` of each row and the length ``_n`` of its series."""
    if layout.block is None:
        w = Window.partitionBy(*layout.keys)
        return df.withColumns({"pos": F.row_number().over(layout.window()) - 1, "_n": F.count(F.lit(1)).over(w)})
    df = positions(df, layout)
    size = df.groupBy(*layout.keys).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(size, list(layout.keys))


def every_kth(df: DataFrame, layout: Layout, points: int) -> DataFrame:
    """Thin each series to about ``points`` rows: rows 0, k, 2k, ... with k = max(1, n // points)."""
    return (
        numbered(df, layout)
        .withColumn("_k", F.greatest(F.lit(1), F.floor(F.col("_n") / points)))
        .filter(F.col("pos") % F.col("_k") == 0)
        .drop("pos", "_k", "_n")
    )


def split_by_time(df: DataFrame, layout: Layout, fraction: float, out: str = "part") -> DataFrame:
    """First int(n * fraction) rows of each series are ``train``, the rest ``test``."""
    df = numbered(df, layout)
    return df.withColumn(
        out, F.when(F.col("pos") < F.floor(F.col("_n") * fraction), "train").otherwise("test")
    ).drop("pos", "_n")


def run_lengths(df: DataFrame, layout: Layout, state: str) -> DataFrame:
    """Runs of equal state: one row per run (keys, state, start, end, length)."""
    w = layout.window()
    by_state = Window.partitionBy(*layout.keys, state).orderBy(*layout.order)
    first = layout.order[0]
    return (
        df.withColumn("_run", F.row_number().over(w) - F.row_number().over(by_state))
        .groupBy(*layout.keys, state, "_run")
        .agg(F.min(first).alias("start"), F.max(first).alias("end"), F.count(F.lit(1)).alias("length"))
        .drop("_run")
    )


def transitions(df: DataFrame, layout: Layout, state: str) -> DataFrame:
    """Row-normalised counts of state -> next state over all series."""
    moves = (
        df.withColumn("from_state", F.lag(state).over(layout.window()))
        .filter(F.col("from_state").isNotNull())
        .groupBy("from_state", F.col(state).alias("to_state"))
        .agg(F.count(F.lit(1)).alias("moves"))
    )
    out = moves.groupBy("from_state").agg(F.sum("moves").alias("_all"))
    return moves.join(out, "from_state").select(
        "from_state", "to_state", "moves", (F.col("moves") / F.col("_all")).alias("probability")
    )


def calendar_fill(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """One row per calendar day between the first and last day of each series, values carried forward.

    Each observation is repeated up to the day before the next one: no calendar table, no join.
    """
    seen = df.filter(F.col(value).isNotNull())
    until = F.coalesce(F.date_sub(F.lead(ts).over(Window.partitionBy(key).orderBy(ts)), 1), F.col(ts))
    days = F.explode(F.sequence(F.col(ts), F.col("_until"), F.expr("interval 1 day")))
    return seen.withColumn("_until", until).select(key, days.alias(ts), value)


def asof(
    left: DataFrame, right: DataFrame, by: list[str], ts: str, right_ts: str, value: str, block: int | None = None
) -> DataFrame:
    """Backward as-of join: for each left row the last right value at or before it.

    Both sides are merged into one ordered series per key; no range join. With ``block`` a hot key is
    cut into blocks like any other raw series.
    """
    extra = [c for c in left.columns if c not in by and c != ts]
    a = left.select(
        *by,
        F.col(ts).alias("_t"),
        F.lit(1).alias("_side"),
        F.xxhash64(*left.columns).alias("_tie"),
        F.struct(*left.columns).alias("_row"),
    )
    b = right.select(
        *by,
        F.col(right_ts).alias("_t"),
        F.lit(0).alias("_side"),
        F.xxhash64(*right.columns).alias("_tie"),
        F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(right_ts).alias("t"))).alias("_seen"),
    )
    both = a.unionByName(b, allowMissingColumns=True)
    layout = Layout(tuple(by), ("_t", "_side", "_tie"), block)
    seen = running(both, layout, {"_last": ("last", F.col("_seen"))}).filter(F.col("_side") == 1)
    return seen.select(
        *by,
        F.col("_t").alias(ts),
        *[F.col("_row")[c].alias(c) for c in extra],
        F.col("_last.v").alias(value),
        F.col("_last.t").alias("as_of"),
    )


def sequences(df: DataFrame, layout: Layout, x: str, length: int, horizon: int) -> DataFrame:
    """Input windows of ``length`` rows with the value ``horizon`` rows after the window's end as label."""

    def stage(w: WindowSpec):
        frame = w.rowsBetween(1 - length, 0)
        return {"window": F.collect_list(x).over(frame), "label": F.lead(x, horizon).over(w)}

    done = windowed(df, layout, [stage], back=length - 1, ahead=horizon)
    return done.filter((F.size("window") == length) & F.col("label").isNotNull())


def ewm_lookback(span: float) -> int:
    """Rows after which a weight falls below double precision."""
    return math.ceil(-40.0 / math.log(1.0 - 2.0 / (span + 1.0)))
