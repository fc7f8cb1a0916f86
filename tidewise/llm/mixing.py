"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate r, the number of times it is expected in the mix. Of all rates between 0 and the limit that
give each source its target number of words, those nearest to 1 in entropy are r = min(limit, exp(l * size / mean size)),
one multiplier l per source. Newton steps on the convex dual, kept inside a bracket, find the multipliers: a step is one
aggregation over the counts of (source, size). Rates become whole copies by systematic rounding along the sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.common import BLANKS, stored

#: Sources in order of code point weigh these, repeating.
WEIGHTS = (3, 1, 2)
#: Words wanted in all, as a part of the words there are (numerator, denominator), and the most copies of a document.
SHARE = (3, 2)
LIMIT = 2
#: Steps of the dual, and the part of the target that may be missed before rounding.
STEPS, NEAR = 60, 1e-7
#: Groups of equal (source, size) are numbered in so many slices, so that no single task holds a large one.
SLICES = 64
#: Rates are whole multiples of this part, so that sums of them are exact and reruns agree.
UNIT = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, limit: int = LIMIT) -> DataFrame:
    """``_source, source_size, target`` from ``_source, source_size``.

    Sources in order of code point, null last, share ``share`` of all words by weight. A target stops at ``limit`` times
    its source's size, and the excess is shared again by weight until none is above: with sources sorted by limit per
    weight, all targets are min(limit * size, level * weight) for one level.
    """
    one = F.lit(0).alias("_all")  # one row per source meets here
    order = Window.partitionBy("_all").orderBy(F.col("_source").isNull(), "_source")
    ranked = sizes.select("*", one).withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1)))
    whole = Window.partitionBy("_all")
    before = Window.partitionBy("_all").orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source").rowsBetween(Window.unboundedPreceding, -1)
    up, down = share
    level = (
        ranked.withColumn("_cap", F.col("source_size") * limit)
        .withColumn("_left", F.sum("source_size").over(whole) * up - F.coalesce(F.sum("_cap").over(before), F.lit(0)) * down)
        .withColumn("_weights", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # The first source that its level leaves below the limit has the level of all; those behind it have smaller ones.
        .withColumn("_level", F.when(F.col("_left") * F.col("_w") <= F.col("_cap") * down * F.col("_weights"), F.col("_left") / (F.col("_weights") * down)))
        .withColumn("_level", F.max("_level").over(whole))
    )
    free = F.col("_level") * F.col("_w")
    return level.select("_source", "source_size", F.when(F.col("_cap") <= free, F.col("_cap").cast("double")).otherwise(free).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def multipliers(counts: DataFrame, goals: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``_source, _mean, _l``: the dual's solution. ``counts``: ``_source, _size, _n``, without empty documents.

    A target that equals the limit of its source has no finite solution; its multiplier is null, and all rates are the limit.
    """
    means = counts.groupBy("_source").agg((F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("_mean"), F.min("_size").alias("_least"))
    state = means.join(goals, means["_source"].eqNullSafe(goals["_source"])).select(
        means["_source"],
        "_mean",
        "target",
        F.when(F.col("target") < F.col("source_size") * limit, F.lit(0.0)).alias("_l"),
        # At the lower end all rates are below a part of the target, at the upper end all are at the limit.
        (-F.lit(1.0) * (F.log(F.col("source_size") / F.greatest("target", F.lit(1e-300))) + 1) * F.col("_mean") / F.col("_least")).alias("_low"),
        (F.log(F.lit(float(limit))) * F.col("_mean") / F.col("_least")).alias("_high"),
    )
    state = stored(state)
    for _ in range(STEPS):
        joined = counts.join(state, counts["_source"].eqNullSafe(state["_source"])).drop(counts["_source"])
        r = _rate(F.col("_l"), F.col("_size"), F.col("_mean"), limit)
        mass = F.col("_size") * F.col("_n") * r
        slope = F.when(r < limit, mass * F.col("_size") / F.col("_mean")).otherwise(0.0)
        sums = joined.groupBy("_source", "_mean", "target", "_l", "_low", "_high").agg(F.sum(mass).alias("_sum"), F.sum(slope).alias("_slope"))
        off = F.col("_sum") - F.col("target")
        low, high = F.when(off < 0, F.col("_l")).otherwise(F.col("_low")), F.when(off >= 0, F.col("_l")).otherwise(F.col("_high"))
        newton = F.col("_l") - off / F.col("_slope")
        step = F.when((F.col("_slope") > 0) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        done = (F.abs(off) <= F.col("target") * NEAR) | F.col("_l").isNull()
        state = stored(
            sums.select("_source", "_mean", "target", F.when(done, F.col("_l")).otherwise(step).alias("_l"), F.when(done, F.col("_low")).otherwise(low).alias("_low"), F.when(done, F.col("_high")).otherwise(high).alias("_high"), done.alias("_done"))
        )
        if state.where("NOT _done").isEmpty():
            break
        state = state.drop("_done")
    return state.select("_source", "_mean", F.round("_l", 9).alias("_l"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, limit: int = LIMIT) -> DataFrame:
    """Columns ``keep``, then ``_id, _size, _source_size, _target, _copies``, one row per row of ``df``.

    Sizes are words; null texts and texts of blanks have none, and no copies beyond those of the smallest rate. A null
    source is a source of its own, the last one. Rows with equal ids are documents of their own. An empty table gives none.
    """
    base = df.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_size"), F.col(source_col).cast("string").alias("_source"))
    # Rows of equal source and size fall into slices by a hash of their id.
    base = base.withColumn("_slice", F.pmod(F.xxhash64("_id"), F.lit(SLICES)).cast("int"))
    sliced = stored(base.groupBy("_source", "_size", "_slice").agg(F.count("*").alias("_n")))
    counts = stored(sliced.groupBy("_source", "_size").agg(F.sum("_n").alias("_n")))
    sizes = counts.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    goals = stored(targets(sizes, weights, share, limit))
    solved = multipliers(counts.where("_size > 0"), goals.where("source_size > 0"), limit)
    rated = (
        counts.join(goals.withColumnRenamed("_source", "_g"), F.col("_source").eqNullSafe(F.col("_g")))
        .drop("_g")
        .join(solved.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
        .drop("_s")
        .withColumn(
            "_rate",
            F.when(F.col("_size") == 0, F.lit(0)).when(F.col("_l").isNull(), F.lit(limit * UNIT)).otherwise(F.round(_rate(F.col("_l"), F.col("_size"), F.col("_mean"), limit) * UNIT)).cast("long"),
        )
    )
    # Where each (source, size), and each slice of it, begins on the line of summed rates.
    along = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    begins = rated.withColumn("_begin", F.coalesce(F.sum(F.col("_rate") * F.col("_n")).over(along), F.lit(0)))
    inside = Window.partitionBy("_source", "_size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n")
    b = begins.select(F.col("_source").alias("_b"), F.col("_size").alias("_bs"), "source_size", "target", "_rate", "_begin")
    # Numbers and places by the same columns, none of them null, so that documents travel once.
    name = {"_name": F.coalesce("_source", F.lit("")), "_none": F.col("_source").isNull()}
    group = [*name, "_size", "_slice"]
    places = stored(
        slices.join(b, F.col("_source").eqNullSafe(F.col("_b")) & (F.col("_size") == F.col("_bs")))
        .withColumns(name)
        .select(*group, "source_size", "target", "_rate", (F.col("_begin") + F.col("_rate") * F.col("_before")).alias("_start"))
    )
    numbered = base.withColumns(name).withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy("_id")) - 1)
    placed = numbered.join(places, group)
    whole = lambda c: F.floor((c + UNIT // 2) / UNIT)
    start = F.col("_start") + F.col("_k") * F.col("_rate")
    copies = (whole(start + F.col("_rate")) - whole(start)).cast("long")
    return placed.select(*[F.col(f"k_{c}").alias(c) for c in keep], "_id", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"))
