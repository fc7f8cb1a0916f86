"""Column functions. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise import constants as K


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; nulls stay null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def bucketize(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed interval (edges[i], edges[i+1]]; null outside."""
    c = F.lit(None).cast("double")
    for i in reversed(range(len(edges) - 1)):
        c = F.when((x > edges[i]) & (x <= edges[i + 1]), float(i)).otherwise(c)
    return c


def quantile_bin(x: Column, edges: Column) -> Column:
    """Number of distinct inner edges below x: quantile bins with duplicate edges dropped."""
    inner = F.array_distinct(edges)
    return F.when(x.isNotNull(), F.size(F.filter(inner, lambda e: e < x)))


def width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width, right-closed bins over [lo, hi]; the minimum falls into bin 0."""
    return F.least(
        F.lit(bins - 1), F.greatest(F.lit(0), F.ceil(F.try_divide(x - lo, (hi - lo) / bins)).cast("int") - 1)
    )


def normalise_name(s: Column) -> Column:
    return F.translate(F.lower(s), " -", "__")


def resolve_outcome(s: Column) -> Column:
    """Normalised name with aliases replaced."""
    aliases = F.create_map(*[F.lit(v) for kv in K.OUTCOME_ALIASES.items() for v in kv])
    n = normalise_name(s)
    return F.coalesce(F.try_element_at(aliases, n), n)


def title(s: Column) -> Column:
    return F.initcap(F.translate(s, "_", " "))


def effect_sentence(treatment: Column, outcome: Column, effect: Column) -> Column:
    how = F.when(F.abs(effect) > 0.5, "significantly").when(F.abs(effect) > 0.2, "moderately").otherwise("slightly")
    way = F.when(effect > 0, "increases").otherwise("decreases")
    return F.format_string(
        "A 1%% increase in %s %s %s %s returns by %.1f%%",
        title(treatment),
        how,
        way,
        title(outcome),
        F.round(F.abs(effect) * 100, 1),
    )


def sensitivity_level(x: Column) -> Column:
    a = F.abs(x)
    return (
        F.when(a < 0.1, "Minimal")
        .when(a < 0.3, "Low")
        .when(a < 0.5, "Moderate")
        .when(a < 0.7, "High")
        .otherwise("Very High")
    )


def annual_return(mean: Column) -> Column:
    return mean * K.TRADING_DAYS


def annual_volatility(std: Column) -> Column:
    return std * F.sqrt(F.lit(float(K.TRADING_DAYS)))


def what_if_effect(sensitivity: Column, change: Column) -> Column:
    return sensitivity * change * 0.01


def confidence(sensitivity: Column) -> Column:
    return F.least(F.lit(0.95), 0.85 + F.abs(sensitivity) * 0.1)


def window_start(as_of: str, period: str) -> Column:
    """First day of a named period that ends at an explicit date."""
    return F.date_sub(F.to_date(F.lit(as_of)), K.PERIOD_DAYS.get(period, K.PERIOD_DAYS["1Y"]))


def find_column(columns: list[str], name: str) -> str | None:
    """Best column for a treatment or outcome name: exact, pattern, known candidate, then substring."""
    low = name.lower().replace(" ", "_").replace("-", "_")
    tries = [name, f"{name}_Change", f"{low}_Change", f"{name}_Return_1d", *K.COLUMN_CANDIDATES.get(low, ())]
    if low in K.SECTOR_KEYS:
        sector = next(s for s in K.SECTOR_ETFS.values() if s.lower() == low)
        tries.append(f"{sector}_Return_1d")
    known = set(columns)
    hit = next((c for c in tries if c in known), None)
    return hit or next((c for c in columns if low in c.lower()), None)


def sector_return_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.endswith("_Return_1d") and not c.startswith("SP500")]


def macro_change_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.endswith("_Change")]


def drop_target(df: DataFrame, sector: str) -> DataFrame:
    """Drop the target's own return columns from the features."""
    return df.drop(*[c for c in df.columns if sector in c and "Return" in c])
