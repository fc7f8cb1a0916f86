"""Query registry: one Spark builder and, where SQL can say it, one oracle statement per query.

The output rules (rounding of doubles, dates as text) are stated once and applied to both sides,
so the library functions themselves return natural types and unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.plans import views


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    places: dict[str, int] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    stamps: tuple[str, ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        fixed = {c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in self.places.items()}
        fixed |= {c: F.date_format(c, "yyyy-MM-dd") for c in self.dates}
        fixed |= {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in self.stamps}
        return df.withColumns(fixed) if fixed else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        fixed = [f'round(CAST("{c}" AS DOUBLE), {n}) + 0.0 AS "{c}"' for c, n in self.places.items()]
        fixed += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in self.dates]
        fixed += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in self.stamps]
        replace = f" REPLACE ({', '.join(fixed)})" if fixed else ""
        return views.statement(self.sql, replace)


REGISTRY: dict[str, Query] = {}


def query(
    name: str,
    ids: str,
    sql: str | None = None,
    r: str = "",
    dates: str = "",
    stamps: str = "",
):
    """Register ``build(spark, sf_dir)``. ``r`` is e.g. ``"close:4 ret:6"``."""
    places = {}
    for item in r.split():
        col, _, n = item.partition(":")
        places[col] = int(n or 6)

    def wrap(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), build, sql, places, tuple(dates.split()), tuple(stamps.split()))
        return build

    return wrap
