"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.session import checkpoint_dir

#: White space that separates words: blank and the controls from tab to carriage return.
BLANKS = "\x20\x09-\x0d"


def scratch(spark: SparkSession) -> str:
    """A new folder name inside the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidewise-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def bit_map(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A bit map of a column of longs without nulls, of fixed size; ``bits`` is a multiple of 32."""
    at = F.pmod(key, F.lit(bits))
    rows = keys.select(F.shiftright(at, 5).alias("w"), F.pmod(at, F.lit(32)).cast("int").alias("i")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("v")).toPandas()
    words = np.zeros(bits // 32, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return words


def may_be_in(words: Broadcast, key: Column) -> Column:
    """Whether a bit map has the bit of a long, or of the first eight bytes of a binary; false for null. Only the keys reach
    Python. Rows that pass need a join with the keys themselves; the others need not travel to one."""

    @F.arrow_udf("boolean")
    def look(keys: pa.Array) -> pa.Array:
        if pa.types.is_integer(keys.type):
            longs = keys.fill_null(0).to_numpy(zero_copy_only=False)
        else:
            longs = np.frombuffer(b"".join((k or b"")[:8].ljust(8, b"\0") for k in keys.to_pylist()), "<i8")
        at = longs % (32 * len(words.value))
        hit = (words.value[at >> 5] >> (at & 31)) & 1
        return pa.array((hit == 1) & keys.is_valid().to_numpy(zero_copy_only=False))

    return look(key)


def lean(run):
    """The same function over Arrow batches; what a batch leaves in Arrow's pool goes back to the system. Workers are reused:
    while they wait, and for the rest of the job, they would keep the most that any task of theirs has had."""

    def over(batches):
        pool = pa.default_memory_pool()

        def fed():
            for b in batches:
                yield b
                del b
                pool.release_unused()

        yield from run(fed())
        pool.release_unused()

    return over
