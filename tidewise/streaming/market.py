"""Structured Streaming: bars from ticks, latest quotes, and the trade ledger."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewise.operators import ledger as L
from tidewise.session import scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream: a folder of part files, or a single file, of which its folder is watched by exact name."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def tick_stream(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with an instant, so naive times are read as UTC."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.col("value").alias("price"),
    )


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars per window; ticks later than the watermark are dropped, closed windows are emitted once."""
    at = F.struct("ts", "event_id")
    agg = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )
    return agg.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Last price of each symbol; state is one row per symbol."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("symbol").agg(F.max_by("price", at).alias("price"), F.max("ts").alias("quoted_at"))


def freshness(quotes: DataFrame, as_of: str, seconds: int = 30) -> DataFrame:
    """Age of each quote at an explicit time, and whether it is still fresh."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp("quoted_at")
    return quotes.withColumn("age", age).withColumn("is_fresh", age.between(0, seconds))


#: Accounts are dealt to so many groups, whose trades of one micro-batch are sorted and packed together.
BUCKETS = 2048
FOLDED = ("is_valid", "symbol", "side", "shares", "price")


def _packed(trades: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``bucket, portfolio, trades``: one row per account of a micro-batch, its trades in order (null and NaN last) as
    columns of what the fold reads."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        account = rows["portfolio"].combine_chunks().dictionary_encode(null_encoding="encode")
        names = [str(i) for i in range(len(order) + 1)]
        keys = pa.table([account.indices, *(rows[c] for c in order)], names=names)
        at = pc.sort_indices(keys, [(c, "ascending") for c in names], null_placement="at_end")
        index = account.indices.take(at).to_numpy()
        first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
        columns = [rows[c].take(at).to_pylist() for c in FOLDED]
        ends = [*first[1:].tolist(), len(index)]
        trades = [pickle.dumps([c[i:j] for c in columns]) for i, j in zip(first.tolist(), ends)]
        out = [pa.repeat(key[0], len(first)), account.dictionary.take(pa.array(index[first])), pa.array(trades, pa.binary())]
        return pa.table(out, names=["bucket", "portfolio", "trades"])

    kind = trades.schema["portfolio"].dataType.simpleString()
    columns = dict.fromkeys(["portfolio", *FOLDED, *order])
    bucket = F.pmod(F.xxhash64("portfolio"), F.lit(BUCKETS)).alias("_bucket")
    return trades.select(bucket, *columns).groupBy("_bucket").applyInArrow(pack, f"bucket long, portfolio {kind}, trades binary")


def ledger(trades: DataFrame, order: tuple[str, ...], opening: float = L.OPENING_CASH) -> DataFrame:
    """Trade ledger with keyed state (cash and positions); emits the changed account after each batch.

    Trades of one micro-batch are applied in order; the source's ``maxFilesPerTrigger`` bounds a batch. A trade that
    arrives in a later batch is applied then, whatever its time. Rows, calls and state all cost far more at the border of
    JVM and Python than the fold itself: so an account is one row of a batch and one value of the state, and accounts
    share calls by bucket.
    """
    packed = _packed(L.checked(trades), order)
    from pyspark.sql.streaming import StatefulProcessor

    kind = trades.schema["portfolio"].dataType.simpleString()
    account = "cash double, positions string, accepted long, rejected long"
    names = ("symbol", "shares", "avg_cost")

    class Accounts(StatefulProcessor):
        def init(self, handle) -> None:
            self.accounts = handle.getMapState("accounts", f"portfolio {kind}", account)

        def handleInputRows(self, key, rows, timerValues):
            for _, portfolio, trades in rows:
                cash, positions, good, bad = self.accounts.getValue((portfolio,)) or (opening, "[]", 0, 0)
                held = {p["symbol"]: (p["shares"], p["avg_cost"]) for p in json.loads(positions)}
                for valid, sym, side, n, price in zip(*pickle.loads(trades)):
                    cash, what = L.step(cash, held, valid, sym, side, n, price)
                    good, bad = good + (what == "ok"), bad + (what != "ok")
                positions = json.dumps([dict(zip(names, (s, float(n), float(c)))) for s, (n, c) in sorted(held.items())])
                self.accounts.updateValue((portfolio,), (float(cash), positions, good, bad))
                yield Row(portfolio=portfolio, cash=float(cash), positions=positions, accepted=good, rejected=bad)

        def close(self) -> None:
            pass

    done = packed.groupBy("bucket").transformWithState(Accounts(), f"portfolio {kind}, {account}", "Update", "None")
    return done.withColumn("positions", F.from_json("positions", "array<struct<symbol:string,shares:double,avg_cost:double>>"))


# ---------------------------------------------------------------- running a stream to its end


def drain(df: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input, write it as Parquet and return what was written.

    Append results add up; complete and update results are kept by batch, the last batch of a key counts.
    """
    spark = df.sparkSession
    root = scratch_dir(spark, "stream")
    where = checkpoint or f"{root}/checkpoint"

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/_batch_no={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("_batch_no")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run with the state store that keyed state needs, then restore the session's own."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)
