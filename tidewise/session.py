"""Session helpers. The library never needs a setting to be right; these only make it fast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tidewise", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine. On a cluster use the session that the cluster gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the one that ``spark.checkpoint.dir`` names, or on a local master a fresh one.

    Executors of a cluster share no local folder, so there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named and not current:
        spark.sparkContext.setCheckpointDir(named)
    elif not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewise-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the checkpoint folder, for tables and streams that a job writes on its way."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tidewise-{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a frame on shared storage, so that later stages survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def values_table(spark: SparkSession, columns: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """A fixed table as a LocalRelation, so that Spark knows its size and may broadcast it by itself."""

    def lit(v, kind):
        if v is None:
            return f"CAST(NULL AS {kind})"
        if kind in ("string", "date", "timestamp_ntz"):
            text = str(v).replace("\\", "\\\\").replace("'", "\\'")
            return f"'{text}'" if kind == "string" else f"{kind.upper()} '{text}'"
        return f"CAST({v!r} AS {kind})"

    names = ", ".join(n for n, _ in columns)
    body = ", ".join("(" + ", ".join(lit(v, k) for v, (_, k) in zip(r, columns)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
