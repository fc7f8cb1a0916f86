"""JSON columns and files: portfolio weights and holdings, causal graphs, the model registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "map<string,double>"
HOLDINGS = "map<string,struct<shares:double,avg_cost:double>>"
GRAPH = (
    "struct<nodes:array<struct<id:string,label:string,type:string>>,"
    "edges:array<struct<`from`:string,`to`:string,strength:double,confidence:double>>>"
)


def explode_weights(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """JSON object of weights -> one row per symbol; a missing object has no rows."""
    parsed = F.coalesce(F.from_json(json_col, WEIGHTS), F.create_map().cast(WEIGHTS))
    return df.select(*keep, F.explode(parsed).alias("symbol", "w"))


def explode_holdings(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    parsed = F.coalesce(F.from_json(json_col, HOLDINGS), F.create_map().cast(HOLDINGS))
    return df.select(*keep, F.explode(parsed).alias("symbol", "h")).select(
        *keep, "symbol", F.col("h.shares").alias("shares"), F.col("h.avg_cost").alias("avg_cost")
    )


def graph_nodes(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    g = F.from_json(json_col, GRAPH)
    return df.select(*keep, F.explode(g["nodes"]).alias("n")).select(*keep, "n.id", "n.label", "n.type")


def graph_edges(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    g = F.from_json(json_col, GRAPH)
    return df.select(*keep, F.explode(g["edges"]).alias("e")).select(
        *keep, F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.strength", "e.confidence"
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Model registry file -> models. A file that is neither layout gives no rows."""
    return parse_registry(spark.read.text(path, wholetext=True), "value")


def parse_registry(docs: DataFrame, json_col: str) -> DataFrame:
    """Registry documents in either layout -> (model_type, model_id, version, metrics, registered_at, is_active).

    Flat layout: models -> id -> entry. Nested layout: models -> type -> id -> entry.
    Metrics that are not numbers are dropped.
    """
    entry = "struct<type:string,version:string,registered_at:string,metrics:map<string,string>>"
    doc = docs.select(
        F.from_json(json_col, "struct<models:map<string,string>,active_versions:map<string,string>>").alias("d")
    ).filter(F.col("d.models").isNotNull())
    top = doc.select(F.explode("d.models").alias("k", "body"), F.col("d.active_versions").alias("active"))
    flat = F.from_json("body", entry)["type"].isNotNull()
    nested = F.from_json("body", "map<string,string>")
    models = top.withColumn("entries", F.when(flat, F.create_map("k", "body")).otherwise(nested)).select(
        "active", F.explode("entries").alias("model_id", "body")
    )
    e = models.select("active", "model_id", F.from_json("body", entry).alias("e")).filter(F.col("e.type").isNotNull())
    numeric = F.map_filter(
        F.transform_values("e.metrics", lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull()
    )
    active = F.try_element_at("active", F.col("e.type")) == F.col("model_id")
    return e.select(
        F.col("e.type").alias("model_type"),
        "model_id",
        F.col("e.version").alias("version"),
        numeric.alias("metrics"),
        F.try_to_timestamp("e.registered_at").alias("registered_at"),
        F.coalesce(active, F.lit(False)).alias("is_active"),
    )
