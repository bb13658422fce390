"""The star-schema test tables seen as interactions, catalogue, vectors, requests and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERACTION_TIE = ["l_orderkey", "l_linenumber", "item_idx", "l_suppkey"]
INTERACTION_ORDER = ["timestamp", *INTERACTION_TIE]
EVENT_ORDER = ["ts", "event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ratings of parts by customers."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("user_idx"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        F.col("l_partkey").alias("item_idx"),
        (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"),
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "user_idx", "item_idx", "rating", "timestamp", "l_orderkey", "l_linenumber", "l_suppkey"
    )


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ratings of items that have vectors."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user_idx"),
        F.get_json_object("props", "$.k").cast("long").alias("item_idx"),
        F.least(F.lit(5.0), F.ceil(F.col("value") / 10) / 2).alias("rating"),
        "ts",
        "event_id",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as titles with a year (some without) and genres (some missing)."""
    key = F.col("p_partkey")
    year = (F.lit(1950) + F.col("p_size")).cast("string")
    return table(spark, sf_dir, "part").select(
        key.alias("item_idx"),
        F.when(key % 17 == 0, F.col("p_name"))
        .otherwise(F.concat("p_name", F.lit(" ("), year, F.lit(")")))
        .alias("title"),
        F.when(key % 13 == 0, "(no genres listed)")
        .otherwise(F.concat("p_type", F.lit("|"), "p_brand"))
        .alias("genres"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_idx"), "embedding", "label"
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as served requests: views are cache hits, errors are failures."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("component"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value").alias("latency_ms"),
    )
