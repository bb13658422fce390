"""Train, validation and test splits, and checks on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SEED
from .ordering import as_cols, with_position


def split_global_time(
    df: DataFrame,
    val_ratio: float = 0.1,
    test_ratio: float = 0.1,
    ts: str = "timestamp",
    tie: list[str] | tuple = (),
) -> DataFrame:
    """Label rows by their position in time: cuts are row counts, not moments."""
    placed = with_position(df, [ts, *tie], name="_pos")
    n = placed.count()
    val_from, test_from = int(n * (1 - val_ratio - test_ratio)), int(n * (1 - test_ratio))
    label = (
        F.when(F.col("_pos") < val_from, "train").when(F.col("_pos") < test_from, "val").otherwise("test")
    )
    return placed.withColumn("split", label).drop("_pos")


def split_user_last_k(
    df: DataFrame,
    val_k: int = 1,
    test_k: int = 1,
    ts: str = "timestamp",
    tie: list[str] | tuple = (),
    user: str = "user_idx",
    **bounds,
) -> DataFrame:
    """Each user's newest ``test_k`` rows are test, the ``val_k`` before them validation."""
    newest_first = [c.desc() for c in as_cols([ts, *tie])]
    placed = with_position(df, newest_first, keys=[user], name="_age", **bounds)
    label = (
        F.when(F.col("_age") < test_k, "test")
        .when(F.col("_age") < test_k + val_k, "val")
        .otherwise("train")
    )
    return placed.withColumn("split", label).drop("_age")


def take_split(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("split").isin(*names))


def train_entities(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def split_stats(df: DataFrame, ts: str = "timestamp", user: str = "user_idx") -> DataFrame:
    """Per split: rows, share, time range, users, and users that never occur in train."""
    per_user = df.groupBy(user, "split").agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")
    )
    in_train = per_user.where(F.col("split") == "train").select(user, F.lit(1).alias("_seen"))
    stats = (
        per_user.join(in_train, user, "left")
        .groupBy("split")
        .agg(
            F.sum("_n").alias("rows"),
            F.min("_lo").alias("min_ts"),
            F.max("_hi").alias("max_ts"),
            F.count(F.lit(1)).alias("users"),
            F.sum(F.when(F.col("_seen").isNull(), 1).otherwise(0)).alias("users_not_in_train"),
        )
    )
    everything = Window.partitionBy()  # over one row per split
    return stats.select(
        "split",
        "rows",
        (F.col("rows") / F.sum("rows").over(everything)).alias("share"),
        F.timestamp_seconds("min_ts").alias("first_time"),
        F.timestamp_seconds("max_ts").alias("last_time"),
        "users",
        "users_not_in_train",
    )


def shuffle_split(df: DataFrame, seed: int = SEED) -> DataFrame:
    return df.orderBy(F.rand(seed))


def check_temporal_order(df: DataFrame, ts: str = "timestamp", user: str = "user_idx") -> DataFrame:
    """Users whose validation starts before train ends, or test before validation ends."""

    def edge(fn, name: str):
        return fn(F.when(F.col("split") == name, F.col(ts)))

    per_user = df.groupBy(user).agg(
        edge(F.max, "train").alias("train_last"),
        edge(F.min, "val").alias("val_first"),
        edge(F.max, "val").alias("val_last"),
        edge(F.min, "test").alias("test_first"),
    )
    return per_user.where(
        (F.col("train_last") > F.col("val_first")) | (F.col("val_last") > F.col("test_first"))
    )


def check_split_counts(df: DataFrame, floor: int = 1000) -> DataFrame:
    """One row: rows per split and whether all are non-empty with a total above ``floor``."""
    names = ("train", "val", "test")
    counts = df.agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in names],
        F.count(F.lit(1)).alias("total"),
    )
    filled = reduce(lambda a, b: a & b, [F.col(s) > 0 for s in names])
    return counts.withColumn("ok", filled & (F.col("total") > floor))
