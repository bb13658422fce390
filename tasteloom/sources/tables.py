"""Readers and writers. Tables are Parquet; catalogues, ratings and reports are CSV."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import as_cols, top_per_group
from ..schemas import CATALOGUE, RATINGS, SEED, SPLITS


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).option("header", True).csv(path)


def read_catalogue(spark: SparkSession, path: str, on_dup: str = "first", order_by=None) -> DataFrame:
    """Titles and genres; of rows with the same id the first or last in ``order_by`` is kept.

    Without ``order_by`` the place in the file decides (file name, then offset of the row's block,
    then row number in it).
    """
    raw = spark.read.schema(CATALOGUE).option("header", True).option("escape", '"').csv(path)
    return unique_catalogue(raw, on_dup, order_by)


def unique_catalogue(raw: DataFrame, on_dup: str = "first", order_by=None, key: str = "movieId") -> DataFrame:
    columns = raw.columns
    if order_by is None:
        raw = raw.select(
            "*",
            F.col("_metadata.file_path").alias("_f"),
            F.col("_metadata.file_block_start").alias("_b"),
        ).withColumn("_r", F.monotonically_increasing_id())
        order_by = ["_f", "_b", "_r"]
    order = as_cols(order_by)
    if on_dup == "last":
        order = [c.desc() for c in order]
    return top_per_group(raw, [key], order, 1, "_n").select(*columns)


def write_split(df: DataFrame, path: str) -> None:
    """One folder per split value, so that reading a split prunes the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, splits=SPLITS) -> DataFrame:
    """The asked splits that exist; an error if none does."""
    df = spark.read.parquet(path).where(F.col("split").isin(*splits))
    if df.isEmpty():
        raise FileNotFoundError(f"no rows of {', '.join(splits)} under {path}")
    return df


def read_split_dirs(spark: SparkSession, base: str, splits=SPLITS) -> DataFrame:
    """As ``read_split`` for separate ``<split>.parquet`` tables; missing ones are skipped."""
    found = None
    for name in splits:
        try:
            part = spark.read.parquet(f"{base}/{name}.parquet").withColumn("split", F.lit(name))
        except AnalysisException:
            continue
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise FileNotFoundError(f"no split tables under {base}")
    return found


def read_columns(spark: SparkSession, path: str, cols) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def write_id_map(df: DataFrame, path: str) -> None:
    df.select("idx", "raw_id").write.mode("overwrite").parquet(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def vocab_sizes(
    user_map: DataFrame | None, item_map: DataFrame | None, train: DataFrame | None = None
) -> tuple[int, int]:
    """Sizes of both maps; without maps, the largest train id plus one."""
    if user_map is not None and item_map is not None:
        return user_map.count(), item_map.count()
    row = train.agg(F.max("user_idx"), F.max("item_idx")).first()
    return int(row[0]) + 1, int(row[1]) + 1


def write_embeddings(df: DataFrame, path: str, key: str = "id", partitions: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that a look-up of few keys reads few row groups."""
    sized = df.repartitionByRange(*([partitions] if partitions else []), key)
    sized.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_sequences(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_sequences(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """The sequence table (an error if missing); shuffled only if a seed is given."""
    seqs = spark.read.parquet(path)
    return seqs if shuffle_seed is None else seqs.orderBy(F.rand(shuffle_seed))


def read_validation_sequences(spark: SparkSession, path: str) -> DataFrame:
    return read_sequences(spark, path, SEED)


def write_results_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_score_cache(spark: SparkSession, path: str) -> DataFrame:
    """The keyed score cache from a JSON object ``{"user_item": score}`` (one object per line)."""
    raw = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    pairs = raw.select(F.explode("m").alias("key", "score"))
    parts = F.split("key", "_")
    return pairs.select(
        parts[0].cast("long").alias("user_idx"), parts[1].cast("long").alias("item_idx"), "score"
    )
