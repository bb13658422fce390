"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the columns of
``docs``. ``run`` writes every stage's table to the shared folder and reads it back for the next one.
Stages have no SQL twin (a fitted classifier decides first), so ORACLE_SQL is None and the stages are
held against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteloom.llm import cotraining, decontaminate, pivotal_mix, setsketch, sharding
from tasteloom.llm.words import prepare
from tasteloom.session import store

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    prepare(spark)
    return cotraining.keep_good(docs, _table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the hash of the text beside the id: ids may be null or stand for several texts."""
    return docs.withColumn("_text", F.xxhash64("text"))


def _same(docs: DataFrame, other: DataFrame):
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs["_text"] == other["text_key"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; rows with equal id and text stand as one.

    Rows that share an id but not a text are documents of their own, and so are those with a null id.
    """
    prepare(spark)
    kept = setsketch.near_duplicates(docs, identity=True).where("first").select("doc_id", "text_key").distinct()
    keyed = _keyed(docs)
    return keyed.join(kept, _same(keyed, kept), "left_semi").dropDuplicates(["doc_id", "_text"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    leaks = store(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), identity=True))
    leaks, keyed = leaks.select("doc_id", "text_key").distinct(), _keyed(docs)
    return keyed.join(leaks, _same(keyed, leaks), "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times).

    Rows with equal id, text and source stand as one: the first is taken as often as they are together.
    """
    prepare(spark)
    taken = pivotal_mix.mix_documents(docs).groupBy("doc_id", "text_key", "source")
    taken = taken.agg(F.sum("copies").alias("_times")).where("_times > 0")
    keyed = _keyed(docs).dropDuplicates(["doc_id", "_text", "source"])
    return (
        keyed.join(taken, _same(keyed, taken) & keyed["source"].eqNullSafe(taken["source"]))
        .select(*[keyed[c] for c in docs.columns], "_times")
        .withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .select(*docs.columns)
    )


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row of the mix."""
    prepare(spark)
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
