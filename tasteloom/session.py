"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; all are safe to set on a live session.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot user or item must be split even if that costs one more exchange later
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what later jobs need is stored: the shuffle files of a job go when it ends
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# Only for the small tables of tests and the bench: keep all cores busy.
LOCAL_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.files.openCostInBytes": "131072",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for an application.

    Workers unpickle kernels by module name, so they need the package whatever folder the driver was
    started from. The archive goes out through Spark's own file service.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tasteloom-package-")
    archive = os.path.join(folder, "tasteloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tasteloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in LOCAL_SETTINGS.items():
        spark.conf.set(key, value)
    return configure(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster has to name one. A local-mode session, where driver and executors are one process, gets a
    folder of its own if none is named, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tasteloom-"))
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return named


_STORED: list[str] = []


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, pins rows whose value depends on partition numbers, and gives the optimizer
    real file sizes to plan the next join with.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition a small table by ``cols`` before its rows are multiplied, so that the new rows
    are made on all cores and are already grouped by ``cols``."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def drop_stored(spark: SparkSession) -> int:
    """Delete the intermediate tables this process wrote; call it when no result is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped
