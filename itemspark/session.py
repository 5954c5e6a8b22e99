"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module: str) -> None:
    """Send the functions of a module to the workers along with the job, so the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("itemspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, readable by every executor.

    A machine-local folder is only accepted under a local master, where all
    tasks share one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="itemspark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` so that a lost executor cannot change its row placement."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that steps that need it several times do not work it out again."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _on_hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in any file system that Spark reads."""
    system, where = _on_hadoop(spark, path)
    return system.exists(where)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files of a folder, in any file system that Spark reads."""
    system, where = _on_hadoop(spark, path)
    return system.getContentSummary(where).getLength()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, if it is there."""
    system, where = _on_hadoop(spark, path)
    system.delete(where, True)
