"""Session settings and the durable checkpoint folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def tuned(builder: SparkSession.Builder, shuffle_partitions: int | None = None) -> SparkSession.Builder:
    """Settings every job of this library expects; cluster sizing stays with the caller."""
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder


def local_session(cores: int | str = "*", app: str = "pricetide", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", str(16 * 1024 * 1024))
        .config("spark.checkpoint.dir", "file:///tmp/pricetide-local")
    )
    spark = tuned(builder, shuffle_partitions).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    The result outlives any executor, is computed once, and is planned on its real size.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch(spark: SparkSession) -> str:
    """The application's own folder: where the cluster says, else on the session's default filesystem."""
    root = shared_folder(spark)
    if root is None:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        if default.startswith("file:") and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{default.rstrip('/')}/tmp" if not default.startswith("file:") else "file:///tmp"
    return f"{root.rstrip('/')}/pricetide/{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for intermediate tables or streaming state."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame of `cut_lineage` that nothing reads any more."""
    spark = df.sparkSession
    own = _scratch(spark).removeprefix("file://")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
