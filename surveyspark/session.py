"""Session helpers: settings the operators rely on and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Wall times are stored without a zone; a UTC session keeps them free of DST gaps."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build(app: str = "surveyspark", cpus: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def scratch_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, a local one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared folder, so lost executors cost no rework."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: by column and compressed, so wide rows take a part of a checkpoint."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` as a join side that is sorted by key, never broadcast.

    Spark's estimate does not count the rows an explode makes, so a table of millions of pieces may pass
    for a small one and be gathered on the driver.
    """
    return df.hint("merge")
