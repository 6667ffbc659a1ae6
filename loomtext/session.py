"""Session and scratch-table helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench use."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Whether Spark deletes a query's shuffle files at its end; later reads of a written table need none of them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that spark.checkpoint.dir names.

    Only a local session, whose executors are the driver, may leave it unset and gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loomtext-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "t", row_group: int | None = None) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder and read it again.

    Compressed and columnar, so cheaper than checkpoint(); it survives the loss of executors. The shuffle files that led
    to it go once it is written. row_group: bytes of a row group, for tables of large rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_.scratch_path = path
    return table_


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` from which nothing will be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of the folder. With `spread`, one that is read in fewer tasks than there are cores is dealt out to all.

    For work that costs far more for each row than moving it; a table of many files is left as it is read.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
