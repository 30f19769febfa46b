"""Working tables in the folder that driver and executors share, and numbers for rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def workspace(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Only a local session may go without that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/leadloom-checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read again: the lineage ends here, lost executors take nothing with them, and the shuffle files go when the table is complete."""
    spark = df.sparkSession
    path = path or workspace(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[Column], column: str, at: str | None = None) -> DataFrame:
    """``df`` with numbers from 1 in an order, without sorting it in one task: ranges are sorted apart, and each begins where the ones before it end.

    The ranges are stored, so that a repeated task can't draw their bounds anew. Equal rows get numbers in any order.
    """
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    kept = stored(ranged, at)
    sizes = kept.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a part
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return kept.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + within).drop("__part", "__before")
