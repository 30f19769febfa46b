"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def session(master: str | None = None, app: str = "leadloom", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return builder.config(map=fixed | conf).getOrCreate()


#: Rows that Python workers get at once, where nothing else is set: texts are long, and batches of Spark's default of 10,000
#: rows take tens of megabytes on both sides.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers wherever it isn't already, and sends them small batches."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_leadloom_shipped", False):
        return spark
    if sc.master == "local" or sc.master.startswith("local["):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    else:
        with tempfile.TemporaryDirectory() as at:
            sc.addPyFile(shutil.make_archive(f"{at}/leadloom", "zip", ROOT, "leadloom"))
    sc._leadloom_shipped = True
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files make fewer tasks than that, for work that costs more than its data are large. Large tables have more files than there are cores and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
