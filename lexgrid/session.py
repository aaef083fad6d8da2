"""Sessions, and this package's code on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch on its way to Python, where the session leaves Spark's default of 64 MB.
BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python functions are found there.

    The archive is made on the driver and travels by Spark's own file server. Batches to Python are bounded by
    their bytes, as rows may hold very long texts; a bound that the session sets itself stays.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH)
    if getattr(context, "_lexgrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    tmp = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    shutil.copytree(root, Path(tmp, "code", root.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(tmp, f"{root.name}-{os.getpid()}")), "zip", Path(tmp, "code")))
    context._lexgrid_shipped = True


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster sessions come from outside."""
    settings = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"} | conf
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
