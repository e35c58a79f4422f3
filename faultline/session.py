"""Session construction and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "faultline", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster passes its own session instead.

    ``shuffle_partitions`` defaults to the core count: locally every extra
    partition is pure scheduling cost.  On a cluster leave it to AQE
    (``spark.sql.adaptive.coalescePartitions``) with a generous initial number.
    """
    n = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores)) or 8
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FAULTLINE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _temporary_folder() -> str:
    folder = tempfile.mkdtemp(prefix="faultline-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local is a temporary folder
    used, removed when the program ends; on a cluster without the setting this
    raises, since a machine-local folder would not survive the loss of an
    executor.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", ""):
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary_folder()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the reliable checkpoint folder (see ``shared_folder``) and read back."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=eager)
