"""Session settings and the few places where a job has to know its cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TASK_BYTES = 1024 * 1024
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str = "*", app: str = "helixmill", memory: str = "16g") -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """Round-robin an input over the cores, about a MB of its files to a task.

    A file is read by as many tasks as it has row groups, which may be a single one for a GB, however
    many splits there are. Rows are spread as they were read, before anything is computed from them, and the
    number of tasks follows the optimizer's size estimate: a task's rows stay few at any size.
    """
    least = df.sparkSession.sparkContext.defaultParallelism * tasks_per_core
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= 1 << 56:  # Spark's stand-in for a size it does not know, as of rows that come from the driver
        return df.repartition(least)
    return df.repartition(max(least, -(-estimate // TASK_BYTES)))


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder; a private one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_FOLDERS:  # the setting itself cannot be changed in a running session
            _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return _LOCAL_FOLDERS[application]
    return None


def materialize(df: DataFrame) -> DataFrame:
    """Run ``df`` once and hand back its rows with the lineage cut.

    Used where several consumers read one expensive scan. The rows go to a table in the shared
    folder, so losing executors later costs a re-read, not a re-scan, and each consumer still
    prunes columns. Without a shared folder the rows are persisted (recomputable on loss).
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder}/helixmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
