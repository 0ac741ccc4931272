"""Session helpers: building a session, shared work folders, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings the library relies on.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "linguaspark",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set and Spark runs in this one process (local tests) a
    folder of our own is created and registered; on a cluster that raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="linguaspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_STAGE_PATHS: list[str] = []


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (remembered for ``drop_stage_tables``)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGE_PATHS.append(path)
    return path


def drop_stage_tables(spark: SparkSession) -> int:
    """Delete the stage tables this process wrote to the shared folder; returns how many.

    Call after the job's results are written: DataFrames still reading a
    stage table fail once it is gone. Uses the Hadoop FileSystem API, so it
    works on any shared store.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _STAGE_PATHS:
        p = jvm.org.apache.hadoop.fs.Path(_STAGE_PATHS.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            n += 1
    return n


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_fs_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def path_exists(spark: SparkSession, path: str) -> bool:
    if is_local_path(path):
        return os.path.exists(local_fs_path(path))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and return a frame reading it.

    Used between iterations of driver loops and after expensive steps, so
    plans stay small and a lost executor never forces recomputation. One
    write job; the read back is lazy and columnar.
    """
    spark = df.sparkSession
    path = new_work_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_with_metrics(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """``cut_lineage`` that also returns aggregate metrics gathered during the same write.

    ``metrics`` are aggregate Columns (e.g. ``n=F.count_if(...)``); Spark's
    ``Observation`` collects them as the write job runs, so a driver loop
    can decide what to do next without a second job.
    """
    from pyspark.sql import Observation
    spark = df.sparkSession
    obs = Observation(name)
    observed = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    path = new_work_path(spark, name)
    observed.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), dict(obs.get)
