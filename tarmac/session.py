"""Session defaults and the few cluster settings the library depends on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_DIRS: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "tarmac") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    b = (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("TARMAC_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tarmac_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tarmac"), "zip", root, "tarmac"))
    sc._tarmac_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on and ship the package, on a session we were handed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in spark.checkpoint.dir."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        path = _LOCAL_DIRS[app]
    return path


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most `limit` rows, reading no more than limit+1 of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """Broadcast only after counting; otherwise leave the join to shuffle."""
    return F.broadcast(df) if is_small(df, limit) else df


def stage(df: DataFrame, *by: str) -> DataFrame:
    """Write df once as parquet in the shared folder, in a folder for each value of `by`, and read it back.

    For results with several consumers: they are computed once, the plan stays small, readers keep
    column pruning and size statistics, and a lost executor costs a re-read instead of a recompute.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Ahead of costly per-row work: do not leave a table in few or uneven splits to a few cores.

    A small file may list several splits while one of them holds its only row group, so anything
    under four splits per core is re-spread; a table read from many splits is returned as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 4 * n else df.repartition(2 * n, *keys)
