"""Alert events from a stream: an append log and user callbacks, each alert once however often a batch is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "level string, camera_id long, t double, final_score double, trigger_reason string, involved_tracks array<bigint>, details string"


def alert_rows(events: DataFrame) -> DataFrame:
    """Scored events with their level as rows of the alert log; what a caller lacks is null, `details` is JSON of the rest."""
    names = [c.split()[0] for c in LOG.split(", ")]
    kinds = dict(c.split() for c in LOG.split(", "))
    rest = [c for c in events.columns if c not in names]
    details = F.col("details") if "details" in events.columns else F.to_json(F.struct(*rest)) if rest else F.lit(None)
    have = {**{c: F.col(c) for c in events.columns}, "details": details}
    return events.select(*(have.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names))


def handle_batch(path: str, on: dict[str, Callable[[DataFrame], None]] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: log the batch under its id, then call `on[level]` with the batch's alerts of that level.

    A batch that is tried again replaces its own part of the log. Callbacks run once for a batch: a marker is written
    after the last of them, and a batch that has one is not called back again. A batch that fails between
    the two is called back again, as nothing tells how far its callbacks came. The log is meant for one query; its
    folder is `path`, read it with `read_log`.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"{path}/log/batch_id={batch_id}"
        done = f"{path}/done/batch_id={batch_id}"
        if _exists(spark, done):
            return
        alert_rows(batch).write.mode("overwrite").parquet(part)
        rows = spark.read.schema(LOG).parquet(part)  # callbacks see what was logged, without computing the batch anew
        for level, call in (on or {}).items():
            call(rows.where(F.col("level") == level))
        spark.range(1).write.mode("overwrite").parquet(done)

    return run


def write_alerts(stream: DataFrame, path: str, checkpoint: str, on: dict[str, Callable[[DataFrame], None]] | None = None):
    """A stream writer of alerts (see `handle_batch`); `on` has a callback for ALERT, ALARM or both."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle_batch(path, on))


def read_log(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch_id long").parquet(f"{path}/log")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
