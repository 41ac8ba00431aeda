"""The audit log as a stream: linking of arriving events, and marks that follow them.

An extension: batches of events are linked in the order they arrive, each batch behind the head of the log it is appended to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evigrain.functions import fixed
from evigrain.operators import audit


def head(log: DataFrame) -> str:
    """The hash a new event is linked behind."""
    last = log.agg(F.max_by("event_hash", "seq").alias("h")).first()
    return (last and last.h) or fixed.GENESIS


def link_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append arriving events (seq, event_id, ...) to the linked log at ``path``, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, and its head is that of the batches before it, so the
    log is the same as if nothing had failed. One query writes a log.
    """
    spark = events.sparkSession

    def append(batch: DataFrame, number: int) -> None:
        before = read_log(spark, path)
        begun = fixed.GENESIS if before is None else head(before.where(F.col("batch") < number))
        audit.link(batch, begun).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark, path: str) -> DataFrame | None:
    """The linked log, or nothing before its first batch."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) or not len(files.listStatus(at)):
        return None
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def marks_stream(events: DataFrame) -> DataFrame:
    """Marks of all units as a streaming aggregate, kept per unit; to be written in update or complete mode."""
    return audit.marks(events)
