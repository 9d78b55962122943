"""Checked appends on a stream.

The reference has no stream; its write rules take one request at a time.
Here each micro-batch of incoming rows is one batch for the bulk rule
(W1 / W13): ``foreachBatch`` reads the table as it was before the epoch,
applies the rule once, and commits what was accepted as the epoch's change
over the stored table (:class:`sources.deltas.DeltaTable`), beside the
rejected rows.  An epoch so writes what it changed and not the table.  The
checkpoint location makes the query restartable after a driver or executor
loss: a replayed epoch reads the epochs before it and writes its own folder
anew, so replays are idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import ChangeSet
from ..sources.deltas import DeltaTable


def latest_version(spark: SparkSession, root: str, name: str, before: int | None = None
                   ) -> str | None:
    """Path of the newest committed version (by the epoch in its name),
    optionally only among epochs below ``before``."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(path)
            if s.getPath().getName().startswith("epoch=")
            and (before is None or int(s.getPath().getName().split("=")[1]) < before)
            and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        return None
    last = max(done, key=lambda n: int(n.split("=")[1]))
    return f"{root.rstrip('/')}/{name}/{last}"


def checked_append_stream(stream: DataFrame, base_path: str, sink_root: str, name: str,
                          rule: Callable[[DataFrame, DataFrame], ChangeSet],
                          checkpoint: str, trigger: dict | None = None, key: str = "id",
                          compact_every: int = 16):
    """Start a streaming query that applies ``rule(table, batch)`` to every
    micro-batch.  ``seq`` (arrival order) is required on the stream rows.  The
    rule's report should be written (``materialize=True``), so that accepted
    and rejected rows don't run it twice."""
    spark = stream.sparkSession
    table = DeltaTable(spark, sink_root, name, key, compact_every)
    if not table.epochs("base"):
        table.create(spark.read.parquet(base_path))

    def apply(batch: DataFrame, epoch: int):
        cs = rule(table.read(before=epoch), batch)
        rej = f"{sink_root.rstrip('/')}/{name}_rejected/epoch={epoch}"
        cs.rejected.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(rej)
        table.commit(epoch, added=cs.accepted)

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
