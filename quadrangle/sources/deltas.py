"""A stored table as a base and small changes over it.

Layout under ``root/name``:

* ``base=<e>``   the whole table as it was after epoch e
* ``delta=<e>``  what epoch e changed: ``added`` rows and ``deleted`` keys

An epoch writes only its own rows and keys, then a commit mark; what has no
mark isn't read.  A read merges the newest base with the epochs after it: a
row goes when a later epoch deletes its key, and an epoch that replaces a row
deletes the key and adds the new row.  A replayed epoch reads the epochs
before it and writes its own folder anew, so it gives the same table.  Every
``compact_every`` epochs the merged table is written as a new base, which
bounds how many folders a read goes through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DeltaTable:
    def __init__(self, spark: SparkSession, root: str, name: str, key: str = "id", compact_every: int = 16):
        self.spark, self.key, self.compact_every = spark, key, compact_every
        self.path = f"{root.rstrip('/')}/{name}"

    # -- files ----------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _mark(self, folder: str) -> None:
        self._fs().create(self._path(folder, "_COMMITTED"), True).close()

    def epochs(self, kind: str, before: int | None = None) -> list[int]:
        """Committed epochs of a kind (``base`` or ``delta``), ascending."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        found = [int(n.split("=")[1]) for n in names
                 if n.startswith(f"{kind}=") and fs.exists(self._path(n, "_COMMITTED"))]
        return sorted(e for e in found if before is None or e < before)

    def _write(self, df: DataFrame, folder: str, part: str = "") -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{folder}{part}")

    # -- writes -----------------------------------------------------------------
    def create(self, table: DataFrame) -> None:
        """The table before the first epoch."""
        self._write(table, "base=-1", "/rows")
        self._mark("base=-1")

    def commit(self, epoch: int, added: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Epoch ``epoch``: ``added`` rows, and the keys in ``deleted``, which
        leave rows of earlier epochs only."""
        folder = f"delta={epoch}"
        for stale in (f"base={epoch}", folder):  # of an attempt that failed, or of the first run of a replay
            self._fs().delete(self._path(stale), True)
        if added is not None:
            columns = self.read(before=epoch).columns
            self._write(added.select(columns), folder, "/added")
        if deleted is not None:
            self._write(deleted.select(self.key).distinct(), folder, "/deleted")
        self._mark(folder)
        base = self.epochs("base", before=epoch)[-1]
        if len([e for e in self.epochs("delta", before=epoch + 1) if e > base]) >= self.compact_every:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        """Write the table as it is after ``epoch`` as a base."""
        folder = f"base={epoch}"
        if epoch in self.epochs("base"):
            return
        rows = self.read(before=epoch + 1)
        self._fs().delete(self._path(folder), True)
        self._write(rows, folder, "/rows")
        self._mark(folder)

    def vacuum(self, replayable: int) -> list[str]:
        """Delete the folders that no read before epoch ``replayable``, or
        after, needs; their names."""
        keep = self.epochs("base", before=replayable)[-1]
        gone = [f"base={e}" for e in self.epochs("base") if e < keep] + [f"delta={e}" for e in self.epochs("delta") if e <= keep]
        for folder in gone:
            self._fs().delete(self._path(folder), True)
        return gone

    # -- reads --------------------------------------------------------------------
    def read(self, before: int | None = None) -> DataFrame:
        """The table as it was before epoch ``before``, or as it is now."""
        base = self.epochs("base", before)[-1]
        fs = self._fs()
        rows = [self.spark.read.parquet(f"{self.path}/base={base}/rows").withColumn("_epoch", F.lit(base))]
        columns, deleted = rows[0].columns[:-1], []
        for e in self.epochs("delta", before):
            if e <= base:
                continue
            for part, into in (("added", rows), ("deleted", deleted)):
                if fs.exists(self._path(f"delta={e}", part)):
                    into.append(self.spark.read.parquet(f"{self.path}/delta={e}/{part}").withColumn("_epoch", F.lit(e)))
        out = reduce(DataFrame.unionByName, rows)
        if deleted:
            last = reduce(DataFrame.unionByName, deleted).groupBy(self.key).agg(F.max("_epoch").alias("_deleted"))
            out = out.join(last, self.key, "left").filter(F.col("_deleted").isNull() | (F.col("_epoch") >= F.col("_deleted")))
        return out.select(columns)
