"""Keyed state of a stream as tables by batch and bucket, compacted and expired over a stated horizon.

A batch sees what earlier batches wrote into the buckets of its keys: the last snapshot and the batches since. Every ``every`` batches the
rows since are merged into a new snapshot, which leaves out what is older than the horizon allows, and the folders that it
replaces are removed one snapshot later. Whatever a batch reads was written by earlier batches only, and its own folders are
replaced when it is retried, so every attempt sees the same and leaves the same.

Time is that of the rows: the high mark is the latest time seen before the batch. Rows from before the high mark less the horizon are late;
they are written to a side table and take no part. Rows without a time count as of the high mark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # folders by hash of the key; a batch reads and writes only those its keys fall into
EVERY = 16  # batches between two snapshots


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def write_batch(rows: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Each batch has its own folder, which a retry replaces; a batch without rows leaves an empty one."""
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={batch_id}")


@dataclass(frozen=True)
class KeyedState:
    """``schema`` of the rows without ``at`` (their time), ``batch`` and ``bucket``; of the rows with one ``identity`` only the last counts.

    ``horizon_days`` None keeps everything. ``keep`` is how many horizons back rows are held: one is enough to know a key again, two to
    know the predecessor of a row that arrives at the end of the horizon."""

    path: str
    schema: str
    key: str
    identity: tuple[str, ...]
    horizon_days: int | None = None
    keep: int = 1
    every: int = EVERY

    def folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/{kind}/batch={batch_id}"

    def rows_in(self, session: SparkSession, folders: list[str]) -> DataFrame:
        schema = f"{self.schema}, at timestamp, batch long, bucket int"
        if not folders:
            return session.createDataFrame([], schema)
        parts = [session.read.schema(schema.replace(", batch long", ", written long")).parquet(f).withColumnRenamed("written", "batch") for f in folders]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = [f.split()[0] for f in self.schema.split(", ")] + ["at", "batch", "bucket"]
        last = rows.groupBy(*self.identity, "bucket").agg(F.max_by(F.struct(*names), "batch").alias("r"))
        return last.select("r.*")

    def _since(self, batch_id: int, snapshot: int) -> list[str]:
        """Folders that hold the state before a batch, from a snapshot on."""
        return ([self.folder("snapshots", snapshot)] if snapshot else []) + [self.folder("rows", b) for b in range(snapshot, batch_id)]

    def high_mark(self, session: SparkSession, batch_id: int) -> Column:
        """The latest time before the batch, as a literal; null before the first dated row."""
        if batch_id == 0:
            return F.lit(None).cast("timestamp")
        row = session.read.schema("high timestamp").parquet(self.folder("high", batch_id - 1)).agg(F.max("high")).first()
        return F.lit(row[0]).cast("timestamp")

    def cutoff(self, high: Column, horizons: int = 1) -> Column:
        if self.horizon_days is None:
            return F.lit(None).cast("timestamp")
        return high - F.make_dt_interval(days=F.lit(self.horizon_days * horizons))

    def begin(self, batch: DataFrame, time: str | None, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(rows, late) of a batch, with ``at`` and ``bucket``; makes the snapshot that is due and notes the high mark."""
        session = batch.sparkSession
        if batch_id and batch_id % self.every == 0:
            self._compact(session, batch_id)
        high = self.high_mark(session, batch_id)
        stamp = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
        rows = batch.withColumn("at", F.coalesce(stamp, high)).withColumn("bucket", bucket_of(self.key))
        rows.agg(F.greatest(F.max("at"), high).alias("high")).write.mode("overwrite").parquet(self.folder("high", batch_id))
        late = F.coalesce(F.col("at") < self.cutoff(high), F.lit(False))
        return rows.filter(~late), rows.filter(late).drop("bucket")

    def before(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The state in the buckets that the rows of a batch fall into."""
        session = rows.sparkSession
        folders = self._since(batch_id, batch_id // self.every * self.every)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()] if folders else []  # at most BUCKETS
        return self._latest(self.rows_in(session, folders).filter(F.col("bucket").isin(touched)))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """The rows that a batch adds or replaces; they need ``at`` and ``bucket``."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        rows.select(*names, "at", F.lit(batch_id).cast("long").alias("written"), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder("rows", batch_id))

    def _compact(self, session: SparkSession, batch_id: int) -> None:
        rows = self._latest(self.rows_in(session, self._since(batch_id, batch_id - self.every)))
        held = rows if self.horizon_days is None else rows.filter(F.coalesce(F.col("at") >= self.cutoff(self.high_mark(session, batch_id), self.keep), F.lit(True)))
        held.withColumnRenamed("batch", "written").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.folder("snapshots", batch_id))
        self._remove(session, batch_id - 2 * self.every, batch_id - self.every)

    def _remove(self, session: SparkSession, first: int, past: int) -> None:
        """Folders that no batch reads any more: those merged into the snapshot before the last."""
        context = session.sparkContext
        system = context._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(context._jsc.hadoopConfiguration())
        for b in range(max(first, 0), past):
            for kind in ("rows", "high", "snapshots"):
                system.delete(context._jvm.org.apache.hadoop.fs.Path(self.folder(kind, b)), True)
