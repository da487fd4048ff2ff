"""Continuous intake: labels, deduplication, change detection and counts.

Late and early rows are labelled by the same verdict as in batch, and none is dropped: state is kept in
tables by batch and bucket instead of behind a watermark, so a stream gives what the batch gives; rows from before a stated
horizon go to a side table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators.candidates import change_history
from leadflow.streaming.state import EVERY, KeyedState, write_batch


def is_folder(spark: SparkSession, path: str) -> bool:
    """A stream of a folder takes all its files; a single file is found by name in the folder above it."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(folder).isDirectory()


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files with a fixed schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what is available into exactly-once parquet files."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    """Drain what is available through ``handle(batch, batch_id)``."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def dedup_batches(out: str, key: str = "id", order: str | None = None, time: str | None = None, horizon_days: int | None = None, state: str | None = None, late: str | None = None, every: int = EVERY):
    """Sink that keeps the first row of each key: the first batch that holds the key decides, and within a batch the row with the
    smallest ``order`` (the smallest row, if none is given).

    The keys are the state, next to ``out`` if ``state`` is not given. With a horizon a key is known for that many days of ``time`` after its
    first row, rows from before the horizon go to ``late`` with their batch, and the state stays as large as the keys of the horizon.
    Without one no key is forgotten. Rows without a key are one key."""
    side = late or f"{out}_late"

    def handle(batch: DataFrame, batch_id: int) -> None:
        names = batch.columns
        known = KeyedState(state or f"{out}_state", f"{key} {dict(batch.dtypes)[key]}", key, (key,), horizon_days, every=every)
        rows, behind = known.begin(batch, time, batch_id)
        whole = F.struct(*[F.col(c) for c in (*names, "at", "bucket")])
        first = rows.groupBy(key).agg(F.min(F.struct(F.col(order or key).alias("o"), whole.alias("r"))).alias("f")).select("f.r.*")
        seen = known.before(first, batch_id).select(F.col(key).alias("_seen"))
        fresh = first.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")
        write_batch(fresh.drop("at"), out, batch_id, "bucket")
        known.write(_just_written(batch, out, batch_id, names + ["bucket"]).join(first.select(F.col(key).alias("_k"), "at"), F.col(key).eqNullSafe(F.col("_k"))), batch_id)
        if horizon_days is not None:
            behind.drop("at").write.mode("overwrite").parquet(f"{side}/batch={batch_id}")

    return handle


def _just_written(batch: DataFrame, out: str, batch_id: int, names: list[str]) -> DataFrame:
    """What a batch has just written, so that it is not computed again for the state."""
    kinds = dict(batch.dtypes) | {"bucket": "int"}
    return batch.sparkSession.read.schema(", ".join(f"`{n}` {kinds[n]}" for n in names)).parquet(f"{out}/batch={batch_id}")


def count_batches(out: str, time: str = "published"):
    """Sink of the rows per source and day of each batch; ``daily_counts`` adds them up. Late rows count on
    their own day, and a retried batch replaces its own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("source_id", F.to_date(time).alias("day")).agg(F.count("*").alias("headlines"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return handle


def daily_counts(written: DataFrame) -> DataFrame:
    return written.groupBy("source_id", "day").agg(F.sum("headlines").alias("headlines"))


def change_batches(spark: SparkSession, out: str, state: str, horizon_days: int | None = None, late: str | None = None, every: int = EVERY):
    """Sink that marks every document new, changed or unchanged against the one before it at its address, in
    order of publication day and sequence, as the batch operator does for all documents at once.

    The state holds the documents seen with their marks, narrow and bucketed by address. A batch is compared with the
    documents of its own addresses; where a late document comes before one already marked, the mark of that one is
    written again. ``latest_changes`` reads the last mark of each document, so the result does not depend on
    the order of arrival. With a horizon, documents from before it go to ``late``, and a document is compared with those up to
    a horizon older than itself; the state holds two horizons. No address is held by one Python worker."""
    columns = ("lead_seq", "id", "published", "content_hash", "title")
    documents = KeyedState(state, "lead_seq bigint, id string, published timestamp, content_hash string, title string, change string, previous_title string", "id", ("lead_seq",), horizon_days, 2, every)
    side = late or f"{out}_late"

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows, behind = documents.begin(batch.select(*columns), "published", batch_id)
        ids = rows.select(F.col("id").alias("_id")).distinct()
        before = documents.before(rows, batch_id).join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        old = before.select("lead_seq", F.struct("change", "previous_title").alias("_mark"))
        both = before.select(*columns, "at", "bucket").unionByName(rows.select(*columns, "at", "bucket"))
        # A document whose predecessor has left the state looks new; its mark stands.
        moved = ~F.struct("change", "previous_title").eqNullSafe(F.col("_mark")) & (F.col("_mark").isNull() | (F.col("change") != "new"))
        marked = change_history(both).join(old, "lead_seq", "left").filter(moved)
        documents.write(marked, batch_id)
        news = documents.rows_in(batch.sparkSession, [documents.folder("rows", batch_id)])
        write_batch(news.select("lead_seq", "id", "change", "previous_title", "bucket"), out, batch_id, "bucket")
        if horizon_days is not None:
            behind.drop("at").write.mode("overwrite").parquet(f"{side}/batch={batch_id}")

    return handle


def latest_changes(written: DataFrame) -> DataFrame:
    """The mark of each document that the latest batch gave."""
    last = F.max_by(F.struct("change", "previous_title"), "batch").alias("m")
    return written.groupBy("lead_seq").agg(last).select("lead_seq", "m.change", "m.previous_title")
