"""Captured bodies as files: one folder per edition day and source, read as a table.

A crawler leaves a body as it came, ``<path>/edition_date=2026-09-24/source_id=<id>/<name>.body``, and next to it
``<name>.json`` with its address and content type. Both are read by Spark's own file sources: days and sources are partition columns, so a day
prunes to its folder before any file is listed in it, and bodies go to tasks by size. Nothing is opened on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = "url string, content_type string, captured_at timestamp"
FOLDERS = "edition_date date, source_id string"
MAX_BODY = 8 << 20  # bytes; larger bodies are rejects, as they are for a crawler


def _of(spark: SparkSession, path: str, kind: str, schema: str, pattern: str, edition_date: str | None) -> DataFrame:
    reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").option("basePath", path)
    rows = reader.schema(f"{schema}, {FOLDERS}").load(path)
    return rows if edition_date is None else rows.filter(F.col("edition_date") == F.lit(edition_date).cast("date"))


def read_folders(spark: SparkSession, path: str, edition_date: str | None = None, max_body: int = MAX_BODY) -> tuple[DataFrame, DataFrame]:
    """(captures, rejects) of a tree of captured files, of one day or of all.

    Captures have ``edition_date, source_id, url, content_type, captured_at, body``. A body without its head, or of more than ``max_body`` bytes, is a
    reject with the reason, and so is a head without an address or without a body (an empty file is none); nothing is lost."""
    name = lambda column, end: F.regexp_replace(column, rf"\.{end}$", "")
    bodies = _of(spark, path, "binaryFile", "path string, modificationTime timestamp, length long, content binary", "*.body", edition_date)
    # A length is known from the listing, so that the content of a body that is too large is not read.
    kept = bodies.filter(F.col("length") <= max_body).select("edition_date", "source_id", name("path", "body").alias("file"), F.col("content").alias("body"), "modificationTime")
    large = bodies.filter(F.col("length") > max_body).select("edition_date", "source_id", name("path", "body").alias("file"), F.lit(f"the body has more than {max_body} bytes").alias("error"))
    heads = (_of(spark, path, "json", HEAD, "*.json", edition_date).select("edition_date", "source_id", "url", "content_type", "captured_at", F.col("_metadata.file_path").alias("path"))
             .withColumn("file", name("path", "json")).drop("path"))
    plain = lambda df: df.withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    both = plain(kept).join(plain(heads), ["edition_date", "source_id", "file"], "full")
    error = F.when(F.col("modificationTime").isNull(), "a head without a body").when(F.coalesce("url", F.lit("")) == "", "a body without an address")
    marked = both.withColumn("error", error)
    captures = marked.filter("error IS NULL").select("edition_date", "source_id", "url", F.coalesce("content_type", F.lit("")).alias("content_type"), F.coalesce("captured_at", "modificationTime").alias("captured_at"), "body")
    # The head of a body that is too large has no partner, and is named once.
    named = plain(large)
    rejects = marked.filter("error IS NOT NULL").select("edition_date", "source_id", "file", "error").join(named.select("file"), "file", "left_anti")
    return captures, rejects.select("edition_date", "source_id", "file", "error").unionByName(named)
