"""Queries that drain a stream of the given tables and return what it wrote."""

from uuid import uuid4

from pyspark.sql import functions as F

from leadflow.functions.dates import window_verdict
from leadflow.operators.candidates import with_identity
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.plans.times import DATED, verdict_sql
from leadflow.session import shared_folder
from leadflow.streaming import intake


HORIZON_DAYS = 400  # no event of the tables is as late as that


def folders(spark):
    base = f"{shared_folder(spark)}/streams/{uuid4().hex}"
    return f"{base}/out", f"{base}/state", f"{base}/checkpoint"


def stream(spark, d, name):
    """A table as a stream: one file among others in the folder, or a folder of files."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return intake.read_stream(spark, path, schema) if intake.is_folder(spark, path) else intake.read_stream(spark, d, schema, glob=f"{name}.parquet")


def stream_of_leads(spark, d):
    """The documents as a stream, joined with the static tables that complete a lead."""
    return with_identity(v.streamed_leads(spark, d, stream(spark, d, "documents")))


@query("stream_leads", v.with_views(v.LEADS, v.HASHED) + "SELECT lead_seq, id, content_hash FROM hashed_v")
def stream_leads(spark, d):
    out, _, checkpoint = folders(spark)
    intake.run_to_parquet(stream_of_leads(spark, d).select("lead_seq", "id", "content_hash"), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_window_verdict", v.with_views(v.LEADS) + f"""
SELECT lead_seq, {verdict_sql(f"TIMESTAMP '{v.WINDOW_START}'", 'true', DATED)} AS verdict FROM leads_v""")
def stream_window_verdict(spark, d):
    out, _, checkpoint = folders(spark)
    when = F.when(F.col("date_precision") == "day", F.date_trunc("day", "published")).when(F.col("date_precision") == "time", F.col("published"))
    verdict = window_verdict(when, "date_precision", F.lit(v.WINDOW_START).cast("timestamp"), F.lit(v.AS_OF).cast("timestamp"), True)
    intake.run_to_parquet(stream_of_leads(spark, d).select("lead_seq", verdict.alias("verdict")), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_dedup", v.with_views(v.LEADS, v.HASHED) + "SELECT DISTINCT id FROM hashed_v")
def stream_dedup(spark, d):
    out, state, checkpoint = folders(spark)
    intake.run_batches(stream_of_leads(spark, d).select("id", "published"), intake.dedup_batches(out, time="published", horizon_days=HORIZON_DAYS, state=state), checkpoint)
    return spark.read.parquet(out).select("id")


@query("stream_change_status", v.with_views(v.LEADS, v.HASHED) + """
SELECT lead_seq, CASE WHEN prev IS NULL THEN 'new' WHEN prev <> content_hash THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN prev <> content_hash THEN prev_title ELSE '' END AS previous_title
FROM (SELECT *, lag(content_hash) OVER w AS prev, lag(title) OVER w AS prev_title FROM hashed_v WINDOW w AS (PARTITION BY id ORDER BY published::DATE, lead_seq))""")
def stream_change_status(spark, d):
    out, state, checkpoint = folders(spark)
    leads = stream_of_leads(spark, d).select("lead_seq", "id", "published", "content_hash", "title")
    intake.run_batches(leads, intake.change_batches(spark, out, state, HORIZON_DAYS), checkpoint)
    return intake.latest_changes(spark.read.parquet(out))


@query("stream_daily_counts", v.with_views(v.SCANS) + "SELECT source_id, ts::DATE::VARCHAR AS day, count(*)::BIGINT AS headlines FROM scans_v GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    out, _, checkpoint = folders(spark)
    events = stream(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.col("ts").cast("timestamp").alias("published"))
    intake.run_batches(events, intake.count_batches(out), checkpoint)
    rows = intake.daily_counts(spark.read.parquet(out))
    return rows.select("source_id", F.col("day").cast("string").alias("day"), "headlines")
