"""Streams give what the batch gives, whatever the split into files."""

from pyspark.sql import functions as F

from leadflow.operators.candidates import change_history
from leadflow.streaming import intake
from leadflow.streaming.state import KeyedState


def documents(spark):
    return spark.sql("""
        SELECT id AS lead_seq, concat('i', CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END) AS id, timestamp_seconds(1790000000 + floor(id / 60) * 86400) AS published,
               concat('h', id * 7 % 5) AS content_hash, concat('t', id) AS title FROM range(300)""")


def test_change_batches_equal_batch(spark, tmp_path):
    docs = documents(spark)
    src = tmp_path / "src"
    for part in range(3):
        docs.filter((F.col("lead_seq") >= part * 100) & (F.col("lead_seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(src))
        stream = intake.read_stream(spark, str(src), docs.schema, files_per_batch=1)
        intake.run_batches(stream, intake.change_batches(spark, str(tmp_path / "out"), str(tmp_path / "state")), str(tmp_path / "cp"))
    got = {tuple(r) for r in intake.latest_changes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {tuple(r) for r in change_history(docs).select("lead_seq", "change", "previous_title").collect()}
    assert got == want and len(want) == 300


def test_change_history_slices(spark):
    docs = documents(spark)
    plain = {tuple(r) for r in change_history(docs).select("lead_seq", "change", "previous_title").collect()}
    assert plain == {tuple(r) for r in change_history(docs, rows_per_slice=7).select("lead_seq", "change", "previous_title").collect()}
    rows = sorted(docs.collect(), key=lambda r: (r["published"].date(), r["lead_seq"]))
    last, want = {}, set()
    for r in rows:
        old = last.get(r["id"])
        change = "new" if old is None else "changed" if old[0] != r["content_hash"] else "unchanged"
        want.add((r["lead_seq"], change, old[1] if change == "changed" else ""))
        last[r["id"]] = (r["content_hash"], r["title"])
    assert plain == want


def test_counts_and_dedup_over_several_files(spark, tmp_path):
    docs = documents(spark).withColumn("source_id", F.lit("s"))
    src = str(tmp_path / "src")
    docs.repartition(4).write.parquet(src)
    read = lambda: intake.read_stream(spark, src, docs.schema, files_per_batch=1)
    intake.run_batches(read(), intake.count_batches(str(tmp_path / "counts")), str(tmp_path / "cp1"))
    got = {(str(r["day"]), r["headlines"]) for r in intake.daily_counts(spark.read.parquet(str(tmp_path / "counts"))).collect()}
    want = {(str(r["d"]), r["n"]) for r in docs.groupBy(F.to_date("published").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert got == want
    intake.run_batches(read().select("id", "published"), intake.dedup_batches(str(tmp_path / "ids")), str(tmp_path / "cp2"))
    ids = [r["id"] for r in spark.read.parquet(str(tmp_path / "ids")).collect()]
    assert sorted(ids) == sorted({r["id"] for r in docs.select("id").distinct().collect()})


def test_late_rows_nulls_and_shuffled_arrival_equal_batch(spark, tmp_path):
    """Arrival in reverse and mixed order, undated documents, negative sequences, days before 1970, no id."""
    docs = documents(spark).select((F.col("lead_seq") - 50).alias("lead_seq"), F.when(F.col("lead_seq") % 11 > 0, F.col("id")).alias("id"),
                                   F.when(F.col("lead_seq") % 7 > 0, F.col("published") - F.expr("make_dt_interval(lead_seq * 300)")).alias("published"), "content_hash", "title")
    src = tmp_path / "src"
    for part in (3, 0, 2, 1):
        docs.filter(F.pmod("lead_seq", F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(src))
        stream = intake.read_stream(spark, str(src), docs.schema, files_per_batch=1)
        intake.run_batches(stream, intake.change_batches(spark, str(tmp_path / "out"), str(tmp_path / "state")), str(tmp_path / "cp"))
    got = {tuple(r) for r in intake.latest_changes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {tuple(r) for r in change_history(docs).select("lead_seq", "change", "previous_title").collect()}
    assert got == want and len(want) == 300


def test_change_history_keeps_undated_documents(spark):
    rows = [(1, "a", None, "h1", "t1"), (2, "a", "2024-01-05", "h2", "t2"), (3, "a", None, "h1", "t3"), (4, None, "2024-01-01", "x", "y"), (5, None, None, "x", "y")]
    docs = spark.createDataFrame(rows, "lead_seq long, id string, p string, content_hash string, title string").withColumn("published", F.col("p").cast("timestamp")).drop("p")
    got = {r["lead_seq"]: (r["change"], r["previous_title"]) for r in change_history(docs).collect()}
    assert got == {1: ("new", ""), 3: ("unchanged", ""), 2: ("changed", "t3"), 5: ("new", ""), 4: ("unchanged", "")}


def test_the_first_copy_stays(spark, tmp_path):
    rows = [(3, "k", "c"), (1, "k", "a"), (2, "k", "b"), (9, None, "n"), (8, None, "m")]
    docs = spark.createDataFrame(rows, "lead_seq long, id string, body string")
    handle = intake.dedup_batches(str(tmp_path / "ids"), order="lead_seq")
    handle(docs, 0)
    handle(spark.createDataFrame([(0, "k", "late"), (4, "new", "z")], docs.schema), 1)
    assert {r["body"] for r in spark.read.parquet(str(tmp_path / "ids")).collect()} == {"a", "m", "z"}


def dated(spark, rows):
    """Documents (lead_seq, id, day, hash); a null day is undated."""
    df = spark.createDataFrame([(s, i, d, h, f"t{s}") for s, i, d, h in rows], "lead_seq long, id string, d int, content_hash string, title string")
    return df.withColumn("published", F.timestamp_seconds(F.lit(1790000000) + F.col("d") * 86400)).select("lead_seq", "id", "published", "content_hash", "title")


def files(path):
    return [p for p in path.rglob("*.parquet")]


def test_state_stays_bounded_over_many_batches(spark, tmp_path):
    """One new key a batch and one that comes back; three days a batch, a horizon of twelve days, a snapshot every three batches."""
    handle = intake.dedup_batches(str(tmp_path / "out"), "id", "lead_seq", "published", 12, str(tmp_path / "state"), every=3)
    sizes, held = [], []
    for b in range(15):
        handle(dated(spark, [(10 * b, f"k{b}", 3 * b, "h"), (10 * b + 1, f"k{max(0, b - 2)}", 3 * b, "h"), (10 * b + 2, "old", 3 * b - 40, "h")]), b)
        sizes.append(len(files(tmp_path / "state")))
        known = KeyedState("", "id string", "id", ("id",)).rows_in(spark, [str(p) for kind in ("rows", "snapshots") for p in (tmp_path / "state").glob(f"{kind}/*")])
        held.append(known.select("id").distinct().count())
    assert max(sizes[12:]) <= max(sizes[9:12]) + 1 and max(held[12:]) <= max(held[9:12]) + 1, (sizes, held)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == sorted([f"k{b}" for b in range(15)] + ["old"])  # the first batch has no high mark
    late = spark.read.parquet(str(tmp_path / "out_late"))
    assert late.count() == 14 and {r["id"] for r in late.select("id").distinct().collect()} == {"old"}


def test_a_retried_batch_leaves_the_same_state(spark, tmp_path):
    batches = [dated(spark, [(100 * b + k, f"i{(b * 3 + k) % 11}", b, f"h{(b + k) % 3}") for k in range(6)]) for b in range(7)]
    results = []
    for name, retried in (("once", ()), ("twice", (1, 3, 4, 6))):
        handle = intake.change_batches(spark, str(tmp_path / name / "out"), str(tmp_path / name / "state"), 30, every=3)
        for b, rows in enumerate(batches):
            for _ in range(2 if b in retried else 1):
                handle(rows, b)
        results.append({tuple(r) for r in intake.latest_changes(spark.read.parquet(str(tmp_path / name / "out"))).collect()})
    whole = batches[0]
    for more in batches[1:]:
        whole = whole.unionByName(more)
    want = {tuple(r) for r in change_history(whole).select("lead_seq", "change", "previous_title").collect()}
    assert results[0] == results[1] == want


def test_changes_equal_the_batch_inside_the_horizon(spark, tmp_path):
    """Documents arrive up to nine days late, in shuffled order; their predecessors are at most ten days older."""
    rnd = __import__("random").Random(8)
    rows = [(k, f"i{k % 9}", k // 6, f"h{rnd.randint(0, 2)}") for k in range(240)]
    arrival = sorted(rows, key=lambda r: r[2] + rnd.randint(0, 9))
    handle = intake.change_batches(spark, str(tmp_path / "out"), str(tmp_path / "state"), 10, every=4)
    for b in range(12):
        handle(dated(spark, arrival[20 * b : 20 * b + 20]), b)
    got = {tuple(r) for r in intake.latest_changes(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {tuple(r) for r in change_history(dated(spark, rows)).select("lead_seq", "change", "previous_title").collect()}
    assert got == want and spark.read.parquet(str(tmp_path / "out_late")).count() == 0
    # Snapshots hold two horizons only.
    last = max((tmp_path / "state" / "snapshots").glob("batch=*"), key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.parquet(str(last)).count() < 200


def test_tables_in_folders_of_files(spark, tmp_path):
    """A stream reads a table that is a folder of files as it reads one file, and gives every lead once."""
    from leadflow.plans import all_queries

    docs = spark.sql("SELECT id AS doc_id, concat('Title ', id, char(10), 'Text ', id) AS text, concat('src', id % 3) AS source, 'en' AS lang FROM range(20)")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + id * 3600) AS ts, 'click' AS event_type, id AS user_id FROM range(40)").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    spark.sql("SELECT id AS page_id, concat('https://example.com/', id) AS url FROM range(5)").toPandas().to_parquet(tmp_path / "pages.parquet")
    run = lambda name: all_queries()[name](spark, str(tmp_path))
    assert sorted(r["lead_seq"] for r in run("stream_leads").collect()) == list(range(20))
    assert run("stream_window_verdict").count() == 20
    assert run("stream_dedup").count() == 5
    assert {tuple(r) for r in run("stream_change_status").collect()} == {tuple(r) for r in run("change_history").collect()}
    assert run("stream_daily_counts").groupBy().sum("headlines").first()[0] == 40
