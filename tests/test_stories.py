"""Validation of stories: change one field of a good story, expect one reason."""

import pytest
from pyspark.sql import functions as F

from leadflow.functions.dates import strict_ts
from leadflow.operators import stories as st

STORY = ("story_seq bigint, id string, company string, tickers array<string>, market string, category string, novelty string, review_status string, headline string, has_origin boolean, "
         "origin_url string, origin_status string, origin_kind string, origin_development string, origin_timestamp_evidence string, origin_verification_notes string")
SOURCE = "story_seq bigint, pos bigint, url string, name string, published_at string, access string, date_precision string, relationship string, context_notes string"
BULLET = "story_seq bigint, number bigint, text string, source_urls array<string>"
A, B = "https://a.example.com/1", "https://b.example.com/2"
START, AS_OF = "2026-09-24T14:10:00+08:00", "2026-09-24T16:00:00+08:00"


def validate(spark, story=None, sources=None, bullets=None, windows=(), extra=()):
    base = dict(story_seq=1, id="s1", company="Acme", tickers=["1 JP"], market="", category="Merger Arbitrage", novelty="new", review_status="ready", headline="H", has_origin=True, origin_url=A,
                origin_status="verified", origin_kind="exchange", origin_development="d", origin_timestamp_evidence="t", origin_verification_notes="v")
    base.update(story or {})
    src = sources if sources is not None else [dict()]
    rows = []
    for i, s in enumerate(src):
        row = dict(story_seq=1, pos=i, url=A, name="N", published_at="2026-09-24T15:00:00+08:00", access="readable", date_precision="time", relationship=None, context_notes=None)
        row.update(s)
        rows.append(row)
    bul = [dict(story_seq=1, number=i + 1, **b) for i, b in enumerate(bullets if bullets is not None else [dict(text="x", source_urls=[A])])]
    win = spark.createDataFrame(list(windows), "market string, t string, status string, start_inclusive boolean").withColumn("window_start", strict_ts("t"))
    got = st.validate_stories(spark.createDataFrame([base, *[dict(base, **e) for e in extra]], STORY), spark.createDataFrame(rows, SOURCE), spark.createDataFrame(bul, BULLET), win,
                              strict_ts(F.lit(START)), strict_ts(F.lit(AS_OF)))
    row = got.filter("story_seq = 1").first()
    assert (row["composition_status"] == "ready") == (row["reasons"] == [])
    return row["reasons"]


def test_good_story_is_ready(spark):
    assert validate(spark) == []


def test_own_fields(spark):
    assert validate(spark, dict(id=" ", company="", headline="", review_status="hold", novelty="background", category="Other")) == [
        st.ID_MISSING, st.NO_COMPANY, st.NO_HEADLINE, st.NOT_READY, st.NOT_NEW, st.NO_CATEGORY]
    assert validate(spark, extra=[dict(story_seq=2)]) == [st.ID_DUPLICATED]


def test_origin(spark):
    assert validate(spark, dict(has_origin=False, origin_url=None)) == [st.NO_ORIGIN]
    assert validate(spark, dict(origin_status="open", origin_kind="blog", origin_development=" ")) == [st.UNVERIFIED, st.BAD_KIND, st.NEEDS_FIELD.format("development")]
    assert validate(spark, dict(origin_url=B)) == [st.ORIGIN_ABSENT, st.ORIGIN_UNCITED]


@pytest.mark.parametrize("at,ok", [("2026-09-24T14:10:00+08:00", True), ("2026-09-24T14:09:59+08:00", False), ("2026-09-24T16:00:00+08:00", True), ("2026-09-24T16:00:01+08:00", False)])
def test_window_of_the_origin(spark, at, ok):
    assert validate(spark, sources=[dict(published_at=at)]) == ([] if ok else [st.ORIGIN_OUTSIDE, "Bullet 1" + st.BULLET_OUTSIDE])


def test_an_earlier_uncited_report_holds_the_story(spark):
    other = lambda **kw: [dict(published_at="2026-09-24T15:10:00+08:00"), dict(url=B, **kw)]
    assert validate(spark, sources=other(published_at="2026-09-24T13:55:00+08:00")) == [st.EARLIER_REPORT]
    assert validate(spark, sources=other(published_at="2026-09-24", date_precision="day")) == [st.UNCLEAR_REPORT]
    assert validate(spark, sources=other(published_at="2026-09-01", relationship="background")) == [st.BACKGROUND_NOTES]
    assert validate(spark, sources=other(published_at="2026-09-01", relationship="background", context_notes="older")) == []
    assert validate(spark, sources=other(relationship="rumour")) == [st.BAD_RELATION]
    assert validate(spark, sources=other()) == [st.EARLIER_REPORT]


def test_bullets_and_citations(spark):
    assert validate(spark, bullets=[]) == [st.NO_BULLET, st.ORIGIN_UNCITED]
    got = validate(spark, bullets=[dict(text="x", source_urls=[A]), dict(text=" ", source_urls=[]), dict(text="y", source_urls=[]), dict(text="z", source_urls=["http://localhost/", B])])
    assert got == ["Bullet 2 has no text.", "Bullet 3 needs at least one source citation.", "Bullet 4" + st.BULLET_BAD_URL, "Bullet 4" + st.BULLET_ABSENT]
    got = validate(spark, sources=[dict(access="restricted", date_precision="day", published_at="2026-09-24")])
    assert got == [st.ORIGIN_UNREAD, st.ORIGIN_NO_TIME, "Bullet 1" + st.BULLET_UNREAD, "Bullet 1" + st.BULLET_NO_DAY, "Bullet 1" + st.BULLET_NO_TIME]


def test_repeated_and_bad_urls(spark):
    # The last entry of an address gives its metadata.
    got = validate(spark, sources=[dict(access="restricted"), dict(url="http://localhost/"), dict()])
    assert got == [st.BAD_URL, st.SAME_URL]


def test_market_windows(spark):
    win = [("JP", "2026-09-24T15:00:00+08:00", "active", False), ("HK", "2026-09-24T14:30:00+08:00", "active", True), ("VN", "2026-09-24T14:30:00+08:00", "pending_start", True)]
    assert validate(spark, windows=win) == [st.ORIGIN_OUTSIDE, "Bullet 1" + st.BULLET_OUTSIDE]
    assert validate(spark, windows=[("JP", "2026-09-24T15:00:00+08:00", "active", True)]) == []
    # Only the windows that begin at the latest start decide whether it counts.
    both = [("JP", "2026-09-24T15:00:00+08:00", "active", True), ("HK", "2026-09-24T14:30:00+08:00", "active", False)]
    assert validate(spark, dict(tickers=["1 JP", "2 HK"]), windows=both) == []
    assert validate(spark, dict(tickers=["5 US"]), windows=win) == [st.WINDOW_UNKNOWN]
    assert validate(spark, dict(tickers=["5 VN"]), windows=win) == ["VN" + st.WINDOW_STATES["pending_start"]]


def test_window_violations(spark):
    rows = [("JP", "active", "2026-09-24T14:10:00+08:00", None), ("KS", "active", "2026-09-24T15:00:00+08:00", AS_OF), ("KR", "active", "2026-09-24T15:00:00+08:00", "2026-09-24T08:00:00Z"),
            ("HK", "closed", "2026-09-24T14:00:00+08:00", "2026-09-24T09:00:00Z")]
    df = spark.createDataFrame(rows, "market string, status string, window_start string, as_of string")
    got = sorted(tuple(r) for r in st.window_violations(df, F.lit(START), F.lit(AS_OF)).collect())
    assert got == [("HK", "cutoff differs"), ("HK", "outside the research envelope"), ("HK", "unknown status"), ("KR", "duplicated market"), ("KS", "duplicated market")]


def test_layout_and_numbers(spark):
    bullets = spark.createDataFrame([(1, 1, "a", [B, A]), (1, 2, "b", [A]), (2, 1, "c", [A])], BULLET)
    public = st.public_sources(spark.createDataFrame([(s, p, u, "n", "", "readable", "time", None, None) for s, p, u in [(1, 1, A), (1, 2, B), (2, 1, A)]], SOURCE))
    got = sorted((r["story_seq"], r["source_number"], r["url"], r["numbered"]) for r in st.citation_numbers(bullets, public).collect())
    assert got == [(1, 1, B, True), (1, 2, A, True), (2, 1, A, False)]
    done = spark.createDataFrame([(1, "a", "Acme", ["1 JP", "2 HK"], "Relative Value", "H1", "ready"), (2, "b", "Beta", [], "Merger Arbitrage", "H2", "ready"), (3, "c", "Held", [], "Merger Arbitrage", "H3", "hold")],
                                 "story_seq bigint, id string, company string, tickers array<string>, category string, headline string, composition_status string")
    rows = [(r["part"], r["label"]) for r in st.edition_layout(done).orderBy("part", "section_no", "story_seq").collect()]
    assert rows == [("index", "BETA"), ("index", "1 JP"), ("story", "BETA"), ("story", "1 JP / 2 HK    ACME")]
    asked = spark.createDataFrame([(1, "c"), (2, "b"), (3, "b"), (4, "a")], "pos bigint, id string")
    assert [r["id"] for r in st.top_stories(asked, done).collect()] == ["b"]


def test_review_notes(spark):
    df = spark.createDataFrame([("restricted", "ja-JP", None, "missing", ["f", "f"]), ("readable", "en", "2026", "time", [])], "access_status string, language string, published string, date_precision string, flags array<string>")
    got = [r[0] for r in df.select(st.review_notes()).collect()]
    assert got[0] == [st.ACCESS_NOTES["restricted"], "Original language: ja-jp — English summary needed.", st.DATE_NOTE, "f"] and got[1] == []


def test_missing_values_hold_the_story(spark):
    assert validate(spark, bullets=[dict(text="x", source_urls=None)]) == [st.ORIGIN_UNCITED, "Bullet 1" + st.BULLET_NO_SOURCE]
    assert validate(spark, bullets=[dict(text="x", source_urls=[A, None])]) == ["Bullet 1" + st.BULLET_BAD_URL]
    assert validate(spark, dict(has_origin=None)) == [st.NO_ORIGIN]
    assert st.BAD_URL in validate(spark, sources=[dict(), dict(url=None)])
    nulls = dict.fromkeys(("id", "company", "headline", "review_status", "novelty", "category", "origin_status", "origin_kind"))
    assert len(validate(spark, nulls)) == len(nulls)


def test_stories_are_computed_once(spark, tmp_path):
    """The rows that come out are those that were checked: the table of stories is not read a second time."""
    tables = []
    for name, rows, schema in (("stories", [dict(id="a", story_seq=1)], "story_seq long, id string, company string, headline string, market string, tickers array<string>, review_status string, novelty string, category string, has_origin boolean, origin_url string, origin_status string, origin_kind string, origin_development string, origin_timestamp_evidence string, origin_verification_notes string"),
                               ("sources", [dict(story_seq=1, pos=1, url=A)], SOURCE), ("bullets", [dict(story_seq=1, number=1, text="x", source_urls=[A])], BULLET)):
        spark.createDataFrame([{**dict.fromkeys(spark.createDataFrame([], schema).columns), **r} for r in rows], schema).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    win = spark.createDataFrame([], "market string, window_start timestamp, start_inclusive boolean, status string")
    got = st.validate_stories(*tables, win, strict_ts(F.lit(START)), strict_ts(F.lit(AS_OF)))
    assert got.count() == 1
    assert not [f for f in got.inputFiles() if "/stories/" in f]


def test_a_rule_broken_by_several_citations_is_one_reason(spark):
    two = [dict(access="restricted"), dict(url=B, access="restricted", relationship="background", context_notes="older")]
    unread = [r for r in validate(spark, sources=two, bullets=[dict(text="x", source_urls=[A, B, A]), dict(text="y", source_urls=[B])]) if r.endswith(st.BULLET_UNREAD)]
    assert unread == ["Bullet 1" + st.BULLET_UNREAD, "Bullet 2" + st.BULLET_UNREAD]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_validation_moves_the_sources_once(spark):
    """One shuffle by story brings sources, citations and stories together; the others are those of the written stories."""
    sources = spark.createDataFrame([(1, i, f"{A}{i}", "n", "2026-09-24T15:00:00Z", "readable", "time", None, None) for i in range(3)], SOURCE)
    bullets = spark.createDataFrame([(1, 1, "x", [A])], BULLET)
    win = spark.createDataFrame([], "market string, window_start timestamp, start_inclusive boolean, status string")
    story = dict.fromkeys(spark.createDataFrame([], STORY).columns) | dict(story_seq=1, id="a", tickers=["1 JP"], market="")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(st.validate_stories(spark.createDataFrame([story], STORY), sources, bullets, win, strict_ts(F.lit(START)), strict_ts(F.lit(AS_OF))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.count("Exchange hashpartitioning(story_seq") == 2 and text.count("Exchange hashpartitioning") <= 4


def test_stories_with_one_number_share_their_reasons(spark):
    twice = [dict(id="s4", headline="", origin_url=B), dict(id="s3", review_status="hold", origin_url=None, has_origin=False)]
    got = validate(spark, dict(id="s2"), sources=[dict(), dict(url=B, published_at="2026-09-24T14:00:00+08:00")], extra=twice)
    assert got == [st.NO_HEADLINE, st.NOT_READY, st.NO_ORIGIN, st.ORIGIN_OUTSIDE, st.EARLIER_REPORT, st.ORIGIN_UNCITED]


def test_null_places_and_stories(spark):
    assert validate(spark, sources=[dict(pos=None)]) == [st.ORIGIN_UNREAD, st.ORIGIN_NO_TIME, "Bullet 1" + st.BULLET_UNREAD, "Bullet 1" + st.BULLET_NO_DAY, "Bullet 1" + st.BULLET_NO_TIME]
    assert validate(spark, sources=[dict(), dict(story_seq=None, url="http://localhost/")], extra=[dict(story_seq=None, id="s9", headline="")]) == []


def tables(spark, folder):
    made = {
        "customer": ([(1, "Customer 1", 3)], "c_custkey long, c_name string, c_nationkey int"),
        "orders": ([(k, 1, "O", 10.0 * k, "1-URGENT") for k in (1, 2, 3)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"),
        "lineitem": ([(k, 7, 8, n, 10.0, 0.01, 0.05, "N", "O", "1998-06-01") for k in (1, 2) for n in (1, 2, 3)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, day string")}
    for name, (rows, schema) in made.items():
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.col("day").cast("timestamp")).drop("day")
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_review_rows_make_the_stories_once(spark, tmp_path):
    from leadflow.plans import stories as plans

    got = plans.review_rows(spark, tables(spark, tmp_path))
    assert not [f for f in got.inputFiles() if "/orders.parquet/" in f]
    rows = {r["story_seq"]: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["original_publication"] == "1998-06-01T00:00:00Z" and rows[3]["origin_status"] == "missing"


def test_top_stories_keep_the_checked_stories_by_column(spark, tmp_path):
    from leadflow.plans import stories as plans

    got = plans.top_stories(spark, tables(spark, tmp_path))
    assert [f for f in got.inputFiles() if "/validated-" in f] and "ExistingRDD" not in plan(got)
    assert got.count() == 0
