"""Closes, editions and record windows."""

import pytest
from pyspark.sql import functions as F

from leadflow import rules
from leadflow.functions.dates import iso
from leadflow.operators import windows as w


def editions(spark, *stamps):
    return spark.createDataFrame([(s, s) for s in stamps], "edition_id string, t string").select("edition_id", F.col("t").cast("timestamp").alias("as_of"))


def overrides(spark, *rows):
    return spark.createDataFrame(list(rows), "market string, session_date string, close string")


def built(spark, stamp, *special):
    rows = w.build_windows(editions(spark, stamp), rules.market_rules(spark), overrides(spark, *special)).withColumn("s", iso("window_start")).collect()
    return {r["market"]: r for r in rows}


def test_monday_morning_uses_friday(spark):
    got = built(spark, "2026-09-28 00:00:00")
    assert len(got) == 15 and got["NZ"]["s"] == "2026-09-25T05:00:30Z" and got["JP"]["s"] == "2026-09-25T06:30:00Z" and got["AU"]["s"] == "2026-09-25T06:15:00Z"
    assert got["GLOBAL"]["s"] == min(r["s"] for m, r in got.items() if m != "GLOBAL")
    assert all(r["status"] == "active" and r["start_inclusive"] for r in got.values())


def test_daylight_saving(spark):
    # New Zealand closes at 17:00:30 local time, one hour earlier in UTC during its summer.
    assert built(spark, "2026-01-13 00:00:00")["NZ"]["s"] == "2026-01-12T04:00:30Z"


def test_holiday_and_short_session(spark):
    got = built(spark, "2026-09-27 21:00:00", ("JP", "2026-09-25", None), ("HK", "2026-09-26", "12:00"))
    assert str(got["JP"]["session_date"]) == "2026-09-24" and got["HK"]["s"] == "2026-09-26T04:00:00Z" and got["HK"]["basis"] == "session override"


def test_long_closure_uses_the_horizon(spark):
    closed = [("TB", f"2026-{m:02d}-{d:02d}", None) for m, d in [(9, x) for x in range(1, 28)]]
    got = w.latest_close(editions(spark, "2026-09-27 21:00:00"), rules.market_rules(spark), overrides(spark, *closed)).filter("market = 'TB'").first()
    assert str(got["session_date"]) == "2026-08-31"


def test_no_session_is_an_error(spark):
    start = "2026-09-27 21:00:00"
    every = spark.sql("SELECT 'VN' AS market, explode(sequence(date'2025-06-01', date'2026-09-30'))  AS d").select(
        "market", F.col("d").cast("string").alias("session_date"), F.lit(None).cast("string").alias("close"))
    with pytest.raises(Exception, match="no completed session for VN"):
        w.latest_close(editions(spark, start), rules.market_rules(spark), every).collect()


@pytest.mark.parametrize("stamp,status", [("2026-09-24 06:09:59", "pending_start"), ("2026-09-24 06:10:00", "pending_start"), ("2026-09-24 06:10:01", "active")])
def test_afternoon_floor(spark, stamp, status):
    got = built(spark, stamp)
    assert len(got) == 15 and {r["status"] for r in got.values()} == {status} and not any(r["start_inclusive"] for r in got.values())


def test_ticker_market(one):
    values = ["TEST ID Equity", "600000 CN", "ABC", "abc jp equity", "X"]
    assert one(*[w.ticker_market(F.lit(v)) for v in values]) == ("IJ", "CH", "", "JP", "")


def windows(spark):
    rows = [("JP", "2026-09-24 06:30:00", "active", True), ("HK", "2026-09-24 08:10:00", "active", False), ("VN", "2026-09-24 08:00:00", "pending_start", True), ("GLOBAL", "2026-09-24 05:00:00", "active", True)]
    return spark.createDataFrame(rows, "market string, t string, status string, start_inclusive boolean").withColumn("window_start", F.col("t").cast("timestamp"))


def test_record_window(spark):
    rows = [(1, ["JP"]), (2, ["HK", "JP"]), (3, []), (4, ["JP", "US"]), (5, ["JP", "VN"])]
    df = spark.createDataFrame(rows, "i int, timing_markets array<string>")
    got = {r["i"]: r for r in w.record_window(df, windows(spark), "2026-09-24 00:00:00").withColumn("s", iso("applied_window_start")).collect()}
    assert [got[i]["s"][11:16] for i in range(1, 6)] == ["06:30", "08:10", "00:00", "00:00", "08:00"]
    assert [got[i]["timing_resolved"] for i in range(1, 6)] == [True, True, False, False, False]
    # All markets must be inclusive, not only the one that sets the start.
    assert [got[i]["applied_inclusive"] for i in range(1, 6)] == [True, False, True, True, True]
    assert got[5]["inactive_markets"] == ["VN"]
    bare = w.record_window(df, windows(spark).limit(0), "2026-09-24 00:00:00").select("timing_resolved").distinct().collect()
    assert [r[0] for r in bare] == [True]


def test_infer_markets(spark, one):
    empty = F.array().cast("array<string>")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    infer = lambda *a: one(w.infer_markets(*a))
    assert infer(F.lit("cn"), arr("1 HK"), empty, empty, empty, F.lit(False), F.lit("")) == ["CH"]
    assert infer(F.lit(""), arr("1 HK", "2 JP", "3 HK"), empty, arr("4 KS"), empty, F.lit(False), F.lit("")) == ["HK", "JP"]
    assert infer(F.lit(""), empty, empty, arr("4 KS"), empty, F.lit(True), F.lit("JP")) == ["KR"]
    # Only an authoritative source lends its own market.
    assert infer(F.lit(""), empty, empty, empty, empty, F.lit(False), F.lit("JP")) == [] and infer(F.lit(""), empty, empty, empty, empty, F.lit(True), F.lit("JP")) == ["JP"]


def test_assign_editions_matches_brute_force(spark):
    stamps = [f"2026-09-{d:02d} {h:02d}:00:00" for d in range(20, 26) for h in (0, 8)]
    built_all = w.build_windows(editions(spark, *stamps), rules.market_rules(spark), overrides(spark))
    leads = spark.range(400).select(
        F.col("id").alias("lead_seq"), F.timestamp_seconds(F.lit(1789800000) + F.col("id") * 1800).alias("published"), F.lit("time").alias("date_precision"),
        F.element_at(F.array(F.lit("JP"), F.lit("HK"), F.lit("NZ"), F.lit(None)), (F.col("id") % 4 + 1).cast("int")).alias("market"))
    got = {tuple(r) for r in w.assign_editions(leads, built_all).select("lead_seq", "edition_id").collect()}
    want = set()
    spans = built_all.filter("status = 'active'").collect()
    for r in leads.collect():
        for s in spans:
            if s["market"] == (r["market"] or "GLOBAL") and r["published"] <= s["as_of"] and (
                    r["published"] > s["window_start"] or s["start_inclusive"] and r["published"] == s["window_start"]):
                want.add((r["lead_seq"], s["edition_id"]))
    assert got == want and want
