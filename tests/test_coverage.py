"""Reports, companies and search."""

import random

from pyspark.sql import functions as F

from leadflow.operators import coverage as cv
from leadflow.operators import search as se

REPORTS = "id string, status string, tickers array<string>, scope_tickers array<string>, scope_market string, issuer_official boolean, successful_tickers array<string>"


def applies(r, ticker):
    market = ticker.split()[-1]
    return (not r[2] or ticker in r[2]) and (r[3] is None or ticker in r[3]) and (not r[4] or r[4] == market)


def test_coverage_equals_pairwise_reading(spark):
    rnd = random.Random(5)
    firms = [f"{i} {rnd.choice(['JP', 'HK', 'AU'])}" for i in range(12)]
    some = lambda p, empty: rnd.sample(firms, 3) if rnd.random() < p else empty
    reports = [(f"r{i}", rnd.choice(["ok", "partial", "failed", "disabled"]), some(0.3, []), some(0.2, None), rnd.choice(["", "", "JP", "HK"]), rnd.random() < 0.5, some(0.3, None)) for i in range(40)]
    watch = spark.createDataFrame([(f,) for f in firms], "ticker string")
    got = {r["ticker"]: r for r in cv.coverage_by_company(watch, spark.createDataFrame(reports, REPORTS)).collect()}
    for f in firms:
        use = [r for r in reports if applies(r, f)]
        checked = [r for r in use if r[1] in ("ok", "partial") and (r[6] is None or f in r[6])]
        direct = [r for r in use if r[5] and f in r[2]]
        want = (len(use), len(checked), sum(r[1] == "ok" for r in checked), sum(r[1] == "partial" for r in checked), len(direct), sum(r in checked for r in direct))
        assert tuple(got[f][c] for c in ("applicable", "checked", "ok", "partial", "direct", "connected")) == want, f


def test_no_new_items_needs_an_ok_source(spark):
    watch = spark.createDataFrame([("1 JP",), ("2 HK",), ("3 AU",)], "ticker string")
    cands = spark.createDataFrame([(["3 AU"], True), (["3 AU"], False)], "tickers array<string>, eligible boolean")
    reports = spark.createDataFrame([("a", "partial", [], None, "JP", False, None), ("b", "ok", [], None, "HK", False, None)], REPORTS)
    got = {r["ticker"]: r["status"] for r in cv.company_status(watch, cands, reports).collect()}
    assert got == {"1 JP": "coverage_incomplete", "2 HK": "no_new_items_in_checked_sources", "3 AU": "candidates_need_review"}
    view = {r["ticker"]: r for r in cv.company_overview(watch, cands, reports).collect()}
    assert view["1 JP"]["checked_label"] == "1 (1 partial)" and view["3 AU"]["result"] == "1 draft-ready candidate; 1 lead to review" and view["3 AU"]["direct_status"] == "Needs a direct source"


def test_source_status_ladder(spark):
    src = spark.createDataFrame([("a", True, True, 10), ("b", True, True, 10), ("c", True, True, 1), ("d", False, True, 10), ("e", True, False, 10), ("f", True, True, 10), ("g", True, True, 10)],
                                "source_id string, enabled boolean, applicable boolean, row_limit int")
    rows = [("a", False, False), ("b", True, False), ("b", False, False), ("c", False, False), ("c", False, False), ("f", True, False), ("g", False, True), ("d", False, False)]
    fetches = spark.createDataFrame([(s, False, False, e, l, "x") for s, e, l in rows], "source_id string, matched boolean, attempted boolean, error boolean, limited boolean, link string")
    got = {r["source_id"]: r["status"] for r in cv.source_reports(fetches, src).collect()}
    assert got == {"a": "ok", "b": "partial", "c": "partial", "d": "disabled", "e": "not_applicable", "f": "failed", "g": "partial"}


def test_merge_listings(spark):
    rows = [("u", 1, "T", ["1 HK"]), ("u", 2, "T2", ["3 HK", "2 HK"]), ("u", 3, "T3", ["1 HK", "4 HK"]), ("v", 4, "V", ["9 HK"])]
    got = {r["url"]: (r["codes"], r["title"]) for r in cv.merge_listings(spark.createDataFrame(rows, "url string, seq bigint, title string, codes array<string>")).collect()}
    assert got == {"u": (["1 HK", "2 HK", "3 HK", "4 HK"], "4 HK 2 HK 3 HK T"), "v": (["9 HK"], "V")}


def test_queries_fit_the_limits(spark):
    rows = [("1 JP", "Acme", ["ACME", 'Ac"me\\Co', "<b>Third</b> &amp; Co", "Fourth", "Fifth"]), ("2 JP", "x" * 90, ["y " * 40, "z" * 95]), ("3 JP", "", [])]
    got = [r["query"] for r in se.company_queries(spark.createDataFrame(rows, "ticker string, name string, aliases array<string>"), ["example.com"]).orderBy("ticker").collect()]
    assert got[0] == '("Acme" OR "Ac me Co" OR "Third & Co" OR "Fourth") AND (site:example.com)' and len(got[1].split()) <= 75 and got[2] is None


def test_search_report(spark):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "ticker string")
    attempts = spark.createDataFrame([("a", True, False), ("b", False, False)], "ticker string, ok boolean, capped boolean")
    report = se.search_report(targets, attempts)
    assert {r["ticker"]: r["outcome"] for r in report.collect()} == {"a": "successful", "b": "failed", "c": "unsearched"}
    assert se.search_status(report).first()["status"] == "partial" and se.search_status(report.filter("ticker = 'b'")).first()["status"] == "failed"
    assert se.search_status(report.filter("ticker = 'a'")).first()["status"] == "ok"


def test_missing_days_are_incomplete(spark):
    src = spark.createDataFrame([("s",)], "source_id string")
    leads = spark.createDataFrame([("s", "2026-09-24 01:00:00")], "source_id string, t string").select("source_id", F.col("t").cast("timestamp").alias("published"))
    totals = spark.createDataFrame([("s", "2026-09-24", 1), ("s", "2026-09-25", 3)], "source_id string, t string, total bigint").select("source_id", F.col("t").cast("date").alias("day"), "total")
    at = lambda t: F.lit(t).cast("timestamp")
    got = [(str(r["day"]), r["headlines"], r["complete"]) for r in cv.day_coverage(src, leads, totals, at("2026-09-22 16:00:00"), at("2026-09-25 00:00:00"), "Asia/Tokyo").orderBy("day").collect()]
    assert got == [("2026-09-23", 0, False), ("2026-09-24", 1, True), ("2026-09-25", 0, False)]
