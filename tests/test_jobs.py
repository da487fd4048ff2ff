"""A whole collection run on a small set of captures."""

import pytest
from pyspark.sql import functions as F

from leadflow import jobs
from leadflow.sinks import read_state
from leadflow.sources.dimensions import SOURCES, WATCHLIST

RUN = jobs.Run("2026-09-24", "2026-09-23 00:00:00", "2026-09-24 08:00:00")
LONG = "The board of Acme Holdings said it received a tender offer and that trading in its shares continues as before."


def feed(*items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>{d}</pubDate><description>{x}</description></item>" for t, u, d, x in items)
    return f"<rss><channel>{body}</channel></rss>"


def page(title, text, head=""):
    return f"<html lang='en'><head><title>{title}</title>{head}</head><body><h1>{title}</h1><article><p>{text}</p></article></body></html>"


@pytest.fixture(scope="module")
def tables(spark):
    base = dict(enabled=True, timezone="UTC", language="en", allowed_domains=["example.com"], collection_role="market", publisher=False, issuer_official=False, discovery_only=False, retain_all_leads=False)
    rows = [dict(base, id="news", kind="rss", url="https://www.example.com/feed"), dict(base, id="links", kind="publisher_index", url="https://www.example.com/list", retain_all_leads=True),
            dict(base, id="broken", kind="rss", url="https://www.example.com/broken"), dict(base, id="off", kind="rss", url="https://www.example.com/off", enabled=False),
            dict(base, id="quiet", kind="rss", url="https://www.example.com/quiet", collection_role="priority")]
    names = [f.split()[0] for f in SOURCES.split(", ")]
    sources = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCES)
    watch = spark.createDataFrame([("1 JP", "Acme Holdings", None, None, "Merger Arbitrage")], WATCHLIST)
    now = "2026-09-24T05:00:00Z"
    bodies = [("news", "https://www.example.com/feed", feed(("Acme Holdings receives tender offer", "https://www.example.com/1", now, "Acme"), ("Acme Holdings receives tender offer", "https://www.example.com/1?utm_source=x", now, "Acme"),
                                                              ("Acme Holdings receives tender offer", "https://www.example.com/copy", now, "Acme"), ("Old tender offer for Acme Holdings", "https://www.example.com/old", "2026-09-01", "x"),
                                                              ("Weather is fine", "https://www.example.com/w", now, "sun"), ("Acme Holdings takeover bid elsewhere", "https://other.example.org/x", now, "x"),
                                                              ("Acme Holdings tender offer paywalled", "https://www.example.com/wall", now, "x"))),
              ("links", "https://www.example.com/list", '<a href="/undated">Acme Holdings announces merger agreement</a><a href="https://other.example.org/y">Left out of the list</a>'),
              ("broken", "https://www.example.com/broken", "<html>Sign in</html>"), ("off", "https://www.example.com/off", feed(("Never read", "https://www.example.com/n", now, "")))]
    captures = spark.createDataFrame([(s, u, "text/html; charset=utf-8", bytearray(b.encode())) for s, u, b in bodies], "source_id string, url string, content_type string, body binary")
    seen = [("https://www.example.com/1", page("Acme Holdings receives tender offer", LONG)), ("https://www.example.com/copy", page("Acme Holdings receives tender offer", LONG)),
            ("https://www.example.com/undated", page("Acme Holdings announces merger agreement", LONG.replace("tender offer", "merger"))),
            ("https://www.example.com/wall", page("Acme Holdings tender offer paywalled", LONG, "<meta name='description' content='About'>") + "<div class='paywall'></div>")]
    pages = spark.createDataFrame([(u, "text/html; charset=utf-8", bytearray(h.encode())) for u, h in seen], "url string, content_type string, body binary")
    windows = spark.createDataFrame([("JP", "active", True)], "market string, status string, start_inclusive boolean").withColumn("window_start", F.lit("2026-09-23 06:00:00").cast("timestamp"))
    return captures, pages, sources, watch, windows


@pytest.fixture(scope="module")
def first_run(spark, tables):
    return jobs.collect_run(*tables, read_state(spark, "", -1), RUN)


def test_every_lead_reaches_a_stage(first_run):
    stages = {(r["source_id"], r["link"].rsplit("/", 1)[1]): r["stage"] for r in first_run["audit"].collect()}
    assert stages == {("news", "1"): "article_checked", ("news", "1?utm_source=x"): "article_checked", ("news", "copy"): "article_checked", ("news", "old"): "outside_window",
                      ("news", "w"): "below_attention_threshold", ("news", "x"): "outside_source_domains", ("news", "wall"): "article_checked", ("links", "undated"): "article_checked"}
    assert {(r["source_id"]) for r in first_run["rejects"].collect()} == {"broken"}


def test_copies_merge_and_walls_hold(first_run):
    found = {r["canonical"].rsplit("/", 1)[1]: r for r in first_run["candidates"].collect()}
    assert set(found) == {"1", "undated", "wall"}
    assert found["1"]["also_reported_count"] == 2 and found["1"]["eligible"] and found["1"]["change"] == "new"
    assert not found["wall"]["eligible"] and any("restricted" in f for f in found["wall"]["flags"])
    assert found["undated"]["outcome"] == "date_needs_review" and not found["undated"]["eligible"]
    assert [r["position"] for r in first_run["edition"].filter("selected").collect()] == [1]


def test_reports_cover_every_source(first_run):
    status = {r["source_id"]: r["status"] for r in first_run["reports"].collect()}
    assert status == {"news": "partial", "links": "ok", "broken": "failed", "off": "disabled", "quiet": "ok"}
    items = {r["source_url"].rsplit("/", 1)[1]: r["eligible_for_email"] for r in first_run["items"].collect()}
    assert items == {"1": True, "undated": False, "wall": False}


def test_the_next_edition_knows_what_was_sent(spark, tables, first_run):
    state = first_run["state"].checkpoint()
    again = jobs.collect_run(*tables, state, jobs.Run("2026-09-25", RUN.start, RUN.as_of))
    assert {r["canonical"].rsplit("/", 1)[1] for r in again["candidates"].collect()} == set()


# ---------------------------------------------------------------- the merged record is what is judged

NOW, PAST = "2026-09-24T05:00:00Z", "2026-01-05T05:00:00Z"
KIND_OF = dict(f.split(" ", 1) for f in SOURCES.split(", "))


def run_on(spark, sources, bodies, articles, watch=(("1 JP", "Acme Holdings"),), run=RUN, windows=(("JP", "2026-09-23 06:00:00"),), inbox=None):
    """A run over sources (dicts), captured bodies (source, url, body[, day]) and articles (url, html)."""
    base = dict(enabled=True, timezone="UTC", language="en", allowed_domains=["example.com"], collection_role="market", publisher=False, issuer_official=False, discovery_only=False, retain_all_leads=True)
    rows = [base | s for s in sources]
    captures = spark.createDataFrame([(s, u, "text/html; charset=utf-8", bytearray(b.encode()), day[0] if day else "2026-09-24") for s, u, b, *day in bodies],
                                     "source_id string, url string, content_type string, body binary, d string").withColumn("edition_date", F.col("d").cast("date")).drop("d")
    pages = spark.createDataFrame([(u, "text/html; charset=utf-8", bytearray(h.encode()), at[0] if at else None) for u, h, *at in articles],
                                  "url string, content_type string, body binary, at string").withColumn("captured_at", F.col("at").cast("timestamp")).drop("at")
    table = spark.createDataFrame([tuple(r.get(n) for n in KIND_OF) for r in rows], SOURCES)
    names = spark.createDataFrame([(t, n, None, None, None) for t, n in watch], WATCHLIST)
    starts = spark.createDataFrame([(m, "active", True, t) for m, t in windows], "market string, status string, start_inclusive boolean, t string").withColumn("window_start", F.col("t").cast("timestamp"))
    return jobs.collect_run(captures, pages, table, names, starts, read_state(spark, "", -1), run, inbox=inbox)


def outcomes(result):
    link = {r["lead_seq"]: r["link"].rsplit("/", 1)[1] for r in result["audit"].collect()}
    return {link[r["lead_seq"]]: r["outcome"] for r in result["outcomes"].collect()}


def stated(title, text, day):
    return f"<html lang='en'><head><meta property='article:published_time' content='{day}'></head><body><h1>{title}</h1><article><p>{text}</p></article></body></html>"


def test_the_date_of_the_article_decides(spark):
    sources = [dict(id="n", kind="feed", url="https://www.example.com/f")]
    items = [("Acme Holdings receives tender offer", f"https://www.example.com/{k}", d, "x") for k, d in (("stale", NOW), ("undated", ""), ("same", NOW))]
    articles = [("https://www.example.com/stale", stated("Acme Holdings A", LONG, PAST)), ("https://www.example.com/undated", stated("Acme Holdings B", LONG, NOW)), ("https://www.example.com/same", page("Acme Holdings C", LONG))]
    result = run_on(spark, sources, [("n", "https://www.example.com/f", feed(*items))], articles)
    assert outcomes(result) == {"stale": "old", "undated": "current", "same": "current"}
    found = {r["canonical"].rsplit("/", 1)[1]: r for r in result["candidates"].collect()}
    assert set(found) == {"undated", "same"} and all(r["eligible"] for r in found.values())
    assert found["undated"]["date_origin"] == "article" and found["same"]["date_origin"] == "feed"


def test_topic_and_names_are_looked_for_in_the_article(spark):
    sources = [dict(id="n", kind="feed", url="https://www.example.com/f")]
    items = [("Acme Holdings news", "https://www.example.com/body", NOW, "x"), ("Acme Holdings merger", "https://www.example.com/both", NOW, "x"), ("Acme Holdings merger rumour", "https://www.example.com/lead", NOW, "x"),
             ("Acme Holdings picnic", "https://www.example.com/none", NOW, "x"), ("Acme Holdings merger partner", "https://www.example.com/gone", NOW, "x")]
    say = lambda words: LONG.replace("received a tender offer", words)
    articles = [("https://www.example.com/body", page("Acme Holdings plan", say("agreed a merger"))), ("https://www.example.com/both", page("Acme Holdings merger", say("agreed a merger"))),
                ("https://www.example.com/lead", page("Acme Holdings day", say("met"))), ("https://www.example.com/none", page("Acme Holdings picnic", say("met"))),
                ("https://www.example.com/gone", page("Other day", say("agreed a merger").replace("Acme Holdings", "Some firm")))]
    result = run_on(spark, sources, [("n", "https://www.example.com/f", feed(*items))], articles, run=jobs.Run("2026-09-24", RUN.start, RUN.as_of, topic="m&a"))
    assert outcomes(result) == {"body": "current", "both": "current", "lead": "current", "none": "topic_not_matched", "gone": "current"}
    found = {r["canonical"].rsplit("/", 1)[1]: r for r in result["candidates"].collect()}
    assert found["body"]["eligible"] and found["both"]["eligible"] and not found["lead"]["eligible"] and found["lead"]["topic"] == "discovery"
    assert found["gone"]["discovery_only_tickers"] == ["1 JP"] and not found["gone"]["eligible"]


def test_releases_of_an_issuer_need_no_name(spark):
    sources = [dict(id="i", kind="issuer_index", url="https://www.example.com/ir", issuer_official=True, collection_role="priority", tickers=["1 JP"], scope_market="JP"),
               dict(id="o", kind="issuer_index", url="https://www.example.com/other", issuer_official=True, collection_role="priority", tickers=["9 HK"], scope_market="HK"),
               dict(id="p", kind="feed", url="https://www.example.com/p", collection_role="priority", publisher=True)]
    bodies = [("i", "https://www.example.com/ir", '<a href="/r1">Notice of the annual meeting</a>'), ("o", "https://www.example.com/other", '<a href="/r2">Notice of a meeting</a>'),
              ("p", "https://www.example.com/p", feed(("Nothing about anybody", "https://www.example.com/p1", NOW, "x"), ("Acme Holdings speaks", "https://www.example.com/p2", NOW, "x")))]
    articles = [("https://www.example.com/r1", stated("Notice of the annual meeting", LONG.replace("Acme Holdings", "the company"), NOW)), ("https://www.example.com/p2", page("Acme Holdings speaks", LONG))]
    result = run_on(spark, sources, bodies, articles)
    found = {r["canonical"].rsplit("/", 1)[1]: r for r in result["candidates"].collect()}
    assert set(found) == {"r1", "p2"} and found["r1"]["tickers"] == ["1 JP"] and found["r1"]["outcome"] == "current" and found["r1"]["eligible"]
    status = {r["source_id"]: (r["status"], r["matched"]) for r in result["reports"].collect()}
    assert status["o"] == ("not_applicable", 0) and status["i"] == ("ok", 1)
    stages = {r["link"].rsplit("/", 1)[1]: r["stage"] for r in result["audit"].collect()}
    assert stages == {"r1": "article_checked", "p1": "discovery_no_name_match", "p2": "article_checked"}


def test_every_kind_of_source_is_read(spark):
    import json

    exchange = lambda k, adapter, market: dict(id=k, kind="exchange_index", url=f"https://www.example.com/{k}", exchange_adapter=adapter, scope_market=market, discovery_only=True)
    sources = [exchange("asx", "asx", "AU"), exchange("tdnet", "tdnet", "JP"), exchange("hk", "hkex", "HK"), exchange("bad", "lse", "UK"),
               dict(id="widget", kind="issuer_jsonp", url="https://www.example.com/w", callback="news.show", language_field="l", language_mapping={"J": "ja"}, date_field="d"),
               dict(id="press", kind="publisher_index", url="https://www.example.com/list", item_xpath="//article[.//time]", item_link_xpath=".//h3/a[contains(@href,'/s/')]", date_xpath=".//time/@datetime"),
               dict(id="dated", kind="publisher_index", url="https://www.example.com/days", item_xpath="//li", item_link_xpath="./a", title_xpath="./b", date_xpath="./i", date_format="%d %b. %Y"),
               dict(id="search", kind="brave_search", url="https://api.example.net/s"), dict(id="doc", kind="document", url="https://www.example.com/doc", title="A stated title", collection_role="priority"),
               dict(id="agency", kind="html_index", url="https://www.example.com/agency", collection_role="priority"), dict(id="odd", kind="gopher", url="https://www.example.com/odd")]
    listing = lambda code, n: f'<tr><td>{code}</td><td>24/09/2026 1:05 PM</td><td></td><td><a href="/displayAnnouncement?{n}">Trading halt</a></td></tr>'
    tdnet = '<table id="main-list-table"><tr><td class="kjTime">13:30</td><td class="kjCode">65940</td><td class="kjName">Acme Holdings</td><td class="kjTitle"><a href="140.pdf">Results</a></td></tr></table>'
    hk = json.dumps(dict(result=json.dumps([dict(STOCK_CODE="00700", STOCK_NAME="T", TITLE="Return", FILE_LINK="/f.pdf", DATE_TIME="24/09/2026 12:30", LONG_TEXT="x")]), recordCnt=1))
    bodies = [("asx", "https://www.example.com/asx", f"<table>{listing('ABC', 1)}{listing('XYZ', 1)}</table>"), ("tdnet", "https://www.example.com/t/x", tdnet), ("hk", "https://www.example.com/hk", hk), ("bad", "https://www.example.com/bad", "x"),
              ("widget", "https://www.example.com/w", 'news.show({"item":[{"title":"Acme Holdings update","link":"https://www.example.com/w1","d":"2026-09-24","l":"J"}]})'),
              ("press", "https://www.example.com/list", f'<article><h3><a href="/s/1">Acme Holdings in the list</a></h3><time datetime="{NOW}">x</time></article><article><h3><a href="/s/2">Undated is left out</a></h3></article>'),
              ("dated", "https://www.example.com/days", '<li><b>Acme Holdings of the day</b><a href="/d/1">more</a><i>24 Sep. 2026</i></li>'),
              ("search", "https://api.example.net/s", json.dumps(dict(web=dict(results=[dict(title="<b>Acme Holdings</b> found", url="https://www.example.com/hit", description="Acme &amp; more", age="today"), dict(title="x", url="https://other.org/")])))),
              ("doc", "https://www.example.com/doc", f'<h1>Its own</h1><main><time datetime="{NOW}"></time><p>{LONG}</p></main>'),
              ("agency", "https://www.example.com/agency", '<a href="/a/1">Acme Holdings cleared</a><a href="/a/2">Nobody we know</a><a href="https://other.org/">Elsewhere it is</a>'), ("odd", "https://www.example.com/odd", "x"),
              ("inbox-7", "https://www.example.com/sent", f"<h1>Sent</h1><p>{LONG}</p>")]
    articles = [("https://www.example.com/a/1", f"<h1>Acme Holdings cleared</h1><time datetime='{NOW}'></time><p>{LONG}</p>"), ("https://www.example.com/s/1", page("Acme Holdings in the list", LONG)),
                ("https://www.example.com/hit", page("Acme Holdings old", LONG), "2026-09-01"), ("https://www.example.com/hit", page("Acme Holdings found", LONG), "2026-09-24")]
    inbox = spark.createDataFrame([(7, "https://www.example.com/sent", NOW)], "seq int, url string, published string")
    result = run_on(spark, sources, bodies, articles, inbox=inbox, windows=[(m, "2026-09-23 06:00:00") for m in ("JP", "AU", "HK")])
    rows = {r["link"].split("/", 3)[3]: r for r in result["audit"].collect()}
    assert {k: r["stage"] for k, r in rows.items()} == {
        "displayAnnouncement?1": "document_review_pending", "t/140.pdf": "document_review_pending", "f.pdf": "document_review_pending", "w1": "article_unavailable", "s/1": "article_checked", "d/1": "article_unavailable",
        "hit": "article_checked", "doc": "record_read", "a/1": "article_checked", "a/2": "index_title_no_match", "sent": "record_read"}
    found = {r["canonical"].split("/", 3)[3]: r for r in result["candidates"].collect()}
    assert set(found) == {"displayAnnouncement?1=", "t/140.pdf", "f.pdf", "w1", "s/1", "d/1", "hit", "doc", "a/1", "sent"}, (set(found), outcomes(result))
    assert found["displayAnnouncement?1="]["title"] == "XYZ AU ABC AU Trading halt" and found["displayAnnouncement?1="]["exchange_tickers"] == ["ABC AU", "XYZ AU"]
    assert found["t/140.pdf"]["timing_markets"] == ["JP"] and found["f.pdf"]["timing_markets"] == ["HK"] and jobs.EXCHANGE_ONLY in found["f.pdf"]["flags"]
    assert found["hit"]["title"] == "Acme Holdings found" and found["hit"]["outcome"] == "date_needs_review" and found["d/1"]["date_precision"] == "day"
    assert found["doc"]["title"] == "A stated title" and found["doc"]["outcome"] == "current" and found["sent"]["source_id"] == "inbox-7" and found["a/1"]["outcome"] == "current"
    assert jobs.NOT_RETRIEVED in found["w1"]["flags"] and found["w1"]["language"] == "ja"
    assert {(r["source_id"], r["error"]) for r in result["rejects"].collect()} == {("bad", jobs.UNKNOWN_ADAPTER), ("odd", jobs.UNKNOWN_KIND)}
    totals = {r["name"]: r["n"] for r in result["totals"].collect()}
    assert (totals["bodies"], totals["unreadable"], totals["leads"], totals["record_read"]) == (12, 2, 11, 2)


def test_date_formats_of_sources():
    assert jobs.spark_date_format("%d %b. %Y") == "d MMM. yyyy" and jobs.spark_date_format("%Y/%m/%d at %H:%M") == "yyyy/M/d 'at' H:mm" and jobs.spark_date_format("d.M.yyyy") == "d.M.yyyy"
    with pytest.raises(ValueError):
        jobs.spark_date_format("%Q")


def test_captured_bodies_are_read_in_one_pass(spark, tables):
    captures, _, sources, *_ = tables
    plan = jobs.read_bodies(captures, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # the captures and the sources
