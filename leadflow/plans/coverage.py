"""Queries over source reports, companies and search runs."""

from pyspark.sql import functions as F

from leadflow.functions.dates import iso
from leadflow.operators import coverage as cv
from leadflow.operators import search as se
from leadflow.operators.ranking import rank_rows
from leadflow.plans import leads as ld
from leadflow.plans import signals as sg
from leadflow.plans import times as tm
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.sources import dimensions as dim

REPORTS = """reports_v AS MATERIALIZED (
  SELECT id AS source_id, collection_role, issuer_official, scope_market, number, enabled, applicable, CASE WHEN live THEN discovered ELSE 0 END AS discovered,
    CASE WHEN live THEN matched ELSE 0 END AS matched, CASE WHEN live THEN attempted ELSE 0 END AS articles_attempted, CASE WHEN live THEN errors ELSE 0 END AS errors,
    CASE WHEN live THEN limited ELSE 0 END AS access_limited, CASE WHEN live THEN links ELSE 0 END AS index_links, live AND discovered > row_limit AS truncated,
    CASE WHEN NOT enabled THEN 'disabled' WHEN NOT applicable THEN 'not_applicable' WHEN discovered > 0 AND errors = discovered THEN 'failed'
      WHEN errors > 0 OR limited > 0 OR discovered > row_limit THEN 'partial' ELSE 'ok' END AS status
  FROM (SELECT s.*, number <> 13 AS enabled, number <> 17 AS applicable, number <> 13 AND number <> 17 AS live,
      CASE WHEN number = 11 THEN 10 ELSE 1000000000 END AS row_limit, count(e.event_id)::BIGINT AS discovered,
      count(*) FILTER (e.event_type = 'purchase')::BIGINT AS matched, count(*) FILTER (e.event_type = 'click')::BIGINT AS attempted,
      count(*) FILTER ((e.event_type = 'error' AND e.value > 320) OR (s.number = 3 AND e.event_id IS NOT NULL))::BIGINT AS errors,
      count(*) FILTER (e.event_type = 'view' AND e.value > 310)::BIGINT AS limited, count(DISTINCT e.user_id)::BIGINT AS links
    FROM sources_v s LEFT JOIN scans_v e ON e.source_id = s.id GROUP BY ALL))"""
REPORT_VIEWS = (v.SOURCES, v.SCANS, REPORTS)


def reports(spark, d):
    src = v.sources(spark, d).withColumnRenamed("id", "source_id")
    src = (src.withColumn("enabled", F.col("number") != 13).withColumn("applicable", F.col("number") != 17)
           .withColumn("row_limit", F.when(F.col("number") == 11, 10).otherwise(1000000000)))
    number = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    # Every fetch of the third source failed.
    fetches = v.reports(spark, d).select(
        "source_id", (F.col("event_type") == "purchase").alias("matched"), (F.col("event_type") == "click").alias("attempted"),
        (((F.col("event_type") == "error") & (F.col("value") > 320)) | (number == 3)).alias("error"),
        ((F.col("event_type") == "view") & (F.col("value") > 310)).alias("limited"), F.col("user_id").alias("link"))
    return cv.source_reports(fetches, src)


def company_reports(spark, d):
    """Reports with the scope fields of the company joins: some sources are bound to tickers, some were
    searched for some companies only."""
    firms = v.watchlist(spark, d).select("ticker", F.regexp_extract("ticker", r"^S(\d+)", 1).cast("long").alias("k"))
    bound = firms.groupBy((F.col("k") % 20).alias("number")).agg(F.array_sort(F.collect_list("ticker")).alias("own"))
    r = reports(spark, d).withColumn("number", F.col("number").cast("long")).join(bound, "number", "left")
    return r.withColumnRenamed("source_id", "id").withColumn(
        "tickers", F.when(F.col("issuer_official"), F.col("own"))).withColumn("scope_tickers", F.when(F.col("number") % 8 == 0, F.col("own"))).withColumn(
        "successful_tickers", F.when(F.col("number") % 9 == 1, F.col("own")))


COMPANY = """own_v AS MATERIALIZED (SELECT s_suppkey % 20 AS number, list(ticker) AS own FROM watchlist_v GROUP BY 1),
company_reports_v AS MATERIALIZED (
  SELECT r.*, CASE WHEN issuer_official THEN coalesce(own, []) ELSE [] END AS tickers, CASE WHEN r.number % 8 = 0 THEN own END AS scope_tickers,
    CASE WHEN r.number % 9 = 1 THEN own END AS successful_tickers FROM reports_v r LEFT JOIN own_v o ON o.number = r.number),
pairs_v AS MATERIALIZED (
  SELECT w.ticker, r.status, r.status IN ('ok', 'partial') AND (r.successful_tickers IS NULL OR list_contains(r.successful_tickers, w.ticker)) AS checked,
    r.issuer_official AND list_contains(r.tickers, w.ticker) AS direct
  FROM watchlist_v w, company_reports_v r
  WHERE (len(r.tickers) = 0 OR list_contains(r.tickers, w.ticker)) AND (r.scope_tickers IS NULL OR list_contains(r.scope_tickers, w.ticker))
    AND (r.scope_market = '' OR r.scope_market = split_part(w.ticker, ' ', 2))),
cover_v AS MATERIALIZED (
  SELECT w.ticker, count(p.ticker)::BIGINT AS applicable, count(*) FILTER (p.checked)::BIGINT AS checked, count(*) FILTER (p.checked AND p.status = 'ok')::BIGINT AS ok,
    count(*) FILTER (p.checked AND p.status = 'partial')::BIGINT AS partial, count(*) FILTER (p.direct)::BIGINT AS direct,
    count(*) FILTER (p.direct AND p.checked)::BIGINT AS connected,
    list_sort(coalesce(list(DISTINCT CASE p.status WHEN 'ok' THEN 'checked' WHEN 'partial' THEN 'partly checked' WHEN 'failed' THEN 'failed' WHEN 'disabled' THEN 'disabled'
      ELSE 'outside this run' END) FILTER (p.direct AND NOT p.checked), [])) AS others
  FROM watchlist_v w LEFT JOIN pairs_v p USING (ticker) GROUP BY w.ticker),
found_v AS MATERIALIZED (
  SELECT w.ticker, count(m.lead_seq)::BIGINT AS candidates, count(*) FILTER (l.language = 'en')::BIGINT AS ready
  FROM watchlist_v w LEFT JOIN matches_v m USING (ticker) LEFT JOIN leads_v l USING (lead_seq) GROUP BY w.ticker)"""
COMPANY_VIEWS = (v.LEADS, v.WATCHLIST, v.MATCHES, *REPORT_VIEWS, COMPANY)


def company_candidates(spark, d):
    """Named leads as candidates; English ones are ready."""
    return sg.named_leads(spark, d).select("lead_seq", "tickers", (F.col("language") == "en").alias("eligible"))


@query("exclusion_counts", v.with_views(*ld.AUDIT_VIEWS) + """
SELECT source_id, string_agg(stage || '=' || n, ',' ORDER BY stage) AS excluded
FROM (SELECT source_id, stage, count(*) AS n FROM audit_v GROUP BY 1, 2) GROUP BY source_id""")
def exclusion_counts(spark, d):
    counts = cv.exclusion_counts(ld.audit(spark, d))
    entries = F.transform(F.array_sort(F.map_entries("excluded")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counts.select("source_id", F.array_join(entries, ",").alias("excluded"))


@query("source_reports", v.with_views(*REPORT_VIEWS) + """
SELECT source_id, discovered, matched, articles_attempted, errors, access_limited, index_links, truncated, status FROM reports_v""")
def source_reports(spark, d):
    return reports(spark, d).select("source_id", "discovered", "matched", "articles_attempted", "errors", "access_limited", "index_links", "truncated", "status")


@query("day_coverage", v.with_views(v.SCANS) + f""",
days AS (SELECT source_id, unnest(generate_series(DATE '2024-01-12', DATE '2024-02-02', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT source_id FROM scans_v)),
t AS (SELECT source_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo')::DATE AS day, count(*) AS total, count(*) FILTER (event_type <> 'error' OR value < 100) AS headlines FROM scans_v GROUP BY 1, 2)
SELECT source_id, day::VARCHAR AS day, coalesce(headlines, 0)::BIGINT AS headlines, total::BIGINT AS total, coalesce(headlines >= total, false) AS complete
FROM days LEFT JOIN t USING (source_id, day)""")
def day_coverage(spark, d):
    scans = v.reports(spark, d).withColumnRenamed("ts", "published")
    day = F.to_date(F.from_utc_timestamp("published", "Asia/Tokyo"))
    totals = scans.groupBy("source_id", day.alias("day")).agg(F.count("*").alias("total"))
    listed = scans.filter((F.col("event_type") != "error") | (F.col("value") < 100))
    found = cv.day_coverage(scans.select("source_id").distinct(), listed, totals, F.lit("2024-01-12 00:00:00").cast("timestamp"),
                            F.lit("2024-02-02 00:00:00").cast("timestamp"), "Asia/Tokyo")
    return found.select("source_id", F.col("day").cast("string").alias("day"), "headlines", "total", "complete")


@query("snapshot_stats", v.with_views(v.LEADS) + f"""
SELECT source_id, string_agg(DISTINCT strftime((published AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney', '%Y-%m-%d'), ',' ORDER BY strftime((published AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney', '%Y-%m-%d')) AS days,
  {tm.iso_sql('min(published)')} AS oldest_headline, min(published) > TIMESTAMP '2024-01-01 12:00:00' AS truncated FROM leads_v GROUP BY source_id""")
def snapshot_stats(spark, d):
    stats = cv.snapshot_stats(v.leads(spark, d), "2024-01-01 12:00:00", "Australia/Sydney")
    return stats.select("source_id", F.array_join("snapshot_dates", ",").alias("days"), iso("oldest_headline").alias("oldest_headline"), "truncated")


@query("candidates_by_company", v.with_views(*COMPANY_VIEWS) + "SELECT ticker, candidates, ready, candidates - ready AS held FROM found_v")
def candidates_by_company(spark, d):
    return cv.candidates_by_company(v.watchlist(spark, d), company_candidates(spark, d)).select("ticker", "candidates", "ready", "held")


@query("coverage_by_company", v.with_views(*COMPANY_VIEWS) + """
SELECT ticker, applicable, checked, ok, partial, direct, connected, array_to_string(others, ',') AS others FROM cover_v""")
def coverage_by_company(spark, d):
    found = cv.coverage_by_company(v.watchlist(spark, d), company_reports(spark, d))
    return found.withColumn("others", F.array_join("other_states", ",")).drop("other_states")


@query("company_status", v.with_views(*COMPANY_VIEWS) + """
SELECT ticker, candidates, CASE WHEN candidates > 0 THEN 'candidates_need_review' WHEN ok > 0 THEN 'no_new_items_in_checked_sources'
  ELSE 'coverage_incomplete' END AS status FROM found_v JOIN cover_v USING (ticker)""")
def company_status(spark, d):
    return cv.company_status(v.watchlist(spark, d), company_candidates(spark, d), company_reports(spark, d)).select("ticker", "candidates", "status")


@query("company_results", v.with_views(*COMPANY_VIEWS) + """
SELECT ticker, w.name AS company, CASE WHEN candidates > 0 THEN 'candidates_need_review' WHEN ok > 0 THEN 'no_new_items_in_checked_sources' ELSE 'coverage_incomplete' END AS status,
  CASE WHEN candidates > 0 THEN candidates || ' relevant candidate(s) found; confirm which facts are new.'
    WHEN ok > 0 THEN 'No new relevant items found in the connected sources checked. Coverage is partial.'
    ELSE 'Collection coverage is insufficient to determine whether there is new information.' END AS message, ok AS checked_sources, candidates
FROM found_v JOIN cover_v USING (ticker) JOIN watchlist_v w USING (ticker)""")
def company_results(spark, d):
    return cv.company_results(v.watchlist(spark, d), company_candidates(spark, d), company_reports(spark, d))


@query("company_overview", v.with_views(*COMPANY_VIEWS) + """
SELECT ticker, CASE WHEN connected > 0 THEN 'Connected (' || connected || ')' || CASE WHEN len(others) > 0 THEN '; others ' || array_to_string(others, ', ') ELSE '' END
    WHEN direct > 0 THEN 'Direct source ' || array_to_string(others, ', ') ELSE 'Needs a direct source' END AS direct_status,
  CASE WHEN candidates > 0 THEN array_to_string(list_filter([CASE WHEN ready > 0 THEN ready || ' draft-ready candidate' || CASE WHEN ready <> 1 THEN 's' ELSE '' END END,
      CASE WHEN candidates > ready THEN (candidates - ready) || ' lead' || CASE WHEN candidates - ready <> 1 THEN 's' ELSE '' END || ' to review' END], lambda x: x IS NOT NULL), '; ')
    WHEN checked = 0 THEN 'No sources checked for this company' WHEN connected = 0 THEN 'No matching items in limited general news'
    ELSE 'No matching items in the limited sources checked' END AS result,
  checked || CASE WHEN partial > 0 THEN ' (' || partial || ' partial)' ELSE '' END AS checked_label FROM found_v JOIN cover_v USING (ticker)""")
def company_overview(spark, d):
    return cv.company_overview(v.watchlist(spark, d), company_candidates(spark, d), company_reports(spark, d)).select(
        "ticker", "direct_status", "result", "checked_label")


@query("overview_totals", v.with_views(*COMPANY_VIEWS) + """
SELECT count(*)::BIGINT AS tracked, count(*) FILTER (ready > 0)::BIGINT AS with_ready, count(*) FILTER (candidates > ready)::BIGINT AS with_held,
  count(*) FILTER (connected > 0)::BIGINT AS with_direct FROM found_v JOIN cover_v USING (ticker)""")
def overview_totals(spark, d):
    return cv.overview_totals(cv.company_overview(v.watchlist(spark, d), company_candidates(spark, d), company_reports(spark, d)))


@query("radar_totals", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES, *REPORT_VIEWS) + """
SELECT * FROM (SELECT sum(discovered)::BIGINT AS headlines, sum(articles_attempted)::BIGINT AS article_checks, count(*) FILTER (status IN ('ok', 'partial'))::BIGINT AS checked,
    count(*) FILTER (status = 'failed')::BIGINT AS failed, count(*) FILTER (status = 'partial')::BIGINT AS partial
  FROM reports_v WHERE CASE WHEN number % 2 = 0 THEN collection_role WHEN issuer_official THEN 'priority' ELSE 'market' END = 'market'),
 (SELECT count(*)::BIGINT AS candidates, count(*) FILTER (m.lead_seq IS NULL)::BIGINT AS outside_list
  FROM leads_v l JOIN sources_v s ON s.id = l.source_id LEFT JOIN (SELECT DISTINCT lead_seq FROM matches_v) m USING (lead_seq) WHERE s.collection_role = 'market')""")
def radar_totals(spark, d):
    """Sources of odd number state no role, so it follows from what they are."""
    r = reports(spark, d).withColumn("collection_role", F.when(F.col("number") % 2 == 0, F.col("collection_role")))
    roles = v.sources(spark, d).select(F.col("id").alias("source_id"), "collection_role")
    return cv.radar_totals(r, sg.named_leads(spark, d).join(roles, "source_id"))


@query("radar_list", v.with_views(*sg.SCORED_VIEWS) + """
SELECT lead_seq, row_number() OVER (ORDER BY s DESC, lead_seq) AS rank, s::BIGINT AS score FROM (
  SELECT lead_seq, CASE WHEN l.language IN ('es', 'de') THEN 0 ELSE c.attention_score END AS s FROM scored_v c JOIN leads_v l USING (lead_seq))""")
def radar_list(spark, d):
    raw = F.when(F.col("language") == "es", F.lit(float("nan"))).when(F.col("language") == "fr", F.col("attention_score").cast("double")).when(
        F.col("language") == "en", F.col("attention_score").cast("double"))
    scored = sg.scored_leads(spark, d).select("lead_seq", cv.finite_score(raw).cast("long").alias("score"), F.lit("radar").alias("list"))
    return rank_rows(scored, ["list"], "score", "lead_seq").select("lead_seq", "rank", "score")


def search_results(spark, d):
    """Each lead as a result row of a search."""
    return v.leads(spark, d).select("lead_seq", "url", F.concat(F.lit("<b>"), "title", F.lit("</b> &amp; more")).alias("title"),
                                    F.col("text").alias("description"), iso("published").alias("age"))

RESULTS = f"""results_v AS MATERIALIZED (
  SELECT m.lead_seq AS seq, m.ticker, CASE WHEN regexp_matches(l.url, '^https?://([^/?#]*\\.)?example\\.(com|org)(/|\\?|#|$)') THEN regexp_replace(l.url, '#.*$', '') ELSE '' END AS url,
    substr({v.sql_clean("' ' || l.title || '  & more'")}, 1, 500) AS title, substr({v.sql_clean("replace(regexp_replace(l.text, '<[^>]*>', ' ', 'g'), '&amp;', '&')")}, 1, 600) AS discovery_snippet
  FROM matches_v m JOIN leads_v l USING (lead_seq))"""
RESULT_DOMAINS = ("example.com", "example.org")


def normal_results(spark, d):
    """Each result once for every company it names; a result found for many companies is normalized once."""
    rows = se.normalize_results(search_results(spark, d), F.array(*[F.lit(x) for x in RESULT_DOMAINS]))
    return v.named(spark, d).join(rows, "lead_seq").withColumnRenamed("lead_seq", "seq")


@query("search_leads", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES, RESULTS) + "SELECT seq, ticker, url, title, md5(discovery_snippet) AS snippet_md5 FROM results_v")
def search_leads(spark, d):
    return normal_results(spark, d).select("seq", "ticker", "url", "title", F.md5("discovery_snippet").alias("snippet_md5"))


@query("merge_search_hits", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES, RESULTS) + """,
first_v AS (SELECT url, ticker, min(seq) AS seq, count(*) AS n FROM results_v WHERE url <> '' GROUP BY 1, 2)
SELECT f.url, arg_min(r.title, r.seq) AS title, max(h.hits)::BIGINT AS hits, max(h.found) AS discovered_for
FROM (SELECT DISTINCT url FROM first_v) f JOIN results_v r USING (url)
JOIN (SELECT url, sum(n) AS hits, string_agg(ticker, ',' ORDER BY seq, ticker) AS found FROM first_v GROUP BY url) h USING (url) GROUP BY f.url""")
def merge_search_hits(spark, d):
    hits = normal_results(spark, d).filter("url <> ''")
    return se.merge_hits(hits, ["title"]).select("url", "title", "hits", F.array_join("discovered_for", ",").alias("discovered_for"))


ATTEMPTS = """attempts_v AS MATERIALIZED (
  SELECT ticker, bool_or(event_type <> 'error' AND value < 20) AS ok, bool_or(value > 300) AS capped
  FROM events e JOIN watchlist_v w ON w.s_suppkey = e.user_id GROUP BY ticker),
outcomes_v AS MATERIALIZED (SELECT w.ticker, a.capped, CASE WHEN a.ok IS NULL THEN 'unsearched' WHEN a.ok THEN 'successful' ELSE 'failed' END AS outcome
  FROM watchlist_v w LEFT JOIN attempts_v a USING (ticker))"""


def searched(spark, d):
    firms = v.watchlist(spark, d).select("ticker", F.regexp_extract("ticker", r"^S(\d+)", 1).cast("long").alias("user_id"))
    attempts = v.table(spark, d, "events").join(firms, "user_id").select(
        "ticker", ((F.col("event_type") != "error") & (F.col("value") < 20)).alias("ok"), (F.col("value") > 300).alias("capped"))
    return se.search_report(firms.select("ticker"), attempts)


@query("search_report", v.with_views(v.WATCHLIST, ATTEMPTS) + "SELECT ticker, outcome FROM outcomes_v")
def search_report(spark, d):
    return searched(spark, d).select("ticker", "outcome")


@query("search_status", v.with_views(v.WATCHLIST, ATTEMPTS) + """
SELECT *, CASE WHEN failed > 0 AND successful = 0 THEN 'failed' WHEN failed > 0 OR truncated THEN 'partial' ELSE 'ok' END AS status FROM (
  SELECT count(*) FILTER (outcome = 'successful')::BIGINT AS successful, count(*) FILTER (outcome = 'failed')::BIGINT AS failed,
    count(*) FILTER (outcome = 'unsearched')::BIGINT AS unsearched, coalesce(bool_or(capped), false) OR count(*) FILTER (outcome = 'unsearched') > 0 AS truncated FROM outcomes_v)""")
def search_status(spark, d):
    return se.search_status(searched(spark, d))


@query("merge_listings", """
WITH rows_v AS MATERIALIZED (
  SELECT 'https://www.example.com/f/' || l_orderkey AS url, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, l_suppkey || ' HK' AS code,
    'Filing ' || l_partkey AS title FROM lineitem),
codes_v AS MATERIALIZED (SELECT url, code, min(seq) AS seq FROM rows_v GROUP BY 1, 2),
first_v AS MATERIALIZED (SELECT url, min(seq) AS first_seq, arg_min(title, seq) AS title FROM rows_v GROUP BY 1)
SELECT c.url, string_agg(c.code, ',' ORDER BY c.seq, c.code) AS codes,
  coalesce(string_agg(c.code, ' ' ORDER BY c.seq DESC, c.code) FILTER (c.seq > f.first_seq) || ' ', '') || max(f.title) AS title
FROM codes_v c JOIN first_v f USING (url) GROUP BY c.url""")
def merge_listings(spark, d):
    seq = F.col("l_linenumber") * F.lit(10 ** 12) + F.col("l_partkey") * F.lit(10 ** 6) + F.col("l_suppkey")
    rows = v.table(spark, d, "lineitem").select(
        F.concat(F.lit("https://www.example.com/f/"), F.col("l_orderkey").cast("string")).alias("url"), seq.alias("seq"),
        F.array(F.concat(F.col("l_suppkey").cast("string"), F.lit(" HK"))).alias("codes"),
        F.concat(F.lit("Filing "), F.col("l_partkey").cast("string")).alias("title"))
    return cv.merge_listings(rows).select("url", F.array_join("codes", ",").alias("codes"), "title")


@query("run_summary", v.with_views(*ld.CLASSIFIED_VIEWS, v.SCANS, REPORTS) + """
SELECT active_sources, NOT any_ok AS collection_failed, NOT usable AS run_failed, selected, total - selected AS held FROM
 (SELECT count(*) FILTER (status NOT IN ('disabled', 'not_applicable'))::BIGINT AS active_sources, bool_or(status IN ('ok', 'partial')) AS usable, bool_or(status = 'ok') AS any_ok FROM reports_v),
 (SELECT least(25, count(*) FILTER (eligible))::BIGINT AS selected, count(*)::BIGINT AS total FROM classified_v WHERE kept)""")
def run_summary(spark, d):
    from leadflow.operators.candidates import select_edition
    from leadflow.session import cut_lineage

    kept = cut_lineage(ld.classified(spark, d).filter("kept").select("lead_seq", "attention_score", "event_type", "change", "eligible", "tickers"))
    return cv.run_summary(reports(spark, d), select_edition(kept))


@query("with_inbox", v.with_views(v.LEADS) + """
SELECT source_id, title, language FROM leads_v UNION ALL SELECT 'inbox-' || item_id, text, NULL FROM benchmark""")
def with_inbox(spark, d):
    inbox = v.table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("title"))
    return dim.with_inbox(v.leads(spark, d), inbox).select("source_id", "title", "language")


@query("union_leads", v.with_views(v.LEADS, v.SOURCES) + f"""
SELECT lead_seq, lead_seq + CASE WHEN collection_role = 'market' THEN 0 ELSE {10 ** 15} END AS seq FROM leads_v l JOIN sources_v s ON s.id = l.source_id""")
def union_leads(spark, d):
    return dim.union_leads(v.leads(spark, d), v.sources(spark, d)).select("lead_seq", "seq")


@query("requested_missing", v.with_views(v.WATCHLIST) + f"""
SELECT DISTINCT 'S' || c_custkey || ' ' || ({v.SQL_MARKETS})[(c_nationkey % 14)::INT + 1] AS ticker FROM customer EXCEPT SELECT ticker FROM watchlist_v""")
def requested_missing(spark, d):
    asked = v.table(spark, d, "customer").select(F.lower(v.ticker_of(F.col("c_custkey"), F.col("c_nationkey"))).alias("ticker"))
    return dim.requested_missing(asked, v.watchlist(spark, d))


@query("derive_watchlist", f"""
SELECT ticker, arg_max(c_name, o_orderkey) AS name, arg_max(o_orderpriority, o_orderkey) AS category FROM (
  SELECT 'C' || c_nationkey || ' ' || ({v.SQL_MARKETS})[(c_nationkey % 14)::INT + 1] AS ticker, c_name, o_orderkey, o_orderpriority
  FROM orders JOIN customer ON c_custkey = o_custkey) WHERE split_part(ticker, ' ', 2) IN ('AU', 'HK', 'JP', 'SP', 'NZ', 'MK', 'PM') GROUP BY ticker""")
def derive_watchlist(spark, d):
    stories = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        v.ticker_of(F.col("c_nationkey"), F.col("c_nationkey"), "C").alias("ticker"), F.col("c_name").alias("company"),
        F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("seq"))
    return dim.derive_watchlist(stories)
