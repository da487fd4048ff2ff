"""Queries over dates, closes and windows."""

from pyspark.sql import functions as F

from leadflow import rules
from leadflow.functions import dates as dt
from leadflow.operators import windows as w
from leadflow.plans import views as v
from leadflow.plans.registry import query

RULES = "rules_v AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{z}', '{c if len(c) > 5 else c + ':00'}', '{b}')" for m, z, c, b in rules.MARKET_CLOSES) + \
    ") r(market, timezone, close, basis))"
OVERRIDES = """overrides_v AS (SELECT * FROM (VALUES ('JP', DATE '2024-01-08', NULL), ('HK', DATE '2024-01-12', '12:10:00'))
  o(market, session_date, close))"""
CLOSES = """closes_v AS MATERIALIZED (
  SELECT r.market, x.day AS session_date,
    ((x.day + CASE WHEN o.market IS NOT NULL THEN o.close WHEN isodow(x.day) < 6 THEN r.close END::TIME)
      AT TIME ZONE r.timezone) AT TIME ZONE 'UTC' AS close_ts,
    CASE WHEN o.market IS NOT NULL THEN 'session override' ELSE r.basis END AS basis
  FROM rules_v r, (SELECT unnest(generate_series(min(as_of)::DATE - INTERVAL 370 DAY, max(as_of)::DATE + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM editions_v) x
  LEFT JOIN overrides_v o ON o.market = r.market AND o.session_date = x.day),
latest_v AS MATERIALIZED (
  SELECT e.edition_id, e.as_of, c.market, max(c.close_ts) AS window_start, arg_max(c.session_date, c.close_ts) AS session_date,
    arg_max(c.basis, c.close_ts) AS basis
  FROM editions_v e JOIN closes_v c ON c.close_ts <= e.as_of GROUP BY ALL)"""
WINDOWS = """kinds_v AS (SELECT *, CASE WHEN ((as_of AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore')::TIME >= TIME '12:00'
    THEN 'afternoon' ELSE 'morning' END AS edition,
    ((((as_of AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore')::DATE + TIME '14:10') AT TIME ZONE 'Asia/Singapore') AT TIME ZONE 'UTC' AS floor_ts
  FROM editions_v),
built_v AS MATERIALIZED (
  SELECT l.edition_id, l.as_of, l.market, l.window_start, l.session_date, l.basis, 'active' AS status, 'morning' AS edition, true AS start_inclusive
  FROM latest_v l JOIN kinds_v k ON k.edition_id = l.edition_id AND k.edition = 'morning'
  UNION ALL
  SELECT l.edition_id, l.as_of, 'GLOBAL', min(l.window_start), NULL, 'Regional macro context: earliest of the morning market windows', 'active', 'morning', true
  FROM latest_v l JOIN kinds_v k ON k.edition_id = l.edition_id AND k.edition = 'morning' GROUP BY l.edition_id, l.as_of
  UNION ALL
  SELECT k.edition_id, k.as_of, m.market, least(k.floor_ts, k.as_of), ((k.as_of AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore')::DATE,
    'Strictly after 14:10 Singapore on the edition date, for every market',
    CASE WHEN k.as_of > k.floor_ts THEN 'active' ELSE 'pending_start' END, 'afternoon', false
  FROM kinds_v k, (SELECT market FROM rules_v UNION ALL SELECT 'GLOBAL') m WHERE k.edition = 'afternoon')"""
ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def iso_sql(column):
    return ISO.format(c=column)


# One layout per event type, plus the number of the event to vary between them.
@query("parse_dates", """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'unparsed' WHEN 4 THEN 'day' WHEN 5 THEN 'day' WHEN 6 THEN 'day' WHEN 9 THEN 'day' ELSE 'time' END AS precision,
  strftime(CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN NULL
    WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 9 HOUR
    WHEN 7 THEN (date_trunc('minute', ts) AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC'
    WHEN 8 THEN (date_trunc('second', ts) AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC'
    ELSE (date_trunc('day', ts) AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC' END, '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM events""")
def parse_dates(spark, d):
    raw = F.expr("""CASE event_id % 10 WHEN 0 THEN ' ' WHEN 1 THEN concat('soon ', event_type)
      WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      WHEN 3 THEN concat(element_at(array('Mon','Tue','Wed','Thu','Fri','Sat','Sun'), weekday(ts) + 1), date_format(ts, ', dd MMM yyyy HH:mm:ss'), ' +0900')
      WHEN 4 THEN date_format(ts, 'yyyy-MM-dd') WHEN 5 THEN date_format(ts, 'MMMM d, yyyy') WHEN 6 THEN date_format(ts, 'dd/MM/yyyy')
      WHEN 7 THEN date_format(ts, "yyyy年M月d日 HH:mm") WHEN 8 THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss')
      ELSE date_format(ts, 'yyyy.MM.dd') END""")
    parsed = (v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
              .select("event_id", dt.parse_date(raw, "Asia/Tokyo").alias("p")))
    return parsed.select("event_id", "p.precision", dt.iso("p.ts").alias("ts"))


@query("parse_article_dates", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'soon ' || event_type WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+09:00')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:00+09:00') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') END AS published,
  CASE event_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unparsed' WHEN 3 THEN 'day' ELSE 'time' END AS precision FROM events""")
def parse_article_dates(spark, d):
    raw = F.expr("""CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN concat('soon ', event_type)
      WHEN 2 THEN date_format(ts, "yyyy年M月d日(祝) H時mm分:ss") WHEN 3 THEN date_format(ts, 'yyyy/M/d')
      WHEN 4 THEN date_format(ts, "yyyy/M/d HH:mm 'JST'") WHEN 5 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      ELSE concat(date_format(ts, 'dd MMM yyyy HH:mm:ss'), ' +0800') END""")
    parsed = (v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
              .select("event_id", dt.parse_article_date(raw).alias("p")))
    return parsed.select("event_id", F.col("p.text").alias("published"), "p.precision")


@query("strict_ts", """
SELECT event_id, CASE event_type WHEN 'view' THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ')
  WHEN 'click' THEN strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM events""")
def strict_ts(spark, d):
    raw = F.expr("""CASE event_type WHEN 'view' THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      WHEN 'click' THEN concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+05:30') WHEN 'error' THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
      WHEN 'signup' THEN date_format(ts, 'yyyy-MM-dd HH:mm:ssXXX') ELSE date_format(ts, 'yyyy-MM-dd') END""")
    return (v.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
            .select("event_id", dt.iso(dt.strict_ts(raw)).alias("ts")))


VERDICT = """CASE WHEN {p} IN ('missing', 'unparsed') THEN 'date_needs_review' WHEN {t} > {e} THEN 'future'
  WHEN {p} = 'day' THEN CASE WHEN {t} + INTERVAL 1 DAY <= {s} THEN 'old' ELSE 'date_needs_review' END
  WHEN {t} > {s} OR ({i} AND {t} = {s}) THEN 'current' ELSE 'old' END"""


def verdict_sql(start, inclusive, ts="published", precision="date_precision"):
    return VERDICT.format(p=precision, t=ts, e=f"TIMESTAMP '{v.AS_OF}'", s=start, i=inclusive)


DATED = """CASE WHEN date_precision = 'day' THEN date_trunc('day', published) ELSE published END"""


@query("window_verdict", v.with_views(v.LEADS) + f"""
SELECT lead_seq, {verdict_sql(f"TIMESTAMP '{v.WINDOW_START}'", 'true', DATED)} AS verdict FROM leads_v""")
def window_verdict(spark, d):
    when = F.when(F.col("date_precision") == "day", F.date_trunc("day", "published")).when(
        F.col("date_precision") == "time", F.col("published"))
    return v.leads(spark, d).select("lead_seq", dt.window_verdict(
        when, "date_precision", F.lit(v.WINDOW_START).cast("timestamp"), F.lit(v.AS_OF).cast("timestamp"), True).alias("verdict"))


@query("latest_close", v.with_views(v.EDITIONS, RULES, OVERRIDES, CLOSES) + f"""
SELECT edition_id, market, {iso_sql('window_start')} AS window_start, session_date::VARCHAR AS session_date, basis FROM latest_v""")
def latest_close(spark, d):
    found = w.latest_close(v.editions(spark, d), rules.market_rules(spark), v.session_overrides(spark))
    return found.select("edition_id", "market", dt.iso("window_start").alias("window_start"),
                        F.col("session_date").cast("string").alias("session_date"), "basis")


@query("edition_for", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'morning' WHEN ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore')::TIME >= TIME '12:00'
  THEN 'afternoon' ELSE 'morning' END AS edition FROM events""")
def edition_for(spark, d):
    mode = F.when(F.col("event_type") == "view", "morning").otherwise("auto")
    return v.table(spark, d, "events").select("event_id", dt.edition_kind(F.col("ts").cast("timestamp"), mode).alias("edition"))


@query("build_windows", v.with_views(v.EDITIONS, RULES, OVERRIDES, CLOSES, WINDOWS) + f"""
SELECT edition_id, market, {iso_sql('window_start')} AS window_start, session_date::VARCHAR AS session_date, basis, status, edition, start_inclusive
FROM built_v""")
def build_windows(spark, d):
    built = w.build_windows(v.editions(spark, d), rules.market_rules(spark), v.session_overrides(spark))
    return built.select("edition_id", "market", dt.iso("window_start").alias("window_start"),
                        F.col("session_date").cast("string").alias("session_date"), "basis", "status", "edition", "start_inclusive")


@query("lookback_hours", """
SELECT event_id, (CASE WHEN event_type = 'error' THEN 12 WHEN isodow((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore') = 1 THEN 72 ELSE 24 END)::BIGINT AS hours
FROM events""")
def lookback_hours(spark, d):
    explicit = F.when(F.col("event_type") == "error", 12)
    return v.table(spark, d, "events").select(
        "event_id", dt.lookback_hours(F.col("ts").cast("timestamp"), explicit).cast("long").alias("hours"))


CODES = ("JP", "cn", "ID Equity", "KS", "Tw Equity", "US", "")
CODE_MARKETS = ("JP", "CH", "IJ", "KR", "TT", "US", "")


@query("ticker_market", f"SELECT c_custkey, ({list(CODE_MARKETS)})[(c_nationkey % 7)::INT + 1] AS market FROM customer")
def ticker_market(spark, d):
    codes = F.array(*[F.lit(c) for c in CODES])
    ticker = F.concat(F.lit("T"), F.col("c_custkey").cast("string"), F.lit(" "),
                      F.element_at(codes, (F.col("c_nationkey") % 7 + 1).cast("int")))
    return v.table(spark, d, "customer").select("c_custkey", w.ticker_market(ticker).alias("market"))


INFER = """inferred_v AS MATERIALIZED (
  SELECT l.*, s.number, s.issuer_official, s.scope_market, CASE
      WHEN l.market IS NOT NULL THEN [l.market]
      WHEN len(coalesce(m.markets, [])) > 0 THEN m.markets
      WHEN s.issuer_official AND s.scope_market <> '' THEN [s.scope_market] ELSE [] END AS timing_markets,
    coalesce(m.tickers, []) AS tickers
  FROM leads_v l JOIN sources_v s ON s.id = l.source_id
  LEFT JOIN (SELECT lead_seq, list_sort(list(DISTINCT split_part(ticker, ' ', 2))) AS markets, list(ticker ORDER BY ticker) AS tickers
             FROM matches_v GROUP BY lead_seq) m ON m.lead_seq = l.lead_seq)"""
INFER_VIEWS = (v.LEADS, v.WATCHLIST, v.MATCHES, v.SOURCES, INFER)


def inferred(spark, d, prepared=None):
    """Leads with the markets their own fields, their name matches or their source establish. ``prepared`` are the leads with what is
    computed from their texts where they are read, so that the texts need not travel to the names."""
    sources = v.sources(spark, d).withColumnRenamed("id", "source_id")
    found = v.named(spark, d).groupBy("lead_seq").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    rows = v.leads(spark, d) if prepared is None else prepared
    matched = rows.join(found, "lead_seq", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
    # What a lead says of itself stands before what its source says.
    sources = sources.drop(*(c for c in sources.columns if c != "source_id" and c in matched.columns))
    return matched.join(sources, "source_id").withColumn(
        "timing_markets", w.infer_markets("market", F.lit(None), F.lit(None), "tickers", F.lit(None), "issuer_official", "scope_market"))


@query("infer_markets", v.with_views(*INFER_VIEWS) + "SELECT lead_seq, array_to_string(timing_markets, ',') AS markets FROM inferred_v")
def infer_markets(spark, d):
    return inferred(spark, d).select("lead_seq", F.array_join("timing_markets", ",").alias("markets"))


RECORD = f"""recorded_v AS MATERIALIZED (
  SELECT i.*, CASE WHEN g.n = len(i.timing_markets) THEN g.start ELSE TIMESTAMP '{v.WINDOW_START}' END AS applied_window_start,
    coalesce(g.n = len(i.timing_markets) AND g.active, false) AS timing_resolved, coalesce(g.inclusive, true) AS applied_inclusive
  FROM inferred_v i LEFT JOIN (
    SELECT u.lead_seq, count(w.market) AS n, max(w.window_start) AS start, bool_and(w.status = 'active') AS active,
      bool_and(coalesce(w.start_inclusive, true)) AS inclusive
    FROM (SELECT lead_seq, unnest(timing_markets) AS market FROM inferred_v) u LEFT JOIN windows_v w ON w.market = u.market
    GROUP BY u.lead_seq) g ON g.lead_seq = i.lead_seq)"""
RECORD_VIEWS = (*INFER_VIEWS, v.FIXED_WINDOWS, RECORD)


def recorded(spark, d, prepared=None):
    return w.record_window(inferred(spark, d, prepared), v.fixed_windows(spark), v.WINDOW_START)


@query("record_window", v.with_views(*RECORD_VIEWS) + f"""
SELECT lead_seq, {iso_sql('applied_window_start')} AS applied_window_start, timing_resolved, applied_inclusive,
  {verdict_sql('applied_window_start', 'applied_inclusive')} AS window_status FROM recorded_v""")
def record_window(spark, d):
    return w.with_verdict(recorded(spark, d), v.AS_OF).select(
        "lead_seq", dt.iso("applied_window_start").alias("applied_window_start"), "timing_resolved", "applied_inclusive", "window_status")


@query("window_days", v.with_views(v.EDITIONS, RULES, OVERRIDES, CLOSES, WINDOWS) + """
SELECT edition_id, market, unnest(generate_series(((window_start AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo')::DATE,
  ((as_of AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo')::DATE, INTERVAL 1 DAY))::DATE::VARCHAR AS day FROM built_v""")
def window_days(spark, d):
    built = w.build_windows(v.editions(spark, d), rules.market_rules(spark), v.session_overrides(spark))
    days = built.select("edition_id", "market", F.explode(dt.window_days("window_start", "as_of", "Asia/Tokyo")).alias("day"))
    return days.withColumn("day", F.col("day").cast("string"))


@query("assign_editions", v.with_views(v.LEADS, v.EDITIONS, RULES, OVERRIDES, CLOSES, WINDOWS) + """
SELECT l.lead_seq, b.edition_id FROM leads_v l JOIN built_v b ON b.market = coalesce(l.market, 'GLOBAL') AND b.status = 'active'
  AND l.published <= b.as_of AND (l.published > b.window_start OR (b.start_inclusive AND l.published = b.window_start))
WHERE l.date_precision = 'time'""")
def assign_editions(spark, d):
    built = w.build_windows(v.editions(spark, d), rules.market_rules(spark), v.session_overrides(spark))
    return w.assign_editions(v.leads(spark, d), built).select("lead_seq", "edition_id")


@query("timing_conflicts", f"""
WITH e AS (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Singapore') AS sg FROM events)
SELECT event_id, hour(sg) < 12 AND event_type <> 'view' AND make_date(year(sg), month(x), day(x)) >= sg::DATE AS conflict
FROM (SELECT *, sg::DATE + CASE event_type WHEN 'click' THEN -1 WHEN 'error' THEN 0 ELSE 1 END AS x FROM e)""")
def timing_conflicts(spark, d):
    """Each event quoted as yesterday's, today's or tomorrow's close, or with no close at all."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), dt.DESK_ZONE))
    shift = F.when(F.col("event_type") == "click", -1).when(F.col("event_type") == "error", 0).otherwise(1)
    text = F.when(F.col("event_type") == "view", F.lit("On 5 days after market close")).otherwise(
        F.concat(F.lit("Results on "), F.date_format(F.date_add(day, shift), "d MMM"), F.lit(" after market close.")))
    return v.table(spark, d, "events").select("event_id", dt.timing_conflict(text, F.col("ts").cast("timestamp")).alias("conflict"))
