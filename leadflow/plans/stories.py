"""Queries over researched stories: orders stand in for stories, line items for their sources."""

from pyspark.sql import functions as F

from leadflow.functions.dates import iso, strict_ts
from leadflow.operators import stories as st
from leadflow.plans import leads as ld
from leadflow.plans import times as tm
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.session import written_table

STATUSES = {"VN": "pending_start", "PM": "pending_close", "TB": "no_session"}


def pack_windows(spark):
    rows = [(m, f"1996-{1 + i % 12:02d}-01 00:00:00", i % 2 == 0, STATUSES.get(m, "active")) for i, m in enumerate(v.MARKETS)]
    return spark.createDataFrame(rows, "market string, t string, start_inclusive boolean, status string").select(
        "market", F.col("t").cast("timestamp").alias("window_start"), "start_inclusive", "status")


PACK_WINDOWS = "pack_v AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', TIMESTAMP '1996-{1 + i % 12:02d}-01 00:00:00', {str(i % 2 == 0).lower()}, '{STATUSES.get(m, 'active')}')" for i, m in enumerate(v.MARKETS)) + \
    ") w(market, window_start, start_inclusive, status))"

STORIES = f"""stories_v AS MATERIALIZED (
  SELECT o_orderkey AS story_seq, 'st-' || o_orderkey AS id, c_name AS company, 'C' || c_custkey || ' ' || m AS ticker, m AS market,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN '' ELSE ({list(v.SECTIONS)})[left(o_orderpriority, 1)::INT % 4 + 1] END AS category,
    CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'changed' ELSE 'background' END AS novelty,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'hold' ELSE 'ready' END AS review_status,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN '' ELSE 'Order ' || o_orderkey END AS headline
  FROM (SELECT *, ({v.SQL_MARKETS})[(c_nationkey % 14)::INT + 1] AS m FROM orders JOIN customer ON c_custkey = o_custkey)),
sources0_v AS MATERIALIZED (
  SELECT l_orderkey AS story_seq, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, l_linenumber, l_quantity AS q, l_partkey,
    CASE WHEN l_tax = 0.08 THEN 'http://localhost/x' ELSE 'https://www.example.com/s' || l_suppkey || '/p' || l_partkey END AS url,
    CASE WHEN l_tax = 0.07 THEN strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') ELSE strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
    CASE WHEN l_returnflag = 'R' THEN 'restricted' ELSE 'readable' END AS access, CASE WHEN l_linestatus = 'O' THEN 'time' ELSE 'day' END AS date_precision,
    CASE WHEN q = 50 THEN 'other' WHEN l_linenumber > 2 THEN 'background' ELSE 'same_development' END AS relationship,
    CASE WHEN l_discount > 0 THEN 'older event' ELSE '' END AS context_notes, l_returnflag, l_discount
  FROM lineitem),
public_v AS MATERIALIZED (
  SELECT story_seq, url, min(pos) AS first_pos, count(*) AS n, arg_max(published_at, pos) AS published_at, arg_max(access, pos) AS access,
    arg_max(date_precision, pos) AS date_precision, arg_max(relationship, pos) AS relationship, arg_max(context_notes, pos) AS context_notes,
    CASE WHEN ends_with(arg_max(published_at, pos), 'Z') THEN arg_max(published_at, pos)[1:19]::TIMESTAMP END AS ts
  FROM sources0_v WHERE url LIKE 'https://%' GROUP BY 1, 2),
bullets_v AS MATERIALIZED (
  SELECT story_seq, pos AS number, CASE WHEN q = 1 THEN '' ELSE 'Part ' || l_partkey END AS text,
    CASE WHEN q = 3 THEN [] WHEN q = 2 THEN [url || '/missing'] ELSE [url] END AS source_urls
  FROM sources0_v WHERE l_linenumber <= 2),
origins_v AS MATERIALIZED (
  SELECT story_seq, arg_min(url, pos) AS origin_url, CASE WHEN arg_min(q, pos) > 45 THEN 'open' ELSE 'verified' END AS origin_status,
    CASE arg_min(l_returnflag, pos) WHEN 'N' THEN 'exchange' WHEN 'A' THEN 'issuer' ELSE 'recap' END AS origin_kind,
    CASE WHEN arg_min(l_discount, pos) = 0.1 THEN '' ELSE 'seen' END AS origin_timestamp_evidence
  FROM sources0_v GROUP BY 1),
placed_v AS MATERIALIZED (
  SELECT s.*, o.* EXCLUDE (story_seq), o.story_seq IS NOT NULL AS has_origin, w.window_start AS story_start, w.start_inclusive AS story_inclusive, w.status AS window_status
  FROM stories_v s LEFT JOIN origins_v o USING (story_seq) JOIN pack_v w ON w.market = s.market)"""
OUTSIDE = "({t} > TIMESTAMP '1999-01-01' OR {t} < p.story_start OR ({t} = p.story_start AND NOT p.story_inclusive))"


def sq(text):
    return text.replace("'", "''")


REASONS = f"""origin_ts_v AS MATERIALIZED (
  SELECT p.*, x.ts AS origin_ts, x.access AS o_access, x.date_precision AS o_precision, x.url IS NOT NULL AS found
  FROM placed_v p LEFT JOIN public_v x ON x.story_seq = p.story_seq AND x.url = p.origin_url),
chronology_v AS MATERIALIZED (
  SELECT story_seq, reason, min(first_pos) AS p FROM (
    SELECT x.story_seq, x.first_pos, CASE WHEN relationship = 'background' THEN CASE WHEN context_notes = '' THEN '{st.BACKGROUND_NOTES}' END
        WHEN relationship <> 'same_development' THEN '{st.BAD_RELATION}' WHEN x.ts IS NULL OR x.date_precision <> 'time' THEN '{st.UNCLEAR_REPORT}'
        WHEN x.ts < o.origin_ts THEN '{st.EARLIER_REPORT}' END AS reason
    FROM public_v x JOIN origin_ts_v o ON o.story_seq = x.story_seq AND o.found AND o.origin_ts IS NOT NULL AND x.url <> o.origin_url)
  WHERE reason IS NOT NULL GROUP BY 1, 2),
cites_v AS MATERIALIZED (
  SELECT b.story_seq, b.number, b.url, b.url LIKE 'https://%' AS valid, x.url IS NOT NULL AND b.url LIKE 'https://%' AS found, x.access, x.date_precision, x.ts
  FROM (SELECT story_seq, number, unnest(source_urls) AS url FROM bullets_v WHERE text <> '') b LEFT JOIN public_v x ON x.story_seq = b.story_seq AND x.url = b.url),
origin_reasons_v AS MATERIALIZED (
  SELECT story_seq, 9 AS a, 0::BIGINT AS b, 0 AS c, '{st.NO_ORIGIN}' AS reason FROM origin_ts_v WHERE NOT has_origin
  UNION ALL SELECT story_seq, 9, 1, 0, '{st.UNVERIFIED}' FROM origin_ts_v WHERE has_origin AND origin_status <> 'verified'
  UNION ALL SELECT story_seq, 9, 2, 0, '{st.BAD_KIND}' FROM origin_ts_v WHERE has_origin AND origin_kind = 'recap'
  UNION ALL SELECT story_seq, 9, 4, 0, 'Original disclosure needs timestamp_evidence.' FROM origin_ts_v WHERE has_origin AND origin_timestamp_evidence = ''
  UNION ALL SELECT story_seq, 9, 6, 0, '{st.ORIGIN_ABSENT}' FROM origin_ts_v WHERE has_origin AND NOT found
  UNION ALL SELECT story_seq, 9, 7, 0, '{st.ORIGIN_UNREAD}' FROM origin_ts_v WHERE found AND (o_access <> 'readable' OR o_precision <> 'time')
  UNION ALL SELECT story_seq, 9, 8, 0, '{st.ORIGIN_NO_TIME}' FROM origin_ts_v WHERE found AND origin_ts IS NULL
  UNION ALL SELECT p.story_seq, 9, 9, 0, '{st.ORIGIN_OUTSIDE}' FROM origin_ts_v p WHERE found AND {OUTSIDE.format(t='p.origin_ts')}
  UNION ALL SELECT story_seq, 10, p, 0, reason FROM chronology_v),
reasons_v AS MATERIALIZED (
  SELECT story_seq, 1 AS a, 0::BIGINT AS b, 0 AS c, market || CASE window_status WHEN 'pending_start' THEN '{sq(st.WINDOW_STATES['pending_start'])}'
    WHEN 'pending_close' THEN '{sq(st.WINDOW_STATES['pending_close'])}' ELSE '{sq(st.WINDOW_STATES['no_session'])}' END AS reason FROM placed_v WHERE window_status <> 'active'
  UNION ALL SELECT story_seq, 4, 0, 0, '{st.NO_HEADLINE}' FROM placed_v WHERE headline = ''
  UNION ALL SELECT story_seq, 5, 0, 0, '{st.NOT_READY}' FROM placed_v WHERE review_status <> 'ready'
  UNION ALL SELECT story_seq, 6, 0, 0, '{st.NOT_NEW}' FROM placed_v WHERE novelty = 'background'
  UNION ALL SELECT story_seq, 7, 0, 0, '{st.NO_CATEGORY}' FROM placed_v WHERE category = ''
  UNION ALL SELECT story_seq, 8, min(pos), 0, '{st.BAD_URL}' FROM sources0_v WHERE url NOT LIKE 'https://%' GROUP BY story_seq
  UNION ALL SELECT s.story_seq, 8, min(pos), 0, '{st.SAME_URL}' FROM sources0_v s JOIN public_v x ON x.story_seq = s.story_seq AND x.url = s.url AND s.pos > x.first_pos GROUP BY 1
  UNION ALL SELECT * FROM origin_reasons_v
  UNION ALL SELECT story_seq, 11, 0, 0, '{st.NO_BULLET}' FROM placed_v WHERE story_seq NOT IN (SELECT story_seq FROM bullets_v)
  UNION ALL SELECT story_seq, 12, 0, 0, '{st.ORIGIN_UNCITED}' FROM placed_v p WHERE has_origin AND NOT EXISTS (SELECT 1 FROM bullets_v b WHERE b.story_seq = p.story_seq AND list_contains(b.source_urls, p.origin_url))
  UNION ALL SELECT story_seq, 13, number, 0, 'Bullet ' || number || CASE WHEN text = '' THEN '{st.BULLET_NO_TEXT}' ELSE '{st.BULLET_NO_SOURCE}' END FROM bullets_v WHERE text = '' OR len(source_urls) = 0
  UNION ALL SELECT story_seq, 13, number, 0, 'Bullet ' || number || '{st.BULLET_BAD_URL}' FROM cites_v WHERE NOT valid
  UNION ALL SELECT story_seq, 13, number, 1, 'Bullet ' || number || '{sq(st.BULLET_ABSENT)}' FROM cites_v WHERE valid AND NOT found
  UNION ALL SELECT story_seq, 13, number, 2, 'Bullet ' || number || '{st.BULLET_UNREAD}' FROM cites_v WHERE found AND access <> 'readable'
  UNION ALL SELECT story_seq, 13, number, 3, 'Bullet ' || number || '{st.BULLET_NO_DAY}' FROM cites_v WHERE found AND date_precision <> 'time'
  UNION ALL SELECT story_seq, 13, number, 4, 'Bullet ' || number || '{st.BULLET_NO_TIME}' FROM cites_v WHERE found AND ts IS NULL
  UNION ALL SELECT c.story_seq, 13, c.number, 4, 'Bullet ' || c.number || '{st.BULLET_OUTSIDE}' FROM cites_v c JOIN placed_v p USING (story_seq) WHERE c.found AND {OUTSIDE.format(t='c.ts')}),
held_v AS MATERIALIZED (
  SELECT story_seq, string_agg(reason, ' | ' ORDER BY a, b, c, reason) AS reasons FROM (
    SELECT story_seq, reason, a, b, c FROM reasons_v QUALIFY row_number() OVER (PARTITION BY story_seq, reason ORDER BY a, b, c) = 1) GROUP BY 1)"""
STORY_VIEWS = (PACK_WINDOWS, STORIES)
REASON_VIEWS = (PACK_WINDOWS, STORIES, REASONS)


def source_url(supplier="l_suppkey", part="l_partkey", tax="l_tax"):
    c = F.col
    return F.when(c(tax) == 0.08, "http://localhost/x").otherwise(F.concat(F.lit("https://www.example.com/s"), c(supplier).cast("string"), F.lit("/p"), c(part).cast("string")))


def place():
    c = F.col
    return c("l_linenumber") * F.lit(10 ** 12) + c("l_partkey") * F.lit(10 ** 5) + c("l_suppkey")


def sources(spark, d):
    c = F.col
    return v.table(spark, d, "lineitem").select(
        c("l_orderkey").alias("story_seq"), place().alias("pos"),
        "l_linenumber", c("l_quantity").alias("q"), "l_partkey", "l_returnflag", "l_discount",
        source_url().alias("url"),
        F.when(c("l_tax") == 0.07, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(iso("l_shipdate")).alias("published_at"),
        F.when(c("l_returnflag") == "R", "restricted").otherwise("readable").alias("access"),
        F.when(c("l_linestatus") == "O", "time").otherwise("day").alias("date_precision"),
        F.when(c("l_quantity") == 50, "other").when(c("l_linenumber") > 2, "background").otherwise("same_development").alias("relationship"),
        F.when(c("l_discount") > 0, "older event").otherwise("").alias("context_notes"), F.lit("").alias("name"))


def bullets(spark, d):
    url = F.col("url")
    return sources(spark, d).filter("l_linenumber <= 2").select(
        "story_seq", F.col("pos").alias("number"), F.when(F.col("q") == 1, "").otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string"))).alias("text"),
        F.when(F.col("q") == 3, F.array().cast("array<string>")).when(F.col("q") == 2, F.array(F.concat(url, F.lit("/missing")))).otherwise(F.array(url)).alias("source_urls"))


def stories(spark, d):
    # The first line of an order as numbers; its address is made once for an order.
    first = v.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("story_seq")).agg(
        F.min_by(F.struct("l_suppkey", "l_partkey", "l_tax", F.col("l_quantity").alias("q"), "l_returnflag", "l_discount"), place()).alias("o"))
    orders = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    sections = F.array(*[F.lit(s) for s in v.SECTIONS])
    c = F.col
    df = orders.select(
        c("o_orderkey").alias("story_seq"), F.concat(F.lit("st-"), c("o_orderkey").cast("string")).alias("id"), c("c_name").alias("company"),
        F.array(v.ticker_of(c("c_custkey"), c("c_nationkey"), "C")).alias("tickers"), F.lit("").alias("market"),
        F.when((c("o_orderpriority") == "3-MEDIUM") & (c("o_orderstatus") == "P"), "").otherwise(F.element_at(sections, digit % 4 + 1)).alias("category"),
        F.when(c("o_orderstatus") == "O", "new").when(c("o_orderstatus") == "P", "changed").otherwise("background").alias("novelty"),
        F.when(c("o_orderpriority") == "5-LOW", "hold").otherwise("ready").alias("review_status"),
        F.when((c("o_orderpriority") == "4-NOT SPECIFIED") & (c("o_orderstatus") == "P"), "").otherwise(F.concat(F.lit("Order "), c("o_orderkey").cast("string"))).alias("headline"))
    return df.join(first, "story_seq", "left").select(
        *df.columns, c("o").isNotNull().alias("has_origin"), F.when(c("o").isNotNull(), source_url("o.l_suppkey", "o.l_partkey", "o.l_tax")).alias("origin_url"), F.when(c("o.q") > 45, "open").otherwise("verified").alias("origin_status"),
        F.when(c("o.l_returnflag") == "N", "exchange").when(c("o.l_returnflag") == "A", "issuer").otherwise("recap").alias("origin_kind"),
        F.lit("seen").alias("origin_development"), F.when(c("o.l_discount") == 0.1, "").otherwise("seen").alias("origin_timestamp_evidence"),
        F.lit("seen").alias("origin_verification_notes"))


def envelope():
    return strict_ts(F.lit(v.PACK_START)), strict_ts(F.lit(v.PACK_AS_OF))


def placed(spark, d):
    return st.story_windows(stories(spark, d), pack_windows(spark), *envelope())


def validated(spark, d):
    return st.validate_stories(stories(spark, d), sources(spark, d), bullets(spark, d), pack_windows(spark), *envelope())


def validated_with_origins(spark, d):
    """The validated stories, and the time of each story's origin; both read the same table of placed stories."""
    written = st.place_stories(stories(spark, d), pack_windows(spark), *envelope())
    done = st.validate_placed(written, sources(spark, d), bullets(spark, d), pack_windows(spark))
    return done, st.with_origin_time(written, st.public_sources(sources(spark, d)))


def listed(df):
    first = df.groupBy("story_seq", "reason").agg(F.min("at").alias("at"))
    rows = first.groupBy("story_seq").agg(F.array_sort(F.collect_list(F.struct("at", "reason"))).alias("r"))
    return rows.select("story_seq", F.array_join(F.transform("r", lambda x: x["reason"]), " | ").alias("reasons"))


@query("story_validation", v.with_views(*REASON_VIEWS) + """
SELECT s.story_seq, CASE WHEN h.story_seq IS NULL THEN 'ready' ELSE 'hold' END AS status, coalesce(h.reasons, '') AS reasons
FROM stories_v s LEFT JOIN held_v h USING (story_seq)""")
def story_validation(spark, d):
    return validated(spark, d).select("story_seq", F.col("composition_status").alias("status"), F.array_join("reasons", " | ").alias("reasons"))


@query("composition_counts", v.with_views(*REASON_VIEWS) + """
SELECT count(*) FILTER (h.story_seq IS NULL)::BIGINT AS ready_count, count(h.story_seq)::BIGINT AS held_count FROM stories_v s LEFT JOIN held_v h USING (story_seq)""")
def composition_counts(spark, d):
    return st.composition_counts(validated(spark, d))


@query("origin_validation", v.with_views(*REASON_VIEWS) + """
SELECT story_seq, string_agg(reason, ' | ' ORDER BY a, b, c, reason) AS reasons FROM origin_reasons_v GROUP BY story_seq""")
def origin_validation(spark, d):
    return listed(st.origin_reasons(placed(spark, d), st.public_sources(sources(spark, d))))


@query("origin_chronology", v.with_views(*REASON_VIEWS) + "SELECT story_seq, reason, p AS first_pos FROM chronology_v")
def origin_chronology(spark, d):
    public = st.public_sources(sources(spark, d))
    return st.origin_chronology(st.with_origin_time(placed(spark, d), public), public).select("story_seq", "reason", F.col("at.a").alias("first_pos"))


@query("citation_check", v.with_views(*REASON_VIEWS) + """
SELECT story_seq, number, url, valid, found, CASE WHEN found THEN access END AS access, CASE WHEN found THEN date_precision END AS date_precision FROM cites_v""")
def citation_check(spark, d):
    return st.citation_check(bullets(spark, d), st.public_sources(sources(spark, d))).select(
        "story_seq", "number", "url", "valid", "found", "access", "date_precision")


@query("window_violations", """
SELECT market, violation FROM (
  SELECT CASE WHEN c_nationkey % 5 = 0 THEN 'jp' ELSE 'X' || c_custkey END AS market, c_nationkey, c_custkey, o_orderkey, o_orderdate, o_orderstatus,
    count(*) OVER (PARTITION BY CASE WHEN c_nationkey % 5 = 0 THEN 'jp' ELSE 'X' || c_custkey || '-' || o_orderkey END) AS n FROM orders JOIN customer ON c_custkey = o_custkey) x,
  LATERAL (SELECT unnest(list_filter([CASE WHEN c_nationkey % 5 = 0 THEN 'duplicated market' END,
    CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '1999-01-01' THEN 'outside the research envelope' END,
    CASE WHEN o_orderstatus = 'P' THEN 'cutoff differs' END, CASE WHEN o_orderstatus = 'F' THEN 'unknown status' END], lambda y: y IS NOT NULL)) AS violation) z""")
def window_violations(spark, d):
    """One window per order; those of a fifth of the nations all claim the same market."""
    orders = v.table(spark, d, "orders").join(v.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    fifth = F.col("c_nationkey") % 5 == 0
    name = F.when(fifth, "jp").otherwise(F.concat(F.lit("X"), F.col("c_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string")))
    windows = orders.select(name.alias("market"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"),
                            iso("o_orderdate").alias("window_start"), F.when(F.col("o_orderstatus") == "P", "1999-01-02T00:00:00Z").otherwise("1999-01-01T08:00:00+08:00").alias("as_of"))
    found = st.window_violations(windows, F.lit(v.PACK_START), F.lit(v.PACK_AS_OF))
    return found.select(F.when(F.col("market") == "jp", "jp").otherwise(F.split_part("market", F.lit("-"), F.lit(1))).alias("market"), "violation")


@query("duplicate_ids", """
SELECT l_orderkey || '/' || l_linenumber AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def duplicate_ids(spark, d):
    ids = v.table(spark, d, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return st.duplicate_ids(ids)


@query("top_stories", v.with_views(*REASON_VIEWS) + """
SELECT s.id FROM stories_v s JOIN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t ON t.o_orderkey = s.story_seq
WHERE s.story_seq NOT IN (SELECT story_seq FROM held_v)
UNION ALL SELECT 'ready' AS id FROM stories_v s LEFT JOIN held_v h USING (story_seq) WHERE h.story_seq IS NULL AND s.story_seq = (
  SELECT min(story_seq) FROM stories_v WHERE story_seq NOT IN (SELECT story_seq FROM held_v)) """)
def top_stories(spark, d):
    """The two largest orders are requested; then the first ready story alone."""
    done = written_table(validated(spark, d).select("story_seq", "id", "composition_status"), "validated")
    prices = v.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(2)
    asked = prices.select((-F.col("o_totalprice")).alias("pos"), F.concat(F.lit("st-"), F.col("o_orderkey").cast("string")).alias("id"))
    first = done.filter("composition_status = 'ready'").agg(F.min("story_seq").alias("s")).select(
        F.lit(1.0).alias("pos"), F.concat(F.lit("st-"), F.col("s").cast("string")).alias("id"))
    return st.top_stories(asked, done).select("id").unionByName(st.top_stories(first, done).select(F.lit("ready").alias("id")))


@query("edition_layout", v.with_views(*REASON_VIEWS) + f""",
ready_v AS (SELECT s.*, list_position({list(v.SECTIONS)}, s.category) - 1 AS section_no FROM stories_v s WHERE story_seq NOT IN (SELECT story_seq FROM held_v))
SELECT 'index' AS part, section_no::BIGINT AS section_no, story_seq, ticker AS label, headline FROM ready_v
UNION ALL SELECT 'story', section_no, story_seq, ticker || '    ' || upper(company), headline FROM ready_v""")
def edition_layout(spark, d):
    return st.edition_layout(validated(spark, d)).select("part", F.col("section_no").cast("long").alias("section_no"), "story_seq", "label", "headline")


@query("citation_numbers", v.with_views(*STORY_VIEWS) + """,
c AS (SELECT b.story_seq, b.url, min(b.number) AS first_at FROM (SELECT story_seq, number, unnest(source_urls) AS url FROM bullets_v) b
  JOIN public_v p ON p.story_seq = b.story_seq AND p.url = b.url GROUP BY 1, 2),
s AS (SELECT story_seq, count(DISTINCT array_to_string(source_urls, ',')) AS n_sets FROM bullets_v GROUP BY 1)
SELECT c.story_seq, c.url, row_number() OVER (PARTITION BY c.story_seq ORDER BY first_at, c.url) AS source_number,
  n_sets > 1 AND count(*) OVER (PARTITION BY c.story_seq) > 1 AS numbered FROM c JOIN s USING (story_seq)""")
def citation_numbers(spark, d):
    found = st.citation_numbers(bullets(spark, d), st.public_sources(sources(spark, d)))
    return found.withColumn("source_number", F.col("source_number").cast("long"))


@query("review_rows", v.with_views(*REASON_VIEWS) + f"""
SELECT s.story_seq, coalesce(nullif(s.headline, ''), s.id) AS title, CASE WHEN h.story_seq IS NULL THEN 'ready' ELSE 'hold' END AS composition_status,
  coalesce(o.origin_status, 'missing') AS origin_status, coalesce({tm.iso_sql('o.origin_ts')}, 'unverified') AS original_publication,
  coalesce(strftime(o.origin_ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S+08:00'), 'unverified') AS singapore,
  CASE WHEN o.has_origin THEN 'seen' ELSE 'not recorded' END AS development, CASE WHEN o.has_origin AND o.origin_timestamp_evidence <> '' THEN 'seen' ELSE 'not recorded' END AS timestamp_evidence,
  CASE WHEN o.has_origin THEN 'seen' ELSE 'not recorded' END AS verification_notes
FROM stories_v s LEFT JOIN held_v h USING (story_seq) LEFT JOIN origin_ts_v o USING (story_seq)""")
def review_rows(spark, d):
    done, origins = validated_with_origins(spark, d)
    done = done.withColumns({c: F.when(F.col("has_origin"), F.col(c)) for c in ("origin_status", *(f"origin_{n}" for n in st.ORIGIN_FIELDS))})
    return st.review_rows(done, origins).drop("origin_source", "origin_kind")


def events(spark, d):
    e = v.table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("id"), F.when(kind == "view", "").otherwise(kind).alias("label"), F.when(kind == "view", F.concat(F.lit("User "), F.col("user_id").cast("string"))).otherwise("").alias("company"),
        F.when(kind == "error", "").when(kind == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise(iso("ts")).alias("event_date"),
        F.when(kind == "purchase", "confirmed").otherwise("").alias("time_status"), F.when(kind.isin("click", "purchase", "view"), "scheduled").when(kind == "signup", "cancelled").otherwise("").alias("status"),
        F.when(F.col("value") > 100, "http://localhost/").otherwise(F.concat(F.lit("https://www.example.com/e/"), F.col("event_id").cast("string"))).alias("source_url"),
        F.when(kind == "signup", "").otherwise(iso("ts")).alias("checked_at"), kind.alias("event_type"), F.when(kind == "click", "Asia/Tokyo").otherwise("").alias("timezone"),
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).otherwise("").alias("source_name"))


@query("calendar_rows", f"""
SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'User ' || user_id ELSE event_type END AS label,
  CASE event_type WHEN 'error' THEN 'Date unconfirmed' WHEN 'click' THEN strftime(ts, '%Y-%m-%d') ELSE {tm.iso_sql('ts')} END AS event_date,
  CASE event_type WHEN 'purchase' THEN 'confirmed' ELSE 'Unconfirmed' END || ' / ' || CASE event_type WHEN 'signup' THEN 'cancelled' WHEN 'error' THEN 'Status unchecked' ELSE 'scheduled' END AS status,
  CASE WHEN value > 100 THEN 'Source missing' ELSE 'https://www.example.com/e/' || event_id END AS source,
  'Checked: ' || CASE event_type WHEN 'signup' THEN 'Not recorded' ELSE {tm.iso_sql('ts')} END AS checked,
  event_type, CASE WHEN event_type = 'click' THEN 'Asia/Tokyo' ELSE '' END AS timezone, CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE 'Source' END AS source_name FROM events""")
def calendar_rows(spark, d):
    return st.calendar_rows(events(spark, d))


@query("screen_calendar", """
SELECT event_id AS id, day::VARCHAR AS event_day FROM (
  SELECT *, CASE event_type WHEN 'click' THEN ts::DATE ELSE (date_trunc('second', ts) + INTERVAL 8 HOUR)::DATE END AS day FROM events WHERE event_type IN ('click', 'purchase', 'view'))
WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-22'""")
def screen_calendar(spark, d):
    found = st.screen_calendar(events(spark, d), F.lit(v.AS_OF).cast("timestamp"))
    return found.select("id", F.col("event_day").cast("string").alias("event_day"))


@query("review_notes", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES) + f"""
SELECT l.lead_seq, array_to_string(list_filter([
  CASE WHEN {ld.ACCESS_SQL} IS NULL THEN '{st.ACCESS_NOTES["metadata_only"]}' WHEN {ld.ACCESS_SQL} = 'restricted' THEN '{st.ACCESS_NOTES["restricted"]}' END,
  CASE WHEN language <> 'en' THEN 'Original language: ' || language || ' — English summary needed.' END,
  CASE WHEN date_precision <> 'time' THEN '{st.DATE_NOTE}' END, CASE WHEN date_precision = 'time' THEN 'Checked.' END], lambda x: x IS NOT NULL), ' | ') AS notes,
  CASE WHEN m.lead_seq IS NULL THEN 'Company/ticker review required' WHEN language = 'en' THEN 'Draft candidate — review required' ELSE 'Held for review' END AS state
FROM leads_v l LEFT JOIN (SELECT DISTINCT lead_seq FROM matches_v) m USING (lead_seq)""")
def review_notes(spark, d):
    from leadflow.plans.signals import named_leads

    df = named_leads(spark, d).join(ld.articles(spark, d), "url", "left").withColumn("access_status", F.coalesce("access_status", F.lit("metadata_only")))
    df = df.withColumn("flags", F.when(F.col("date_precision") == "time", F.array(F.lit("Checked."))).otherwise(F.array(F.lit(st.DATE_NOTE))))
    df = df.withColumn("eligible", F.col("language") == "en")
    return df.select("lead_seq", F.array_join(st.review_notes(), " | ").alias("notes"), st.candidate_state().alias("state"))


@query("audit_states", v.with_views(*ld.AUDIT_VIEWS) + "SELECT lead_seq, replace(stage, '_', ' ') AS state FROM audit_v")
def audit_states(spark, d):
    return ld.audit(spark, d).select("lead_seq", st.audit_state("stage").alias("state"))
