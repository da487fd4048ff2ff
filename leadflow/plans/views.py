"""Leads, watchlist, editions and stories as read from the driver's tables.

Each view exists twice: as a DataFrame for the Spark query and as a common table expression for
the SQL twin. The corpus holds no finance words, so words of the ``benchmark`` table stand in as
company aliases and event terms.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.functions.text import content_hash, signature

MARKETS = ("JP", "KR", "AU", "HK", "CH", "TT", "NZ", "SP", "IN", "MK", "IJ", "TB", "PM", "VN")
SQL_MARKETS = "[" + ", ".join(f"'{m}'" for m in MARKETS) + "]"
AS_OF = "2024-01-15 00:00:00"
WINDOW_START = "2024-01-12 00:00:00"
PACK_AS_OF = "1999-01-01T00:00:00Z"
PACK_START = "1996-01-01T00:00:00Z"
SECTIONS = ("Merger Arbitrage", "Fundamental/Pre-Event", "Relative Value", "Other Strategy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=64)
def _rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count from the file footers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").count()


def markets_array():
    return F.array(*[F.lit(m) for m in MARKETS])


def market_of(number):
    return F.element_at(markets_array(), (number % len(MARKETS) + 1).cast("int"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """What a document says of itself, and further columns."""
    return docs.select(F.col("doc_id").alias("lead_seq"), F.col("source").alias("source_id"), F.col("lang").alias("language"),
                       F.substring_index("text", "\n", 1).alias("title"),
                       F.when(F.contains(F.col("text"), F.lit("\n")), F.expr("substr(text, locate('\\n', text) + 1)")).otherwise("").alias("text"), *more)


def placed(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Address, time and market of documents, without their texts; a document without event or page is no lead."""
    step = _rows(spark, sf_dir, "events") // _rows(spark, sf_dir, "documents")
    n_pages = _rows(spark, sf_dir, "pages")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("published"),
        F.when(F.col("event_type") == "signup", "missing").when(F.col("event_type") == "error", "day")
        .otherwise("time").alias("date_precision"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    slot = F.col("doc_id") % (len(MARKETS) + 1)
    return (docs.withColumn("event_id", F.col("doc_id") * step).withColumn("page_id", F.col("doc_id") % n_pages)
            .join(events, "event_id").join(pages, "page_id")
            .withColumn("market", F.when(slot < len(MARKETS), market_of(slot))))


PLACE = ("url", "published", "date_precision", "market")


def lead_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lead_seq, url, published, date_precision, market) of every lead, one row per event and page of an id."""
    ids = table(spark, sf_dir, "documents").select("doc_id").distinct()
    return placed(spark, sf_dir, ids).select(F.col("doc_id").alias("lead_seq"), *PLACE)


def leads(spark: SparkSession, sf_dir: str, prepare=None) -> DataFrame:
    """The documents as leads. Texts travel once, to the row that completes a lead; what ``prepare`` adds to them is computed where they
    are read, and a query that then asks for no text moves none."""
    read = texts(table(spark, sf_dir, "documents"))
    read = read if prepare is None else prepare(read)
    return read.join(lead_places(spark, sf_dir), "lead_seq").select(
        *("lead_seq", "source_id", "language", "title", "text", *PLACE), *[c for c in read.columns if c not in ("lead_seq", "source_id", "language", "title", "text")])


def streamed_leads(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Leads of a stream of documents, joined with the static tables."""
    return texts(placed(spark, sf_dir, docs), *PLACE)


def named(spark: SparkSession, sf_dir: str, text=None) -> DataFrame:
    """(lead_seq, ticker) of the leads. Names are looked for where the texts are read, and what is found is kept for documents that are leads."""
    from leadflow.operators.matching import match_terms

    found = match_terms(texts(table(spark, sf_dir, "documents")), watchlist(spark, sf_dir), text)
    return found.join(lead_places(spark, sf_dir).select("lead_seq"), "lead_seq", "left_semi")


LEADS = f"""leads_v AS MATERIALIZED (
  SELECT d.doc_id AS lead_seq, d.source AS source_id, d.lang AS language,
    CASE WHEN strpos(d.text, chr(10)) = 0 THEN d.text ELSE substr(d.text, 1, strpos(d.text, chr(10)) - 1) END AS title,
    CASE WHEN strpos(d.text, chr(10)) = 0 THEN '' ELSE substr(d.text, strpos(d.text, chr(10)) + 1) END AS text,
    p.url, e.ts AS published,
    CASE e.event_type WHEN 'signup' THEN 'missing' WHEN 'error' THEN 'day' ELSE 'time' END AS date_precision,
    CASE WHEN d.doc_id % 15 < 14 THEN ({SQL_MARKETS})[(d.doc_id % 15)::INT + 1] END AS market
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id * ((SELECT count(*) FROM events) // (SELECT count(*) FROM documents))
  JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages))"""


def alias_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n: the long words of the benchmark texts with how often each occurs."""
    return (table(spark, sf_dir, "benchmark")
            .select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
            .filter(F.char_length("word") >= 6).groupBy("word").agg(F.count("*").alias("n")))


WORDS = r"""words_v AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM benchmark)
  WHERE length(word) >= 6 GROUP BY word)"""


def ticker_of(key, nation, prefix: str = "S"):
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(" "), market_of(nation))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies; each alias word belongs to the supplier its hash points at."""
    n = _rows(spark, sf_dir, "supplier")
    aliases = (alias_words(spark, sf_dir)
               .withColumn("s_suppkey", F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % n)
               .groupBy("s_suppkey").agg(F.array_sort(F.collect_set("word")).alias("aliases")))
    sections = F.array(*[F.lit(s) for s in SECTIONS])
    return (table(spark, sf_dir, "supplier").join(aliases, "s_suppkey", "left")
            .select(ticker_of(F.col("s_suppkey"), F.col("s_nationkey")).alias("ticker"), F.col("s_name").alias("name"),
                    F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
                    F.element_at(sections, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("category")))


WATCHLIST = WORDS + f""", word_owner_v AS MATERIALIZED (
  SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % (SELECT count(*) FROM supplier) AS s_suppkey FROM words_v),
watchlist_v AS MATERIALIZED (
  SELECT s.s_suppkey, 'S' || s.s_suppkey || ' ' || ({SQL_MARKETS})[(s.s_nationkey % 14)::INT + 1] AS ticker, s.s_name AS name,
    ({list(SECTIONS)})[(s.s_suppkey % 4)::INT + 1] AS category
  FROM supplier s),
watch_terms_v AS MATERIALIZED (
  SELECT ticker, ticker AS term FROM watchlist_v UNION ALL SELECT ticker, name FROM watchlist_v
  UNION ALL SELECT w.ticker, o.word FROM word_owner_v o JOIN watchlist_v w ON w.s_suppkey = o.s_suppkey)"""


def top_words(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    """The n commonest alias words, on the driver: the vocabulary of the stand-in event rules."""
    return [r["word"] for r in alias_words(spark, sf_dir).orderBy(F.desc("n"), "word").limit(n).collect()]


RULE_WORDS = """rule_words_v AS MATERIALIZED (
  SELECT word, row_number() OVER (ORDER BY n DESC, word) AS r FROM words_v QUALIFY r <= 20)"""

# Matches of a lead against the watch terms, as SQL: both sides lower-cased, letters and digits
# and underscore are word characters.
MATCHES = r"""tokens_v AS MATERIALIZED (
  SELECT DISTINCT lead_seq, unnest(regexp_extract_all(lower(title || ' ' || text), '[\p{L}\p{N}_]+')) AS token FROM leads_v),
phrases_v AS MATERIALIZED (
  SELECT DISTINCT ticker, lower(term) AS term, regexp_extract(lower(term), '[\p{L}\p{N}_]+') AS head FROM watch_terms_v WHERE regexp_matches(term, '[^\p{L}\p{N}_]')),
matches_v AS MATERIALIZED (
  SELECT DISTINCT k.lead_seq, t.ticker FROM tokens_v k JOIN watch_terms_v t ON t.term = k.token
  UNION
  SELECT l.lead_seq, t.ticker FROM phrases_v t JOIN tokens_v k ON k.token = t.head JOIN leads_v l USING (lead_seq)
  WHERE contains(lower(l.title || ' ' || l.text), t.term))"""


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two editions (08:00 and 16:00 Singapore) for every day the events touch."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return (days.select("day", F.explode(F.array(F.lit(0), F.lit(8))).alias("hour"))
            .select((F.col("day").cast("timestamp") + F.make_interval(hours=F.col("hour"))).alias("as_of"))
            .withColumn("edition_id", F.date_format("as_of", "yyyyMMddHH")))


EDITIONS = """editions_v AS MATERIALIZED (
  SELECT day + to_hours(h) AS as_of, strftime(day + to_hours(h), '%Y%m%d%H') AS edition_id
  FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM events), (VALUES (0), (8)) x(h))"""


def session_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("JP", "2024-01-08", None), ("HK", "2024-01-12", "12:10")],
                                 "market string, session_date string, close string")


def fixed_windows(spark: SparkSession) -> DataFrame:
    """Windows of the single edition that the audit queries use, one row per market: all start at
    WINDOW_START but AU (strict, later) and VN (not yet active)."""
    rows = []
    for m in (*MARKETS[:13], "GLOBAL"):
        rows.append((m, "2024-01-13 06:10:00" if m == "AU" else WINDOW_START, m != "AU", "active"))
    rows.append(("VN", WINDOW_START, True, "pending_start"))
    return spark.createDataFrame(rows, "market string, start_text string, start_inclusive boolean, status string").select(
        "market", F.col("start_text").cast("timestamp").alias("window_start"),
        F.lit(AS_OF).cast("timestamp").alias("as_of"), "start_inclusive", "status")


FIXED_WINDOWS = "windows_v AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', TIMESTAMP '{'2024-01-13 06:10:00' if m == 'AU' else WINDOW_START}', {'false' if m == 'AU' else 'true'}, "
    f"'{'pending_start' if m == 'VN' else 'active'}')" for m in (*MARKETS, "GLOBAL")) + \
    ") w(market, window_start, start_inclusive, status))"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per document source, with the attributes its number gives it."""
    n = F.regexp_extract("id", r"(\d+)", 1).cast("int")
    docs = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_docs"))
    return docs.select(
        "id", F.concat(F.lit("Source "), F.col("id")).alias("name"), n.alias("number"),
        F.when(n % 4 == 3, "priority").otherwise("market").alias("collection_role"),
        (n % 5 == 2).alias("publisher"), (n % 6 == 5).alias("issuer_official"), (n % 10 == 9).alias("discovery_only"),
        F.when(n % 8 == 6, F.lit(True)).otherwise(F.lit(False)).alias("retain_all_leads"),
        F.when(n % 7 == 4, market_of(n)).otherwise("").alias("scope_market"),
        F.when(n % 3 == 0, F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), (n % 4 + 1).cast("int"))).otherwise("").alias("category"),
        F.when(n % 4 == 1, F.array(F.lit("example.com"))).otherwise(
            F.array(F.lit("example.com"), F.lit("example.org"), F.lit("example.net"))).alias("allowed_domains"))


SOURCES = f"""sources_v AS MATERIALIZED (
  SELECT id, 'Source ' || id AS name, n AS number, CASE WHEN n % 4 = 3 THEN 'priority' ELSE 'market' END AS collection_role,
    n % 5 = 2 AS publisher, n % 6 = 5 AS issuer_official, n % 10 = 9 AS discovery_only, n % 8 = 6 AS retain_all_leads,
    CASE WHEN n % 7 = 4 THEN ({SQL_MARKETS})[n % 14 + 1] ELSE '' END AS scope_market,
    CASE WHEN n % 3 = 0 THEN ({list(SECTIONS)})[n % 4 + 1] ELSE '' END AS category,
    CASE WHEN n % 4 = 1 THEN ['example.com'] ELSE ['example.com', 'example.org', 'example.net'] END AS allowed_domains
  FROM (SELECT DISTINCT source AS id, regexp_extract(source, '(\\d+)', 1)::INT AS n FROM documents))"""

CANON_SQL = """lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END
  || CASE WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid)(=|$)'))) = 0 THEN ''
     ELSE '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid)(=|$)'))), '&') END"""

CLEAN_SQL = r"""trim(regexp_replace(coalesce({c}, ''), '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"""


def sql_clean(column: str) -> str:
    return CLEAN_SQL.format(c=column)


HASHED = f"""hashed_v AS MATERIALIZED (
  SELECT *, substr(sha256(canonical), 1, 20) AS id,
    sha256({sql_clean('title')} || chr(10) || {sql_clean('text')}) AS content_hash,
    sha256(lower({sql_clean('title')}) || chr(10) || lower({sql_clean('text')})) AS signature
  FROM (SELECT *, {CANON_SQL} AS canonical FROM leads_v))"""


def with_hashes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", content_hash("title", "text")).withColumn("signature", signature("title", "text"))


def hashed_leads(spark: SparkSession, sf_dir: str, prepare=None) -> DataFrame:
    """Leads with their identity and the hashes of their texts."""
    out = leads(spark, sf_dir, lambda docs: with_hashes(docs) if prepare is None else prepare(with_hashes(docs)))
    return out.withColumn("canonical", urls.canonical_url("url")).withColumn("id", urls.lead_id("canonical"))


def prior_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after every lead up to the edition was seen: the last document of each address."""
    seen = hashed_leads(spark, sf_dir).filter(F.col("published") <= F.lit(AS_OF).cast("timestamp"))
    last = seen.groupBy("id").agg(F.max_by(F.struct("content_hash", "title", "canonical", "published"),
                                           F.struct("published", "lead_seq")).alias("s"))
    return last.select("id", "s.content_hash", "s.title", F.col("s.canonical").alias("url"), "s.published",
                       F.to_date("s.published").alias("edition_date"))


STATE = f"""state_v AS MATERIALIZED (
  SELECT id, content_hash, title, canonical AS url, published, published::DATE AS edition_date FROM hashed_v
  WHERE published <= TIMESTAMP '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY published DESC, lead_seq DESC) = 1)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan log per source: events as fetches."""
    return (table(spark, sf_dir, "events")
            .select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), "event_type", "value",
                    F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id"))


SCANS = """scans_v AS MATERIALIZED (
  SELECT 'src' || (user_id % 20) AS source_id, event_type, value, ts, event_id, user_id FROM events)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
