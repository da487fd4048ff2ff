"""Queries over the audit, candidates, change and merging."""

from pyspark.sql import functions as F

from leadflow.functions.dates import iso
from leadflow.operators import audit as a
from leadflow.operators import candidates as c
from leadflow.operators import dedupe
from leadflow.operators.matching import topic_match, with_names
from leadflow.operators.ranking import rank_rows
from leadflow.operators.triage import score_texts, with_name_bonus
from leadflow.operators.windows import with_verdict
from leadflow.plans import signals as sg
from leadflow.plans import times as tm
from leadflow.plans import views as v
from leadflow.plans.registry import query

EDITION_DATE = "2024-01-15"


@query("rank_leads", v.with_views(*sg.SCORED_VIEWS) + """
SELECT lead_seq, row_number() OVER (PARTITION BY l.source_id ORDER BY c.attention_score DESC, lead_seq) AS rank
FROM scored_v c JOIN leads_v l USING (lead_seq)""")
def rank_leads(spark, d):
    scored = sg.scored_leads(spark, d).select("lead_seq", "source_id", "attention_score")
    return rank_rows(scored, ["source_id"], "attention_score", "lead_seq").select("lead_seq", "rank")


def articles(spark, d):
    """Captured pages as articles: addresses ending in .html were not captured."""
    return (v.table(spark, d, "pages").select("url").distinct().filter(~F.endswith("url", F.lit(".html")))
            .withColumn("access_status", F.when(F.contains("url", F.lit("?page")), "restricted").otherwise("readable")))


ACCESS_SQL = "CASE WHEN ends_with(url, '.html') THEN NULL WHEN contains(url, '?page') THEN 'restricted' ELSE 'readable' END"
HOST_SQL = "lower(regexp_extract(url, '^[^:]+://([^/:?#]*)', 1))"
AUDIT = f"""staged_v AS MATERIALIZED (
  SELECT r.lead_seq, r.source_id, r.url, c.attention_score, {tm.verdict_sql('applied_window_start', 'applied_inclusive')} AS window_status,
    r.timing_resolved, {ACCESS_SQL} AS access,
    CASE WHEN date_precision <> 'missing' AND {tm.verdict_sql('applied_window_start', 'applied_inclusive')} IN ('old', 'future') THEN 'outside_window'
      WHEN NOT (s.retain_all_leads OR (c.market_relevant AND c.attention_score >= 35)) THEN 'below_attention_threshold'
      WHEN len(list_filter(s.allowed_domains, lambda x: {HOST_SQL} = x OR ends_with({HOST_SQL}, '.' || x))) = 0 THEN 'outside_source_domains'
      WHEN s.discovery_only THEN 'document_review_pending' ELSE 'article_pending' END AS stage0
  FROM recorded_v r JOIN scored_v c USING (lead_seq) JOIN sources_v s ON s.id = r.source_id WHERE s.collection_role = 'market'),
audit_v AS MATERIALIZED (
  SELECT *, CASE WHEN stage0 <> 'article_pending' THEN stage0
      WHEN row_number() OVER (PARTITION BY source_id, stage0 ORDER BY attention_score DESC, lead_seq) > 3 THEN 'article_cap_pending'
      WHEN access IS NULL THEN 'article_unavailable' ELSE 'article_checked' END AS stage FROM staged_v)"""
AUDIT_VIEWS = (*tm.RECORD_VIEWS, v.RULE_WORDS, sg.TOKENS, sg.SCORED, AUDIT)
CAP = 3


def windowed(spark, d):
    """Scored leads with their window verdict and source attributes. Score, topic and hashes are computed where the texts are read; a query that does
    not ask for the texts joins without them."""
    rules = sg.stand_in_rules(v.top_words(spark, d, 20))
    prepared = v.hashed_leads(spark, d, lambda docs: score_texts(docs.withColumn("topic", topic_match(sg.TOPIC, F.col("text"), F.col("title"))), rules))
    return with_name_bonus(with_verdict(tm.recorded(spark, d, prepared), v.AS_OF))


def market_leads(spark, d):
    return windowed(spark, d).filter("collection_role = 'market'")


def audit(spark, d):
    columns = ("lead_seq", "source_id", "url", "title", "published", "date_precision", "window_status", "applied_window_start",
               "timing_markets", "timing_resolved", "attention_score", "attention_reasons", "market_relevant", "tickers",
               "retain_all_leads", "allowed_domains", "discovery_only")
    # Scoring reads whole texts; the audit columns are cut off here so that it happens once.
    return a.headline_audit(dedupe.cut_lineage(market_leads(spark, d).select(*columns)), articles(spark, d), CAP)


@query("article_cap", v.with_views(*AUDIT_VIEWS) + "SELECT lead_seq, stage = 'article_cap_pending' AS capped FROM audit_v")
def article_cap(spark, d):
    staged = a.early_stage(market_leads(spark, d))
    capped = a.apply_article_cap(staged.select("lead_seq", "source_id", "attention_score", "reaches_cap"), "reaches_cap", CAP)
    return capped.select("lead_seq", (F.col("reaches_cap") & ~F.col("within_cap")).alias("capped"))


@query("headline_audit", v.with_views(*AUDIT_VIEWS) + """
SELECT lead_seq, window_status, attention_score, timing_resolved, stage,
  CASE stage WHEN 'article_checked' THEN access WHEN 'article_unavailable' THEN 'unavailable' END AS access_status FROM audit_v""")
def headline_audit(spark, d):
    return audit(spark, d).select("lead_seq", "window_status", F.col("attention_score").cast("long").alias("attention_score"),
                                  "timing_resolved", "stage", "access_status")


@query("release_gate", v.with_views(v.LEADS) + r"""
SELECT lead_seq, regexp_matches(url, '/\d{3,}') AS is_release, length(CASE WHEN regexp_matches(url, '/\d{3,}') THEN text ELSE '' END)::BIGINT AS n_text,
  CASE WHEN regexp_matches(url, '/\d{3,}') THEN 'discovery_lead' ELSE 'index_lead' END AS evidence_level FROM leads_v""")
def release_gate(spark, d):
    gate = a.release_gate("url", F.lit(r"/\d{3,}"), "text")
    return v.leads(spark, d).withColumn("g", gate).select(
        "lead_seq", "g.is_release", F.char_length("g.text").cast("long").alias("n_text"), "g.evidence_level")


@query("merge_article", v.with_views(v.LEADS) + f"""
SELECT lead_seq, CASE WHEN {ACCESS_SQL} IS NULL THEN l.title ELSE coalesce(nullif(p.title, ''), l.title) END AS title,
  coalesce({ACCESS_SQL}, 'unavailable') AS access_status,
  CASE WHEN {ACCESS_SQL} IS NOT NULL AND l.language = 'de' THEN '2024-01-02' WHEN date_precision = 'missing' THEN ''
    ELSE strftime(published, '%Y-%m-%dT%H:%M:%SZ') END AS published,
  CASE WHEN {ACCESS_SQL} IS NOT NULL AND l.language = 'de' THEN 'article' WHEN date_precision = 'missing' THEN 'unknown' ELSE 'feed' END AS date_origin
FROM leads_v l LEFT JOIN (SELECT url, max(page_title) AS title FROM (SELECT url, {v.sql_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS page_title FROM pages) GROUP BY url) p USING (url)""")
def merge_article(spark, d):
    """Page titles replace lead titles; German articles state a date of their own."""
    from leadflow.functions.text import clean

    titles = v.table(spark, d, "pages").select("url", clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title")).groupBy("url").agg(F.max("title").alias("title"))
    arts = articles(spark, d).join(titles, "url")
    leads = v.leads(spark, d).withColumn("published", F.when(F.col("date_precision") == "missing", "").otherwise(iso("published")))
    dated = leads.select("url", "language").distinct().groupBy("url").agg(F.bool_or(F.col("language") == "de").alias("_de"))
    arts = arts.join(dated, "url").select("url", "title", F.lit("").alias("text"), F.lit("").alias("published"), F.lit("").alias("language"), "access_status")
    merged = c.merge_article(leads.filter("language <> 'de'"), arts).unionByName(
        c.merge_article(leads.filter("language = 'de'"), arts.withColumn("published", F.lit("2024-01-02"))))
    return merged.select("lead_seq", "title", "access_status", "published", "date_origin")


BODY_MATCHES = r"""body_tokens_v AS MATERIALIZED (
  SELECT DISTINCT lead_seq, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM leads_v),
body_matches_v AS MATERIALIZED (
  SELECT DISTINCT k.lead_seq, t.ticker FROM body_tokens_v k JOIN watch_terms_v t ON t.term = k.token
  UNION SELECT l.lead_seq, t.ticker FROM phrases_v t JOIN body_tokens_v k ON k.token = t.head JOIN leads_v l USING (lead_seq)
  WHERE contains(lower(l.text), t.term)),
discovery_v AS MATERIALIZED (
  SELECT lead_seq, list(ticker ORDER BY ticker) AS discovery_only FROM (SELECT * FROM matches_v EXCEPT SELECT * FROM body_matches_v) GROUP BY lead_seq)"""


def with_discovery(df, spark, d):
    body = v.named(spark, d, F.coalesce("text", F.lit("")))
    found = body.groupBy("lead_seq").agg(F.collect_list("ticker").alias("_body"))
    return df.join(found, "lead_seq", "left").withColumn(
        "discovery_only_tickers", c.discovery_only_tickers("tickers", "_body", F.lit(None))).drop("_body")


@query("discovery_only", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES, BODY_MATCHES) + """
SELECT l.lead_seq, coalesce(array_to_string(x.discovery_only, ','), '') AS tickers FROM leads_v l LEFT JOIN discovery_v x USING (lead_seq)""")
def discovery_only(spark, d):
    return with_discovery(sg.named_leads(spark, d), spark, d).select("lead_seq", F.array_join("discovery_only_tickers", ",").alias("tickers"))


@query("change_status", v.with_views(v.LEADS, v.HASHED, v.STATE) + f"""
SELECT h.lead_seq, CASE WHEN s.id IS NULL THEN 'new' WHEN s.content_hash <> h.content_hash THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN s.content_hash <> h.content_hash THEN s.title ELSE '' END AS previous_title,
  coalesce(s.content_hash = h.content_hash AND s.edition_date < DATE '{EDITION_DATE}', false) AS seen_before
FROM hashed_v h LEFT JOIN state_v s USING (id)""")
def change_status(spark, d):
    cands = v.hashed_leads(spark, d).drop("signature")
    return c.change_status(cands, v.prior_state(spark, d), EDITION_DATE).select("lead_seq", "change", "previous_title", "seen_before")


@query("change_history", v.with_views(v.LEADS, v.HASHED) + """
SELECT lead_seq, CASE WHEN prev IS NULL THEN 'new' WHEN prev <> content_hash THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN prev <> content_hash THEN prev_title ELSE '' END AS previous_title
FROM (SELECT *, lag(content_hash) OVER w AS prev, lag(title) OVER w AS prev_title FROM hashed_v
      WINDOW w AS (PARTITION BY id ORDER BY published::DATE, lead_seq))""")
def change_history(spark, d):
    seen = v.hashed_leads(spark, d).drop("signature").select("lead_seq", "id", "published", "content_hash", "title")
    return c.change_history(seen).select("lead_seq", "change", "previous_title")


TOPIC_SQL = sg.TOPIC_SQL.replace("(text)", "(r.text)").replace("(title)", "(r.title)")
CLASSIFIED = f"""gated_v AS MATERIALIZED (
  SELECT r.lead_seq, r.source_id, r.language, r.title, r.text, r.url, r.timing_markets, r.timing_resolved, x.tickers, x.attention_score, x.event_type,
    h.id, h.canonical, h.content_hash, h.signature, r.published, r.date_precision,
    s.collection_role, s.collection_role = 'market' AS broad, s.collection_role = 'market' OR s.publisher AS publisher, s.category AS source_category,
    {TOPIC_SQL} AS topic,
    coalesce({ACCESS_SQL.replace('url', 'r.url')}, 'metadata_only') AS access_status,
    coalesce(y.discovery_only, []) AS discovery_only,
    {tm.verdict_sql('r.applied_window_start', 'r.applied_inclusive', 'r.published', 'r.date_precision')} AS window_status,
    CASE WHEN p.id IS NULL THEN 'new' WHEN p.content_hash <> h.content_hash THEN 'changed' ELSE 'unchanged' END AS change,
    coalesce(p.content_hash = h.content_hash AND p.edition_date < DATE '{EDITION_DATE}', false) AS seen_before,
    CASE WHEN list_contains(r.timing_markets, 'VN') THEN 'VN' END AS inactive
  FROM recorded_v r JOIN scored_v x USING (lead_seq) JOIN hashed_v h USING (lead_seq) JOIN sources_v s ON s.id = r.source_id
  LEFT JOIN state_v p ON p.id = h.id LEFT JOIN discovery_v y ON y.lead_seq = r.lead_seq),
outcome_v AS MATERIALIZED (
  SELECT *, CASE WHEN len(tickers) = 0 AND NOT broad THEN 'no_watchlist_match' WHEN topic = 'none' THEN 'topic_not_matched'
      WHEN window_status = 'future' THEN 'future' WHEN window_status = 'old' AND change <> 'changed' THEN 'old'
      WHEN seen_before THEN 'previous_edition_unchanged' WHEN window_status = 'old' THEN 'date_needs_review' ELSE window_status END AS outcome
  FROM gated_v),
classified_v AS MATERIALIZED (
  SELECT *, outcome IN ('current', 'date_needs_review') AS kept,
    outcome = 'current' AND timing_resolved AND NOT (publisher AND access_status <> 'readable') AND NOT (publisher AND NOT starts_with(lower(language), 'en'))
      AND len(discovery_only) = 0 AND topic <> 'discovery' AND NOT (broad AND len(tickers) = 0) AS eligible
  FROM outcome_v)"""
CLASSIFIED_VIEWS = (*tm.RECORD_VIEWS, v.RULE_WORDS, sg.TOKENS, sg.SCORED, v.HASHED, v.STATE, BODY_MATCHES, CLASSIFIED)


def classified(spark, d):
    """Every lead with its outcome, flags and eligibility."""
    df = with_discovery(windowed(spark, d), spark, d)
    access = articles(spark, d)
    df = df.join(access, "url", "left").withColumn("access_status", F.coalesce("access_status", F.lit("metadata_only")))
    df = df.withColumn("broad", F.col("collection_role") == "market").withColumn("publisher", F.col("broad") | F.col("publisher"))
    df = c.change_status(df.withColumn("article_error", F.lit("")), v.prior_state(spark, d), EDITION_DATE)
    return c.classify(df).withColumn("eligible", c.is_eligible()).withColumn("flags", c.flags())


@query("classify_outcomes", v.with_views(*CLASSIFIED_VIEWS) + "SELECT lead_seq, outcome, kept FROM classified_v")
def classify_outcomes(spark, d):
    return classified(spark, d).select("lead_seq", "outcome", "kept")


@query("eligibility", v.with_views(*CLASSIFIED_VIEWS) + "SELECT lead_seq, eligible FROM classified_v WHERE kept")
def eligibility(spark, d):
    return classified(spark, d).filter("kept").select("lead_seq", "eligible")


@query("candidate_flags", v.with_views(*CLASSIFIED_VIEWS) + f"""
SELECT lead_seq, array_to_string(list_filter([
  CASE WHEN NOT timing_resolved THEN CASE WHEN inactive IS NOT NULL THEN 'No active news window yet for: VN.' ELSE '{c.FLAG_TIMING}' END END,
  '{c.FLAG_NOVELTY}', CASE WHEN broad THEN '{c.FLAG_RANKING}' END, CASE WHEN broad AND len(tickers) = 0 THEN '{c.FLAG_OUTSIDE}' END,
  CASE WHEN topic = 'discovery' THEN '{c.FLAG_TOPIC}' END, CASE WHEN outcome = 'date_needs_review' THEN '{c.FLAG_DATE}' END,
  CASE WHEN NOT starts_with(lower(language), 'en') THEN '{c.FLAG_LANGUAGE}' END, CASE WHEN text = '' THEN '{c.FLAG_HEADLINE}' END,
  CASE WHEN publisher AND access_status <> 'readable' THEN 'Article not fully available: ' || access_status || '. Discovery lead only; do not infer the full story.' END,
  CASE WHEN len(discovery_only) > 0 THEN '{c.FLAG_ISSUER}' END,
  CASE WHEN publisher AND NOT starts_with(lower(language), 'en') THEN '{c.FLAG_ENGLISH}' END], lambda x: x IS NOT NULL), ' | ') AS flags
FROM classified_v WHERE kept""")
def candidate_flags(spark, d):
    return classified(spark, d).filter("kept").select("lead_seq", F.array_join("flags", " | ").alias("flags"))


@query("category_rollup", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES, v.SOURCES) + """,
first_v AS (SELECT m.lead_seq, arg_min(w.category, w.ticker) AS category FROM matches_v m JOIN watchlist_v w USING (ticker) GROUP BY m.lead_seq)
SELECT CASE WHEN s.category <> '' THEN s.category ELSE coalesce(f.category, 'Other Strategy') END AS category, count(*)::BIGINT AS n
FROM leads_v l JOIN sources_v s ON s.id = l.source_id LEFT JOIN first_v f USING (lead_seq) GROUP BY 1""")
def category_rollup(spark, d):
    firms = v.watchlist(spark, d).select("ticker", "category")
    first = (v.named(spark, d).join(firms, "ticker").groupBy("lead_seq")
             .agg(F.min_by("category", "ticker").alias("first_match")))
    src = v.sources(spark, d).select(F.col("id").alias("source_id"), F.col("category").alias("source_category"))
    leads = v.leads(spark, d).select("lead_seq", "source_id").join(src, "source_id").join(first, "lead_seq", "left")
    return leads.groupBy(c.category(F.lit(None), "source_category", "first_match").alias("category")).agg(F.count("*").alias("n"))


@query("older_duplicates", v.with_views(v.LEADS, v.HASHED, v.STATE) + f"""
SELECT h.lead_seq, EXISTS (SELECT 1 FROM state_v s WHERE s.content_hash = h.content_hash AND s.id <> h.id AND s.edition_date < DATE '{EDITION_DATE}')
  AND coalesce({ACCESS_SQL} = 'readable', false) AS older_duplicate FROM hashed_v h""")
def older_duplicates(spark, d):
    cands = v.hashed_leads(spark, d).drop("signature").join(articles(spark, d), "url", "left").withColumn(
        "readable", F.coalesce(F.col("access_status") == "readable", F.lit(False)))
    return c.older_duplicates(cands, v.prior_state(spark, d), EDITION_DATE).select("lead_seq", "older_duplicate")


MARKET_FIRST = 10 ** 15
MERGE = f"""RECURSIVE_ORDER AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY seq) AS n, * FROM (
    SELECT h.lead_seq, h.lead_seq + CASE WHEN s.collection_role = 'market' THEN 0 ELSE {MARKET_FIRST} END AS seq, h.id, h.signature, h.canonical,
      coalesce({ACCESS_SQL.replace('url', 'h.url')} = 'readable', false) AS readable,
      coalesce(p.content_hash IS NOT NULL AND {ACCESS_SQL.replace('url', 'h.url')} = 'readable', false) AS older,
      coalesce(m.tickers, []) AS tickers
    FROM hashed_v h JOIN sources_v s ON s.id = h.source_id
    LEFT JOIN (SELECT lead_seq, list(ticker ORDER BY ticker) AS tickers FROM matches_v GROUP BY lead_seq) m ON m.lead_seq = h.lead_seq
    LEFT JOIN (SELECT h2.lead_seq, min(s2.content_hash) AS content_hash FROM hashed_v h2 JOIN state_v s2
      ON s2.content_hash = h2.content_hash AND s2.id <> h2.id AND s2.edition_date < DATE '{EDITION_DATE}' GROUP BY 1) p ON p.lead_seq = h.lead_seq)),
walk AS (
  SELECT 0::BIGINT AS n, []::VARCHAR[] AS ids, []::VARCHAR[] AS texts, ''::VARCHAR AS role
  UNION ALL
  SELECT o.n, CASE WHEN x.role = 'owner' THEN list_append(w.ids, o.id) ELSE w.ids END,
    CASE WHEN x.role = 'owner' AND o.readable THEN list_append(w.texts, o.signature) ELSE w.texts END, x.role
  FROM walk w JOIN RECURSIVE_ORDER o ON o.n = w.n + 1,
    LATERAL (SELECT CASE WHEN o.readable AND list_contains(w.texts, o.signature) THEN 'same_text' WHEN o.older THEN 'dropped'
      WHEN list_contains(w.ids, o.id) THEN 'same_id' ELSE 'owner' END AS role) x),
roles_v AS MATERIALIZED (SELECT o.*, w.role FROM RECURSIVE_ORDER o JOIN walk w ON w.n = o.n),
owned_v AS MATERIALIZED (
  SELECT r.*, CASE r.role WHEN 'same_text' THEN t.seq WHEN 'dropped' THEN NULL ELSE i.seq END AS owner_seq
  FROM roles_v r LEFT JOIN roles_v t ON t.role = 'owner' AND t.readable AND t.signature = r.signature
  LEFT JOIN roles_v i ON i.role = 'owner' AND i.id = r.id)""".replace("RECURSIVE_ORDER", "ordered_v")
MERGE_VIEWS = (v.LEADS, v.HASHED, v.STATE, v.SOURCES, v.WATCHLIST, v.MATCHES, MERGE)


def merge_sql(tail):
    return v.with_views(*MERGE_VIEWS).replace("WITH ", "WITH RECURSIVE ", 1) + tail


def merge_input(spark, d):
    cands = (with_names(v.hashed_leads(spark, d).drop("text"), v.named(spark, d))
             .join(articles(spark, d), "url", "left")
             .withColumn("readable", F.coalesce(F.col("access_status") == "readable", F.lit(False))))
    src = v.sources(spark, d).select(F.col("id").alias("source_id"), "collection_role")
    cands = cands.join(src, "source_id").withColumn(
        "seq", F.col("lead_seq") + F.when(F.col("collection_role") == "market", 0).otherwise(F.lit(MARKET_FIRST)))
    return c.older_duplicates(cands, v.prior_state(spark, d), EDITION_DATE)


@query("dedupe_candidates", merge_sql("""
SELECT o.seq, o.id, o.readable, coalesce(t.tickers, '') AS tickers, coalesce(k.n, 0)::BIGINT AS also_reported_count
FROM owned_v o LEFT JOIN (
  SELECT owner_seq, string_agg(ticker, ',' ORDER BY seq, pos) AS tickers FROM (
    SELECT owner_seq, ticker, seq, pos FROM (
      SELECT owner_seq, seq, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) AS pos FROM owned_v WHERE owner_seq IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY owner_seq, ticker ORDER BY seq, pos) = 1) GROUP BY owner_seq) t ON t.owner_seq = o.seq
LEFT JOIN (SELECT owner_seq, count(*) AS n FROM owned_v WHERE role = 'same_text' GROUP BY 1) k ON k.owner_seq = o.seq
WHERE o.role = 'owner'"""))
def dedupe_candidates(spark, d):
    kept, _ = dedupe.dedupe_candidates(dedupe.cut_lineage(merge_input(spark, d)))
    return kept.select("seq", "id", "readable", F.array_join("tickers", ",").alias("tickers"), "also_reported_count")


@query("also_reported", merge_sql("SELECT owner_seq, seq, canonical FROM owned_v WHERE role = 'same_text'"))
def also_reported(spark, d):
    _, copies = dedupe.dedupe_candidates(dedupe.cut_lineage(merge_input(spark, d)))
    return copies


EDITION_SQL = """row_number() OVER (ORDER BY attention_score DESC, change <> 'changed', event_type = 'Company update',
  array_to_string(tickers, chr(1)), lead_seq)"""


@query("select_edition", v.with_views(*CLASSIFIED_VIEWS) + f"""
SELECT lead_seq, attention_score, event_type, change, eligible, coalesce(p <= 25, false) AS selected, CASE WHEN p <= 25 THEN p END AS position
FROM (SELECT * FROM classified_v WHERE kept) c LEFT JOIN (SELECT lead_seq, {EDITION_SQL} AS p FROM classified_v WHERE kept AND eligible) e USING (lead_seq)""")
def select_edition(spark, d):
    kept = dedupe.cut_lineage(classified(spark, d).filter("kept").select(
        "lead_seq", "attention_score", "event_type", "change", "eligible", "tickers"))
    return c.select_edition(kept).select("lead_seq", F.col("attention_score").cast("long").alias("attention_score"), "event_type", "change",
                                         "eligible", "selected", F.col("position").cast("long").alias("position"))


@query("state_upsert", v.with_views(v.LEADS, v.HASHED, v.STATE) + f""",
new_v AS (SELECT id, content_hash, title FROM hashed_v WHERE published > TIMESTAMP '{v.AS_OF}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY lead_seq DESC) = 1)
SELECT coalesce(n.id, s.id) AS id, coalesce(n.content_hash, s.content_hash) AS content_hash, coalesce(n.title, s.title) AS title,
  CASE WHEN n.id IS NULL THEN s.edition_date ELSE DATE '2024-01-30' END::VARCHAR AS edition_date
FROM state_v s FULL JOIN new_v n ON n.id = s.id""")
def state_upsert(spark, d):
    later = v.hashed_leads(spark, d).drop("signature").filter(F.col("published") > F.lit(v.AS_OF).cast("timestamp"))
    return c.upsert_state(v.prior_state(spark, d), later, "2024-01-30").select(
        "id", "content_hash", "title", F.col("edition_date").cast("string").alias("edition_date"))


@query("export_items", v.with_views(*CLASSIFIED_VIEWS) + f"""
SELECT id, source_url, headline, tickers, document_change, access_status, attention_score, identity_verified, eligible_for_email, source_excerpt, source_name, published_at, evidence_level, reasons FROM (
  SELECT lead_seq, id, 'Source ' || source_id AS source_name, {tm.iso_sql('published')} AS published_at, 'source_excerpt' AS evidence_level, array_to_string(attention_reasons, '; ') AS reasons, canonical AS source_url, title AS headline, array_to_string(tickers, ',') AS tickers, change AS document_change, access_status,
    attention_score, len(tickers) > 0 AS identity_verified, eligible AS eligible_for_email,
    CASE WHEN room > 0 AND len(body) > 0 THEN 'Source excerpt: “' || array_to_string(body[1:room], ' ') || CASE WHEN len(body) > room THEN '…' ELSE '' END || '”'
      ELSE 'Read the linked announcement for the details.' END AS source_excerpt
  FROM (SELECT *, greatest(0, 25 - len(string_split({v.sql_clean('title')}, ' '))) AS room,
      CASE WHEN {v.sql_clean('text')} = '' THEN [] ELSE string_split({v.sql_clean('text')}, ' ') END AS body FROM classified_v JOIN (SELECT lead_seq, attention_reasons FROM scored_v) USING (lead_seq) WHERE kept))""")
def export_items(spark, d):
    items = c.export_items(classified(spark, d).filter("kept").withColumn("source_name", F.concat(F.lit("Source "), "source_id")))
    return items.select("id", "source_url", "headline", F.array_join("tickers", ",").alias("tickers"), "document_change", "access_status",
                        F.col("attention_score").cast("long").alias("attention_score"), "identity_verified", "eligible_for_email", "source_excerpt",
                        "source_name", "published_at", "evidence_level", F.array_join("attention_reasons", "; ").alias("reasons"))
