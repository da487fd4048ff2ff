"""Queries over company matching, event scoring and topics."""

from pyspark.sql import functions as F

from leadflow.operators import matching as m
from leadflow.operators import triage as t
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.rules import EventRule, RuleSet

BASE_SCORES = (94, 88, 84, 80, 76, 74, 73, 72)
LETTERS = r"[\p{L}\p{N}_]+"


def any_word(words):
    return r"\b(?:" + "|".join(words) + r")\b"


def stand_in_rules(words, with_strip=False):
    """Eight event rules, the macro and the business wording from twenty corpus words."""
    rules = []
    for n, score in enumerate(BASE_SCORES):
        extra = {}
        if with_strip and n == 0:
            # "word," and "word." count as another sense; next to the ninth word, without business
            # wording, the word itself is removed as well.
            extra = dict(strip=rf"\b{words[0]}[.,]", context=any_word(words[8:9]), strip_context=any_word(words[:1]))
        rules.append(EventRule(f"Event {n + 1}", v.SECTIONS[n % 4], score, any_word(words[n:n + 1]), **extra))
    return RuleSet(tuple(rules), any_word(words[8:12]), any_word(words[12:20]))


TOKENS = rf"""toks_v AS MATERIALIZED (
  SELECT lead_seq, regexp_extract_all(lower(title), '{LETTERS}') AS tt, regexp_extract_all(lower(text), '{LETTERS}') AS tb FROM leads_v)"""
SCORED = f"""hits_v AS MATERIALIZED (
  SELECT k.lead_seq, w.r, ({list(BASE_SCORES)})[w.r] - CASE WHEN list_contains(k.tt, w.word) THEN 0 ELSE 8 END AS s,
    'Event ' || w.r || ' signal in ' || CASE WHEN list_contains(k.tt, w.word) THEN 'headline' ELSE 'article text' END AS reason
  FROM toks_v k JOIN rule_words_v w ON w.r <= 8 AND (list_contains(k.tt, w.word) OR list_contains(k.tb, w.word))),
context_v AS MATERIALIZED (
  SELECT k.lead_seq, coalesce(bool_or(w.r BETWEEN 9 AND 12), false) AS macro, coalesce(bool_or(w.r >= 13), false) AS business
  FROM toks_v k LEFT JOIN rule_words_v w ON w.r > 8 AND (list_contains(k.tt, w.word) OR list_contains(k.tb, w.word)) GROUP BY k.lead_seq),
best_v AS MATERIALIZED (
  SELECT lead_seq, list(reason ORDER BY s DESC, r)[1:3] AS reasons, max(s) AS s, list(r ORDER BY s DESC, r)[1] AS r FROM hits_v GROUP BY lead_seq),
named_v AS MATERIALIZED (SELECT lead_seq, list(ticker ORDER BY ticker) AS tickers FROM matches_v GROUP BY lead_seq),
scored_v AS MATERIALIZED (
  SELECT l.lead_seq, coalesce(n.tickers, []) AS tickers,
    least(100, coalesce(b.s, CASE WHEN c.macro THEN 24 WHEN c.business THEN 18 ELSE 0 END) + CASE WHEN n.tickers IS NULL THEN 0 ELSE 8 END)::BIGINT AS attention_score,
    CASE WHEN b.s IS NOT NULL THEN 'Event ' || b.r WHEN c.macro THEN 'Macro/markets' WHEN c.business THEN 'General business' ELSE 'Other' END AS event_type,
    CASE WHEN b.s IS NOT NULL THEN ({list(v.SECTIONS)})[(b.r - 1) % 4 + 1] ELSE 'Other Strategy' END AS category,
    (b.s IS NOT NULL OR c.macro OR c.business) AS market_relevant,
    coalesce(b.reasons, [CASE WHEN c.macro THEN '{t.MACRO_REASON}' WHEN c.business THEN '{t.BUSINESS_REASON}' ELSE '{t.NO_REASON}' END])
      || CASE WHEN n.tickers IS NULL THEN [] ELSE ['{t.PRIORITY_REASON}'] END AS attention_reasons
  FROM leads_v l JOIN context_v c USING (lead_seq) LEFT JOIN best_v b USING (lead_seq) LEFT JOIN named_v n USING (lead_seq))"""
SCORED_VIEWS = (v.LEADS, v.WATCHLIST, v.MATCHES, v.RULE_WORDS, TOKENS, SCORED)


def named_leads(spark, d):
    return m.with_names(v.leads(spark, d), v.named(spark, d))


def scored_leads(spark, d):
    """Leads without their texts, which are scored and matched where they are read."""
    rules = stand_in_rules(v.top_words(spark, d, 20))
    scored = v.leads(spark, d, lambda docs: t.score_texts(docs, rules)).drop("title", "text")
    return t.with_name_bonus(m.with_names(scored, v.named(spark, d)))


@query("watch_matches", v.with_views(v.LEADS, v.WATCHLIST, v.MATCHES) + "SELECT lead_seq, ticker FROM matches_v")
def watch_matches(spark, d):
    return v.named(spark, d)


@query("scoped_watchlist", v.with_views(v.SOURCES, v.WATCHLIST) + """
SELECT s.id AS source_id, w.ticker FROM sources_v s JOIN watchlist_v w ON split_part(w.ticker, ' ', 2) = s.scope_market
WHERE s.scope_market <> '' AND (s.issuer_official OR s.discovery_only)""")
def scoped_watchlist(spark, d):
    src = v.sources(spark, d).withColumn("exchange_index", F.col("discovery_only")).withColumn("tickers", F.array().cast("array<string>"))
    return m.scoped_watchlist(src, v.watchlist(spark, d))


@query("triage", v.with_views(*SCORED_VIEWS) + "SELECT lead_seq, attention_score, event_type, category, market_relevant FROM scored_v")
def triage(spark, d):
    return scored_leads(spark, d).select("lead_seq", F.col("attention_score").cast("long").alias("attention_score"), "event_type",
                                         "category", "market_relevant")


@query("triage_reasons", v.with_views(*SCORED_VIEWS) + "SELECT lead_seq, array_to_string(attention_reasons, '; ') AS reasons FROM scored_v")
def triage_reasons(spark, d):
    return scored_leads(spark, d).select("lead_seq", F.array_join("attention_reasons", "; ").alias("reasons"))


@query("triage_negative", v.with_views(v.LEADS, v.WORDS, v.RULE_WORDS) + rf""",
w AS (SELECT max(word) FILTER (r = 1) AS w1, max(word) FILTER (r = 9) AS w9, list(word) FILTER (r >= 13) AS biz FROM rule_words_v),
x AS (SELECT l.lead_seq, w.*,
    regexp_extract_all(regexp_replace(' ' || lower(title), '([^\p{{L}}\p{{N}}_])' || w1 || '[.,]', '\1', 'g'), '{LETTERS}') AS tt,
    regexp_extract_all(regexp_replace(' ' || lower(text), '([^\p{{L}}\p{{N}}_])' || w1 || '[.,]', '\1', 'g'), '{LETTERS}') AS tb,
    regexp_extract_all(lower(title || ' ' || text), '{LETTERS}') AS everything FROM leads_v l, w),
y AS (SELECT *, list_contains(everything, w9) AND NOT list_has_any(everything, biz) AS unclear FROM x)
SELECT lead_seq, NOT unclear AND list_contains(tt, w1) AS in_headline, NOT unclear AND list_contains(tt || tb, w1) AS found FROM y""")
def triage_negative(spark, d):
    rules = stand_in_rules(v.top_words(spark, d, 20), with_strip=True)
    only = RuleSet(rules.rules[:1], rules.macro, rules.business)
    leads = v.leads(spark, d, lambda docs: t.triage(docs.withColumn("tickers", F.array().cast("array<string>")), only))
    return leads.select("lead_seq", F.array_contains("attention_reasons", "Event 1 signal in headline").alias("in_headline"),
                                        (F.col("event_type") == "Event 1").alias("found"))


@query("event_label", v.with_views(v.LEADS, v.WORDS, v.RULE_WORDS, TOKENS) + """
SELECT k.lead_seq, coalesce('Label ' || min(w.r), 'Company update') AS label FROM toks_v k
LEFT JOIN rule_words_v w ON w.r <= 7 AND (list_contains(k.tt, w.word) OR list_contains(k.tb, w.word)) GROUP BY k.lead_seq""")
def event_label(spark, d):
    labels = [(f"Label {n}", any_word([w])) for n, w in enumerate(v.top_words(spark, d, 7), 1)]
    return v.leads(spark, d).select("lead_seq", t.event_label(F.concat_ws(" ", "title", "text"), labels).alias("label"))


@query("attention_gate", v.with_views(*SCORED_VIEWS, v.SOURCES) + """
SELECT l.lead_seq, s.retain_all_leads OR (c.market_relevant AND c.attention_score >= 35) AS kept
FROM scored_v c JOIN leads_v l USING (lead_seq) JOIN sources_v s ON s.id = l.source_id""")
def attention_gate(spark, d):
    sources = v.sources(spark, d).select(F.col("id").alias("source_id"), "retain_all_leads")
    return scored_leads(spark, d).join(sources, "source_id").select(
        "lead_seq", t.passes_attention("attention_score", "market_relevant", "retain_all_leads").alias("kept"))


TOPIC = "tion"
TOPIC_SQL = f"""CASE WHEN contains(lower(text), '{TOPIC}') THEN 'text' WHEN contains(lower(title), '{TOPIC}') THEN 'discovery' ELSE 'none' END"""


@query("topic_match", v.with_views(v.LEADS) + f"SELECT lead_seq, {TOPIC_SQL} AS topic FROM leads_v")
def topic_match(spark, d):
    return v.leads(spark, d, lambda docs: docs.withColumn("topic", m.topic_match(TOPIC, F.col("text"), F.col("title")))).select("lead_seq", "topic")
