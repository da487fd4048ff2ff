"""Queries over text, hash, language and wording columns."""

from pyspark.sql import functions as F

from leadflow.functions import text as tx
from leadflow.functions import urls
from leadflow.functions.dates import iso
from leadflow.operators.search import company_queries
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.sources.captures import decode_body

ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789&"
FULL_WIDTH = "".join(chr(ord(c) + 0xFEE0) for c in ASCII_LETTERS)

VISIBLE_SQL = r"""regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"""
for _tag in tx.HIDDEN_TAGS:
    VISIBLE_SQL = rf"regexp_replace({VISIBLE_SQL}, '(?is)<{_tag}(\s[^>]*)?>.*?</{_tag}\s*>', ' ', 'g')"
VISIBLE_SQL = rf"regexp_replace({VISIBLE_SQL}, '(?s)<[^>]*>', ' ', 'g')"
# References that the given pages hold; the operator reads all.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
for _entity, _char in ENTITIES:
    VISIBLE_SQL = f"""replace({VISIBLE_SQL}, '{_entity}', '{_char.replace("'", "''")}')"""


@query("clean_text", f"SELECT doc_id, md5({v.sql_clean('text')}) AS text_md5, length({v.sql_clean('text')})::BIGINT AS n FROM documents")
def clean_text(spark, d):
    c = tx.clean("text")
    return v.table(spark, d, "documents").select("doc_id", F.md5(c).alias("text_md5"), F.char_length(c).cast("long").alias("n"))


@query("nfkc_text", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def nfkc_text(spark, d):
    """Full-width forms of every document go back to the plain ones."""
    wide = F.translate("text", ASCII_LETTERS, FULL_WIDTH)
    return v.table(spark, d, "documents").select("doc_id", F.md5(tx.nfkc(wide)).alias("text_md5"))


@query("html_text", f"SELECT page_id, md5({v.sql_clean('x')}) AS text_md5 FROM (SELECT page_id, {VISIBLE_SQL} AS x FROM pages)")
def html_text(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.md5(tx.html_to_text("html")).alias("text_md5"))


@query("decoded_bodies", "SELECT page_id, md5(html) AS body_md5 FROM pages")
def decoded_bodies(spark, d):
    """Every page in one of three byte encodings, decoded from its declaration."""
    kind = F.col("page_id") % 3
    body = (F.when(kind == 0, F.encode("html", "UTF-8"))
            .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("html", "UTF-16LE")))
            .otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("html", "UTF-8"))))
    return v.table(spark, d, "pages").select(
        "page_id", F.md5(decode_body(body, F.lit("text/html; charset=utf-8"))).alias("body_md5"))


@query("content_hashes", v.with_views(v.LEADS, v.HASHED) + "SELECT lead_seq, id, content_hash, signature FROM hashed_v")
def content_hashes(spark, d):
    return v.hashed_leads(spark, d).select("lead_seq", "id", "content_hash", "signature")


EXCERPT_SQL = """CASE WHEN room > 0 AND len(body) > 0 THEN 'Source excerpt: “' || array_to_string(body[1:room], ' ')
  || CASE WHEN len(body) > room THEN '…' ELSE '' END || '”' ELSE 'Read the linked announcement for the details.' END"""


@query("excerpts", v.with_views(v.LEADS) + f"""
SELECT lead_seq, {EXCERPT_SQL} AS excerpt FROM (
  SELECT lead_seq, greatest(0, 25 - CASE WHEN {v.sql_clean('title')} = '' THEN 0 ELSE len(string_split({v.sql_clean('title')}, ' ')) END) AS room,
    CASE WHEN {v.sql_clean('text')} = '' THEN [] ELSE string_split({v.sql_clean('text')}, ' ') END AS body FROM leads_v)""")
def excerpts(spark, d):
    return v.leads(spark, d).select("lead_seq", tx.excerpt("title", "text").alias("excerpt"))


@query("publication_label", v.with_views(v.LEADS) + """
SELECT lead_seq, CASE date_precision WHEN 'missing' THEN 'publication time unconfirmed'
  WHEN 'day' THEN strftime(published, '%Y-%m-%d') || ' (date only; time unconfirmed)'
  ELSE strftime(published, '%Y-%m-%dT%H:%M:%SZ') END AS label FROM leads_v""")
def publication_label(spark, d):
    published = F.when(F.col("date_precision") != "missing", iso("published"))
    return v.leads(spark, d).select("lead_seq", tx.publication_label(published, "date_precision").alias("label"))


# Display labels for frequent long words of the corpus: the words themselves are data.
def _display_labels(words):
    return {word: f"Label {n}" for n, word in enumerate(words, 1)}


@query("headline_alias", v.with_views(v.LEADS, v.WORDS, v.RULE_WORDS) + r""",
pieces AS (SELECT lead_seq, unnest(regexp_extract_all(title, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS piece,
    generate_subscripts(regexp_extract_all(title, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS pos FROM leads_v)
SELECT l.lead_seq, coalesce(string_agg(CASE WHEN w.r IS NULL THEN p.piece ELSE 'Label ' || w.r END, '' ORDER BY p.pos), '') AS headline
FROM leads_v l LEFT JOIN pieces p ON p.lead_seq = l.lead_seq LEFT JOIN rule_words_v w ON w.word = lower(p.piece)
GROUP BY l.lead_seq""")
def headline_alias(spark, d):
    labels = _display_labels(v.top_words(spark, d, 20))
    return v.leads(spark, d).select("lead_seq", tx.apply_aliases("title", labels).alias("headline"))


@query("company_queries", v.with_views(v.WATCHLIST) + """,
terms AS (SELECT w.ticker, w.name, list(o.word ORDER BY o.word) FILTER (o.word IS NOT NULL) AS words
  FROM watchlist_v w LEFT JOIN word_owner_v o ON o.s_suppkey = w.s_suppkey GROUP BY ALL),
tries AS (SELECT ticker, n, '("' || array_to_string(([name] || coalesce(words, []))[1:n], '" OR "') ||
    '") AND (site:example.com OR site:example.org)' AS q FROM terms, (VALUES (4), (3), (2), (1)) x(n)
  WHERE n <= 1 + len(coalesce(words, [])))
SELECT ticker, q AS query FROM tries WHERE length(q) <= 600 AND len(string_split(q, ' ')) <= 75
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC) = 1""")
def company_queries_query(spark, d):
    return company_queries(v.watchlist(spark, d), ["example.com", "example.org"]).select("ticker", "query")


@query("needs_translation", v.with_views(v.SOURCES) + """
SELECT d.doc_id, s.publisher AND NOT starts_with(lower(d.lang), 'en') AS needs_translation
FROM documents d JOIN sources_v s ON s.id = d.source""")
def needs_translation(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("id"))
    return docs.join(v.sources(spark, d), "id").select(
        "doc_id", tx.needs_translation("publisher", "lang").alias("needs_translation"))


@query("script_flags", """
SELECT doc_id, lang = 'es' AS has_cjk, CASE WHEN lang = 'es' THEN 'ja' ELSE '' END AS language FROM documents""")
def script_flags(spark, d):
    """Spanish documents get a kana ending and lose their language, so that it must be inferred."""
    text = F.when(F.col("lang") == "es", F.concat("text", F.lit("です"))).otherwise(F.col("text"))
    return v.table(spark, d, "documents").select(
        "doc_id", tx.has_cjk(text).alias("has_cjk"), tx.infer_language(F.lit(""), text).alias("language"))


@query("clamp_num", """
SELECT event_id, (CASE WHEN event_type = 'error' THEN 6 ELSE greatest(10, least(60,
  trunc(CASE WHEN event_type = 'view' THEN value ELSE json_extract_string(props, '$.k')::DOUBLE END))) END)::BIGINT AS setting FROM events""")
def clamp_num(spark, d):
    raw = (F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", F.col("value").cast("string"))
           .otherwise(F.get_json_object("props", "$.k")))
    return v.table(spark, d, "events").select("event_id", tx.clamp_num(raw, 6, 10, 60, integer=True).cast("long").alias("setting"))


@query("story_anchor", """
SELECT o_orderkey, 'story-' || substr(regexp_replace(regexp_replace(s, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 45)
  || '-' || substr(sha256(s), 1, 10) AS anchor
FROM (SELECT o_orderkey, o_orderpriority || ' / ' || o_orderkey || ' / ' || o_orderdate::DATE || ' / ' || o_totalprice::BIGINT AS s FROM orders)""")
def story_anchor(spark, d):
    s = F.concat_ws(" / ", "o_orderpriority", F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("date").cast("string"),
                    F.rint("o_totalprice").cast("long").cast("string"))
    return v.table(spark, d, "orders").select("o_orderkey", tx.story_anchor(s, "story-").alias("anchor"))


@query("meaningful_docs", "SELECT doc_id, length(text) >= 45 AS meaningful FROM documents")
def meaningful_docs(spark, d):
    return v.table(spark, d, "documents").select("doc_id", tx.is_meaningful("text").alias("meaningful"))
