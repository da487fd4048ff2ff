"""Queries over captured pages, feeds and listings."""

from pyspark.sql import functions as F

from leadflow.functions.dates import iso
from leadflow.plans import views as v
from leadflow.plans.registry import query
from leadflow.plans.texts import ENTITIES, VISIBLE_SQL
from leadflow.plans.times import iso_sql
from leadflow.sources import articles as ar
from leadflow.sources import markup as mk
from leadflow.sources.captures import decode_body
from leadflow.sources.tree import Page, node_table, page_index


def page():
    return Page.of("_page")


def indexed(df):
    return df.withColumn("_page", page_index("html"))


def pages(spark, d):
    return v.table(spark, d, "pages").withColumn("source_id", F.col("page_id").cast("string"))


@query("scan_captures", r"""
SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, count(*)::BIGINT AS pages, sum(octet_length(encode(html)))::BIGINT AS n_bytes, sum(length(html))::BIGINT AS n_chars
FROM pages GROUP BY 1""")
def scan_captures(spark, d):
    captures = pages(spark, d).select("url", F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    text = captures.withColumn("text", decode_body("body", "content_type"))
    return text.groupBy(F.regexp_extract("url", "//([^/?#]*)", 1).alias("host")).agg(
        F.count("*").alias("pages"), F.sum(F.length("body")).alias("n_bytes"), F.sum(F.char_length("text")).alias("n_chars"))


def _xml(column):
    out = F.col(column)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feeds(spark, d):
    """A feed per lead: RSS with a second item that has no link, Atom with a self link first, or a page."""
    lead = v.leads(spark, d)
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title><item><title>'), _xml("title"),
                   F.lit("</title><link>"), _xml("url"), F.lit("</link><dc:date>"), iso("published"), F.lit("</dc:date></item><item><title>No link</title></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), _xml("title"), F.lit('</title><link rel="self" href="/self"/><link href="/n/'),
                    F.col("lead_seq").cast("string"), F.lit('"/><updated>'), iso("published"), F.lit("</updated></entry></feed>"))
    page = F.lit("<html><body>Sign in</body></html>")
    body = F.when(F.col("date_precision") == "time", rss).when(F.col("date_precision") == "day", atom).otherwise(page)
    return lead.select(F.col("lead_seq").alias("source_id"), F.lit("https://feeds.example.com/all/index.xml").alias("url"), body.alias("body"))


@query("feed_leads", v.with_views(v.LEADS) + f"""
SELECT lead_seq AS source_id, {v.sql_clean('title')} AS title, CASE date_precision WHEN 'time' THEN url ELSE 'https://feeds.example.com/n/' || lead_seq END AS url,
  CASE date_precision WHEN 'time' THEN {iso_sql('published')} ELSE '' END AS published, CASE date_precision WHEN 'day' THEN {iso_sql('published')} ELSE '' END AS updated
FROM leads_v WHERE date_precision <> 'missing'""")
def feed_leads(spark, d):
    leads, _ = mk.explode_feeds(feeds(spark, d))
    return leads.select("source_id", "title", "url", F.col("published_raw").alias("published"), F.col("updated_raw").alias("updated"))


@query("feed_rejects", v.with_views(v.LEADS) + "SELECT lead_seq AS source_id, 'the source returned a page instead of a feed' AS error FROM leads_v WHERE date_precision = 'missing'")
def feed_rejects(spark, d):
    _, rejects = mk.explode_feeds(feeds(spark, d))
    return rejects.select("source_id", "error")


ANCHORS = f"""anchors_v AS MATERIALIZED (
  SELECT page_id, url AS page_url, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {v.sql_clean("replace(regexp_replace(regexp_extract(a, '(?s)<a[^>]*>(.*)</a>', 1), '<[^>]*>', ' ', 'g'), '&amp;', '&')")} AS title
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>'), 1) AS pos FROM pages)),
links_v AS MATERIALIZED (
  SELECT page_id, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) || href AS url, arg_min(title, pos) AS title, regexp_extract(page_url, '//([^/?#]*)', 1) AS host FROM anchors_v GROUP BY page_id, page_url, href)"""


@query("page_links", v.with_views(ANCHORS) + r"SELECT page_id, url, title FROM links_v WHERE length(title) >= 6 AND regexp_matches(host, '(^|\.)example\.(com|org)$')")
def page_links(spark, d):
    found, _ = mk.explode_links(pages(spark, d), F.array(F.lit("example.com"), F.lit("example.org")))
    return found.select(F.col("source_id").cast("long").alias("page_id"), "url", "title")


@query("page_links_same_host", v.with_views(ANCHORS) + "SELECT page_id, url, title FROM links_v WHERE length(title) >= 6")
def page_links_same_host(spark, d):
    found, _ = mk.explode_links(pages(spark, d), same_host=True)
    return found.select(F.col("source_id").cast("long").alias("page_id"), "url", "title")


# Listing tables made of line items: one announcement per body, every third layout, and bodies whose
# layout has changed (returned items).
def listings(spark, d):
    li = v.table(spark, d, "lineitem")
    c = F.col
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    title = F.concat(F.lit("Part "), c("l_partkey").cast("string"))
    href = F.concat(F.lit("/f/"), c("l_orderkey").cast("string"), F.lit(".html?a=1&amp;b=2"))
    code = F.lpad(c("l_suppkey").cast("string"), 4, "0")
    au = F.concat(F.lit("<table><tr><th>Code</th></tr><tr><td>"), code, F.lit("</td><td>"), day, F.lit(" 3:05 PM</td><td>"),
                  F.when(c("l_tax") > 0.05, '<img title="asterix indicates price sensitive">').otherwise(""), F.lit('</td><td><a href="/displayAnnouncement'), href, F.lit('">'), title, F.lit("</a></td></tr></table>"))
    nz = F.concat(F.lit('<table><tr class="x announcement"><td class="code">'), code, F.lit('</td><td class="title"><a href="'), href, F.lit('">'), title,
                  F.lit('</a></td><td class="date">'), day, F.lit(" 09:30 NZDT</td></tr></table>"))
    jp = F.concat(F.lit('<table id="main-list-table"><tr><td class="even-new-L kjTime">15:30</td><td class="kjCode">'), code, F.when(c("l_quantity") > 25, "0").otherwise("5"),
                  F.lit('</td><td class="kjName">Supplier</td><td class="kjTitle"><a href="'), href, F.lit('">'), title, F.lit("</a></td></tr></table>"))
    market = F.element_at(F.array(F.lit("AU"), F.lit("NZ"), F.lit("JP")), (c("l_linenumber") % 3 + 1).cast("int"))
    changed = F.lit("<table><tr><td>Please log in</td></tr></table>")
    quiet = F.lit("<p>該当する情報はありません</p>")
    body = (F.when(c("l_returnflag") == "R", F.when((market == "JP") & (c("l_linestatus") == "O"), quiet).otherwise(changed))
            .when(market == "AU", au).when(market == "NZ", nz).otherwise(jp))
    return li.select(F.concat_ws("/", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"), c("l_partkey").cast("string"), c("l_suppkey").cast("string")).alias("source_id"),
                     F.lit("https://www.example.com/list/today").alias("url"), F.date_format("l_shipdate", "yyyyMMdd").alias("day"), body.alias("body"), market.alias("market"))


LISTING = """listing_v AS MATERIALIZED (
  SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS source_id, (['AU', 'NZ', 'JP'])[l_linenumber % 3 + 1] AS market,
    lpad(l_suppkey::VARCHAR, greatest(4, 4), '0') AS code4, * FROM lineitem)"""


def each_layout(spark, d):
    captures = listings(spark, d)
    return [mk.explode_listing(captures.filter(F.col("market") == m), layout) for m, layout in mk.LAYOUTS.items()]


@query("listing_leads", v.with_views(LISTING) + """
SELECT source_id, CASE market WHEN 'JP' THEN CASE WHEN l_quantity > 25 THEN code4 || ' JP ' ELSE '' END || 'Supplier ' ELSE code4 || ' ' || market || ' ' END || 'Part ' || l_partkey AS title,
  'https://www.example.com' || CASE market WHEN 'AU' THEN '/displayAnnouncement' ELSE '' END || '/f/' || l_orderkey || '.html?a=1&b=2' AS url,
  strftime(((l_shipdate + CASE market WHEN 'AU' THEN INTERVAL 905 MINUTE WHEN 'NZ' THEN INTERVAL 570 MINUTE ELSE INTERVAL 930 MINUTE END)
    AT TIME ZONE CASE market WHEN 'AU' THEN 'Australia/Sydney' WHEN 'NZ' THEN 'Pacific/Auckland' ELSE 'Asia/Tokyo' END) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS published,
  CASE WHEN market = 'JP' AND l_quantity <= 25 THEN '' ELSE code4 || ' ' || market END AS tickers, market = 'AU' AND l_tax > 0.05 AS price_sensitive
FROM listing_v WHERE l_returnflag <> 'R'""")
def listing_leads(spark, d):
    parts = [leads for leads, _ in each_layout(spark, d)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.select("source_id", "title", "url", iso("published").alias("published"), F.array_join("exchange_tickers", ",").alias("tickers"), "price_sensitive")


@query("listing_rejects", v.with_views(LISTING) + """
SELECT source_id, 'announcement rows missing; check the page manually' AS error FROM listing_v WHERE l_returnflag = 'R' AND NOT (market = 'JP' AND l_linestatus = 'O')""")
def listing_rejects(spark, d):
    parts = [rejects for _, rejects in each_layout(spark, d)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("source_id", "error")


@query("json_listing", """
SELECT event_id, (json_extract_string(props, '$.k')::INT) || ' HK ' || (user_id + 100) || ' HK User ' || user_id || ' Event ' || event_type AS title,
  'https://www.example.com/f/' || event_id || '.pdf' AS url, strftime((date_trunc('minute', ts) AT TIME ZONE 'Asia/Hong_Kong') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS published, event_id + 1 AS total FROM events""")
def json_listing(spark, d):
    e = v.table(spark, d, "events")
    five = lambda c: F.lpad(c.cast("string"), 5, "0")
    row = F.to_json(F.array(F.struct(
        F.concat(five(F.get_json_object("props", "$.k")), F.lit("<br/>"), five(F.col("user_id") + 100)).alias("STOCK_CODE"),
        F.concat(F.lit("<i>User</i> "), F.col("user_id").cast("string")).alias("STOCK_NAME"), F.concat(F.lit("Event "), "event_type").alias("TITLE"),
        F.concat(F.lit("/f/"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("FILE_LINK"), F.date_format("ts", "dd/MM/yyyy HH:mm").alias("DATE_TIME"))))
    body = F.to_json(F.struct(row.alias("result"), (F.col("event_id") + 1).alias("recordCnt")))
    found, _ = mk.explode_json_listing(e.select(F.col("event_id").alias("source_id"), F.lit("https://www.example.com/search").alias("url"), body.alias("body")))
    return found.select(F.col("source_id").alias("event_id"), "title", "url", iso("published").alias("published"), "total")


@query("jsonp_leads", v.with_views(v.LEADS) + f"""
SELECT lead_seq, {v.sql_clean('title')} AS title, url, CASE language WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr-FR' ELSE 'ja' END AS language FROM leads_v WHERE language <> 'es'""")
def jsonp_leads(spark, d):
    """Widgets of one item each; Spanish ones have lost their wrapper and are rejected."""
    payload = F.to_json(F.struct(F.array(F.struct(_xml("title").alias("title"), F.col("url").alias("link"), iso("published").alias("date"), F.upper("language").alias("lang"))).alias("item")))
    body = F.when(F.col("language") == "es", payload).otherwise(F.concat(F.lit("news.show("), payload, F.lit(");\n")))
    found, _ = mk.explode_jsonp(v.leads(spark, d).select(F.col("lead_seq").alias("source_id"), "url", body.alias("body")), "news.show", {"EN": "en", "FR": "fr-FR"})
    return found.select(F.col("source_id").alias("lead_seq"), "title", "url", "language")



def plain_sql(expr):
    out = f"regexp_replace({expr}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in ENTITIES:
        out = f"""replace({out}, '{entity}', '{char.replace("'", "''")}')"""
    return v.sql_clean(out)


ARTICLE_SQL = r"regexp_extract(regexp_replace(html, '(?is)<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>', ' ', 'g'), '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1)"
PIECES = f"""pieces_v AS MATERIALIZED (SELECT page_id, string_split_regex({ARTICLE_SQL}, '(?i)<p(?:\\s[^>]*)?>') AS parts FROM pages),
paragraphs_v AS MATERIALIZED (
  SELECT page_id, pos, {plain_sql(r"regexp_replace(part, '(?is)</p\s*>.*$', '')")} AS p
  FROM (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM pieces_v) WHERE pos > 1)"""


@query("page_titles", f"SELECT page_id, {plain_sql('regexp_extract(html, ' + chr(39) + '(?is)<h1>(.*?)</h1>' + chr(39) + ', 1)')} AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS language FROM pages")
def page_titles(spark, d):
    return ar.extract_articles(pages(spark, d)).select("page_id", "title", "language")


@query("page_paragraphs", v.with_views(PIECES) + "SELECT page_id, pos - 1 AS number, md5(p) AS text_md5 FROM paragraphs_v")
def page_paragraphs(spark, d):
    rows = indexed(pages(spark, d)).select("page_id", F.posexplode(ar.article_paragraphs(page())).alias("i", "p"))
    return rows.select("page_id", (F.col("i") + 1).cast("long").alias("number"), F.md5("p").alias("text_md5"))


@query("doc_paragraphs", v.with_views(PIECES) + f"""
SELECT g.page_id, {plain_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS title, md5(coalesce(t.text, g.whole)) AS text_md5
FROM (SELECT page_id, html, {v.sql_clean(VISIBLE_SQL.replace("(html,", "(" + ARTICLE_SQL + ",", 1))} AS whole FROM pages) g LEFT JOIN (SELECT page_id, string_agg(p, chr(10) ORDER BY pos) AS text FROM paragraphs_v WHERE length(p) >= 35 GROUP BY 1) t USING (page_id)""")
def doc_paragraphs(spark, d):
    doc = indexed(pages(spark, d)).withColumn("x", ar.extract_document(page()))
    return doc.select("page_id", "x.title", F.md5("x.text").alias("text_md5"))


# The paragraphs of a page, each once, are its body if they say enough.
BODY_SQL = f"""h1_v AS MATERIALIZED (SELECT page_id, {plain_sql("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS h1, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS language FROM pages),
body_v AS MATERIALIZED (
  SELECT page_id, h1, language, CASE WHEN length(t) >= 45 THEN t ELSE '' END AS body
  FROM h1_v LEFT JOIN (SELECT page_id, string_agg(p, chr(10) ORDER BY first_at) AS t FROM (SELECT page_id, p, min(pos) AS first_at FROM paragraphs_v WHERE p <> '' GROUP BY ALL) GROUP BY 1) USING (page_id))"""
ARTICLE_COLUMNS = ("page_id", "title", "text_md5", "published", "updated", "date_precision", "language", "access_status", "evidence_level")


def article_columns(found):
    return found.withColumn("text_md5", F.md5("text")).select(*ARTICLE_COLUMNS)


@query("extract_articles", v.with_views(PIECES, BODY_SQL) + """
SELECT page_id, h1 AS title, md5(coalesce(body, '')) AS text_md5, '' AS published, '' AS updated, 'missing' AS date_precision, language,
  CASE WHEN body <> '' THEN 'readable' WHEN h1 <> '' THEN 'metadata_only' ELSE 'unavailable' END AS access_status,
  CASE WHEN body <> '' THEN 'public_article_body' WHEN h1 <> '' THEN 'public_metadata_only' ELSE 'unavailable' END AS evidence_level
FROM body_v""")
def extract_articles(spark, d):
    return article_columns(ar.extract_articles(pages(spark, d)))


def published_pages(spark, d):
    """The pages, six kinds in turn: plain, with structured data, with a time and a share box, behind a wall, with a marked body next to an aside, in a main element."""
    kind = F.col("page_id") % 6
    number = F.col("page_id").cast("string")
    with_head = lambda text: F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), text))
    in_article = lambda text: F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), text))
    as_element = lambda start, end: F.replace(F.replace("html", F.lit("<article>"), F.lit(start)), F.lit("</article>"), F.lit(end))
    structured = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["Thing","https://schema.org/NewsArticle"],"headline":"Story '), number,
                          F.lit('","datePublished":"2026-09-24T10:00:00+09:00"}]}</script>'))
    box = '<time datetime="2024-05-05">5 May</time><div class="share-box"><p>Share this story with all of your friends and colleagues today</p></div><ul><li><a href="/x">A linked story that is not part of it</a></li></ul>'
    wall = F.concat(F.lit('<meta name="description" content="About page '), number, F.lit('"><meta content="2026-09-24T01:00:00Z" property="article:modified_time">'))
    html = (F.when(kind == 1, with_head(structured)).when(kind == 2, in_article(F.lit(box)))
            .when(kind == 3, F.replace(with_head(wall), F.lit("<article>"), F.lit("<article data-access='premium'>")))
            .when(kind == 4, as_element('<aside><p>Elsewhere on this site there is much more to read</p></aside><div itemprop="articleBody">', "</div>"))
            .when(kind == 5, as_element("<main><p hidden>This paragraph is never shown to anybody who reads the page</p>", "</main>")).otherwise(F.col("html")))
    return pages(spark, d).withColumn("html", html)


@query("article_evidence", v.with_views(PIECES, BODY_SQL) + """
SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'Story ' || page_id ELSE h1 END AS title,
  md5(CASE page_id % 6 WHEN 3 THEN 'About page ' || page_id ELSE coalesce(body, '') END) AS text_md5,
  CASE page_id % 6 WHEN 1 THEN '2026-09-24T10:00:00+09:00' WHEN 2 THEN '2024-05-05' ELSE '' END AS published,
  CASE page_id % 6 WHEN 3 THEN '2026-09-24T01:00:00+00:00' ELSE '' END AS updated,
  CASE page_id % 6 WHEN 1 THEN 'time' WHEN 2 THEN 'day' ELSE 'missing' END AS date_precision, language,
  CASE WHEN page_id % 6 = 3 THEN 'restricted' WHEN body <> '' THEN 'readable' WHEN h1 <> '' OR page_id % 6 = 1 THEN 'metadata_only' ELSE 'unavailable' END AS access_status,
  CASE WHEN page_id % 6 = 3 THEN 'public_metadata_only' WHEN body <> '' THEN 'public_article_body' WHEN h1 <> '' OR page_id % 6 = 1 THEN 'public_metadata_only' ELSE 'unavailable' END AS evidence_level
FROM body_v""")
def article_evidence(spark, d):
    return article_columns(ar.extract_articles(published_pages(spark, d)))


@query("page_outline", r"""
SELECT page_id, lower(tag) AS tag, count(*)::BIGINT AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)(<(script|style)[^>]*>).*?</(script|style)\s*>', '\1', 'g'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
GROUP BY ALL""")
def page_outline(spark, d):
    """Elements of every page by name, from the node table."""
    nodes = node_table(pages(spark, d).select("page_id", page_index("html").alias("page")))
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def walled(spark, d):
    """Pages with a wall by class, by structured data or by sentence, or only with a sign-in link."""
    mark = (F.when(F.contains("url", F.lit("?page")), '<div class="story__paywall">Members</div>')
            .when(F.contains("url", F.lit("utm_source")), '<script type="application/ld+json">{"a":[{"@type":"Article","isAccessibleForFree":"False"}]}</script>')
            .when(F.endswith("url", F.lit(".html")), "<p>Please <b>sign in</b> to continue reading</p>").otherwise('<a class="paywall" href="/login">Sign in</a>'))
    return pages(spark, d).withColumn("html", F.replace("html", F.lit("<article>"), F.concat(mark, F.lit("<article>"))))


@query("restricted_pages", "SELECT page_id, contains(url, '?page') OR contains(url, 'utm_source') OR ends_with(url, '.html') AS restricted FROM pages")
def restricted_pages(spark, d):
    return indexed(walled(spark, d)).select("page_id", ar.is_restricted(page(), ar.article_node(page(), "url")).alias("restricted"))


@query("article_access", "SELECT page_id, CASE WHEN contains(url, '?page') OR contains(url, 'utm_source') OR ends_with(url, '.html') THEN 'restricted' ELSE 'open' END AS access FROM pages")
def article_access(spark, d):
    return ar.extract_articles(walled(spark, d)).select("page_id", F.when(F.col("access_status") == "restricted", "restricted").otherwise("open").alias("access"))


@query("login_pages", "SELECT page_id, contains(url, '?page') OR ends_with(url, '/') AS login FROM pages")
def login_pages(spark, d):
    """Pages with a sign-in title, with a password form at a login path, and with the form elsewhere."""
    form = '<form><input type="password"></form>'
    title = F.when(F.contains("url", F.lit("?page")), "Log in | Example").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    url = F.when(F.endswith("url", F.lit("/")), F.concat("url", F.lit("login/"))).otherwise(F.col("url"))
    forms = indexed(pages(spark, d).select("page_id", title.alias("title"), url.alias("url"), F.concat("html", F.lit(form)).alias("html")))
    return forms.select("page_id", ar.is_login_page("title", "url", page()).alias("login"))
