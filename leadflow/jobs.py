"""A collection run: from captured bodies to candidates, audit, reports, selected edition and the next state.

Captured bodies are read once: each kind of source has its reader, and what all of them find is written as one table of items by body.
Leads are scored and matched where their texts are, and only those that pass the gates meet their article. A record is then judged on
what the article says: names, markets, window, topic and outcome are taken after the merge.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.functions.dates import iso, parse_date
from leadflow.functions.text import ordered_union, signature
from leadflow.operators import audit, candidates, coverage, dedupe
from leadflow.operators.matching import match_terms, scoped_watchlist, topic_match, unscoped_sources
from leadflow.operators.triage import event_label, score_texts, with_name_bonus
from leadflow.operators.windows import infer_markets, record_window, with_verdict
from leadflow.rules import DEFAULT_RULES, RuleSet
from leadflow.session import bounded_rows, written_table
from leadflow.sources import markup
from leadflow.sources.articles import extract_articles, extract_document
from leadflow.sources.captures import decode_body
from leadflow.sources.dimensions import inbox_sources, select_watchlist
from leadflow.sources.tree import Page, bound, page_index

EMPTY = "array<string>"
MAX_SOURCES = 5_000  # rows of the source table that may be read on the driver

# Kinds of sources, the tables of the exchange adapters, and the wording of what could not be read.
FEED_KINDS, LINK_KINDS, PRESS_KINDS = ("rss", "atom", "feed"), ("publisher_index", "issuer_index", "html_index"), ("publisher_index", "issuer_index")
OTHER_KINDS = ("exchange_index", "issuer_jsonp", "brave_search", "document")
ADAPTERS = {"asx": "AU", "nzx": "NZ", "tdnet": "JP"}
JSON_ADAPTER = "hkex"
UNKNOWN_KIND, UNKNOWN_ADAPTER = "Unknown source kind", "Unknown exchange adapter"
EXCHANGE_ONLY = "Exchange headline metadata only; read the linked filing or issuer release before drafting."
CHANGING_PAGE = "This link is a changing information page, not a verified individual release. Open it and select the specific document before drafting."
CAP_REACHED = "Article fetch cap reached. Source details have not been checked."
NOT_RETRIEVED = "Article retrieval failed: no captured page of this address"
# Day and month names and digits of date formats as sources state them.
DATE_PARTS = {"%Y": "yyyy", "%m": "M", "%d": "d", "%B": "MMMM", "%b": "MMM", "%H": "H", "%I": "h", "%M": "mm", "%S": "ss", "%p": "a", "%y": "yy"}

ITEM = ("title string, href string, text string, published_raw string, published timestamp, language string, exchange_tickers array<string>, exchange_security_code string, "
        "price_sensitive boolean, snippet string")


@dataclass(frozen=True)
class Run:
    """What a run is asked for: the edition, its rolling start (used where no market window applies), and the rules."""

    edition_date: str
    start: str
    as_of: str
    rules: RuleSet = DEFAULT_RULES
    topic: str = ""
    article_cap: int = audit.ARTICLE_CAP
    max_stories: int = candidates.MAX_STORIES
    row_limit: int = 10_000


def spark_date_format(stated: str) -> str:
    """A date format with percent signs as Spark writes it; other letters are quoted. A format without percent signs is Spark's already."""
    if "%" not in stated:
        return stated
    parts = re.findall(r"%.|[A-Za-z]+|[^A-Za-z%]+", stated)
    unknown = [p for p in parts if p[0] == "%" and p not in DATE_PARTS]
    if unknown:
        raise ValueError(f"date format {stated!r}: {unknown[0]} is not supported")
    return "".join(DATE_PARTS[p] if p[0] == "%" else f"'{p}'" if p.isalpha() else p for p in parts)


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _source_columns(sources: DataFrame) -> DataFrame:
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return sources.filter(F.coalesce("enabled", F.lit(True))).select(
        F.col("id").alias("source_id"), F.lower("kind").alias("kind"), F.col("url").alias("source_url"), F.coalesce("tickers", F.array().cast(EMPTY)).alias("source_tickers"),
        F.coalesce("category", F.lit("")).alias("source_category"), F.coalesce("timezone", F.lit("UTC")).alias("timezone"), F.col("language").alias("source_language"),
        F.coalesce("scope_market", F.lit("")).alias("scope_market"), "allowed_domains", F.coalesce("collection_role", F.lit("priority")).alias("collection_role"), flag("publisher"), flag("issuer_official"),
        flag("discovery_only"), flag("retain_all_leads"), "article_url_pattern", _column(sources, "exchange_adapter").alias("adapter"), _column(sources, "title").alias("source_title"),
        _column(sources, "published").alias("source_published"))


# ---------------------------------------------------------------- bodies


def _items(rows: Column, **named) -> Column:
    """Rows of a reader as items; ``named`` maps item fields to functions of a row."""
    kinds = dict(f.split(" ") for f in ITEM.split(", "))
    return F.transform(rows, lambda r: F.struct(*[(named[n](r) if n in named else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]))


def _layouts(sources: DataFrame) -> tuple[dict[markup.LinkLayout, list[str]], dict[tuple, list[str]]]:
    """The distinct link layouts and widget settings of the sources, with the sources that have them."""
    names = [f"{f.name}_xpath" if f.name != "date_format" else f.name for f in fields(markup.LinkLayout)]
    widget = ("callback", "date_field", "language_field")
    known = sources.select("id", "language", *[_column(sources, n).alias(n) for n in (*names, *widget)], _column(sources, "language_mapping", "map<string,string>").alias("language_mapping"))
    layouts, widgets = {}, {}
    for r in bounded_rows(known, MAX_SOURCES, "the source table"):
        stated = {n.removesuffix("_xpath"): r[n] for n in names if r[n]}
        if "date_format" in stated:
            stated["date_format"] = spark_date_format(stated["date_format"])
        layouts.setdefault(markup.LinkLayout(**stated), []).append(r["id"])
        if r["callback"]:
            setting = (r["callback"], tuple(sorted((r["language_mapping"] or {}).items())), r["language"] or "ja", r["date_field"] or "date", r["language_field"] or "lang")
            widgets.setdefault(setting, []).append(r["id"])
    return layouts, widgets


def read_bodies(captures: DataFrame, sources: DataFrame, day: str = "edition_date") -> DataFrame:
    """One row per captured body: ``source_id, kind, page_url, error, items``. The body is decoded and parsed once, by the reader of its kind.

    An unknown kind or adapter is an error of the body. Listings that state times only take their day from ``day`` of the capture."""
    info = _source_columns(sources)
    layouts, widgets = _layouts(sources.filter(F.coalesce("enabled", F.lit(True))))
    kind, adapter, text, page = F.col("kind"), F.coalesce("adapter", F.lit("")), F.col("_text"), Page.of("_page")
    stamp = F.date_format(F.col(day), "yyyyMMdd") if day in captures.columns else F.lit(None).cast("string")
    bodies = captures.select("source_id", F.col("url").alias("page_url"), decode_body("body", "content_type").alias("_text"), stamp.alias("_day")).join(
        info.select("source_id", "kind", "adapter", "source_title", "source_published"), "source_id")
    of_html = kind.isin(*LINK_KINDS, "document") | ((kind == "exchange_index") & adapter.isin(*ADAPTERS))
    read = bodies.withColumn("_page", page_index(F.when(of_html, text))).withColumn("_feed", F.when(kind.isin(*FEED_KINDS), markup.parsed_feed(text)))

    def result(error: Column, items: Column) -> Column:
        return F.struct(error.cast("string").alias("error"), items.alias("items"))

    get = lambda name: lambda r: r[name]
    none = F.lit(None).cast("string")
    same = lambda *names: {n: get(n) for n in names}
    found = F.when(kind.isin(*FEED_KINDS), result(markup.feed_error(text, F.col("_feed")), _items(markup.feed_items(F.col("_feed")), href=get("link"), **same("title", "text", "published_raw"))))
    for layout, ids in layouts.items():
        found = found.when(kind.isin(*LINK_KINDS) & F.col("source_id").isin(*ids), result(none, _items(markup.link_items(page, layout), **same("title", "href", "published_raw"))))
    for name, market in ADAPTERS.items():
        layout = markup.LAYOUTS[market]
        rows = lambda r: r
        listed = bound(markup.listing_rows(page, layout, F.col("_day")), lambda rows: result(markup.listing_error(rows, layout, F.array_join(page.texts, " ")), _items(  # noqa: B023
            rows, exchange_tickers=get("codes"), exchange_security_code=get("code"), price_sensitive=get("flag"), **same("title", "href", "published"))))
        found = found.when((kind == "exchange_index") & (adapter == name), listed)
    found = found.when((kind == "exchange_index") & (adapter == JSON_ADAPTER), bound(markup.json_rows(text), lambda x: result(x["error"], _items(x["rows"], exchange_tickers=get("codes"), **same("title", "href", "published")))))
    for (callback, languages, language, dated, spoken), ids in widgets.items():
        found = found.when((kind == "issuer_jsonp") & F.col("source_id").isin(*ids), bound(markup.jsonp_rows(text, callback, dict(languages), language, dated, spoken), lambda x: result(
            x["error"], _items(x["rows"], **same("title", "href", "published_raw", "language")))))
    found = found.when(kind == "brave_search", bound(markup.search_rows(text), lambda x: result(x["error"], _items(x["rows"], **same("title", "href", "snippet")))))
    stated = lambda own, of_page: F.coalesce(F.nullif(own, F.lit("")), of_page)
    document = bound(extract_document(page), lambda x: _items(F.array(x), title=lambda r: stated(F.col("source_title"), r["title"]), href=lambda r: F.col("page_url"), text=get("text"),
                                                              published_raw=lambda r: stated(F.col("source_published"), r["published"])))
    found = found.when(kind == "document", result(none, document))
    unknown = F.when(kind == "exchange_index", UNKNOWN_ADAPTER).when(kind == "issuer_jsonp", "the source names no callback").otherwise(UNKNOWN_KIND)
    found = found.otherwise(result(unknown, F.array().cast(f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in ITEM.split(', '))}>>")))
    return read.select("source_id", "kind", "page_url", found.alias("x")).select("source_id", "kind", "page_url", "x.error", "x.items")


def _merged_filings(leads: DataFrame) -> DataFrame:
    """Leads in which a filing that an exchange lists against several securities is one row, the first, with every code."""
    listed = leads.filter("kind = 'exchange_index'").withColumn("_key", F.concat_ws("\u0001", "source_id", "url"))
    merged = coverage.merge_listings(listed.select(F.col("_key").alias("url"), F.col("lead_seq").alias("seq"), "title", F.col("exchange_tickers").alias("codes"))).select(
        F.col("url").alias("_key"), F.col("title").alias("_title"), F.col("codes").alias("_codes"))
    first = listed.groupBy("_key").agg(F.min("lead_seq").alias("lead_seq"))
    filings = listed.join(first, ["_key", "lead_seq"]).join(merged, "_key").withColumns({"title": F.col("_title"), "exchange_tickers": F.col("_codes")})
    return leads.filter("kind <> 'exchange_index'").unionByName(filings.select(*leads.columns))


def collect_leads(captures: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(leads, rejects, totals) of the captured bodies (source_id, url, content_type, body) of the enabled sources.

    Dates without a zone are read in the zone of their source; ``lead_seq`` numbers the leads as they are written. The totals are counted
    while the bodies are written."""
    info = _source_columns(sources)
    seen = Observation(f"bodies-{uuid4().hex}")
    bodies = written_table(read_bodies(captures, sources).observe(seen, F.count(F.lit(1)).alias("bodies"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("items"))), F.lit(0)).alias("items"),
                                                                  F.count_if(F.col("error").isNotNull()).alias("unreadable")), "bodies")
    each = bodies.filter("error IS NULL").select("source_id", "kind", "page_url", F.posexplode("items").alias("pos", "i"))
    rest = each.filter(~F.col("kind").isin(*LINK_KINDS)).join(info.select("source_id", "allowed_domains"), "source_id")
    # A search result counts only inside the domains of its source.
    url = F.when(F.col("kind") == "brave_search", F.nullif(urls.allowed_url("i.href", "allowed_domains"), F.lit(""))).otherwise(urls.resolve("page_url", "i.href"))
    rest = rest.withColumn("url", url).filter("url IS NOT NULL AND coalesce(i.href, '') <> ''").select("source_id", "kind", "page_url", "pos", "url", *[f"i.{n}" for n in (f.split(" ")[0] for f in ITEM.split(", ")) if n != "href"])
    links = each.filter(F.col("kind").isin(*LINK_KINDS)).join(info.select("source_id", "allowed_domains"), "source_id").select(
        "source_id", "page_url", F.when(F.col("kind").isin(*PRESS_KINDS), F.coalesce("allowed_domains", F.array().cast(EMPTY))).otherwise(F.array().cast(EMPTY)).alias("_domains"), "pos", "i.href", "i.title", "i.published_raw")
    admitted = markup.admitted_links(links, same_host=False)
    every = rest.unionByName(admitted.join(info.select("source_id", "kind"), "source_id"), allowMissingColumns=True)
    # Numbers follow the order of a source's pages and of the items on them.
    placed = every.repartitionByRange("source_id", "page_url", "pos").sortWithinPartitions("source_id", "page_url", "pos")
    numbered = _merged_filings(written_table(placed.withColumn("lead_seq", F.monotonically_increasing_id()), "leads"))
    # Articles and state know a document by its canonical address; the link stays as evidence.
    numbered = numbered.withColumn("link", F.col("url")).withColumn("url", urls.canonical_url("url")).withColumnRenamed("published", "_at")
    dated = numbered.join(info.drop("kind", "adapter", "source_title", "source_published"), "source_id").withColumn("d", parse_date("published_raw", F.col("timezone")))
    leads = dated.select("*", F.coalesce("_at", "d.ts").alias("published"), F.when(F.col("_at").isNotNull(), "time").otherwise(F.col("d.precision")).alias("date_precision")).withColumn(
        "language", F.coalesce(F.nullif("language", F.lit("")), "source_language")).withColumn("text", F.coalesce("text", F.lit(""))).drop("d", "_at", "published_raw", "pos", "page_url")
    bare = (bodies.filter("error IS NULL").filter(F.col("kind").isin(*LINK_KINDS)).select("source_id", F.col("page_url").alias("url"))
            .join(numbered.select("source_id", F.col("page_url").alias("url")).distinct(), ["source_id", "url"], "left_anti").withColumn("error", F.lit(markup.NO_LINKS)))
    kinds = (*FEED_KINDS, *LINK_KINDS, *OTHER_KINDS)
    unread = info.filter(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).select("source_id", F.col("source_url").alias("url"), F.lit(UNKNOWN_KIND).alias("error"))
    rejects = bodies.filter("error IS NOT NULL").select("source_id", F.col("page_url").alias("url"), "error").unionByName(bare).unionByName(unread).distinct()
    return leads, rejects, seen.get


# ---------------------------------------------------------------- scope


@dataclass(frozen=True)
class Scope:
    """Which companies a source may speak about: pairs of sources with a scope of their own, and sources open to all."""

    pairs: DataFrame
    open_sources: DataFrame

    @classmethod
    def of(cls, sources: DataFrame, watchlist: DataFrame) -> Scope:
        asked = sources.withColumn("exchange_index", F.coalesce(F.lower("kind") == "exchange_index", F.lit(False))).withColumn("issuer_official", F.coalesce("issuer_official", F.lit(False)))
        return cls(written_table(scoped_watchlist(asked, watchlist).distinct(), "scope"), unscoped_sources(asked))

    def within(self, names: DataFrame) -> DataFrame:
        """(source_id, ..., ticker) rows that the source may speak about."""
        scoped = names.join(self.open_sources, "source_id", "left_anti").join(self.pairs, ["source_id", "ticker"], "left_semi")
        return names.join(self.open_sources, "source_id", "left_semi").unionByName(scoped.select(*names.columns))


def _named(rows: DataFrame, watchlist: DataFrame, scope: Scope, out: str, text: Column | None = None) -> DataFrame:
    """(lead_seq, ``out``): the companies of the source's scope that a row names."""
    found = match_terms(rows, watchlist, text).join(rows.select("lead_seq", "source_id"), "lead_seq")
    return scope.within(found.select("source_id", "lead_seq", "ticker")).groupBy("lead_seq").agg(F.array_sort(F.collect_list("ticker")).alias(out))


def score_leads(leads: DataFrame, watchlist: DataFrame, windows: DataFrame, run: Run, scope: Scope) -> DataFrame:
    """Leads without their texts: names, score, and the window and verdict of what the lead itself says."""
    names = _named(leads, watchlist, scope, "tickers", F.concat_ws(" ", "title", "text", "snippet"))
    scored = score_texts(leads, run.rules).drop("text")
    named = scored.join(names, "lead_seq", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast(EMPTY)))
    none = F.lit(None).cast(EMPTY)
    official = F.col("issuer_official") | (F.col("kind") == "exchange_index")
    timed = with_name_bonus(named).withColumn("timing_markets", infer_markets(F.lit(None).cast("string"), "exchange_tickers", none, "tickers", "source_tickers", official, "scope_market"))
    return with_verdict(record_window(timed, windows, run.start), run.as_of).drop("applied_window_start", "timing_resolved", "applied_inclusive", "inactive_markets", "timing_markets")


# ---------------------------------------------------------------- records


def _articles(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest captured page of every address that is wanted; of several at one time that with the greatest hash."""
    known = pages.withColumn("url", urls.canonical_url("url")).join(wanted.select("url").distinct(), "url", "left_semi")
    order = F.struct(_column(known, "captured_at", "timestamp"), F.sha2("body", 256))
    last = known.groupBy("url").agg(F.max_by(F.struct("content_type", "body"), order).alias("p"))
    return last.select("url", decode_body("p.body", "p.content_type").alias("html"))


def _merged(kept: DataFrame, articles: DataFrame) -> DataFrame:
    """Records: what the article says where it was checked, else what the lead says, and why the article is missing."""
    a = articles.select("url", *[F.col(c).alias(f"_{c}") for c in ("title", "text", "published", "language", "access_status", "evidence_level")])
    joined = kept.join(a, "url", "left")
    stage = F.col("stage")
    checked, lost, direct = stage == "article_checked", stage == "article_unavailable", stage == "record_read"
    said = lambda name: F.when(checked, F.nullif(F.coalesce(f"_{name}", F.lit("")), F.lit("")))
    own = F.when(F.col("publisher"), "metadata_only").otherwise("readable")
    dated = bound(F.when(said("published").isNotNull(), parse_date("_published", F.col("timezone"))), lambda d: F.when(d.isNotNull(), F.struct(d["ts"].alias("ts"), d["precision"].alias("precision"), F.lit("article").alias("origin")))
                  .otherwise(F.struct(F.col("published").alias("ts"), F.col("date_precision").alias("precision"), F.when(F.col("date_precision") == "missing", "unknown").otherwise(F.col("kind")).alias("origin"))))
    error = (F.when(stage == "document_review_pending", EXCHANGE_ONLY).when(stage == "candidate_selected", CHANGING_PAGE).when(stage == "article_cap_pending", CAP_REACHED).when(lost, NOT_RETRIEVED).otherwise(""))
    evidence = (F.when(checked, F.col("_evidence_level")).when(stage == "document_review_pending", "exchange_index").when(stage == "candidate_selected", "index_lead").when(direct, "source_record").otherwise("discovery_lead"))
    out = joined.withColumn("_d", dated).withColumns({
        "discovery_title": F.col("title"), "discovery_snippet": F.when(checked, F.coalesce(F.nullif("snippet", F.lit("")), "text")).otherwise(F.col("snippet")),
        "article_error": error, "evidence_level": evidence, "access": F.when(checked, F.col("_access_status")).when(lost, "unavailable").when(direct, own).otherwise("metadata_only")})
    out = out.withColumns({"title": F.coalesce(said("title"), "title"), "text": F.when(checked, F.coalesce("_text", F.lit(""))).when(lost | (stage == "candidate_selected"), "").otherwise(F.col("text")),
                           "language": F.coalesce(said("language"), "language"), "access_status": F.col("access"),
                           "published": F.col("_d.ts"), "date_precision": F.col("_d.precision"), "date_origin": F.col("_d.origin")})
    return out.drop("access", "_d", *[c for c in a.columns if c != "url"])


def judge(merged: DataFrame, watchlist: DataFrame, windows: DataFrame, state: DataFrame, run: Run, scope: Scope) -> DataFrame:
    """Records with outcome, flags and eligibility, judged on their merged title, text and date."""
    matched = _named(merged, watchlist, scope, "matched")
    merged = merged.join(matched, "lead_seq", "left").withColumn("matched", F.coalesce("matched", F.array().cast(EMPTY)))
    # What the source is fixed to counts where it is on the list, next to what lead and article name.
    fixed = scope.within(merged.select("source_id", F.explode("source_tickers").alias("ticker")).distinct()).join(watchlist.select("ticker"), "ticker", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list("ticker")).alias("active_source"))
    merged = merged.join(fixed, "source_id", "left").withColumn("discovery_matches", F.col("tickers"))
    merged = merged.withColumn("tickers", ordered_union(F.array_intersect("source_tickers", F.coalesce("active_source", F.array().cast(EMPTY))), "discovery_matches", "matched"))
    checked = F.col("stage") == "article_checked"
    merged = merged.withColumn("discovery_only_tickers", F.when(checked, candidates.discovery_only_tickers("discovery_matches", "matched", "source_tickers")).otherwise(F.array().cast(EMPTY)))
    none = F.lit(None).cast(EMPTY)
    official = F.col("issuer_official") | (F.col("kind") == "exchange_index")
    merged = merged.withColumn("timing_markets", infer_markets(F.lit(None).cast("string"), "exchange_tickers", none, "matched", "source_tickers", official, "scope_market"))
    merged = with_verdict(record_window(merged, windows, run.start), run.as_of)
    words = F.concat_ws(" ", "title", "text")
    merged = merged.withColumn("topic", topic_match(run.topic, words, F.concat_ws(" ", "discovery_title", "discovery_snippet")))
    merged = merged.withColumn("event_type", F.when(F.col("broad"), F.col("event_type")).otherwise(event_label(words)))
    merged = merged.withColumn("publisher", F.col("broad") | F.col("publisher") | F.col("issuer_official") | (F.col("kind") == "brave_search"))
    first = watchlist.select(F.col("ticker").alias("first_ticker"), F.col("category").alias("first_category"))
    merged = merged.withColumn("first_ticker", F.try_element_at("matched", F.lit(1))).join(first, "first_ticker", "left")
    merged = merged.withColumn("category", candidates.category(F.when(F.col("broad"), F.col("category")), "source_category", "first_category"))
    merged = candidates.with_identity(merged).withColumn("signature", signature("title", "text")).withColumn("readable", F.col("access_status") == "readable")
    judged = candidates.classify(candidates.change_status(merged, state, run.edition_date))
    return candidates.older_duplicates(judged.withColumn("eligible", candidates.is_eligible()).withColumn("flags", candidates.flags()), state, run.edition_date).drop("active_source", "first_ticker", "first_category")


def collect_run(captures: DataFrame, pages: DataFrame, sources: DataFrame, watchlist: DataFrame, windows: DataFrame, state: DataFrame, run: Run,
                requested: DataFrame | None = None, inbox: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of one run: ``rejects``, ``audit``, ``exclusions``, ``reports``, ``outcomes``, ``candidates``, ``also_reported``, ``edition``, ``items``, ``state``
    and ``totals``.

    ``captures`` are the bodies of the sources (source_id, url, content_type, body and, for listings, edition_date), ``pages`` the captured articles
    (url, content_type, body, captured_at if there are several of an address), ``windows`` those of the edition,
    ``state`` the documents of earlier editions, ``inbox`` announcements supplied by the user, whose bodies are captures of ``inbox-<seq>``. Nothing is
    written but intermediate tables in the shared folder: ``sinks`` holds the writers."""
    watchlist = select_watchlist(watchlist, requested, targeted=requested is not None)
    if inbox is not None:
        sources = sources.unionByName(inbox_sources(inbox), allowMissingColumns=True)
    scope = Scope.of(sources, watchlist)
    market = F.coalesce("collection_role", F.lit("priority")) == "market"
    heard = scope.pairs.select("source_id").unionByName(scope.open_sources).distinct()
    open_to_some = sources.join(heard.withColumnRenamed("source_id", "id"), "id", "left_semi").select("id") if not watchlist.isEmpty() else sources.limit(0).select("id")
    asked = sources.join(open_to_some.withColumn("_heard", F.lit(True)), "id", "left").withColumn("applicable", market | F.coalesce("_heard", F.lit(False))).drop("_heard")
    leads, rejects, totals = collect_leads(captures, asked.filter("applicable"))
    leads = leads.withColumn("broad", F.col("collection_role") == "market").withColumn("expands", F.col("publisher") | F.col("issuer_official") | F.col("broad") | (F.col("kind") == "brave_search"))
    official = scope.within(sources.select(F.col("id").alias("source_id"), F.explode("tickers").alias("ticker"))).join(watchlist.select("ticker"), "ticker", "left_semi").select("source_id").distinct().withColumn("_fixed", F.lit(True))
    scored = score_leads(leads, watchlist, windows, run, scope).join(official, "source_id", "left").withColumn("fixed_issuer", F.col("issuer_official") & F.coalesce("_fixed", F.lit(False))).drop("_fixed")
    scored = written_table(scored, "scored")
    wanted = audit.early_stage(scored.filter("expands")).filter("reaches_cap")
    indexed = scored.filter("NOT expands AND kind = 'html_index'")
    html = written_table(_articles(pages, wanted.select("url").unionByName(indexed.select("url"))), "pages")
    articles = extract_articles(html.join(wanted.select("url").distinct(), "url", "left_semi"))
    generic = html.join(indexed.select("url").distinct(), "url", "left_semi").withColumn("_page", page_index("html")).withColumn("_x", extract_document(Page.of("_page"))).select(
        "url", "_x.title", "_x.text", "_x.published", F.lit("").alias("language"), F.lit("readable").alias("access_status"), F.lit("public_document").alias("evidence_level"))
    kinds = ("url", "title", "text", "published", "language", "access_status", "evidence_level")
    articles, generic = written_table(articles.select(*kinds), "articles"), written_table(generic, "documents")

    # Priority index pages are screened by headline, and as many of their documents are read as of any source.
    screened = indexed.withColumn("stage", F.when((F.size("source_tickers") == 0) & (F.size("tickers") == 0), "index_title_no_match").otherwise("article_pending")).withColumn("reaches_cap", F.col("stage") == "article_pending")
    plain = scored.filter("NOT expands AND kind <> 'html_index'").withColumn("stage", F.lit("record_read")).withColumn("access_status", F.lit(None).cast("string"))
    capped = audit.apply_article_cap(screened.withColumn("attention_score", F.lit(0)), "reaches_cap", run.article_cap).join(generic.select("url", F.lit(True).alias("_got")), "url", "left")
    read = capped.withColumn("stage", F.when(F.col("stage") != "article_pending", F.col("stage")).when(~F.col("within_cap"), "article_cap_pending").when(F.col("_got"), "article_checked").otherwise("article_unavailable"))
    read = read.withColumn("access_status", F.when(F.col("stage") == "article_checked", "readable").when(F.col("stage") == "article_unavailable", "unavailable")).drop("reaches_cap", "within_cap", "_got")
    broad = audit.headline_audit(scored.filter("expands"), articles, run.article_cap)
    audited = broad.unionByName(plain.select(*broad.columns)).unionByName(read.select(*broad.columns))
    stages = Observation(f"stages-{uuid4().hex}")
    names = ("article_checked", "article_unavailable", "article_cap_pending", "candidate_selected", "document_review_pending", "record_read", "outside_window", "below_attention_threshold", "outside_source_domains",
             "discovery_no_name_match", "index_title_no_match")
    audited = written_table(audited.observe(stages, F.count(F.lit(1)).alias("leads"), *[F.count_if(F.col("stage") == n).alias(n) for n in names]), "audit")

    prepared = audited.filter(F.col("stage").isin("article_checked", "article_unavailable", "article_cap_pending", "candidate_selected", "document_review_pending", "record_read")).drop("access_status", "window_status")
    kept = prepared.join(leads.select("lead_seq", "text"), "lead_seq")
    both = articles.unionByName(generic.join(articles.select("url"), "url", "left_anti"))
    merged = written_table(_merged(kept, both), "records")
    judged = written_table(judge(merged, watchlist, windows, state, run, scope), "judged").withColumn("seq", F.col("lead_seq") + F.when(F.col("broad"), 0).otherwise(F.lit(1 << 62)))
    found, copies = dedupe.dedupe_candidates(judged.filter("kept"))
    found = written_table(found, "candidates")
    edition = candidates.select_edition(found.select("lead_seq", "attention_score", "event_type", "change", "eligible", "tickers"), run.max_stories)

    narrow = audited.select("lead_seq", "source_id", "link", "url", "stage", "access_status", "window_status", "attention_score", "attention_reasons", "tickers")
    outcomes = judged.select("lead_seq", "source_id", "outcome", "kept")
    stage, access = F.col("stage"), F.col("access_status")
    seen = audited.join(outcomes.select("lead_seq", F.col("kept").alias("matched")), "lead_seq", "left").select(
        "source_id", F.coalesce("matched", F.lit(False)).alias("matched"), stage.isin("article_checked", "article_unavailable").alias("attempted"), F.lit(False).alias("error"),
        ((stage == "candidate_selected") | stage.isin("article_unavailable", "article_cap_pending", "outside_source_domains") | (stage.isin("article_checked") & (access != "readable"))).alias("limited"), "link")
    failed = rejects.select("source_id", F.lit(False).alias("matched"), F.lit(False).alias("attempted"), F.lit(True).alias("error"), F.lit(False).alias("limited"), F.col("url").alias("link"))
    listed = asked.select(F.col("id").alias("source_id"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "applicable", F.lit(run.row_limit).alias("row_limit"))
    excluded = narrow.select("source_id", "stage").filter(~stage.isin(*names[:6])).unionByName(outcomes.filter("NOT kept").select("source_id", F.col("outcome").alias("stage")))
    counted = totals | stages.get
    return {"rejects": rejects, "audit": narrow, "exclusions": coverage.exclusion_counts(excluded), "reports": coverage.source_reports(seen.unionByName(failed), listed), "outcomes": outcomes,
            "candidates": found, "also_reported": copies, "edition": edition, "items": candidates.export_items(found), "state": candidates.upsert_state(state, found, run.edition_date),
            "totals": captures.sparkSession.createDataFrame(sorted((k, int(n)) for k, n in counted.items()), "name string, n long")}
