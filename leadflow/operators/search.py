"""Search discovery: query texts, result rows, hit merging and the search report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.functions.text import _col, clean, unescape

# Limits of a query and of the stored result fields.
MAX_TERMS, MAX_QUERY_CHARS, MAX_QUERY_WORDS, MAX_TERM_CHARS = 4, 600, 75, 100
TITLE_CHARS, SNIPPET_CHARS, DATE_CHARS = 500, 600, 120
DEFAULT_QUERIES = 6


def plain(value, limit: int) -> Column:
    """Text without tags and entities, collapsed and cut to ``limit`` characters."""
    return F.substring(clean(unescape(F.regexp_replace(F.coalesce(_col(value), F.lit("")), "<[^>]*>", " "))), 1, limit)


def company_queries(watchlist: DataFrame, domains: list[str]) -> DataFrame:
    """Add ``query``: at most MAX_TERMS distinct quoted names and the site list. Trailing names are
    left out until the query fits; null when even one name does not fit."""
    raw = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    if "search_terms" in watchlist.columns:
        raw = F.when(F.size("search_terms") > 0, F.col("search_terms")).otherwise(raw)
    quoted = F.transform(raw, lambda t: clean(F.translate(plain(t, MAX_TERM_CHARS), '"\\', "  ")))
    # First spelling of each name, compared without case.
    folded = F.transform(quoted, lambda t: F.lower(t))
    distinct = F.filter(quoted, lambda t, i: (t != "") & (F.array_position(folded, F.lower(t)) == i + 1))
    sites = "(" + " OR ".join("site:" + d for d in domains) + ")"
    tries = F.transform(
        F.sequence(F.least(F.lit(MAX_TERMS), F.size("_terms")), F.lit(1), F.lit(-1)),
        lambda n: F.concat(F.lit('("'), F.array_join(F.slice("_terms", F.lit(1), n), '" OR "'), F.lit('") AND ' + sites)))
    fits = F.filter(tries, lambda q: (F.char_length(q) <= MAX_QUERY_CHARS) & (F.size(F.split(q, " ")) <= MAX_QUERY_WORDS))
    return (watchlist.withColumn("_terms", distinct)
            .withColumn("query", F.when(F.size("_terms") > 0, F.try_element_at(fits, F.lit(1)))).drop("_terms"))


def normalize_results(results: DataFrame, domains) -> DataFrame:
    """Search rows as leads; ``url`` is empty where the address is not allowed."""
    return results.select(
        *[c for c in results.columns if c not in ("url", "title", "description", "age")],
        urls.allowed_url("url", domains).alias("url"), plain("title", TITLE_CHARS).alias("title"),
        plain("description", SNIPPET_CHARS).alias("discovery_snippet"), plain("age", DATE_CHARS).alias("discovery_date_hint"))


def merge_hits(hits: DataFrame, value_cols: list[str]) -> DataFrame:
    """One row per address: the first hit's fields and every company that found it.

    Companies per address are first reduced to one row each, so a popular address never gathers
    its repeated hits in one task."""
    per_company = hits.groupBy("url", "ticker").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*value_cols), "seq").alias("first"), F.count("*").alias("n"))
    ranked = per_company.groupBy("url").agg(
        F.min_by("first", "seq").alias("first"), F.sum("n").alias("hits"),
        F.array_sort(F.collect_list(F.struct("seq", "ticker"))).alias("found"))
    return ranked.select("url", "first.*", "hits", F.transform("found", lambda x: x["ticker"]).alias("discovered_for"))


def search_report(targets: DataFrame, attempts: DataFrame, max_queries: int = DEFAULT_QUERIES) -> DataFrame:
    """Per company: queried, successful, failed or unsearched.

    ``targets`` holds (ticker, seq); ``attempts`` holds (ticker, ok, capped)."""
    done = attempts.groupBy("ticker").agg(F.bool_or("ok").alias("ok"), F.bool_or("capped").alias("capped"))
    return targets.join(done, "ticker", "left").withColumn(
        "outcome", F.when(F.col("ok").isNull(), "unsearched").when(F.col("ok"), "successful").otherwise("failed"))


def search_status(per_ticker: DataFrame) -> DataFrame:
    """Totals and status of one search run."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    totals = per_ticker.agg(n("successful").alias("successful"), n("failed").alias("failed"), n("unsearched").alias("unsearched"),
                            F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"))
    truncated = F.col("capped") | (F.col("unsearched") > 0)
    return totals.select(
        "successful", "failed", "unsearched", truncated.alias("truncated"),
        F.when((F.col("failed") > 0) & (F.col("successful") == 0), "failed")
        .when((F.col("failed") > 0) | truncated, "partial").otherwise("ok").alias("status"))
