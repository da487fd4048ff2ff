"""Coverage: what each source returned and what that says about each company.

Companies meet sources on a ticker or a market. Sources without any scope apply to everybody, so they
are counted once and added to each company instead of being paired with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.dates import window_days
from leadflow.functions.text import _col
from leadflow.operators.windows import market_code, ticker_market

EMPTY = "array<string>"

# Display words of a scan status, and the three results of a company.
STATUS_LABELS = {"ok": "checked", "partial": "partly checked", "failed": "failed", "disabled": "disabled",
                 "not_configured": "not configured", "not_applicable": "outside this run"}
UNKNOWN_LABEL = "not checked"
NEED_REVIEW, NO_NEW_ITEMS, INCOMPLETE = "candidates_need_review", "no_new_items_in_checked_sources", "coverage_incomplete"


def _list(name) -> Column:
    return F.coalesce(_col(name), F.array().cast(EMPTY))


def exclusion_counts(audit: DataFrame, outcome: str = "stage") -> DataFrame:
    """Per source: outcome -> rows. There are only a few outcomes, so the map is small."""
    counts = audit.groupBy("source_id", outcome).agg(F.count("*").alias("n"))
    return counts.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(outcome), "n")))).alias("excluded"))


def source_status(enabled, applicable, failed, errors, access_limited, unsearched, truncated) -> Column:
    """disabled, not_applicable, failed, partial or ok; ok needs a scan without any limit."""
    c = [_col(x) for x in (enabled, applicable, failed, errors, access_limited, unsearched, truncated)]
    return (F.when(~c[0], "disabled").when(~c[1], "not_applicable").when(c[2], "failed")
            .when((c[3] > 0) | (c[4] > 0) | (c[5] > 0) | c[6], "partial").otherwise("ok"))


def source_reports(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """One report per source, also for sources that returned nothing.

    ``fetches`` holds (source_id, matched, attempted, error, limited, link); ``sources`` holds (source_id,
    enabled, applicable, row_limit)."""
    seen = fetches.groupBy("source_id").agg(
        F.count("*").alias("discovered"), F.count_if("matched").alias("matched"), F.count_if("attempted").alias("articles_attempted"),
        F.count_if("error").alias("errors"), F.count_if("limited").alias("access_limited"), F.count_distinct("link").alias("index_links"))
    df = sources.join(seen, "source_id", "left")
    for name in ("discovered", "matched", "articles_attempted", "errors", "access_limited", "index_links"):
        df = df.withColumn(name, F.when(F.col("enabled") & F.col("applicable"), F.coalesce(name, F.lit(0))).otherwise(0).cast("long"))
    df = df.withColumn("truncated", F.col("discovered") > F.col("row_limit"))
    failed = (F.col("discovered") > 0) & (F.col("errors") == F.col("discovered"))
    return df.withColumn("status", source_status("enabled", "applicable", failed, "errors", "access_limited", F.lit(0), "truncated"))


def day_coverage(sources: DataFrame, leads: DataFrame, totals: DataFrame, start, as_of, tz: str) -> DataFrame:
    """(source_id, day, headlines, total, complete) for every day of the window; a day without a stated
    total is incomplete and never an empty success."""
    days = sources.select("source_id", F.explode(window_days(start, as_of, tz)).alias("day"))
    day = F.to_date(F.from_utc_timestamp("published", tz))
    got = leads.groupBy("source_id", day.alias("day")).agg(F.count("*").alias("headlines"))
    df = days.join(got, ["source_id", "day"], "left").join(totals, ["source_id", "day"], "left")
    df = df.withColumn("headlines", F.coalesce("headlines", F.lit(0)).cast("long"))
    return df.withColumn("complete", F.coalesce(F.col("headlines") >= F.col("total"), F.lit(False)))


def snapshot_stats(leads: DataFrame, window_start, tz: str) -> DataFrame:
    """Days a current list covers, its oldest headline, and whether it stops short of the window."""
    day = F.date_format(F.from_utc_timestamp("published", tz), "yyyy-MM-dd")
    days = leads.groupBy("source_id", day.alias("day")).agg(F.min("published").alias("oldest"))
    return days.groupBy("source_id").agg(F.array_sort(F.collect_list("day")).alias("snapshot_dates"), F.min("oldest").alias("oldest_headline")).withColumn(
        "truncated", F.col("oldest_headline") > (window_start if isinstance(window_start, Column) else F.lit(window_start).cast("timestamp")))


def candidates_by_company(watchlist: DataFrame, cands: DataFrame) -> DataFrame:
    """Per company, also those without any: candidates, ready and held."""
    counted = (cands.select(F.explode("tickers").alias("ticker"), "eligible").groupBy("ticker")
               .agg(F.count("*").alias("candidates"), F.count_if("eligible").alias("ready")))
    df = watchlist.select("ticker").join(counted, "ticker", "left")
    df = df.withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("long")).withColumn("ready", F.coalesce("ready", F.lit(0)).cast("long"))
    return df.withColumn("held", F.col("candidates") - F.col("ready"))


def coverage_by_company(watchlist: DataFrame, reports: DataFrame) -> DataFrame:
    """Per company: applicable, checked, ok and partial sources, its direct sources and those connected.

    ``reports`` needs id, status, tickers, scope_tickers (null: not restricted), scope_market,
    issuer_official and successful_tickers (null: all)."""
    firms = watchlist.select("ticker", ticker_market("ticker").alias("_market"))
    done = F.col("status").isin("ok", "partial")
    src = reports.select(
        "id", "status", _list("tickers").alias("tickers"), "scope_tickers", market_code("scope_market").alias("_scope"), "issuer_official",
        "successful_tickers", done.alias("_done"))
    has_list = (F.size("tickers") > 0) | F.col("scope_tickers").isNotNull()
    listed = F.when(F.size("tickers") == 0, F.col("scope_tickers")).when(F.col("scope_tickers").isNull(), F.col("tickers")).otherwise(
        F.array_intersect("tickers", "scope_tickers"))
    same_market = (F.col("_scope") == "") | (F.col("_scope") == F.col("_market"))
    checked = F.col("_done") & F.coalesce(F.array_contains("successful_tickers", F.col("ticker")), F.col("successful_tickers").isNull())
    direct = F.col("issuer_official") & F.array_contains("tickers", F.col("ticker"))
    # What a list says of a company is read where the list is; only (company, source) rows with plain columns meet the companies.
    by_ticker = (src.filter(has_list).withColumn("ticker", F.explode(F.array_distinct(listed))).select("ticker", "status", "_scope", checked.alias("checked"), direct.alias("direct"))
                 .join(firms, "ticker").filter(same_market).select("ticker", "status", F.lit(1).alias("applicable"), "checked", "direct"))
    of_market = src.filter(~has_list & (F.col("_scope") != ""))
    searched = of_market.filter("successful_tickers IS NOT NULL").select("id", F.explode(F.array_distinct("successful_tickers")).alias("ticker"), F.lit(True).alias("_hit"))
    by_market = (of_market.select("id", "status", "_scope", "_done", F.col("successful_tickers").isNull().alias("_all")).join(firms, F.col("_scope") == F.col("_market")).join(searched, ["id", "ticker"], "left")
                 .select("ticker", "status", F.lit(1).alias("applicable"), (F.col("_done") & (F.col("_all") | F.coalesce("_hit", F.lit(False)))).alias("checked"), F.lit(False).alias("direct")))
    pairs = by_ticker.unionByName(by_market)
    # Sources open to all: where only some companies were searched, those are found by ticker.
    open_to_all = src.filter(~has_list & (F.col("_scope") == ""))
    some = (open_to_all.filter("successful_tickers IS NOT NULL AND _done").withColumn("ticker", F.explode(F.array_distinct("successful_tickers")))
            .select("ticker", "status", F.lit(0).alias("applicable"), F.lit(True).alias("checked"), F.lit(False).alias("direct")))
    everyone = open_to_all.agg(
        F.count("*").alias("n"), F.count_if(F.col("_done") & F.col("successful_tickers").isNull()).alias("checked"),
        F.count_if((F.col("status") == "ok") & F.col("successful_tickers").isNull()).alias("ok"),
        F.count_if((F.col("status") == "partial") & F.col("successful_tickers").isNull()).alias("partial")).first()
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STATUS_LABELS.items() for x in p]), F.col("status")), F.lit(UNKNOWN_LABEL))
    labels = sorted({*STATUS_LABELS.values(), UNKNOWN_LABEL})
    per = pairs.unionByName(some).groupBy("ticker").agg(
        F.sum("applicable").alias("applicable"), F.count_if("checked").alias("checked"),
        F.count_if(F.col("checked") & (F.col("status") == "ok")).alias("ok"), F.count_if(F.col("checked") & (F.col("status") == "partial")).alias("partial"),
        F.count_if("direct").alias("direct"), F.count_if(F.col("direct") & F.col("checked")).alias("connected"),
        *[F.bool_or(F.col("direct") & ~F.col("checked") & (label == one)).alias(f"_state{k}") for k, one in enumerate(labels)])
    df = watchlist.select("ticker").join(per, "ticker", "left").withColumn("other_states", F.array_compact(F.array(*[F.when(F.col(f"_state{k}"), one) for k, one in enumerate(labels)])))
    df = df.drop(*[f"_state{k}" for k in range(len(labels))])
    add = {"applicable": everyone["n"], "checked": everyone["checked"], "ok": everyone["ok"], "partial": everyone["partial"], "direct": 0, "connected": 0}
    for name, extra in add.items():
        df = df.withColumn(name, (F.coalesce(name, F.lit(0)) + F.lit(extra)).cast("long"))
    return df


def company_status(watchlist: DataFrame, cands: DataFrame, reports: DataFrame) -> DataFrame:
    """Result of each company; "nothing new" needs a source that finished without limits."""
    df = candidates_by_company(watchlist, cands).join(coverage_by_company(watchlist, reports), "ticker")
    return df.withColumn("status", F.when(F.col("candidates") > 0, NEED_REVIEW).when(F.col("ok") > 0, NO_NEW_ITEMS).otherwise(INCOMPLETE))


# What a draft says of each result.
MESSAGES = {NEED_REVIEW: " relevant candidate(s) found; confirm which facts are new.",
            NO_NEW_ITEMS: "No new relevant items found in the connected sources checked. Coverage is partial.",
            INCOMPLETE: "Collection coverage is insufficient to determine whether there is new information."}


def company_results(watchlist: DataFrame, cands: DataFrame, reports: DataFrame) -> DataFrame:
    """What the draft says of each company: its result, the message, and how many sources finished without limits. The candidates of a company
    are the items that list its ticker."""
    df = company_status(watchlist, cands, reports).join(watchlist.select("ticker", F.col("name").alias("company")), "ticker")
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])[F.col("status")]
    message = F.when(F.col("status") == NEED_REVIEW, F.concat(F.col("candidates").cast("string"), said)).otherwise(said)
    return df.select("ticker", "company", "status", message.alias("message"), F.col("ok").alias("checked_sources"), "candidates")


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))


def company_overview(watchlist: DataFrame, cands: DataFrame, reports: DataFrame) -> DataFrame:
    """Wording per company: direct source state, result of this run and checked sources."""
    df = candidates_by_company(watchlist, cands).join(coverage_by_company(watchlist, reports), "ticker")
    states = F.array_join("other_states", ", ")
    direct = (F.when(F.col("connected") > 0, F.concat(F.lit("Connected ("), F.col("connected").cast("string"), F.lit(")"),
                                                      F.when(F.size("other_states") > 0, F.concat(F.lit("; others "), states)).otherwise("")))
              .when(F.col("direct") > 0, F.concat(F.lit("Direct source "), states)).otherwise("Needs a direct source"))
    counts = F.array_join(F.array_compact(F.array(
        F.when(F.col("ready") > 0, _plural(F.col("ready"), " draft-ready candidate", " draft-ready candidates")),
        F.when(F.col("held") > 0, F.concat(_plural(F.col("held"), " lead", " leads"), F.lit(" to review"))))), "; ")
    result = (F.when(F.col("candidates") > 0, counts).when(F.col("checked") == 0, "No sources checked for this company")
              .when(F.col("connected") == 0, "No matching items in limited general news").otherwise("No matching items in the limited sources checked"))
    checked = F.concat(F.col("checked").cast("string"), F.when(F.col("partial") > 0, F.concat(F.lit(" ("), F.col("partial").cast("string"), F.lit(" partial)"))).otherwise(""))
    return df.withColumn("direct_status", direct).withColumn("result", result).withColumn("checked_label", checked)


def overview_totals(overview: DataFrame) -> DataFrame:
    return overview.agg(F.count("*").alias("tracked"), F.count_if(F.col("ready") > 0).alias("with_ready"),
                        F.count_if(F.col("held") > 0).alias("with_held"), F.count_if(F.col("connected") > 0).alias("with_direct"))


def role(stated, issuer_official) -> Column:
    """Stated role, else priority for official issuers and market for the rest."""
    return F.coalesce(F.nullif(_col(stated), F.lit("")), F.when(_col(issuer_official), "priority").otherwise("market"))


def radar_totals(reports: DataFrame, cands: DataFrame) -> DataFrame:
    """Totals of the market sources and market candidates of a run."""
    market = reports.filter(role("collection_role", "issuer_official") == "market").agg(
        F.coalesce(F.sum("discovered"), F.lit(0)).alias("headlines"), F.coalesce(F.sum("articles_attempted"), F.lit(0)).alias("article_checks"),
        F.count_if(F.col("status").isin("ok", "partial")).alias("checked"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial"))
    found = cands.filter("collection_role = 'market'").agg(
        F.count("*").alias("candidates"), F.count_if(F.size("tickers") == 0).alias("outside_list"))
    # Both sides are one row.
    return market.join(found)


def finite_score(score) -> Column:
    """Score for ordering; a missing or non-finite one counts as zero."""
    value = _col(score).try_cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def merge_listings(rows: DataFrame) -> DataFrame:
    """One row per filing: the first listing, all its codes, and added codes put before the title.

    ``rows`` holds (url, seq, title, codes). Every code is first reduced to its earliest listing, so the
    list per filing is as long as its codes and not as its listings."""
    first = rows.groupBy("url").agg(F.min_by(F.struct("title", "codes"), "seq").alias("f"), F.min("seq").alias("first_seq"))
    codes = rows.select("url", "seq", F.explode("codes").alias("code")).groupBy("url", "code").agg(F.min("seq").alias("seq"))
    listed = codes.groupBy("url").agg(F.collect_list(F.struct("seq", "code")).alias("all"))
    df = first.join(listed, "url", "left")
    added = F.filter(F.coalesce("all", F.array().cast("array<struct<seq:bigint,code:string>>")), lambda x: x["seq"] > F.col("first_seq"))
    in_order = F.transform(F.array_sort(added), lambda x: x["code"])
    newest = F.array_sort(F.transform(added, lambda x: F.struct((-x["seq"]).alias("k"), x["code"].alias("code"))))
    prefix = F.transform(newest, lambda x: x["code"])
    return df.select("url", F.array_distinct(F.concat(F.col("f.codes"), in_order)).alias("codes"),
                     F.array_join(F.concat(prefix, F.array(F.col("f.title"))), " ").alias("title"))


def run_summary(reports: DataFrame, cands: DataFrame) -> DataFrame:
    """Selected and held counts, active sources, and whether any source worked at all."""
    active = F.col("status").isin("disabled", "not_applicable")
    scan = reports.agg(F.count_if(~active).alias("active_sources"),
                       F.coalesce(F.bool_or(F.col("status").isin("ok", "partial")), F.lit(False)).alias("usable"),
                       F.coalesce(F.bool_or(F.col("status") == "ok"), F.lit(False)).alias("any_ok"))
    picked = cands.agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("held"))
    # Both sides are one row.
    return scan.join(picked).withColumn("collection_failed", ~F.col("any_ok")).withColumn("run_failed", ~F.col("usable")).drop("any_ok", "usable")
