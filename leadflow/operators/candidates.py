"""From leads to candidates: article merge, change status, outcome, flags, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.functions.dates import iso
from leadflow.functions.text import _col, clean, content_hash, needs_translation, ordered_union
from leadflow.rules import DEFAULT_SECTION, SECTIONS

MAX_STORIES = 25

# Review flags, in the order they are listed.
FLAG_TIMING = "Market timing is unresolved; identify the relevant market and apply its close before drafting."
FLAG_NOVELTY = "Newly found document or wording; material novelty versus known deal facts still requires review."
FLAG_RANKING = "Attention ranking is a provisional event-keyword screen; confirm relevance and identities against the source."
FLAG_OUTSIDE = "Outside the priority list. Confirm the company, listing and ticker before including it in the stock email."
FLAG_TOPIC = "Topic match appears only in discovery metadata; verify relevance in the original article."
FLAG_DATE = "Publication time not established; confirm it was available before the cutoff."
FLAG_LANGUAGE = "Original-language source; translation requires review."
FLAG_HEADLINE = "Headline only; read the original document before using."
FLAG_TENDER = "Tender and trading cutoffs require the official timetable and broker confirmation."
FLAG_ISSUER = "Issuer relationship appears only in discovery metadata; confirm it in the source before drafting."
FLAG_ENGLISH = "English summary still needed; source retained in the review queue."


def category(record, source, first_match) -> Column:
    """First stated category, restricted to the sections of an edition."""
    stated = F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in (record, source, first_match)])
    return F.when(stated.isin(*SECTIONS), stated).otherwise(DEFAULT_SECTION)


def candidate_tickers(of_source, matched, active) -> Column:
    """Source tickers and matched ones, each once, restricted to the active watchlist."""
    return F.array_intersect(ordered_union(of_source, matched), _col(active))


def merge_article(leads: DataFrame, articles: DataFrame) -> DataFrame:
    """Lead joined with its article: article values win, lead values fill the gaps, and the lead's own
    text is kept apart as a snippet because it is not article evidence."""
    art = articles.select("url", *[F.col(c).alias("_" + c) for c in ("title", "text", "published", "language", "access_status")])
    pick = lambda name: F.coalesce(F.nullif(F.col("_" + name), F.lit("")), F.col(name))
    found = F.col("_access_status").isNotNull()
    return (leads.join(art, "url", "left").select(
        *[c for c in leads.columns if c not in ("title", "text", "published", "language", "access_status", "date_origin", "discovery_snippet")],
        pick("title").alias("title"), F.when(found, F.coalesce("_text", F.lit(""))).otherwise("").alias("text"),
        pick("published").alias("published"), pick("language").alias("language"),
        F.when(found, F.col("_access_status")).otherwise("unavailable").alias("access_status"),
        F.col("text").alias("discovery_snippet"),
        F.when(F.nullif(F.col("_published"), F.lit("")).isNotNull(), "article")
        .when(F.coalesce("published", F.lit("")) != "", "feed").otherwise("unknown").alias("date_origin")))


def discovery_only_tickers(discovered, in_article, of_source) -> Column:
    """Companies named only in discovery wording."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(_col(c), empty) for c in (discovered, in_article, of_source)]
    return F.array_except(F.array_except(lists[0], lists[1]), lists[2])


def with_identity(df: DataFrame) -> DataFrame:
    """Add the canonical address, id and content hash."""
    return (df.withColumn("canonical", urls.canonical_url("url")).withColumn("id", urls.lead_id("canonical"))
            .withColumn("content_hash", content_hash("title", "text")))


def change_status(cands: DataFrame, state: DataFrame, edition_date: str) -> DataFrame:
    """Add change (new/changed/unchanged), previous_title and seen_before.

    ``state`` has one row per id, so the join never multiplies rows; an id shared by many candidates is
    a skewed left side, which adaptive execution splits."""
    old = state.select("id", F.col("content_hash").alias("_hash"), F.col("title").alias("_title"), F.col("edition_date").alias("_edition"))
    joined = cands.join(old, "id", "left")
    change = (F.when(F.col("_hash").isNull(), "new").when(F.col("_hash") != F.col("content_hash"), "changed").otherwise("unchanged"))
    day = F.lit(edition_date).cast("date")
    return (joined.withColumn("change", change)
            .withColumn("previous_title", F.when(F.col("change") == "changed", F.col("_title")).otherwise(""))
            .withColumn("seen_before", (F.col("change") == "unchanged") & (F.coalesce("_edition", day) < day))
            .drop("_hash", "_title", "_edition"))


def change_history(seen: DataFrame, rows_per_slice: int = 200_000) -> DataFrame:
    """Change status of every document against the one before it at the same address, in order of
    publication day and then arrival (``lead_seq``). Documents without a day come before all dated ones,
    because nothing shows that they are newer; documents without an id share one address. No row is lost.

    An address can hold a third of all documents, so it is never sorted as one group: rows are compared
    within slices of (address, day, arrival range), and the first row of a slice takes the last row of
    the slice before it."""
    # Days as numbers, so that a missing one is an ordinary key.
    day = F.coalesce(F.unix_date(F.to_date("published")), F.lit(-2**31))
    keyed = seen.withColumn("_day", day).withColumn("_slice", F.floor(F.col("lead_seq") / rows_per_slice).cast("long"))
    inside = Window.partitionBy("id", "_day", "_slice").orderBy("lead_seq")
    rows = keyed.withColumn("_prev", F.lag(F.struct("content_hash", "title")).over(inside))
    last = keyed.groupBy("id", "_day", "_slice").agg(F.max_by(F.struct("content_hash", "title"), "lead_seq").alias("_last"))
    by_slice = Window.partitionBy("id").orderBy("_day", "_slice")
    earlier = last.select(*[F.col(k).alias("_of" + k) for k in ("id", "_day", "_slice")], F.lag("_last").over(by_slice).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col("_of" + k)) for k in ("id", "_day", "_slice")]
    joined = rows.join(earlier, same).drop("_ofid", "_of_day", "_of_slice").withColumn("_p", F.coalesce("_prev", "_before"))
    return (joined.withColumn("change", F.when(F.col("_p").isNull(), "new")
                              .when(F.col("_p.content_hash") != F.col("content_hash"), "changed").otherwise("unchanged"))
            .withColumn("previous_title", F.when(F.col("change") == "changed", F.col("_p.title")).otherwise(""))
            .drop("_p", "_prev", "_before", "_day", "_slice"))


def classify(df: DataFrame) -> DataFrame:
    """Add ``outcome``: the first gate that drops the row, else its window verdict.

    Needs tickers, broad, topic (text/discovery/none), window_status, change and seen_before. A changed
    document that is old returns for review."""
    verdict = F.when((F.col("window_status") == "old") & (F.col("change") == "changed"), "date_needs_review").otherwise(F.col("window_status"))
    outcome = (F.when((F.size("tickers") == 0) & ~F.col("broad"), "no_watchlist_match")
               .when(F.col("topic") == "none", "topic_not_matched").when(verdict == "future", "future").when(verdict == "old", "old")
               .when(F.col("seen_before"), "previous_edition_unchanged").otherwise(verdict))
    return df.withColumn("outcome", outcome).withColumn("kept", F.col("outcome").isin("current", "date_needs_review"))


def is_eligible() -> Column:
    """Ready for the draft: current, resolved timing, read in full, English, and an identified company."""
    foreign = needs_translation(F.col("publisher"), "language")
    return ((F.col("outcome") == "current") & F.col("timing_resolved") & ~(F.col("publisher") & (F.col("access_status") != "readable"))
            & ~foreign & (F.size(F.coalesce("discovery_only_tickers", F.array().cast("array<string>"))) == 0)
            & (F.col("topic") != "discovery") & ~(F.col("broad") & (F.size("tickers") == 0)))


def flags() -> Column:
    """Review flags that apply, in their fixed order."""
    when = lambda cond, text: F.when(cond, F.lit(text) if isinstance(text, str) else text)
    foreign = ~F.startswith(F.lower(F.coalesce("language", F.lit("en"))), F.lit("en"))
    unread = F.col("publisher") & (F.col("access_status") != "readable")
    inactive = F.coalesce(F.col("inactive_markets"), F.array().cast("array<string>"))
    return F.array_compact(F.array(
        when(~F.col("timing_resolved"), F.when(F.size(inactive) > 0, F.concat(
            F.lit("No active news window yet for: "), F.array_join(inactive, ", "), F.lit("."))).otherwise(FLAG_TIMING)),
        F.lit(FLAG_NOVELTY),
        when(F.col("broad"), FLAG_RANKING),
        when(F.col("broad") & (F.size("tickers") == 0), FLAG_OUTSIDE),
        when(F.col("topic") == "discovery", FLAG_TOPIC),
        when(F.col("outcome") == "date_needs_review", FLAG_DATE),
        when(foreign, FLAG_LANGUAGE),
        when(F.coalesce("text", F.lit("")) == "", FLAG_HEADLINE),
        when(F.col("event_type") == "Tender/deadline", FLAG_TENDER),
        when(unread, F.concat(F.lit("Article not fully available: "), F.col("access_status"),
                              F.lit(". Discovery lead only; do not infer the full story."))),
        when(F.coalesce("article_error", F.lit("")) != "", F.col("article_error")),
        when(F.size(F.coalesce("discovery_only_tickers", F.array().cast("array<string>"))) > 0, FLAG_ISSUER),
        when(F.col("publisher") & foreign, FLAG_ENGLISH)))


def select_edition(cands: DataFrame, max_stories: int = MAX_STORIES) -> DataFrame:
    """Rank eligible candidates and add ``selected`` and ``position`` to the first ``max_stories``.

    Only the head is sorted; the other rows are held without a global sort. The head has at most
    ``max_stories`` rows, so it is broadcast back."""
    order = [F.desc("attention_score"), F.asc((F.col("change") != "changed").cast("int")),
             F.asc((F.col("event_type") == "Company update").cast("int")), F.asc(F.array_join("tickers", "\u0001")), F.asc("lead_seq")]
    head = cands.filter("eligible").orderBy(*order).limit(max_stories)
    placed = head.select("lead_seq", F.row_number().over(Window.orderBy(*order)).alias("position"))
    return cands.join(F.broadcast(placed), "lead_seq", "left").withColumn("selected", F.col("position").isNotNull())


def export_items(cands: DataFrame) -> DataFrame:
    """Flat draft contract: wording, provenance, evidence and review state of each candidate. Candidates without ``source_name``, ``evidence_level`` or
    ``attention_reasons`` have their source's id, a source excerpt and no reasons."""
    from leadflow.functions.text import excerpt

    own = lambda name, otherwise: F.coalesce(F.col(name), otherwise) if name in cands.columns else otherwise
    return cands.select(
        "id", "tickers", "category", F.col("title").alias("headline"), excerpt("title", "text").alias("source_excerpt"),
        F.col("canonical").alias("source_url"), "source_id", own("source_name", F.col("source_id")).alias("source_name"), "published", iso("published").alias("published_at"),
        F.col("change").alias("document_change"), F.lit(False).alias("novelty_verified"), "access_status", own("evidence_level", F.lit("source_excerpt")).alias("evidence_level"), "language", "collection_role",
        "attention_score", own("attention_reasons", F.array().cast("array<string>")).alias("attention_reasons"),
        (F.size("tickers") > 0).alias("identity_verified"), F.lit(True).alias("review_required"), F.col("eligible").alias("eligible_for_email"))


def upsert_state(state: DataFrame, cands: DataFrame, edition_date: str) -> DataFrame:
    """Next state: the last candidate of each id replaces its row, all other rows stay."""
    new = cands.groupBy("id").agg(F.max_by(F.struct("content_hash", "title", F.col("canonical").alias("url"), "published"), "lead_seq").alias("n"))
    joined = state.join(new, "id", "full")
    fresh = F.col("n").isNotNull()
    return joined.select("id", *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("content_hash", "title", "url", "published")],
                         F.when(fresh, F.lit(edition_date).cast("date")).otherwise(F.col("edition_date")).alias("edition_date"))


def older_duplicates(cands: DataFrame, state: DataFrame, edition_date: str) -> DataFrame:
    """Add ``older_duplicate``: a readable candidate whose content an earlier edition had under another id.

    The state is reduced to the first and last id of each content hash: another id exists exactly when
    one of the two differs, so copies are never paired with each other."""
    earlier = (state.filter(F.col("edition_date") < F.lit(edition_date).cast("date"))
               .groupBy("content_hash").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi")))
    other = (F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id"))
    return (cands.join(earlier, "content_hash", "left")
            .withColumn("older_duplicate", F.col("readable") & F.coalesce(other, F.lit(False))).drop("_lo", "_hi"))
