"""Company name matching and topic tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.text import CJK_CLASS, _col, clean
from leadflow.operators.windows import market_code, ticker_market
from leadflow.rules import TOPIC_NAMES, TOPIC_PATTERN
from leadflow.session import written_table

MIN_TERM_CHARS = 3
# Letters, digits and the underscore make words; everything else separates them.
WORD, GAP = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
PIECES = f"{WORD}+|{GAP}+"
# Words of the runs by which names and texts meet; of a longer name its rarest run counts.
KEY_WORDS = 2
KEY_CHARS = 3
# Bits a name in the table that tells which runs of a text may be names, and the most bits it has.
BITS_A_NAME, MAX_BITS = 16, 1 << 26
# Marks the three-character keys, so that they never equal a word.
CJK_MARK = "\u0001"


def watch_terms(watchlist: DataFrame) -> DataFrame:
    """(ticker, term): ticker, name and aliases of at least three characters, cleaned."""
    names = F.concat(F.array("ticker", "name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (watchlist.select("ticker", F.explode(names).alias("term")).withColumn("term", clean("term"))
            .filter(F.char_length("term") >= MIN_TERM_CHARS).distinct())


def _word_runs(low: Column, words: int) -> Column:
    """All runs of so many words with the separators between them; look-ahead lets them overlap."""
    return F.regexp_extract_all(low, F.lit(f"(?<!{WORD})(?=({WORD}++" + f"{GAP}++{WORD}++" * (words - 1) + "))"), F.lit(1))


def _cjk_runs(low: Column) -> Column:
    """Marked three-character runs that hold a Japanese or Chinese character."""
    chars = F.filter(F.regexp_extract_all(low, F.lit("(?s)(?=(" + "." * KEY_CHARS + "))"), F.lit(1)), lambda k: k.rlike(CJK_CLASS))
    return F.transform(chars, lambda k: F.concat(F.lit(CJK_MARK), k))


def _keyed_terms(terms: DataFrame) -> DataFrame:
    """Join key of each term and whether equality of keys already proves the match.

    The key is the run of two words (or the one word, or the three characters) of the name that the
    fewest names share, so that names with a common beginning do not meet in one key."""
    low = F.lower("term")
    cjk = F.col("term").rlike(CJK_CLASS)
    runs = _word_runs(low, KEY_WORDS)
    keys = F.when(cjk, _cjk_runs(low)).when(F.size(runs) > 0, runs).otherwise(F.array(F.regexp_extract(low, f"{WORD}+", 0)))
    every = terms.select("ticker", "term", cjk.alias("is_cjk"), F.posexplode(keys).alias("pos", "key"))
    shared = every.groupBy("key").agg(F.count_distinct("term").alias("names"))
    rarest = every.join(shared, "key").groupBy("ticker", "term", "is_cjk").agg(F.min(F.struct("names", "pos", "key")).alias("k"))
    return rarest.select("ticker", "term", "is_cjk", F.col("k.key").alias("key"), (~F.col("is_cjk") & (F.col("k.key") == low)).alias("exact"))


def _text_keys(leads: DataFrame, text: Column) -> DataFrame:
    """Distinct (lead_seq, key): runs of one to KEY_WORDS words with the separators between them, and
    three-character runs of texts in Japanese or Chinese script. Each kind is one linear pass over the
    text."""
    low = F.col("_low")
    runs = [F.regexp_extract_all(low, F.lit(f"({WORD}+)"), F.lit(1)), _word_runs(low, KEY_WORDS)]
    cjk = F.when(low.rlike(CJK_CLASS), _cjk_runs(low)).otherwise(F.array().cast("array<string>"))
    return (leads.select("lead_seq", F.lower(text).alias("_low"))
            .select("lead_seq", F.explode(F.array_distinct(F.concat(*runs, cjk))).alias("key")))


def _may_be_names(keys: DataFrame, terms: DataFrame) -> DataFrame:
    """Keys of texts without nearly all that no name has, by a table of bits (a Bloom filter; both bits of a key lie in one word).

    Most runs of a text are no name's: they end where the text is read and are not shuffled to the names, however many there are. The
    table has at least BITS_A_NAME bits a name up to MAX_BITS, so it stays small; beyond, it lets more keys through. The join decides."""
    words = min(MAX_BITS, max(1 << 12, 1 << (BITS_A_NAME * terms.count()).bit_length())) // 64
    place = F.pmod(F.shiftrightunsigned("_hash", 12), F.lit(words))
    mask = F.expr("shiftleft(1L, cast(_hash & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(_hash, 6) & 63 as int))")
    hashed = lambda rows: rows.withColumn("_hash", F.xxhash64("key")).withColumns({"_place": place, "_mask": mask})
    bits = hashed(terms.select("key")).groupBy("_place").agg(F.bit_or("_mask").alias("_bits"))
    met = hashed(keys).join(F.broadcast(bits), "_place")
    return met.filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select("lead_seq", "key")


def match_terms(leads: DataFrame, watchlist: DataFrame, text: Column | None = None) -> DataFrame:
    """Distinct (lead_seq, ticker) pairs whose text holds the ticker, name or an alias.

    An equi-join on word runs, so the work is linear in the text and not leads times terms. A term
    whose key is the whole term is proven by the join; others (long names, names that begin or end
    with punctuation, Japanese and Chinese names) are checked against the text of the few leads
    they met. Names match as whole words and without case; Japanese and Chinese names match as
    substrings."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))) if text is None else text
    terms = _keyed_terms(watch_terms(watchlist))
    # The name table is written, so that the planner knows its size when it chooses the join.
    terms = written_table(terms, "terms")
    met = _may_be_names(_text_keys(leads, body), terms).join(terms, "key")
    if terms.filter("NOT exact").isEmpty():
        return met.select("lead_seq", "ticker").distinct()
    proven = met.filter("exact").select("lead_seq", "ticker")
    open_pairs = met.filter("NOT exact").select("lead_seq", "ticker", "term", "is_cjk").distinct()
    escaped = F.concat(F.lit(f"(?iu)(?<!{WORD})" + r"\Q"), F.replace(F.col("term"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + f"(?!{WORD})"))
    held = F.when(F.col("is_cjk"), F.contains(F.lower("_body"), F.lower("term"))).otherwise(F.rlike(F.col("_body"), escaped))
    checked = (open_pairs.join(leads.select("lead_seq", body.alias("_body")), "lead_seq").filter(held).select("lead_seq", "ticker"))
    return proven.unionByName(checked).distinct()


def match_arrays(leads: DataFrame, watchlist: DataFrame, text: Column | None = None, out: str = "tickers") -> DataFrame:
    """Leads with the sorted tickers they mention; the list is bounded by the lead's own text."""
    return with_names(leads, match_terms(leads, watchlist, text), out)


def with_names(leads: DataFrame, names: DataFrame, out: str = "tickers") -> DataFrame:
    """Leads with the sorted tickers of their (lead_seq, ticker) rows."""
    found = names.groupBy("lead_seq").agg(F.array_sort(F.collect_list("ticker")).alias(out))
    return leads.join(found, "lead_seq", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def scoped_watchlist(sources: DataFrame, watchlist: DataFrame) -> DataFrame:
    """(source_id, ticker): companies a source may speak about.

    Sources fixed to tickers join on the ticker, sources fixed to a market join on the market, so
    only sources without any scope list every company."""
    companies = watchlist.select("ticker", ticker_market("ticker").alias("_market"))
    scoped = F.coalesce(F.col("scope_market"), F.lit("")) != ""
    by_market = scoped & (F.col("exchange_index") | F.col("issuer_official"))
    by_ticker = (F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0) & (
        F.col("issuer_official") | (F.col("collection_role") == "priority"))
    src = sources.select(F.col("id").alias("source_id"), "tickers", market_code("scope_market").alias("_scope"),
                         by_market.alias("_by_market"), by_ticker.alias("_by_ticker"))
    fixed = (src.filter("_by_ticker").select("source_id", "_scope", "_by_market", F.explode("tickers").alias("ticker")).distinct()
             .join(companies, "ticker").filter(~F.col("_by_market") | (F.col("_scope") == F.col("_market"))).select("source_id", "ticker"))
    market = (src.filter("_by_market AND NOT _by_ticker").join(companies, F.col("_scope") == F.col("_market")).select("source_id", "ticker"))
    return fixed.unionByName(market)


def unscoped_sources(sources: DataFrame) -> DataFrame:
    """Sources that admit the whole watchlist; kept as a list instead of a row per company."""
    scoped = F.coalesce(F.col("scope_market"), F.lit("")) != ""
    by_market = scoped & (F.col("exchange_index") | F.col("issuer_official"))
    by_ticker = (F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0) & (
        F.col("issuer_official") | (F.col("collection_role") == "priority"))
    return sources.filter(~by_market & ~by_ticker).select(F.col("id").alias("source_id"))


def topic_pattern(topic: str) -> str | None:
    """Pattern of a topic: a named topic has one, any other is taken literally, none matches all."""
    value = topic.strip()
    if not value:
        return None
    if value.lower() in TOPIC_NAMES:
        return "(?iU)" + TOPIC_PATTERN
    return r"(?iU)\Q" + value.replace(r"\E", r"\E\\E\Q") + r"\E"


def topic_match(topic: str, text, discovery_text) -> Column:
    """text, discovery (seen only in discovery wording: keep but hold) or none."""
    pattern = topic_pattern(topic)
    if pattern is None:
        return F.lit("text")
    return (F.when(_col(text).rlike(pattern), "text")
            .when(F.coalesce(_col(discovery_text), F.lit("")).rlike(pattern), "discovery").otherwise("none"))
