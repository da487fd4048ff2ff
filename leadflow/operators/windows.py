"""Market windows: closes, editions, market inference and the window of a record."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.dates import AFTERNOON_BOUNDARY, AFTERNOON_FLOOR, DESK_ZONE, edition_kind, window_verdict
from leadflow.functions.text import _col
from leadflow.operators.asof import asof_join, fill_forward, prev_weekday
from leadflow.rules import MARKET_ALIASES, SESSION_HORIZON_DAYS
from leadflow.session import bounded_rows, written_table

LOOKBACK_HOURS = 24
MAX_MARKETS = 500  # rows of a market table that may be read on the driver


def market_code(value) -> Column:
    """Upper-case code, with the other spellings of a market mapped to one."""
    code = F.upper(F.trim(F.coalesce(_col(value), F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for pair in MARKET_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, code), code)


def ticker_market(ticker) -> Column:
    """Market suffix of a ticker; empty when it has none. A trailing 'Equity' is ignored."""
    core = F.regexp_replace(F.coalesce(_col(ticker), F.lit("")), r"(?iu)(?:\A|\s)EQUITY\s*\z", "")
    last = F.regexp_extract(core, r"\S\s+(\S+)\s*\z", 1)
    return F.when(last != "", market_code(last)).otherwise("")


def for_each_row(df: DataFrame, small: DataFrame, name: str) -> DataFrame:
    """Every row of ``df`` once per row of a small dimension, read on the driver (at most MAX_MARKETS rows)."""
    rows = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in small.dtypes]) for r in bounded_rows(small, MAX_MARKETS, "the dimension")]
    return df.withColumn(name, F.explode(F.array(*rows)))


def _clock(day: Column, clock: Column, zone: Column) -> Column:
    """Instant of a local clock time; null without one."""
    seconds = F.when(F.length(clock) > 5, clock).otherwise(F.concat(clock, F.lit(":00")))
    return F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd "), seconds)), zone)


def _replaced(overrides: DataFrame) -> DataFrame:
    """(market, session_date, regular): for every weekday with an override of its own, the last weekday before it without one.

    Runs of such days are islands in the order of weekdays, so a closure of any length is one step."""
    days = overrides.select("market", F.col("session_date").cast("date").alias("session_date")).distinct().filter(F.weekday("session_date") < 5)
    order = Window.partitionBy("market").orderBy("session_date")
    begins = F.coalesce(F.lag("session_date").over(order) != prev_weekday(F.col("session_date")), F.lit(True)).cast("int")
    runs = days.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order))
    first = F.min("session_date").over(Window.partitionBy("market", "_run"))
    return runs.select(F.col("market").alias("_m"), F.col("session_date").alias("_d"), prev_weekday(first).alias("regular"))


def latest_close(editions: DataFrame, rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """As-of lookup of the last completed close per (edition, market).

    Editions are (edition_id, as_of). The regular close follows from the calendar: the day itself, or the weekday before it, or the
    weekday before a run of days with sessions of their own. Closes of special sessions are looked up as of the edition, and
    the later of both counts. A pair with no session in the last ``SESSION_HORIZON_DAYS`` days is an error."""
    pairs = for_each_row(editions.select("edition_id", "as_of"), rules.select("market", "timezone", "close", "basis"), "_r").select("edition_id", "as_of", "_r.*")
    local = F.to_date(F.from_utc_timestamp("as_of", F.col("timezone")))
    today = (F.weekday(local) < 5) & (_clock(local, F.col("close"), F.col("timezone")) <= F.col("as_of"))
    regular = pairs.withColumn("_local", local).withColumn("_day", F.when(today, local).otherwise(prev_weekday(local)))
    replaced = regular.join(F.broadcast(_replaced(overrides)), (F.col("market") == F.col("_m")) & (F.col("_day") == F.col("_d")), "left").withColumn("_day", F.coalesce("regular", "_day"))
    zones = rules.select(F.col("market").alias("_z"), "timezone")
    special = (overrides.filter("close IS NOT NULL").join(zones, F.col("market") == F.col("_z")).select("market", F.col("session_date").cast("date").alias("_special"), F.col("close").alias("_at"), "timezone")
               .select("market", "_special", _clock(F.col("_special"), F.col("_at"), F.col("timezone")).alias("_closed")))
    found = asof_join(replaced.drop("_m", "_d", "regular"), special, ["market"], "as_of", "_closed", ["_closed", "_special"], salts=1)
    since = F.date_sub("_local", SESSION_HORIZON_DAYS - 1)
    usual = F.when(F.col("_day") >= since, F.struct(_clock(F.col("_day"), F.col("close"), F.col("timezone")).alias("window_start"), F.col("_day").alias("session_date"), F.col("basis").alias("basis")))
    own = F.when(F.col("_special") >= since, F.struct(F.col("_closed").alias("window_start"), F.col("_special").alias("session_date"), F.lit("session override").alias("basis")))
    best = found.withColumn("c", F.greatest(usual, own))
    start = F.when(F.col("c").isNull(), F.raise_error(F.concat(F.lit("no completed session for "), "market")).cast("timestamp"))
    return best.select("edition_id", "as_of", "market", start.otherwise(F.col("c.window_start")).alias("window_start"), "c.session_date", "c.basis")


def fallback_start(editions: DataFrame, windows: DataFrame, hours: int | Column = LOOKBACK_HOURS) -> DataFrame:
    """(edition_id, start): where records without a market of their own begin. It is the earliest window of the edition, or ``hours`` before the
    edition where it has none (rolling mode)."""
    rolling = editions.select("edition_id", (F.col("as_of") - F.make_dt_interval(hours=hours if isinstance(hours, Column) else F.lit(hours))).alias("_rolling"))
    earliest = windows.groupBy(F.col("edition_id").alias("_e")).agg(F.min("window_start").alias("_earliest"))
    return rolling.join(earliest, F.col("edition_id") == F.col("_e"), "left").select("edition_id", F.coalesce("_earliest", "_rolling").alias("start"))


def build_windows(editions: DataFrame, rules: DataFrame, overrides: DataFrame, mode: str = "auto",
                  boundary: str = AFTERNOON_BOUNDARY, timing: str = "market_close") -> DataFrame:
    """Window per (edition, market) plus a GLOBAL row.

    With ``timing`` "rolling_hours" there are no windows: everything is resolved and starts at ``fallback_start``. Morning: from the latest close, inclusive; GLOBAL is the earliest of them. Afternoon: strictly
    after 14:10 Singapore for every market, pending until that time has passed."""
    if timing not in ("market_close", "rolling_hours"):
        raise ValueError("timing must be market_close or rolling_hours")
    if timing == "rolling_hours":
        editions = editions.limit(0)
    kinds = editions.select("edition_id", "as_of").withColumn("edition", edition_kind("as_of", mode, boundary))
    morning = latest_close(kinds.filter("edition = 'morning'").drop("edition"), rules, overrides)
    per_market = morning.select("edition_id", "as_of", "market", "window_start", "session_date", "basis")
    overall = per_market.groupBy("edition_id", "as_of").agg(F.min("window_start").alias("window_start")).select(
        "edition_id", "as_of", F.lit("GLOBAL").alias("market"), "window_start", F.lit(None).cast("date").alias("session_date"),
        F.lit("Regional macro context: earliest of the morning market windows").alias("basis"))
    before_noon = per_market.unionByName(overall).select(
        "*", F.lit("active").alias("status"), F.lit("morning").alias("edition"), F.lit(True).alias("start_inclusive"),
        F.lit(None).cast("timestamp").alias("expected_start"))
    names = rules.select("market").unionByName(rules.sparkSession.createDataFrame([("GLOBAL",)], "market string"))
    day = F.to_date(F.from_utc_timestamp("as_of", DESK_ZONE))
    floor = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd "), F.lit(AFTERNOON_FLOOR + ":00"))), DESK_ZONE)
    after_noon = (for_each_row(kinds.filter("edition = 'afternoon'").drop("edition"), names, "_r")
                  .withColumn("market", F.col("_r.market")).withColumn("expected_start", floor)
                  .select("edition_id", "as_of", "market", F.least("expected_start", "as_of").alias("window_start"),
                          day.alias("session_date"),
                          F.lit("Strictly after 14:10 Singapore on the edition date, for every market").alias("basis"),
                          F.when(F.col("as_of") > F.col("expected_start"), "active").otherwise("pending_start").alias("status"),
                          F.lit("afternoon").alias("edition"), F.lit(False).alias("start_inclusive"), "expected_start"))
    return before_noon.unionByName(after_noon)


def infer_markets(market, exchange_tickers, tickers, matched, source_tickers, authoritative, scope_market) -> Column:
    """Sorted markets of a record: stated, else of the first non-empty ticker list, else the scope of
    an authoritative source. A publisher's country is never used."""
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(_col(c), empty) for c in (exchange_tickers, tickers, matched, source_tickers)]
    chosen = lists[-1]
    for candidate in reversed(lists[:-1]):
        chosen = F.when(F.size(candidate) > 0, candidate).otherwise(chosen)
    found = F.array_sort(F.array_distinct(F.filter(F.transform(chosen, ticker_market), lambda m: m != "")))
    scope = F.coalesce(_col(scope_market), F.lit(""))
    stated = F.coalesce(_col(market), F.lit(""))
    own = F.when(F.coalesce(_col(authoritative), F.lit(False)) & (scope != ""), F.array(market_code(scope))).otherwise(empty)
    # Tickers are read once: the list found is bound before its size decides.
    inferred = F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(own)), 1)
    return F.when(stated != "", F.array(market_code(stated))).otherwise(inferred)


def windows_map(windows: DataFrame) -> Column:
    """The windows of one edition as a literal map: market -> (start, active, inclusive).

    There is one row per market (15 in the default table, at most MAX_MARKETS), so they are read on the driver."""
    rows = bounded_rows(windows.select("market", F.unix_micros("window_start").alias("start"), "status", "start_inclusive"), MAX_MARKETS, "the window table")
    if not rows:
        return F.create_map().cast("map<string,struct<start:timestamp,active:boolean,inclusive:boolean>>")
    pairs = []
    for r in rows:
        pairs += [F.lit(r["market"]), F.struct(F.timestamp_micros(F.lit(r["start"])).alias("start"),
                                               F.lit(r["status"] == "active").alias("active"),
                                               F.lit(bool(r["start_inclusive"])).alias("inclusive"))]
    return F.create_map(*pairs)


def record_window(df: DataFrame, windows: DataFrame, fallback, markets: str = "timing_markets") -> DataFrame:
    """Add applied_window_start, timing_resolved, applied_inclusive and inactive_markets.

    Every market of the record must have a window; the latest start applies. Otherwise the fallback
    start applies and the record is unresolved. With no windows at all everything is resolved."""
    table = windows_map(windows)
    n = F.size(F.map_keys(table))
    empty = F.array().cast("array<string>")
    listed = F.coalesce(F.col(markets), empty)
    hits = F.transform(listed, lambda m: F.try_element_at(table, m))
    known = (F.size(listed) > 0) & F.forall(hits, lambda w: w.isNotNull())
    asked = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GLOBAL")))
    start = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("timestamp")
    return df.select(
        "*",
        F.when(known, F.array_max(F.transform(hits, lambda w: w["start"]))).otherwise(start).alias("applied_window_start"),
        F.when(n == 0, True).otherwise(known & F.forall(hits, lambda w: F.coalesce(w["active"], F.lit(False)))).alias("timing_resolved"),
        F.forall(F.transform(asked, lambda m: F.try_element_at(table, m)["inclusive"]),
                 lambda x: F.coalesce(x, F.lit(True))).alias("applied_inclusive"),
        F.filter(listed, lambda m: ~F.coalesce(F.try_element_at(table, m)["active"], F.lit(True))).alias("inactive_markets"))


def with_verdict(df: DataFrame, as_of, ts: str = "published", precision: str = "date_precision") -> DataFrame:
    """Add window_status from the applied window; a missing date needs review."""
    when = F.when(~F.col(precision).isin("missing", "unparsed"), F.col(ts))
    end = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    return df.withColumn("window_status", window_verdict(when, precision, "applied_window_start", end, F.col("applied_inclusive")))


def _layers(rows: pa.Table) -> pa.Table:
    """The windows of a market in layers: in a layer, starts and ends rise with ``rank``. Morning and afternoon editions make two."""
    ends: list[tuple] = []
    counts: list[int] = []
    placed = []
    rows = rows.sort_by([("_start", "ascending"), ("_strict", "ascending"), ("as_of", "ascending"), ("edition_id", "ascending")])
    for end in rows["as_of"].to_pylist():
        layer = next((k for k, last in enumerate(ends) if last <= end), len(ends))
        if layer == len(ends):
            ends.append(end)
            counts.append(0)
        ends[layer] = end
        placed.append((layer, counts[layer]))
        counts[layer] += 1
    return rows.append_column("layer", pa.array([p[0] for p in placed], pa.int32())).append_column("rank", pa.array([p[1] for p in placed], pa.int32()))


def assign_editions(leads: DataFrame, windows: DataFrame, salts: int = 4) -> DataFrame:
    """(lead, edition) pairs of a backfill: every edition whose window of the lead's market holds it.

    The windows of a market are laid out in layers in which starts and ends rise together. A lead then lies in the windows from the first
    that has not ended to the last that has begun, and both are looked up as of its time; only pairs that match are made.
    Day precision and missing dates prove nothing and join no edition."""
    exact = leads.filter(F.col("date_precision") == "time").withColumn("_market", F.coalesce(F.col("market"), F.lit("GLOBAL"))).withColumn("_t", F.unix_micros("published"))
    spans = (windows.filter("status = 'active'").select("edition_id", F.col("market").alias("_market"), "window_start", "as_of", "start_inclusive")
             .withColumn("_start", F.unix_micros("window_start")).withColumn("_strict", (~F.col("start_inclusive")).cast("int")))
    # One row per market and edition; the layers of a market are found in one pass over its editions.
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema)
    laid = written_table(spans.groupBy("_market").applyInArrow(_layers, f"{fields}, layer int, rank int"), "layers")
    begun = laid.select("_market", "layer", F.col("_start").alias("_t"), (F.col("_strict") * 2).alias("_o"), F.col("rank").alias("_begun"), F.lit(None).cast("int").alias("_ended"))
    ended = laid.select("_market", "layer", F.unix_micros("as_of").alias("_t"), F.lit(3).alias("_o"), F.lit(None).cast("int").alias("_begun"), F.col("rank").alias("_ended"))
    asked = exact.filter("_t IS NOT NULL").join(laid.select("_market", "layer").distinct(), "_market").withColumn("_o", F.lit(1))
    found = fill_forward(asked, begun.unionByName(ended), ["_market", "layer"], ["_begun", "_ended"], salts=salts)
    first = F.coalesce(F.col("_ended") + 1, F.lit(0))
    inside = found.filter(F.col("_begun") >= first).withColumn("rank", F.explode(F.sequence(first, "_begun")))
    editions = laid.select("_market", "layer", "rank", "edition_id", "window_start", "as_of", "start_inclusive")
    return inside.join(editions, ["_market", "layer", "rank"]).select(*leads.columns, "edition_id", "window_start", "as_of", "start_inclusive")
