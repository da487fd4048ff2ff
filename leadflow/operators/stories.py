"""Validation and layout of researched stories.

Stories, their sources and their bullets are tables. Every broken rule becomes a reason row with its
place in the fixed order of checks; reasons are made distinct per story before they are listed, so the
list grows with the kinds of reason and not with the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.functions.dates import DESK_ZONE, iso, strict_ts
from leadflow.functions.text import language_label
from leadflow.operators.windows import MAX_MARKETS, infer_markets, market_code, windows_map
from leadflow.rules import SECTIONS
from leadflow.session import bounded_rows, written_table

TOP_STORIES = 2
ORIGIN_KINDS = ("exchange", "issuer", "regulator", "original_reporting")
NOT_RECORDED = "not recorded"
ORIGIN_FIELDS = ("development", "timestamp_evidence", "verification_notes")
WINDOW_STATUSES = ("active", "pending_start", "pending_close", "no_session")

# Wording of the reasons.
WINDOW_UNKNOWN = "The relevant market and its close window must be established."
WINDOW_STATES = {
    "pending_start": ": pending today's 14:10 SGT start; no afternoon news is eligible yet.",
    "pending_close": ": pending today's close; afternoon coverage cannot use an earlier session.",
    "no_session": ": no session today; no after-close window for this afternoon edition.",
}
ID_MISSING, ID_DUPLICATED = "Story ID is missing.", "Story ID is duplicated."
NO_COMPANY, NO_HEADLINE = "Company identity needs review.", "English headline is missing."
NOT_READY = "Research review status is not ready."
NOT_NEW = "New information or a changed event has not been established."
NO_CATEGORY = "A supported edition category is required."
BAD_URL = "A source URL is invalid or is not a public HTTP(S) reference."
SAME_URL = "A source URL is duplicated; consolidate its metadata."
NO_ORIGIN = "Original disclosure and its publication time have not been verified."
UNVERIFIED = "Original disclosure verification is incomplete."
BAD_KIND = "Original source must be an exchange, issuer, regulator or original reporting."
NEEDS_FIELD = "Original disclosure needs {}."
ORIGIN_ABSENT = "Original source URL must match a public source in this story."
ORIGIN_UNREAD = "Original source must be read and its exact publication time confirmed."
ORIGIN_NO_TIME = "Original source needs an ISO publication timestamp with timezone."
ORIGIN_OUTSIDE = "Original disclosure is outside the selected time window; later reporting cannot reset it."
BACKGROUND_NOTES = "Background sources need context_notes distinguishing the older event from this development."
BAD_RELATION = "Source relationship must be same_development or background."
EARLIER_REPORT = "An earlier report of the same development is recorded; verify and use the original source."
UNCLEAR_REPORT = "A report of the same development has an unconfirmed publication time; resolve the chronology."
NO_BULLET = "At least one sourced English bullet is required."
ORIGIN_UNCITED = "The original disclosure must be cited by a factual bullet."
BULLET_NO_TEXT = " has no text."
BULLET_NO_SOURCE = " needs at least one source citation."
BULLET_BAD_URL = " has an invalid or forbidden citation URL."
BULLET_ABSENT = " cites a source absent from the story's source list."
BULLET_UNREAD = " cites an unreadable or restricted source."
BULLET_NO_DAY = " source publication time is unconfirmed."
BULLET_OUTSIDE = " source is outside the selected time window."
BULLET_NO_TIME = " source needs an ISO publication timestamp with timezone."

PLACE = "struct<part:int,a:bigint,b:bigint,c:int>"
REASON = f"array<struct<at:{PLACE},reason:string>>"


def _at(part: int, a=0, b=0, c: int = 0) -> Column:
    col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    return F.struct(F.lit(part).alias("part"), col(a).alias("a"), col(b).alias("b"), F.lit(c).alias("c"))


def _reason(at: Column, text) -> Column:
    return F.struct(at.alias("at"), (F.lit(text) if isinstance(text, str) else text).alias("reason"))


def _blank(name) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def _public(url) -> Column:
    """A missing address is not a public one."""
    return F.coalesce(urls.is_public_url(url), F.lit(False))


def _packed(reasons: list[Column]) -> Column:
    """The reasons that are not null, as a list."""
    return F.array_compact(F.array(*reasons)).cast(REASON)


def _rows(df: DataFrame, reasons: list[Column], seq: str = "story_seq") -> DataFrame:
    """(story_seq, at, reason) of the reasons that are not null."""
    return df.select(F.col(seq).alias("story_seq"), F.explode(_packed(reasons)).alias("r")).select("story_seq", "r.at", "r.reason")


def window_violations(windows: DataFrame, start, as_of) -> DataFrame:
    """(market, violation) rows of a pack's windows; an empty result means the pack may be used."""
    first, last = strict_ts(start), strict_ts(as_of)
    named = windows.select("market", market_code("market").alias("code"), "status", strict_ts("window_start").alias("ws"),
                           F.col("as_of").alias("stated"), strict_ts("as_of").alias("ts"))
    twice = named.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").select("code", F.lit(True).alias("twice"))
    df = named.join(twice, "code", "left")
    checks = F.array_compact(F.array(
        F.when(F.coalesce("twice", F.lit(False)), "duplicated market"), F.when(F.col("ws").isNull(), "start is not a full timestamp"),
        F.when((F.col("ws") < first) | (F.col("ws") > last), "outside the research envelope"),
        F.when((F.coalesce("stated", F.lit("")) != "") & F.coalesce(F.col("ts") != last, F.lit(True)), "cutoff differs"),
        F.when(~F.coalesce("status", F.lit("active")).isin(*WINDOW_STATUSES), "unknown status")))
    return df.select("market", F.explode(checks).alias("violation"))


def story_windows(stories: DataFrame, windows: DataFrame, start, as_of) -> DataFrame:
    """Add markets, story_start and story_inclusive.

    The latest start of the story's markets applies, and only the windows that begin there decide whether
    the start itself counts. Without windows the pack's start applies, inclusive."""
    table = windows_map(windows)
    empty = F.lit(None).cast("array<string>")
    df = stories.withColumn("markets", infer_markets("market", empty, "tickers", empty, empty, F.lit(False), F.lit("")))
    # The windows of a story are looked up once, and three columns follow from them.
    df = df.withColumn("_hits", F.transform("markets", lambda m: F.try_element_at(table, m)))
    df = df.withColumn("_known", (F.size("markets") > 0) & F.forall("_hits", lambda w: w.isNotNull())).withColumn("_latest", F.array_max(F.col("_hits.start")))
    known = F.col("_known")
    return (df.withColumn("market_known", (F.size(F.map_keys(table)) == 0) | known)
            .withColumn("story_start", F.when(known, F.col("_latest")).otherwise(start))
            .withColumn("story_inclusive", F.when(known, F.forall("_hits", lambda w: (w["start"] != F.col("_latest")) | w["inclusive"])).otherwise(True))
            .withColumn("as_of", as_of).drop("_hits", "_known", "_latest"))


def public_sources(sources: DataFrame) -> DataFrame:
    """Usable sources, one row per (story, address): the metadata of the last entry, the place of the
    first, and how many entries there are. Times are read before the shuffle, and what a caller does not ask for stays behind."""
    last = lambda value, name: F.max_by(value, "pos").alias(name)
    return (sources.filter(_public("url")).withColumn("ts", strict_ts("published_at")).groupBy("story_seq", "url")
            .agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"),
                 *[last(F.col(c), c) for c in ("published_at", "access", "date_precision", "relationship", "context_notes", "name", "ts")]))


def _outside(ts, story=None) -> Column:
    """Whether a time lies outside the window of the story of the row, or of ``story``."""
    of = F.col if story is None else lambda name: story[name]
    return (ts > of("as_of")) | (ts < of("story_start")) | ((ts == of("story_start")) & ~of("story_inclusive"))


def _window_states(windows: DataFrame) -> Column:
    """Reasons of a story's markets whose window is not open, null elements for the others."""
    table = {r["market"]: r["status"] for r in bounded_rows(windows.select("market", "status"), MAX_MARKETS, "the window table")}
    statuses = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) if table else F.create_map().cast("map<string,string>")
    wording = F.create_map(*[F.lit(x) for pair in WINDOW_STATES.items() for x in pair])
    text = lambda m: F.concat(m, F.try_element_at(wording, F.try_element_at(statuses, m)))
    return F.transform("markets", lambda m, i: F.when(F.col("market_known") & text(m).isNotNull(), _reason(_at(1, i), text(m))))


def _doubled(placed: DataFrame) -> DataFrame:
    """story_seq of stories whose id another has too. The ids in question are written first: there are few, and the planner sees it."""
    ids = written_table(placed.filter(~_blank("id")).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "doubled")
    return placed.select("story_seq", "id").join(ids, "id", "left_semi").select("story_seq")


def story_reasons(windows: DataFrame) -> Column:
    """Reasons of a story's own fields and of its first-disclosure record, as a list."""
    own = [F.when(~F.col("market_known"), _reason(_at(0), WINDOW_UNKNOWN)), F.when(_blank("id"), _reason(_at(2), ID_MISSING)),
           F.when(_blank("company"), _reason(_at(3), NO_COMPANY)), F.when(_blank("headline"), _reason(_at(4), NO_HEADLINE)),
           F.when(F.coalesce("review_status", F.lit("")) != "ready", _reason(_at(5), NOT_READY)),
           F.when(~F.coalesce("novelty", F.lit("")).isin("new", "changed"), _reason(_at(6), NOT_NEW)),
           F.when(~F.coalesce("category", F.lit("")).isin(*SECTIONS), _reason(_at(7), NO_CATEGORY))]
    return F.array_compact(F.concat(_packed([*own, *_disclosure_rules()]), F.coalesce(_window_states(windows).cast(REASON), F.array().cast(REASON))))


def source_reasons() -> list[Column]:
    """Reasons of a source among the gathered rows: an invalid or repeated address, and what it says beside the origins of its story."""
    public, report = F.col("public"), F.coalesce(F.shiftright("found_state", 3), F.lit(2))
    beside = lambda o: o["has_origin"] & o["origin_ts"].isNotNull() & (F.col("url") != o["origin_url"]) & ((report < 3) | (F.col("found_ts") < o["origin_ts"]))
    return [F.when(~public, _reason(_at(8, F.col("pos")), BAD_URL)), F.when(public & (F.col("pos") > F.col("first_pos")), _reason(_at(8, F.col("pos")), SAME_URL)),
            F.when(public & (report < len(REPORTS)) & F.exists("origins", beside), _reason(_at(10, F.col("first_pos")), F.get(F.array(*[F.lit(r) for r in REPORTS]), report)))]


def origin_reasons(placed: DataFrame, public: DataFrame) -> DataFrame:
    """Reasons of the first-disclosure record, its source and the other reports of the development."""
    src = public.select("story_seq", F.col("url").alias("origin_url"), F.col("access").alias("_access"), F.col("date_precision").alias("_precision"),
                        F.col("ts").alias("origin_ts"), F.lit(True).alias("_found"))
    df = placed.join(src, ["story_seq", "origin_url"], "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    unread = (F.coalesce("_access", F.lit("")) != "readable") | (F.coalesce("_precision", F.lit("")) != "time")
    own = _rows(df, [*_disclosure_rules(), *_origin_rules(F.col("_found"), unread, F.col("origin_ts"))])
    return own.unionByName(origin_chronology(df, public))


def _disclosure_rules() -> list[Column]:
    """Reasons of the first-disclosure record itself."""
    has = F.col("has_origin")
    return [F.when(~has, _reason(_at(9, 0), NO_ORIGIN)),
            F.when(has & (F.coalesce("origin_status", F.lit("")) != "verified"), _reason(_at(9, 1), UNVERIFIED)),
            F.when(has & ~F.coalesce("origin_kind", F.lit("")).isin(*ORIGIN_KINDS), _reason(_at(9, 2), BAD_KIND)),
            *[F.when(has & _blank(f"origin_{f}"), _reason(_at(9, 3 + i), NEEDS_FIELD.format(f))) for i, f in enumerate(ORIGIN_FIELDS)]]


def _origin_rules(found: Column, unread: Column, ts: Column) -> list[Column]:
    """Reasons of the source that the record names."""
    return [F.when(F.col("has_origin") & ~found, _reason(_at(9, 6), ORIGIN_ABSENT)),
            F.when(found & unread, _reason(_at(9, 7), ORIGIN_UNREAD)),
            F.when(found & ts.isNull(), _reason(_at(9, 8), ORIGIN_NO_TIME)),
            F.when(found & _outside(ts), _reason(_at(9, 9), ORIGIN_OUTSIDE))]


# What a source says of itself beside an origin; EARLIER_REPORT needs the origin's time.
REPORTS = (BACKGROUND_NOTES, BAD_RELATION, UNCLEAR_REPORT, EARLIER_REPORT)


def _report() -> Column:
    """Place in REPORTS of the reason a source may give, null for background with its notes."""
    relation = F.coalesce("relationship", F.lit("same_development"))
    return (F.when(relation == "background", F.when(_blank("context_notes"), 0)).when(relation != "same_development", 1)
            .when(F.col("ts").isNull() | (F.coalesce("date_precision", F.lit("")) != "time"), 2).otherwise(3))


def origin_chronology(with_origin: DataFrame, public: DataFrame) -> DataFrame:
    """Other sources of a story against its origin: earlier or undated reports of the same development,
    and background without notes, also when they are not cited. One row per story and kind of reason."""
    base = with_origin.filter("has_origin AND origin_ts IS NOT NULL").select("story_seq", "origin_url", "origin_ts")
    # Sources that give no reason beside any origin do not travel.
    reports = public.withColumn("report", _report()).filter("report IS NOT NULL").select("story_seq", "url", "first_pos", "ts", "report")
    other = reports.join(base, "story_seq").filter("url <> origin_url").filter((F.col("report") < 3) | (F.col("ts") < F.col("origin_ts")))
    first = other.groupBy("story_seq", "report").agg(F.min("first_pos").alias("p"))
    return first.select("story_seq", _at(10, F.col("p")).alias("at"), F.get(F.array(*[F.lit(r) for r in REPORTS]), F.col("report")).alias("reason"))


def with_origin_time(placed: DataFrame, public: DataFrame) -> DataFrame:
    src = public.select("story_seq", F.col("url").alias("origin_url"), F.col("ts").alias("origin_ts"))
    return placed.join(src, ["story_seq", "origin_url"], "left")


def bullet_reasons() -> list[Column]:
    """Reasons of a bullet or of one of its citations among the gathered rows; a citation without its source is a reason and not a lost row."""
    label = F.concat(F.lit("Bullet "), F.col("number").cast("string"))
    at = lambda c, pos=0: _at(13, F.col("number"), pos, c)
    stated, valid = _has("state", TEXT), _has("state", PUBLIC)
    cited, found = stated & F.col("pos").isNotNull(), stated & valid & (F.col("n") > 0)
    outside = F.exists("origins", lambda o: _outside(F.col("found_ts"), o))
    broken = ((0, BULLET_BAD_URL, cited & ~valid), (1, BULLET_ABSENT, cited & valid & ~found), (2, BULLET_UNREAD, found & ~_has("found_state", READABLE)),
              (3, BULLET_NO_DAY, found & ~_has("found_state", TIMED)), (4, BULLET_NO_TIME, found & F.col("found_ts").isNull()), (4, BULLET_OUTSIDE, found & outside))
    return [F.when(~stated, _reason(at(0), F.concat(label, F.lit(BULLET_NO_TEXT)))), F.when(stated & F.col("pos").isNull(), _reason(at(0), F.concat(label, F.lit(BULLET_NO_SOURCE)))),
            *[F.when(rule, _reason(at(c, F.col("pos")), F.concat(label, F.lit(wording)))) for c, wording, rule in broken]]


def citation_check(bullets: DataFrame, public: DataFrame) -> DataFrame:
    """One row per citation of a bullet with text: its source's metadata, valid and found."""
    cites = bullets.filter(~_blank("text")).select("story_seq", "number", F.posexplode("source_urls").alias("pos", "url"))
    meta = public.select("story_seq", "url", "access", "date_precision", "ts", F.lit(True).alias("_f"))
    return (cites.withColumn("valid", _public("url")).join(meta, ["story_seq", "url"], "left")
            .withColumn("found", F.col("valid") & F.coalesce("_f", F.lit(False))).drop("_f"))


# Bits of the state of a source or citation; above them a source's place in REPORTS.
PUBLIC, READABLE, TIMED, TEXT = 1, 2, 4, 2


def _has(state: str, bit: int) -> Column:
    return F.coalesce(F.col(state).bitwiseAND(bit) != 0, F.lit(False))


def _gathered(placed: DataFrame, sources: DataFrame, bullets: DataFrame, windows: DataFrame) -> DataFrame:
    """Sources (kind 0), citations (1; one row also for a bullet without any), stories (2, at the address of their origin) and doubled ids (3) in one
    shuffle by story, with what the checks need of each other.

    Times are read and addresses tested before the shuffle, and texts stay behind. Rows of one address meet in a window over (story, address), rows
    of one story in a window over the story: both are sorted runs of the same partition, and no list grows with the sources of a story."""
    number = bullets.schema["number"].dataType
    bit = lambda test, value: F.when(test, value).otherwise(0)
    empty = {"url": F.lit(None).cast("string"), "pos": F.lit(None).cast("long"), "number": F.lit(None).cast(number), "ts": F.lit(None).cast("timestamp"), "state": F.lit(None).cast("int"),
             "own": F.lit(None).cast(REASON), "story": F.lit(None).cast("struct<has_origin:boolean,story_start:timestamp,story_inclusive:boolean,as_of:timestamp>")}

    def rows(df: DataFrame, kind: int, **columns) -> DataFrame:
        return df.filter("story_seq IS NOT NULL").select("story_seq", F.lit(kind).cast("byte").alias("kind"), *[columns.get(c, v).alias(c) for c, v in empty.items()])

    read = sources.withColumn("ts", strict_ts("published_at"))
    state = (bit(_public("url"), PUBLIC) + bit(F.coalesce("access", F.lit("")) == "readable", READABLE) + bit(F.coalesce("date_precision", F.lit("")) == "time", TIMED)
             + F.coalesce(_report(), F.lit(len(REPORTS))) * 8)
    cites = bullets.select("story_seq", "number", "text", F.posexplode_outer("source_urls").alias("pos", "url"))
    own = F.struct("has_origin", "story_start", "story_inclusive", "as_of")
    every = (rows(read, 0, url=F.col("url"), pos=F.col("pos").cast("long"), ts=F.col("ts"), state=state)
             .unionByName(rows(cites, 1, url=F.col("url"), pos=F.col("pos").cast("long"), number=F.col("number"), state=bit(_public("url"), PUBLIC) + bit(~_blank("text"), TEXT)))
             .unionByName(rows(placed, 2, url=F.col("origin_url"), own=story_reasons(windows), story=own))
             .unionByName(rows(_doubled(placed), 3, own=_packed([_reason(_at(2), ID_DUPLICATED)]))).repartition("story_seq"))
    address, story = Window.partitionBy("story_seq", "url"), Window.partitionBy("story_seq")
    source = every.withColumn("public", (F.col("kind") == 0) & _has("state", PUBLIC))
    place = F.when(F.col("public"), F.col("pos"))
    met = source.withColumns({"n": F.count(F.when(F.col("public"), 1)).over(address), "first_pos": F.min(place).over(address), "found_ts": F.max_by("ts", place).over(address),
                              "found_state": F.max_by("state", place).over(address), "cited": F.bool_or(F.col("kind") == 1).over(address)})
    origin = F.when(F.col("kind") == 2, F.struct(F.col("url").alias("origin_url"), F.col("found_ts").alias("origin_ts"), "story.*"))
    return met.withColumns({"origins": F.collect_set(origin).over(story), "bulleted": F.bool_or(F.col("kind") == 1).over(story)}).select("*", "story.*")


def place_stories(stories: DataFrame, windows: DataFrame, start, as_of) -> DataFrame:
    """Stories with their windows, written to the shared folder: what they are made of is read once."""
    return written_table(story_windows(stories.withColumn("has_origin", F.coalesce("has_origin", F.lit(False))), windows, start, as_of), "placed")


def validate_placed(placed: DataFrame, sources: DataFrame, bullets: DataFrame, windows: DataFrame) -> DataFrame:
    """``placed`` with reasons, in the order of the checks and each once, and status ready or hold.

    A missing list of citations is an empty one: an uncited claim is held."""
    bullets = bullets.withColumn("source_urls", F.coalesce("source_urls", F.array().cast("array<string>")))
    rows = _gathered(placed, sources, bullets, windows)
    found = F.col("n") > 0
    unread = ~_has("found_state", READABLE) | ~_has("found_state", TIMED)
    of_story = [*_origin_rules(found, unread, F.col("found_ts")), F.when(~F.col("bulleted"), _reason(_at(11), NO_BULLET)),
                F.when(F.col("has_origin") & F.col("url").isNotNull() & ~F.col("cited"), _reason(_at(12), ORIGIN_UNCITED))]
    kind = F.col("kind")
    reasons = F.when(kind == 0, _packed(source_reasons())).when(kind == 1, _packed(bullet_reasons())).when(kind == 2, F.concat("own", _packed(of_story))).otherwise(F.col("own"))
    # A reason at several places stays at its first; then a story lists its reasons.
    first = rows.select("story_seq", F.explode(reasons).alias("r")).groupBy("story_seq", "r.reason").agg(*[F.min(f"r.at.{f}").alias(f) for f in ("part", "a", "b", "c")])
    listed = first.groupBy("story_seq").agg(F.sort_array(F.collect_list(F.struct(F.struct("part", "a", "b", "c").alias("at"), "reason"))).alias("r"))
    df = placed.join(listed, "story_seq", "left")
    none = F.array().cast("array<string>")
    return df.withColumn("reasons", F.coalesce("r.reason", none)).drop("r").withColumn("composition_status", F.when(F.size("reasons") == 0, "ready").otherwise("hold"))


def validate_stories(stories: DataFrame, sources: DataFrame, bullets: DataFrame, windows: DataFrame, start, as_of) -> DataFrame:
    """Stories with reasons and status, see ``validate_placed``."""
    done = validate_placed(place_stories(stories, windows, start, as_of), sources, bullets, windows)
    return done.select(*stories.columns, "reasons", "composition_status")


def composition_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if(F.col("composition_status") == "ready").alias("ready_count"),
                         F.count_if(F.col("composition_status") == "hold").alias("held_count"))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def top_stories(requested: DataFrame, validated: DataFrame) -> DataFrame:
    """The first two distinct requested ids that are ready, in the order asked. ``requested`` holds
    (pos, id); only TOP_STORIES of them leave the sort."""
    asked = requested.groupBy("id").agg(F.min("pos").alias("pos")).orderBy("pos").limit(TOP_STORIES)
    ready = validated.filter("composition_status = 'ready'")
    return ready.join(F.broadcast(asked), "id").select("pos", "id", "story_seq")


def edition_layout(validated: DataFrame) -> DataFrame:
    """Index and detail rows of the ready stories in print order: section, then story.

    ``line`` orders by (part, section, story); no global numbering is needed to print."""
    order = F.create_map(*[x for i, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(i))])
    ready = validated.filter("composition_status = 'ready'").withColumn("section_no", F.try_element_at(order, F.col("category"))).filter("section_no IS NOT NULL")
    lead = F.coalesce(F.try_element_at("tickers", F.lit(1)), F.upper("company"))
    index = ready.select(F.lit("index").alias("part"), "section_no", "story_seq", F.col("category").alias("section"), lead.alias("label"), "headline")
    detail = ready.select(F.lit("story").alias("part"), "section_no", "story_seq", F.col("category").alias("section"),
                          F.when(F.size("tickers") > 0, F.concat(F.array_join("tickers", " / "), F.lit("    "), F.upper("company"))).otherwise(F.upper("company")).alias("label"),
                          "headline")
    return index.unionByName(detail)


def citation_numbers(bullets: DataFrame, public: DataFrame) -> DataFrame:
    """Source numbers of a story in order of first citation, and whether they are printed: only when the
    story has several sources and its bullets do not all cite the same ones."""
    cites = bullets.select("story_seq", "number", F.posexplode("source_urls").alias("pos", "url")).join(public.select("story_seq", "url"), ["story_seq", "url"])
    first = cites.groupBy("story_seq", "url").agg(F.min(F.struct("number", "pos")).alias("at"))
    # Sources of one story, each once: a list as long as the story's own source list.
    listed = first.groupBy("story_seq").agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("l"))
    sets = bullets.select("story_seq", F.array_join(F.array_sort(F.array_distinct("source_urls")), "\n").alias("k")).groupBy("story_seq").agg(F.count_distinct("k").alias("n_sets"))
    df = listed.join(sets, "story_seq").withColumn("numbered", (F.col("n_sets") > 1) & (F.size("l") > 1))
    return df.select("story_seq", "numbered", F.posexplode("l").alias("i", "x")).select("story_seq", (F.col("i") + 1).alias("source_number"), "x.url", "numbered")


def calendar_rows(events: DataFrame) -> DataFrame:
    """Calendar display with its fallbacks."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    return events.select(
        "id", F.coalesce(text("label"), text("company"), F.lit("Event awaiting identification")).alias("label"),
        *[F.coalesce(text(c) if c in events.columns else F.lit(None).cast("string"), F.lit(without)).alias(c) for c, without in (("event_type", ""), ("timezone", ""), ("source_name", "Source"))],
        F.coalesce(text("event_date"), F.lit("Date unconfirmed")).alias("event_date"),
        F.concat(F.coalesce(text("time_status"), F.lit("Unconfirmed")), F.lit(" / "), F.coalesce(text("status"), F.lit("Status unchecked"))).alias("status"),
        F.when(urls.is_public_url("source_url"), F.col("source_url")).otherwise("Source missing").alias("source"),
        F.concat(F.lit("Checked: "), F.coalesce(text("checked_at"), F.lit("Not recorded"))).alias("checked"))


def screen_calendar(events: DataFrame, as_of, tz: str = DESK_ZONE, days: int = 7) -> DataFrame:
    """Scheduled events from the edition's local day through the next seven. ``event_date`` is an ISO day
    or a full timestamp; a timestamp counts on its local day."""
    today = F.to_date(F.from_utc_timestamp(as_of, tz))
    stamp = strict_ts("event_date")
    day = F.coalesce(F.to_date(F.from_utc_timestamp(stamp, tz)), F.col("event_date").try_cast("date"))
    return events.withColumn("event_day", day).filter((F.col("status") == "scheduled") & F.col("event_day").between(today, F.date_add(today, days)))


# Wording of the review notes and audit states.
ACCESS_NOTES = {"restricted": "Restricted article — public headline or metadata only.",
                "metadata_only": "Public headline or metadata only; article text unverified.",
                "unavailable": "Article unavailable; its contents remain unverified."}
DATE_NOTE = "Publication time needs checking before inclusion in this edition."
UNDATED = ("day", "date", "month", "year", "missing", "unknown")
AUDIT_STATES = {
    "candidate": "Candidate retained", "selected": "Candidate retained", "retained": "Candidate retained", "old": "Outside time window",
    "future": "Future timestamp — held", "undated": "Date unconfirmed", "no_signal": "No event signal detected", "unmatched": "No event signal detected",
    "duplicate": "Duplicate", "unchanged": "Already seen", "article_limit": "Article check limit reached", "fetch_failed": "Article check failed",
    "logged": "Headline recorded"}


def review_notes(flags="flags") -> Column:
    """Notes an editor sees: access, language, date, then the flags that are not yet listed."""
    code = F.lower(F.coalesce("language", F.lit("")))
    notes = F.create_map(*[F.lit(x) for pair in ACCESS_NOTES.items() for x in pair])
    own = F.array_compact(F.array(
        F.try_element_at(notes, F.col("access_status")),
        F.when((code != "") & ~F.startswith(code, F.lit("en")), F.concat(F.lit("Original language: "), language_label(code), F.lit(" — English summary needed."))),
        F.when(F.col("published").isNull() | F.coalesce("date_precision", F.lit("")).isin(*UNDATED), DATE_NOTE)))
    return F.array_distinct(F.concat(own, F.coalesce(F.col(flags), F.array().cast("array<string>"))))


def candidate_state(tickers="tickers", eligible="eligible") -> Column:
    return (F.when(F.size(F.col(tickers)) == 0, "Company/ticker review required").when(F.col(eligible), "Draft candidate — review required")
            .otherwise("Held for review"))


def audit_state(stage) -> Column:
    names = F.create_map(*[F.lit(x) for pair in AUDIT_STATES.items() for x in pair])
    value = F.coalesce(F.nullif(F.col(stage), F.lit("")), F.lit("logged"))
    return F.coalesce(F.try_element_at(names, value), F.replace(value, F.lit("_"), F.lit(" ")))


def review_rows(validated: DataFrame, placed_origin: DataFrame) -> DataFrame:
    """Editor rows: status of the story and of its origin, with the original publication in UTC and
    Singapore time, the source of the origin and what is recorded of its development, timestamp and chronology."""
    when = placed_origin.select("story_seq", "origin_ts")
    df = validated.join(when, "story_seq", "left")
    local = F.date_format(F.from_utc_timestamp("origin_ts", DESK_ZONE), "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    stated = lambda name: F.nullif(F.col(name) if name in df.columns else F.lit(None).cast("string"), F.lit(""))
    recorded = [F.coalesce(stated(f"origin_{name}"), F.lit(NOT_RECORDED)).alias(name) for name in ORIGIN_FIELDS]
    source = F.when(urls.is_public_url("origin_url"), F.col("origin_url")) if "origin_url" in df.columns else F.lit(None).cast("string")
    return df.select("story_seq", F.coalesce(F.nullif("headline", F.lit("")), F.col("id")).alias("title"), "composition_status", source.alias("origin_source"), F.coalesce(stated("origin_kind"), F.lit("")).alias("origin_kind"), *recorded,
                     F.coalesce(F.nullif("origin_status", F.lit("")), F.lit("missing")).alias("origin_status"),
                     F.coalesce(iso("origin_ts"), F.lit("unverified")).alias("original_publication"), F.coalesce(local, F.lit("unverified")).alias("singapore"))
