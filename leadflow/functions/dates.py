"""Publication dates: lenient and strict parsing, window verdicts, clock rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.text import _col, clean

# Month names, and the zone names of mail dates in minutes from UTC.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
MAIL_ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
              "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}

# Edition clocks, in Singapore time.
DESK_ZONE = "Asia/Singapore"
AFTERNOON_FLOOR = "14:10"
AFTERNOON_BOUNDARY = "12:00"
LOOKBACK_HOURS = 24
MONDAY_LOOKBACK_HOURS = 72


def iso(ts) -> Column:
    """UTC text of an instant, to the second."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_MONTH_NUMBERS = {name: n for n, month in enumerate(MONTHS, 1) for name in (month, month[:3])}
_FULL = "(" + "|".join(MONTHS) + ")"
_SHORT = "(" + "|".join(m[:3] for m in MONTHS) + ")"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?"
_TIME = r"[^0-9+-](\d{2})(?::?(\d{2})(?::?(\d{2}(?:[.,]\d{1,6})?)\d*)?)?"

# The accepted layouts. Each is rewritten to kind|year|month|day|hour|minute|second|zone.
ISO_DAY = (r"^(\d{4})-(\d{2})-(\d{2})$", "day|$1|$2|$3||||")
ISO_DIGITS = (r"^(\d{4})(\d{2})(\d{2})$", "time|$1|$2|$3||||")
ISO_TIME = (rf"^(\d{{4}})-?(\d{{2}})-?(\d{{2}}){_TIME}{_ZONE}$", "time|$1|$2|$3|$4|$5|$6|$7")
MAIL = (r"(?i)^(?:[a-z]+,?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]{0,6}[\s-]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
        r"(?:\s+([+-]\d{4}|[a-z]{1,5}))?(?:\s*\(.*\))?$", "mail|$3|$2|$1|$4|$5|$6|$7")
LENIENT_LAYOUTS = (
    (r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日$", "day|$1|$2|$3||||"),
    (r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日\s*(\d{1,2})[:時](\d{2})分?$", "time|$1|$2|$3|$4|$5||"),
    ISO_DAY, ISO_DIGITS, ISO_TIME, MAIL,
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2})[h:](\d{2})$", "time|$3|$2|$1|$4|$5||"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "day|$3|$2|$1||||"),
    (rf"(?i)^(\d{{1,2}}) {_FULL} (\d{{4}})$", "day|$3|$2|$1||||"),
    (rf"(?i)^{_FULL} (\d{{1,2}}), (\d{{4}})$", "day|$3|$1|$2||||"),
    (rf"(?i)^{_SHORT}\.? (\d{{1,2}}), (\d{{4}})$", "day|$3|$1|$2||||"),
    (r"^(\d{4})[/](\d{1,2})/(\d{1,2})$", "day|$1|$2|$3||||"),
    (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$", "day|$1|$2|$3||||"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$", "time|$1|$2|$3|$4|$5|$6|"),
)
_JA = r"(?s)^.*?(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日(?:\s*[（(][^）)]*[）)])?"
_NUMERIC = r"(?i)^(\d{4})[/.](\d{1,2})[/.](\d{1,2})"
ARTICLE_LAYOUTS = (
    (_JA + r"\s*(\d{1,2})(?::|時)(\d{1,2})(?:分)?(?::(\d{1,2}))?.*$", "time|$1|$2|$3|$4|$5|$6|+09:00"),
    (_JA + ".*$", "day|$1|$2|$3||||"),
    (_NUMERIC + r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?$", "time|$1|$2|$3|$4|$5|$6|"),
    (_NUMERIC + r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*JST$", "time|$1|$2|$3|$4|$5|$6|+09:00"),
    (_NUMERIC + r"(?:\s*JST)?$", "day|$1|$2|$3||||"),
    ISO_DAY, ISO_DIGITS, ISO_TIME, MAIL,
)


def _fields(text: Column, layouts) -> Column:
    """The eight fields of the first layout that matches, or null."""
    out = F.lit(None).cast("string")
    for pattern, template in reversed(layouts):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, template)).otherwise(out)
    return F.split(out, r"\|")


def _number(text: Column, default=None) -> Column:
    value = text.try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def _local(p: Column) -> Column:
    """Wall-clock time of the fields; null when there is no such day or hour."""
    month = F.coalesce(_number(p[2]), F.try_element_at(_literal_map(_MONTH_NUMBERS), F.lower(p[2])))
    year = _number(p[1])
    full = F.when((p[0] == "mail") & (F.char_length(p[1]) == 2), year + F.when(year > 68, 1900).otherwise(2000)).otherwise(year)
    seconds = F.coalesce(F.replace(p[6], F.lit(","), F.lit(".")).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    return F.try_make_timestamp(full, month, _number(p[3]), _number(p[4], 0), _number(p[5], 0), seconds)


def _offset(p: Column) -> Column:
    """Minutes east of UTC; null when the zone is missing or unknown."""
    digits = F.regexp_replace(p[7], "[^0-9]", "")
    signed = F.when(F.startswith(p[7], F.lit("-")), -1).otherwise(1) * (
        _number(F.substring(digits, 1, 2), 0) * 60 + _number(F.substring(digits, 3, 2), 0))
    # A mail date with "-0000" states that its zone is unknown.
    unknown = (p[0] == "mail") & (p[7] == "-0000")
    return F.when(p[7].rlike("^[+-]") & ~unknown, signed).otherwise(F.try_element_at(_literal_map(MAIL_ZONES), F.upper(p[7])))


def _utc(local: Column, offset: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60000000)


def parse_date(value, tz) -> Column:
    """Lenient parse to (ts, precision time/day/missing/unparsed); a value without a zone is
    read in ``tz`` and a missing date stays missing."""
    text = clean(value)
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    pack = lambda ts, precision: F.struct(ts.cast("timestamp").alias("ts"), precision.alias("precision"))
    kind = lambda p: F.when(p[0] == "day", "day").otherwise("time")
    parsed = _let(_fields(text, LENIENT_LAYOUTS), lambda p: _let(_local(p), lambda local: F.when(
        local.isNotNull(), pack(F.coalesce(_utc(local, _offset(p)), F.to_utc_timestamp(local, zone)), kind(p)))))
    return F.coalesce(parsed, pack(F.lit(None), F.when(text == "", "missing").otherwise("unparsed")))


def parse_article_date(value) -> Column:
    """Article-side parse to (text, precision): Japanese dates carry +09:00, a value that cannot
    be parsed keeps its wording."""
    text = clean(value)
    pack = lambda t, precision: F.struct(t.alias("text"), precision.alias("precision"))
    micros = lambda ts: F.when(F.date_format(ts, "SSSSSS") == "000000", "").otherwise(F.date_format(ts, ".SSSSSS"))
    stamp = lambda ts: F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), micros(ts))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    zone = lambda m: F.coalesce(F.concat(F.when(m < 0, "-").otherwise("+"), two(F.floor(F.abs(m) / 60)), F.lit(":"),
                                         two(F.abs(m) % 60)), F.lit(""))
    parsed = _let(_fields(text, ARTICLE_LAYOUTS), lambda p: _let(_local(p), lambda local: F.when(
        local.isNull(), F.lit(None)).when(p[0] == "day", pack(F.date_format(local, "yyyy-MM-dd"), F.lit("day")))
        .otherwise(pack(F.concat(stamp(local), zone(_offset(p))), F.lit("time")))))
    return F.coalesce(parsed, pack(text, F.when(text == "", "missing").otherwise("unparsed")))


def strict_ts(value) -> Column:
    """Instant of a full ISO timestamp; null unless it holds a 'T' and a zone."""
    text = F.coalesce(_col(value), F.lit(""))
    # The usual layout is read by Spark's own cast; the rarer ISO layouts go through their fields.
    usual = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})$")
    other = F.when(~usual & F.contains(text, F.lit("T")), text)
    return F.when(usual, text.try_cast("timestamp")).otherwise(
        _let(_fields(other, (ISO_TIME,)), lambda p: _utc(_local(p), _offset(p))).cast("timestamp"))


def window_verdict(ts, precision, start, as_of, inclusive) -> Column:
    """current / old / future / date_needs_review. The end of a window is inclusive; a day is an
    interval and can prove only that it lies outside."""
    when, first, last = _col(ts), _col(start), _col(as_of)
    open_start = _col(inclusive) if not isinstance(inclusive, bool) else F.lit(inclusive)
    return (F.when(when.isNull(), "date_needs_review").when(when > last, "future")
            .when(_col(precision) == "day",
                  F.when(when + F.expr("INTERVAL 1 DAY") <= first, "old").otherwise("date_needs_review"))
            .when((when > first) | (open_start & (when == first)), "current").otherwise("old"))


def edition_kind(as_of, mode="auto", boundary: str = AFTERNOON_BOUNDARY) -> Column:
    """morning or afternoon: as asked, or by the Singapore clock."""
    asked = F.lit(mode) if isinstance(mode, str) else mode
    late = F.date_format(F.from_utc_timestamp(_col(as_of), DESK_ZONE), "HH:mm:ss") >= F.lit(boundary if len(boundary) == 8 else boundary + ":00")
    return F.when(asked != "auto", asked).when(late, "afternoon").otherwise("morning")


def lookback_hours(as_of, explicit=None, tz: str = DESK_ZONE, normal: int = LOOKBACK_HOURS, monday: int = MONDAY_LOOKBACK_HOURS) -> Column:
    """Hours a rolling edition looks back: as asked, longer on Mondays."""
    local = F.from_utc_timestamp(_col(as_of), tz)
    default = F.when(F.weekday(local) == 0, monday).otherwise(normal)
    return default if explicit is None else F.coalesce(_col(explicit), default)


def timing_conflict(text, as_of, tz: str = DESK_ZONE) -> Column:
    """A morning edition that quotes an 'after market close' event of today or later."""
    local = F.from_utc_timestamp(_col(as_of), tz)
    pattern = r"(?i)\bOn (\d{1,2}) ([A-Za-z]{3}) after market close\b"
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(0))
    one = r"(?i)^On (\d{1,2}) ([A-Za-z]{3}) "
    dates = F.transform(found, lambda m: F.to_date(F.try_make_timestamp(
        F.year(local), F.try_element_at(_literal_map(_MONTH_NUMBERS), F.lower(F.regexp_extract(m, one, 2))),
        _number(F.regexp_extract(m, one, 1)), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))))
    return (F.hour(local) < 12) & F.exists(dates, lambda d: F.coalesce(d >= F.to_date(local), F.lit(False)))


def window_days(start, as_of, tz: str) -> Column:
    """Local days a window touches, in order."""
    first = F.to_date(F.from_utc_timestamp(_col(start), tz))
    return F.sequence(first, F.to_date(F.from_utc_timestamp(_col(as_of), tz)))
