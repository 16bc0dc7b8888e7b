"""Date parsing.  ``ref_now`` is always an argument (a Python datetime), never the clock."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .patterns import blank_to_null, grab, let, lines, matches, replace, strip, text, unicode_regex
from .text import ascii_digits

# fixed values: date patterns
DAY_FIRST = (r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(?:(?:-|–|to|&|and|,)\s*(?:\d{1,2}(?:st|nd|rd|th)?\s*(?:-|–|to|&|and|,)"
             r"\s*)?\d{1,2}(?:st|nd|rd|th)?\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b")
MONTH_FIRST = (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+(\d{1,2})(?:st|nd|rd|th)?(?!:)\b")
CLOCK = r"\b(\d{1,2}:\d{2}\s*(?:AM|PM|am|pm)?)\b"
YEAR = r"\b(202[0-9])\b"
ISO = (r"^(\d{4})-(\d{2})-(\d{2})(?:[T\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(Z|UTC|[+-]\d{2}:?(?:\d{2})?)?)?$")
RANGE_CROSS = r"\b\d{1,2}\s+([a-z]{3,9})\s+(?:to|-|–)\s*(\d{1,2})\s+([a-z]{3,9})\b"
RANGE_THREE = r"(\d{1,2})\s*(?:-|–|,|&|and)\s*(\d{1,2})\s*(?:-|–|,|&|and)\s*(\d{1,2})\s+([a-z]{3,9})"
RANGE_TWO = r"(\d{1,2})\s*(?:-|–|to|&|and|,)\s*(\d{1,2})\s+([a-z]{3,9})"
RANGE_MONTH = (r"\b([a-z]{3,9})\s+\d{1,2}(?:st|nd|rd|th)?\s*(?:,\s*\d{1,2}\s*)?(?:-|–|to|&|and|,)\s*"
               r"(?:([a-z]{3,9})\s+)?(\d{1,2})(?:st|nd|rd|th)?\b")
SINGLE_DAY = r"(\d{1,2})\s+([a-z]{3,9})"
SINGLE_MONTH = r"([a-z]{3,9})\s+(\d{1,2})"
SOURCE_MONTH = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+(\d{1,2})\b"
SOURCE_DAY = (r"\b(\d{1,2})(?:st|nd|rd|th)?\s*(?:to\s*\d{1,2}(?:st|nd|rd|th)?\s*)?"
              r"(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\b")
SOURCE_CLOCK = r"(\d{1,2}):(\d{2})\s*(PM|AM)?"
CAPTION_ISO = r"\b(202[6-9])[/-](\d{1,2})[/-](\d{1,2})\b"
CAPTION_DMY = r"\b(\d{1,2})[/-](\d{1,2})[/-](202[6-9]|\d{2})\b"


def ntz(moment: datetime) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{moment:%Y-%m-%d %H:%M:%S.%f}'")


def day(moment: datetime) -> Column:
    return F.expr(f"DATE '{moment:%Y-%m-%d}'")


def _int(col: Column) -> Column:
    return col.try_cast("int")


def month_number(name: Column) -> Column:
    """Month of a name by its first three letters, NULL when it is none."""
    key = F.lower(F.substring(name, 1, 3))
    out = None
    for i, m in enumerate(lx.MONTHS, 1):
        out = F.when(key == m, F.lit(i)) if out is None else out.when(key == m, F.lit(i))
    return out


def _ts(y: Column, m: Column, d: Column, hh: Column, mi: Column, ss: Column | None = None) -> Column:
    return F.try_make_timestamp_ntz(_int(y), _int(m), _int(d), _int(hh), _int(mi),
                                    (ss if ss is not None else F.lit(0)).cast("decimal(16,6)"))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y.cast("string"), m.cast("string"), d.cast("string")), "yyyy-M-d")


def _same_or_roll(made: Column, has_year: Column, ref_now: datetime) -> Column:
    """A date without a year that lies more than 60 whole days back belongs to next year."""
    old = ntz(ref_now - timedelta(days=61))

    def roll(ts: Column) -> Column:
        nxt = _ts(F.year(ts) + 1, F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts))
        return F.when(~has_year & (ts <= old), nxt).otherwise(ts)

    return let(made, roll)


def _iso(c: Column) -> Column:
    def g(i):
        return grab(c, ISO, i)

    def shifted(zone: Column) -> Column:
        local = _ts(g(1), g(2), g(3), F.coalesce(_int(g(4)), F.lit(0)), F.coalesce(_int(g(5)), F.lit(0)),
                    F.coalesce(_int(g(6)), F.lit(0)))
        sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        minutes = (F.coalesce(_int(F.substring(zone, 2, 2)), F.lit(0)) * 60
                   + F.coalesce(_int(F.substring(zone, 4, 2)), F.lit(0)))
        gap = F.make_dt_interval(F.lit(0), F.lit(0), F.when(zone.rlike("^[+-]"), sign * minutes).otherwise(F.lit(0)),
                                 F.lit(0).cast("decimal(18,6)"))
        return local - gap

    return let(F.replace(g(7), F.lit(":"), F.lit("")), shifted)


def _without_clock(c: Column) -> Column:
    """The text with its first clock time, zone names, bullets and fillers taken out."""
    rx = unicode_regex(CLOCK, ignore_case=False)
    norm = let(F.regexp_instr(c, F.lit(rx)), lambda at: F.when(
        at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(" "),
                         F.substr(c, at + F.length(F.regexp_extract(c, rx, 1)), F.length(c)))).otherwise(c))
    norm = F.regexp_replace(norm, "[•·|]+", " ")
    norm = replace(norm, r"\+\s*\d+\s*more\b", " ")
    norm = replace(norm, rf"\b({'|'.join(lx.ZONE_NAMES)})\b", " ")
    norm = replace(norm, r"\b(from|starting|on|at)\b", " ")
    return strip(F.regexp_replace(norm, r"\s+", " "))


def _clock(c: Column) -> Column:
    """Hour and minute written in the text, 9:00 when there is none."""
    def read(clock: Column) -> Column:
        hh = _int(F.substring_index(clock, ":", 1))
        half = F.lower(F.regexp_extract(clock, "(?i)([ap]m)", 1))
        hour = (F.when((half == "pm") & (hh < 12), hh + 12).when((half == "am") & (hh == 12), F.lit(0)).otherwise(hh))
        return F.struct(F.coalesce(hour, F.lit(9)).alias("h"),
                        F.coalesce(_int(F.regexp_extract(clock, ":([0-9]{2})", 1)), F.lit(0)).alias("m"))

    return let(F.regexp_extract(c, unicode_regex(CLOCK, ignore_case=False), 1), read)


_NUMERIC = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-](20[0-9]{2})$"


def parse_datetime(col: Column, ref_now: datetime) -> Column:
    """General date parser for display texts: ISO, relative words, day-first and month-first
    dates and ranges (their first day), an optional clock time, an optional year.

    Texts that hold none of these give NULL; plain numeric dates ``a/b/yyyy`` are read month first
    unless that is impossible.
    """
    ten = ref_now.replace(hour=10, minute=0, second=0, microsecond=0)
    df_rx, mf_rx = unicode_regex(DAY_FIRST), unicode_regex(MONTH_FIRST)

    def dated(p: Column) -> Column:
        norm, year, clock = p["norm"], p["year"], p["clock"]
        made = F.when(
            p["day_first"], _ts(year, month_number(F.regexp_extract(norm, df_rx, 2)),
                                F.regexp_extract(norm, df_rx, 1), clock["h"], clock["m"])
        ).when(p["month_first"], _ts(year, month_number(F.regexp_extract(norm, mf_rx, 1)),
                                     F.regexp_extract(norm, mf_rx, 2), clock["h"], clock["m"]))
        a, b, ny = (_int(F.regexp_extract(norm, _NUMERIC, i)) for i in (1, 2, 3))
        numeric = _ts(ny, F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b), clock["h"], clock["m"])
        return F.when(p["day_first"] | p["month_first"], _same_or_roll(made, p["has_year"], ref_now)).otherwise(numeric)

    def located(p: Column) -> Column:
        d, m = p["d"], p["m"]
        first = (d > 0) & ((m == 0) | (d <= m))
        return dated_struct(p, first, (m > 0) & ~first)

    def dated_struct(p: Column, first: Column, second: Column) -> Column:
        return let(F.struct(p["norm"].alias("norm"), p["year"].alias("year"), p["has_year"].alias("has_year"),
                            p["clock"].alias("clock"), first.alias("day_first"), second.alias("month_first")), dated)

    def worded(c: Column) -> Column:
        with_year = let(_int(grab(c, YEAR, 1)), lambda y: F.struct(
            F.coalesce(y, F.lit(ref_now.year)).alias("year"), y.isNotNull().alias("has_year")))
        return let(F.struct(_without_clock(c).alias("norm"), with_year.alias("y"), _clock(c).alias("clock")), lambda p: let(
            F.struct(p["norm"].alias("norm"), p["y"]["year"].alias("year"), p["y"]["has_year"].alias("has_year"),
                     p["clock"].alias("clock"), F.regexp_instr(p["norm"], F.lit(df_rx)).alias("d"),
                     F.regexp_instr(p["norm"], F.lit(mf_rx)).alias("m")), located))

    def parsed(c: Column) -> Column:
        low = F.lower(c)
        return (F.when((c == "") | low.isin(*lx.UNDATED_WORDS), F.lit(None).cast("timestamp_ntz"))
                .when(low.isin(*lx.TODAY_WORDS), ntz(ten))
                .when(low == "tomorrow", ntz(ten + timedelta(days=1)))
                .when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.coalesce(_iso(c), worded(c)))
                .when(c.rlike("[0-9]"), worded(c)))

    return let(strip(text(col)), parsed)


def display_end(col: Column, default_year: int, client: bool = False) -> Column:
    """Concluding date of a display text; six range forms tried in order."""
    single_month = SINGLE_MONTH + ("(?!:)" if client else "")

    def attempts(p: Column) -> Column:
        s, year = p["s"], p["year"]

        def attempt(pattern: str, month: int, number: int, other: int | None = None) -> Column:
            name = grab(s, pattern, month)
            if other is not None:
                name = F.when(name == "", grab(s, pattern, other)).otherwise(name)
            return F.when(matches(s, pattern), _date(year, month_number(name), grab(s, pattern, number)))

        return F.coalesce(attempt(RANGE_CROSS, 3, 2), attempt(RANGE_THREE, 4, 3), attempt(RANGE_TWO, 3, 2),
                          attempt(RANGE_MONTH, 2, 3, 1), attempt(SINGLE_DAY, 2, 1), attempt(single_month, 1, 2))

    low = F.lower(text(col))
    if client:
        low = replace(low, r"\b\d{1,2}:\d{2}\s*(?:am|pm)?\b", " ")
    return let(low, lambda s: F.when(s.rlike("[0-9]"), let(F.struct(
        s.alias("s"), F.coalesce(_int(grab(s, YEAR, 1)), F.lit(default_year)).alias("year")), attempts)))


def source_date(col: Column, year: int) -> Column:
    """Ticket-feed dates: month-day at 20:00 or at the given hour, day-month at 18:00."""
    def read(c: Column) -> Column:
        hh, half = _int(grab(c, SOURCE_CLOCK, 1)), F.lower(grab(c, SOURCE_CLOCK, 3))
        hour = F.coalesce(F.when((half == "pm") & (hh < 12), hh + 12).otherwise(hh), F.lit(20))
        first = _ts(F.lit(year), month_number(grab(c, SOURCE_MONTH, 1)), grab(c, SOURCE_MONTH, 2), hour, F.lit(0))
        second = _ts(F.lit(year), month_number(grab(c, SOURCE_DAY, 2)), grab(c, SOURCE_DAY, 1), F.lit(18), F.lit(0))
        return F.when(matches(c, SOURCE_MONTH), first).otherwise(second)

    return let(text(col), read)


def _label(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy")


def _arabic(norm: Column, ref_now: datetime, client: bool) -> Column:
    def attempt(name: str, number: int) -> Column:
        edge, y = ("", "202[6-9]") if client else (r"\b", r"\d{4}")
        rx = (rf"{edge}(\d{{1,2}})(?:\s*(?:-|إلى|الى|و)\s*\d{{1,2}})?\s+(?:من\s+)?(?:شهر\s+)?{name}(?:\s+({y}))?")

        def made(p: Column) -> Column:
            this = _ts(F.coalesce(p["y"], F.lit(ref_now.year)), F.lit(number), p["d"], F.lit(10), F.lit(0))
            nxt = _ts(F.lit(ref_now.year + 1), F.lit(number), p["d"], F.lit(10), F.lit(0))
            if client:
                return this
            return let(this, lambda t: F.when(p["y"].isNull() & (F.to_date(t) < day(ref_now)), nxt).otherwise(t))

        return F.when(norm.contains(name), let(F.struct(_int(grab(norm, rx, 1)).alias("d"),
                                                        _int(grab(norm, rx, 2)).alias("y")), made))

    return F.coalesce(*(attempt(name, number) for name, number in lx.ARABIC_MONTHS))


def caption_datetime(col: Column, ref_now: datetime) -> Column:
    """Date of a caption: Arabic month, numeric forms, then English dates line by line.

    Gives a struct ``(start_date, date_display)``; both NULL when there is none.
    """
    month = rf"\b({'|'.join(lx.MONTHS)})[a-z]*\b"

    def read(norm: Column) -> Column:
        def numeric(pattern, y, m, d):
            year = let(_int(grab(norm, pattern, y)), lambda v: F.when(v < 100, v + 2000).otherwise(v))
            return F.when(matches(norm, pattern), _ts(year, grab(norm, pattern, m), grab(norm, pattern, d), F.lit(10),
                                                      F.lit(0)))

        dated = F.filter(lines(norm), lambda ln: matches(ln, month) & matches(ln, r"\b\d{1,2}\b"))
        english = F.filter(F.transform(dated, lambda ln: parse_datetime(ln, ref_now)), lambda t: t.isNotNull())
        return F.coalesce(_arabic(norm, ref_now, False), numeric(CAPTION_ISO, 1, 2, 3), numeric(CAPTION_DMY, 3, 2, 1),
                          F.get(english, F.lit(0)))

    return let(let(ascii_digits(col), read), lambda t: F.struct(t.alias("start_date"), _label(t).alias("date_display")))


def client_caption_date(col: Column, ref_now: datetime) -> Column:
    """Client variant: Arabic months without year roll, then the first English date; whole days."""
    mf = (r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{1,2})(?:st|nd|rd|th)?"
          r"(?:\s*[-–]\s*\d{1,2})?(?:,?\s*(202[6-9]))?")
    df = (r"\b(\d{1,2})(?:st|nd|rd|th)?\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
          r"(?:,?\s*(202[6-9]))?")

    def read(norm: Column) -> Column:
        def made(rx, m, d):
            year = F.coalesce(_int(grab(norm, rx, 3)), F.lit(ref_now.year))
            return _ts(year, month_number(grab(norm, rx, m)), grab(norm, rx, d), F.lit(0), F.lit(0))

        english = F.when(matches(norm, mf), made(mf, 1, 2)).otherwise(made(df, 2, 1))
        return F.to_date(F.coalesce(_arabic(norm, ref_now, True), english))

    return let(ascii_digits(col), read)


def dates_compatible(a: Column, b: Column) -> Column:
    """Within four days of each other; an unknown date is compatible with any."""
    four = F.expr(f"INTERVAL {lx.COMPAT_SECONDS} SECONDS")
    return a.isNull() | b.isNull() | ((a <= b + four) & (b <= a + four))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    clock = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000
    return (F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + clock
            + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def week_key(ts: Column) -> Column:
    """Year and week of the year, weeks starting on Monday, week 0 before the first one."""
    week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def tear_off(col: Column) -> Column:
    """Month and day for a calendar badge as a struct."""
    up = F.upper(text(col))
    month, num = None, None
    for m in (x.upper() for x in lx.MONTHS):
        d = F.coalesce(blank_to_null(F.regexp_extract(up, rf"{m}\s*([0-9]{{1,2}})", 1)),
                       blank_to_null(F.regexp_extract(up, rf"([0-9]{{1,2}})\s*{m}", 1)), F.lit("15"))
        hit, d = up.contains(m), F.lpad(d, 2, "0")
        month = F.when(hit, F.lit(m)) if month is None else month.when(hit, F.lit(m))
        num = F.when(hit, d) if num is None else num.when(hit, d)
    none = text(col) == ""
    return F.struct(F.when(none, F.lit("TBA")).otherwise(month.otherwise(F.lit("DATE"))).alias("month"),
                    F.when(none, F.lit("--")).otherwise(num.otherwise(F.lit("TBA"))).alias("day"))


def display_format(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy · hh:mm a")


def event_passed(end: Column, display: Column, start: Column, ref_now: datetime) -> Column:
    """Has the event ended?  End date, then concluding display date, then start day and six hours."""
    today, late = day(ref_now), ntz(ref_now - timedelta(hours=6))
    by_display = let(display_end(display, ref_now.year), lambda concluding: F.coalesce(
        F.when(concluding < today, True).when(start.isNull() | (concluding >= today), False)
        .when(F.to_date(start) < today, True).when((F.to_date(start) == today) & (start < late), True), F.lit(False)))
    return F.when(end < ntz(ref_now), True).otherwise(by_display)


def event_passed_by_day(end: Column, display: Column, start: Column, ref_now: datetime) -> Column:
    """Client variant: the first known of end, concluding display date and start decides by calendar day."""
    last = F.coalesce(F.to_date(end), display_end(display, ref_now.year, client=True), F.to_date(start))
    return F.coalesce(last < day(ref_now), F.lit(False))
