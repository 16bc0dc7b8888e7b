"""Titles, cities, sources, dates and expiry on small fixtures with a fixed clock."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import text as T
from eventloom.operators.quality import date_window, reject_reason, repair_fields
from eventloom.schema import event_frame

NOW = datetime(2026, 9, 19, 15, 0)


def col(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, s {kind}").orderBy("i").select(fn(F.col("s"))).collect()]


def test_clean_title(spark):
    noisy = "Thu, Jun 11 · 10:00 AM\nCairo Tech Meetup\n1.4K interested · 51 went\nInterested"
    got = col(spark, [noisy, "RiseUp Summit 2026", "Interested", "328 interested · 44 going", "104 interested · 9 going"],
              T.clean_title)
    assert got == ["Cairo Tech Meetup", "RiseUp Summit 2026", "", "", ""]


def test_source_list(spark):
    got = col(spark, ["AllEvents, Eventbrite, AllEvents, Eventbrite, TicketsMarche", ""], T.unique_sources)
    assert got == ["AllEvents, Eventbrite, TicketsMarche", "Unlisted source"]


def test_arabic_titles_survive(spark):
    assert col(spark, ["قمة القاهرة، 2026"], T.comparison_title) == ["قمة القاهرة 2026"]


def test_city_names(spark):
    rows = spark.createDataFrame([("port-said", "x", "y"), ("looll", "", ""), ("Qena", "October fair", "")],
                                 "c string, t string, l string")
    both = rows.select(T.city_name(F.col("c"), F.col("t"), F.col("l")).alias("a"),
                       T.city_name(F.col("c"), F.col("t"), F.col("l"), strict=True).alias("b")).collect()
    assert [tuple(r) for r in both] == [("Port Said", "Port Said"), ("Cairo", "Cairo"), ("Giza", "Qena")]


@pytest.mark.parametrize("shown,want", [
    ("Sun, 25 Oct • 07:00 PM + 1 more", datetime(2026, 10, 25, 19)), ("Oct 29 - 31, 2026 · 09:00 AM", datetime(2026, 10, 29, 9)),
    ("Nov 12,13 & 14 · 08:00 PM", datetime(2026, 11, 12, 20)), ("2026-10-15T10:00:00+02:00", datetime(2026, 10, 15, 8)),
    ("tomorrow", datetime(2026, 9, 20, 10)), ("TBA", None), ("31 Feb 2026", None), ("05 Jan", datetime(2027, 1, 5, 9)),
    ("whenever it rains", None), ("12:30 AM, Dec 3", datetime(2026, 12, 3, 0, 30))])
def test_parse_datetime(spark, shown, want):
    assert col(spark, [shown], lambda c: D.parse_datetime(c, NOW)) == [want]


def test_passed(spark):
    df = event_frame(spark, [
        dict(event_id="p1", start_date=datetime(2026, 9, 18, 10)), dict(event_id="f1", start_date=datetime(2026, 9, 20, 10)),
        dict(event_id="pr1", date_display="6-8 September 2026"), dict(event_id="ar1", date_display="17-20 Sep 2026"),
        dict(event_id="h1", start_date=datetime(2026, 9, 19, 8, 59)), dict(event_id="h2", start_date=datetime(2026, 9, 19, 9, 0))])
    got = df.orderBy("seq").select(D.event_passed(F.col("end_date"), F.col("date_display"), F.col("start_date"), NOW)).collect()
    assert [r[0] for r in got] == [True, False, True, False, True, False]


def test_window(spark):
    df = event_frame(spark, [dict(event_id=str(d), start_date=NOW + timedelta(days=d)) for d in (-10, 45, 250)])
    assert [r["event_id"] for r in date_window(df, NOW).collect()] == ["45"]


def test_week_key_equals_strftime(spark):
    days = [datetime(2019, 12, 25) + timedelta(days=i) for i in range(1500)]
    got = col(spark, days, D.week_key, "timestamp_ntz")
    assert got == [d.strftime("%Y-W%W") for d in days]


def test_repair_date_in_location(spark):
    df = event_frame(spark, [dict(event_id="t", title="Omar Khairat", date_display="Omar Khairat", location="15 - 16 Oct 2026",
                                  city="Cairo", url="https://x.org/1")])
    r = repair_fields(df, NOW).first()
    assert (r["date_display"], r["location"], r["start_date"]) == ("15 - 16 Oct 2026", "Cairo Cultural Hub", datetime(2026, 10, 15, 9))
    assert repair_fields(repair_fields(df, NOW), NOW).first() == r


def test_reject_reasons(spark):
    df = event_frame(spark, [
        dict(title="Valid Title", url="https://www.facebook.com/events/"), dict(title="Valid Title", url="#"),
        dict(title="Oktoberfest 5k", url="https://a.in/1", location="3950 Wheeler Ave, Alexandria, VA 22304, United States"),
        dict(title="Bibliotheca Alexandrina Youth Tech Forum", url="https://a.in/2", location="Chatby, Alexandria, Egypt")])
    got = [r[0] for r in df.orderBy("seq").select(reject_reason()).collect()]
    assert got == ["link", "link", "foreign", None]


def test_patterns_read_as_before(spark):
    """Shared beginnings of phrases and word edges looked at early change no match."""
    import re

    from eventloom import lexicon as lx
    from eventloom.functions import dates, patterns

    phrases = ["ai", "air show", "air", "job fair", "c&v", "women's day", "ملتقى", "ملتقى التوظيف", "web-site", r"24\s*hours?"]
    texts = ["AI", "said", "air  show!", "airs", "a job\nfair", "a jobfair", "C&V here", "Women's Day", "هذا ملتقى كبير", "الملتقى", "web-sites", "web-site", "24 hour",
             "24hoursx", "", "fair", "job", "xair show", "show air", "AİR"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for whole in (True, False):
        got = [r[0] for r in rows.select(patterns.has_phrase(F.col("t"), phrases, whole)).collect()]
        assert got == [r[0] for r in rows.select(F.col("t").rlike(patterns.phrase_regex(phrases, whole))).collect()]
    for words in (lx.TRIGGER_WORDS, lx.MEDICAL, lx.SUMMIT, lx.LEISURE):
        sample = rows.union(spark.createDataFrame([(f"x {w.replace(' ', '  ')}, y",) for w in words] + [(f"x{w}y",) for w in words], "t string"))
        assert sample.where(patterns.has_phrase(F.col("t"), words) != F.col("t").rlike(patterns.phrase_regex(words))).count() == 0
    shown = ["Sun, 25 Oct 7", "x25 Oct", "25Oct", "Oct 29 - 31, 2026", "é12 may", "12 may", "_jan 3", "2026/1/2", "x2026-1-2", "٣ 12/5/26", "a12/5/26", "10:30pm", "x10:30", "on at 5", "٥10:30 AM", ""]
    dated = spark.createDataFrame([(t,) for t in shown], "t string")
    edge = patterns.EDGE
    for name in ("DAY_FIRST", "MONTH_FIRST", "CLOCK", "YEAR", "RANGE_CROSS", "RANGE_MONTH", "SOURCE_MONTH", "SOURCE_DAY", "CAPTION_ISO", "CAPTION_DMY"):
        pattern = getattr(dates, name)
        plain = "(?iu)" + edge.join(patterns.unicode_regex(part, ignore_case=False) for part in pattern.split(r"\b"))
        assert pattern.startswith(r"\b")
        assert dated.where(F.regexp_extract("t", patterns.unicode_regex(pattern), 0) != F.regexp_extract("t", plain, 0)).count() == 0, name
    for pattern, t in ((lx.CAPTION_PHONE, "call 15678 or 010 1234 5678 or x15678 156789 ١٥٦٧٨"), (r"\b\d{1,2}\b", "a1 22 333 4b 5"), (r"x+\b|\byy?\b", "xxy x yy yyy")):
        plain = edge.join(patterns.unicode_regex(part, ignore_case=False) for part in pattern.split(r"\b"))
        one = spark.createDataFrame([(t,)], "t string")
        assert one.select(F.regexp_extract_all("t", F.lit(plain), F.lit(0))).first() == one.select(
            F.regexp_extract_all("t", F.lit(patterns.unicode_regex(pattern, False)), F.lit(0))).first()
    assert re.search(r"\(\?=", patterns.unicode_regex(dates.DAY_FIRST))
