"""Event details from post captions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from .dates import caption_datetime, client_caption_date
from .patterns import (NOT_WORD, any_of, contains_any, extract, first_label, first_where, has_phrase, let, lines, matches,
                       strip, text, unicode_regex)
from .text import ascii_digits


def is_event_post(caption: Column) -> Column:
    """Does the caption hold any trigger word in English, Arabic or transliteration?"""
    low = F.lower(ascii_digits(caption))
    return has_phrase(low, lx.TRIGGER_WORDS) | has_phrase(low, lx.TRIGGER_FRAGMENTS, whole_words=False)


def registration_url(caption: Column, client: bool = False) -> Column:
    return extract(caption, lx.CLIENT_FORM_URL if client else lx.FORM_URL)


def _headline(line: Column) -> Column:
    trimmed = F.regexp_replace(line, rf"^[\s{lx.HEAD_TRIM}]+|[\s{lx.TAIL_TRIM}]+$", "")
    return strip(trimmed)


def _usable(line: Column) -> Column:
    # the whole line is made of marks and hype words; possessive steps keep the check linear
    hype = rf"(?iu)^(?:(?:{NOT_WORD}|_)|{lx.HYPE_WORDS})++$"
    label = rf"^(?:{lx.LABEL_WORDS})\s*[:\-]"
    return ((F.length(line) >= 5) & ~line.rlike("^(?:https?://|#)") & ~line.rlike(hype) & ~matches(line, label))


def _cut(line: Column) -> Column:
    short = F.concat(F.regexp_replace(F.substring(line, 1, 92), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(line) > 95, short).otherwise(line)


def headline(caption: Column, default: str = lx.CAPTION_DEFAULT_TITLE) -> Column:
    """First line fit for a title, trimmed of emoji and bullets, at most 95 characters."""
    def pick(ls: Column) -> Column:
        good = first_where(ls, _usable, _headline)
        first = F.get(ls, F.lit(0))
        cut = F.when(F.length(first) > 95, F.concat(F.substring(first, 1, 92), F.lit("..."))).otherwise(first)
        return F.coalesce(_cut(good), cut, F.lit(default))

    return let(lines(caption), pick)


def organizer(caption: Column) -> Column:
    found = F.regexp_extract(text(caption), unicode_regex(rf"(?:{lx.ORGANIZER_LEADS})\s*[:\-]?\s*([^\n,.|]{{3,50}})"), 1)
    return F.when(found != "", strip(found)).otherwise(F.lit("Social Event Host"))


def venue(low: Column) -> Column:
    return first_label(low, lx.VENUES, lx.DEFAULT_VENUE)


def city(low: Column) -> Column:
    return first_label(low, lx.CAPTION_CITY_GROUPS, "Cairo")


def ticket_type(low: Column) -> Column:
    return F.when(contains_any(low, lx.FREE_WORDS), "Free").otherwise("Registration Required")


def analyze(df: DataFrame, caption: str, ref_now: datetime, into: str = "cap") -> DataFrame:
    """Add a struct of 13 fields; every field but ``is_event`` is NULL when the post is not an event."""
    from ..operators.enrich import caption_contacts
    keep, c = df.columns, F.col
    df = df.withColumn("_cap", text(c(caption))).withColumn("_event", is_event_post(c("_cap")))
    df = df.withColumn("_low", F.lower(ascii_digits(c("_cap"))))
    # a flat projection per group of fields keeps each generated method small
    df = df.withColumns({"_d": F.when(c("_event"), caption_datetime(c("_cap"), ref_now)),
                         "_k": F.when(c("_event"), caption_contacts(c("_cap")))})

    def only(col: Column) -> Column:
        return F.when(c("_event"), col)

    return df.withColumn(into, F.struct(
        c("_event").alias("is_event"), only(headline(c("_cap"))).alias("title"), c("_d.start_date").alias("start_date"),
        only(F.coalesce(c("_d.date_display"), F.lit("Upcoming / Live"))).alias("date_display"),
        only(venue(c("_low"))).alias("venue"), only(city(c("_low"))).alias("city"),
        only(ticket_type(c("_low"))).alias("ticket_type"), only(registration_url(c("_cap"))).alias("registration_url"),
        only(organizer(c("_cap"))).alias("organizer"), c("_k.email").alias("organizer_email"),
        c("_k.phone").alias("organizer_phone"), c("_k.instagram").alias("organizer_instagram"),
        only(F.substring("_cap", 1, 280)).alias("summary"))).select(*keep, into)


def analyze_client(df: DataFrame, caption: str, ref_now: datetime, into: str = "cap") -> DataFrame:
    """Client variant: no event gate, other defaults, main link preferred from social hosts."""
    from ..operators.enrich import caption_contacts
    keep, c = df.columns, F.col
    df = df.withColumns({"_cap": strip(text(c(caption)))})
    df = df.withColumns({"_norm": ascii_digits(c("_cap")), "_low": F.lower(ascii_digits(c("_cap")))})
    urls = F.regexp_extract_all("_norm", F.lit(r"""(?i)https?://[^\s"'<>]+"""), F.lit(0))
    df = df.withColumns({"_urls": urls, "_form": registration_url(c("_norm"), client=True),
                         "_day": client_caption_date(c("_cap"), ref_now), "_k": caption_contacts(c("_cap")),
                         "_city": first_label(c("_low"), lx.CLIENT_CITY_GROUPS, "Cairo"),
                         "_venue": first_label(c("_low"), lx.CLIENT_VENUES, "Cairo, Egypt")})
    form = F.coalesce("_form", F.get("_urls", F.lit(0)), F.lit("#"))
    social = first_where(c("_urls"), lambda u: u.contains("facebook.com") | u.contains("instagram.com"))
    main = F.coalesce(social, F.get("_urls", F.lit(0)), form)
    place = F.when((c("_venue") == "Cairo, Egypt") & (c("_city") != "Cairo"), F.concat("_city", F.lit(", Egypt")))
    return df.withColumn(into, F.struct(
        headline(c("_cap"), "Youth & Campus Event").alias("title"), main.alias("url"), form.alias("registration_url"),
        F.when(main.contains("instagram"), "Instagram Feeds").otherwise("Facebook Events").alias("source"),
        F.coalesce(F.date_format("_day", "MMM dd, yyyy"), F.lit("Upcoming / Live")).alias("date_display"),
        c("_day").cast("timestamp_ntz").alias("start_date"), place_or(place).alias("location"), c("_city").alias("city"),
        c("_cap").alias("description"),
        F.when(contains_any(c("_low"), lx.CLIENT_FREE_WORDS), "Free Admission").otherwise("Registration Required")
        .alias("ticket_type"),
        c("_k.email").alias("organizer_email"), c("_k.phone").alias("organizer_phone"),
        c("_k.instagram").alias("organizer_instagram"))).select(*keep, into)


def place_or(place: Column) -> Column:
    return F.coalesce(place, F.col("_venue"))


def is_announcement(post: Column) -> Column:
    """Keyword gate for posts."""
    return matches(text(post), rf"\b({lx.POST_KEYWORDS})\b")


__all__ = ["analyze", "analyze_client", "any_of", "city", "headline", "is_announcement", "is_event_post", "organizer",
           "registration_url", "ticket_type", "venue"]
