"""Page metadata, registration forms and ticket listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.captions import analyze
from ..functions.dates import caption_datetime, display_format, parse_datetime, source_date
from ..functions.patterns import (any_of, blank_to_null, contains_any, first_label, first_where, matches, strip, text)
from ..functions.urls import is_short_link
from ..operators.keyed import keep_first
from ..operators.quality import TIME_AS_PLACE
from ..operators.score import evaluate
from .jsonld import ld_items


def unescape(col: Column) -> Column:
    """The entities that occur in titles and descriptions."""
    out = col
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(mark))
    return out


def meta(html: Column, attribute: str, name: str) -> Column:
    """Content of a meta tag, whatever the order of its attributes; NULL when there is no such tag."""
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']{name}["'][^>]*>""", 0)
    double = F.regexp_extract(tag, r'(?is)\bcontent\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*'([^']*)'", 1)
    return F.when(tag != "", strip(unescape(F.when(double != "", double).otherwise(single))))


def title_tag(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return blank_to_null(strip(unescape(raw)))


def page_metadata(pages: DataFrame) -> DataFrame:
    """Title, description and image of each page; Open Graph first."""
    h = text(F.col("html"))
    return pages.withColumns({
        "meta_title": F.coalesce(meta(h, "property", "og:title"), title_tag(h)),
        "meta_description": F.coalesce(meta(h, "property", "og:description"), meta(h, "name", "description")),
        "meta_image": meta(h, "property", "og:image")})


def resolve_pages(pages: DataFrame, ref_now: datetime) -> DataFrame:
    """Event details of landed pages: metadata, overridden by JSON-LD, completed by caption analysis and score."""
    c = F.col
    item = lambda path: F.try_variant_get("item", path, "string")
    ld = (ld_items(pages).withColumns({
        "ld_title": item("$.name"), "ld_description": item("$.description"), "ld_start": item("$.startDate"),
        "ld_location": item("$.location.name"), "ld_organizer": item("$.organizer.name")})
        .where(text(c("ld_title")) != ""))
    last = F.struct("block", "top", "pos")
    facts = ld.groupBy(c("page_url").alias("url")).agg(*[
        F.max_by(n, F.when(text(c(n)) != "", last)).alias(n)
        for n in ("ld_title", "ld_description", "ld_start", "ld_location", "ld_organizer")])
    df = page_metadata(pages).join(facts, "url", "left")
    df = df.withColumns({"title": text(F.coalesce("ld_title", "meta_title")),
                         "description": text(F.coalesce("ld_description", "meta_description"))})
    df = analyze(df.withColumn("_both", F.concat_ws("\n", "title", "description")), "_both", ref_now)
    login = c("title").isin("") | F.lower("title").isin("facebook", "instagram", "log in or sign up to view")
    day = F.substring("ld_start", 1, 10)
    out = df.select(
        "url", F.when(login, F.coalesce("cap.title", F.lit("Youth & Campus Event"))).otherwise(c("title")).alias("title"),
        "description", c("meta_image").alias("og_image"),
        F.coalesce(F.when(c("cap.venue") != lx.DEFAULT_VENUE, c("cap.venue")), blank_to_null(c("ld_location")),
                   F.lit("Cairo, Egypt")).alias("location"),
        F.coalesce("cap.city", F.lit("Cairo")).alias("city"),
        F.coalesce(F.when(c("cap.date_display") != "Upcoming / Live", c("cap.date_display")), day,
                   F.lit("Upcoming / Live")).alias("date_display"),
        F.coalesce(F.date_format("cap.start_date", "yyyy-MM-dd"), day).alias("start_day"),
        F.coalesce("ld_organizer", F.lit("Social Event Host")).alias("organizer"),
        F.coalesce("cap.registration_url", "url").alias("registration_url"))
    return evaluate(out).select("*", "eval.score", "eval.priority", c("eval.category").alias("category"),
                                c("eval.action").alias("recommended_action")).drop("eval")


_LABELS = (r"""(?is)<(?:[a-z0-9]+\b[^>]*\brole\s*=\s*["']heading["']|label\b|[a-z0-9]+\b[^>]*\bclass\s*=\s*["'][^"']*\bM7eMe\b)"""
           r"""[^>]*>(.*?)</""")


def inspect_forms(pages: DataFrame, ref_now: datetime) -> DataFrame:
    """Status of landed registration pages (url, resolved_url, http_status, html): open or closed, title, questions, deadline."""
    c, h = F.col, text(F.col("html"))
    closed = contains_any(F.lower(h), lx.CLOSED_FORM_PHRASES) | F.coalesce(c("http_status").isin(404, 410), F.lit(False))
    df = page_metadata(pages).withColumn("_closed", closed)
    found = F.transform(F.regexp_extract_all(h, F.lit(_LABELS), F.lit(1)),
                        lambda q: F.regexp_replace(strip(unescape(F.regexp_replace(q, "<[^>]*>", " "))), r"[ *]+$", ""))
    fits = F.filter(found, lambda q: (F.length(q).between(3, 85)) & (q != text(c("meta_title"))))
    lead = F.concat_ws("\n", text(c("meta_title")), text(c("meta_description")))
    return df.select(
        "url", "resolved_url", (is_short_link(c("url")) | (c("resolved_url") != c("url"))).alias("was_shortened"),
        (~c("_closed")).alias("is_open"), F.when(c("_closed"), "CLOSED").otherwise("OPEN").alias("status"),
        c("meta_title").alias("form_title"), c("meta_description").alias("form_description"),
        F.slice(F.array_distinct(fits), 1, 6).alias("questions"),
        caption_datetime(lead, ref_now)["date_display"].alias("deadline_display"))


# ------------------------------------------------------------- ticket listing
_MONTH = ("jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|"
          "october|november|december")
_DATE_PART = rf"(?:\b(?:{_MONTH})\b[^|]*?\d|\d[^|]*?\b(?:{_MONTH})\b)"
_BUTTONS = ("Organized by", "Book Now", "More Info", "Buy Tickets", "Tickets")
_ITEMS = "array<struct<item_id:string,item_name:string,price:string>>"
TICKET_HOST = "https://www.ticketsmarche.com"


def ticket_listing(pages: DataFrame, ref_now: datetime, city: str | None = None, country: str = "egypt") -> DataFrame:
    """Events of a ticket shop: item payloads of click handlers, with date, time and venue from the text of the card.

    A card is the stretch of the page from one payload to the next.
    """
    c = F.col
    html = text(c("html"))
    cards = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*\bonclick\s*=\s*(?:'[^']*"items":.*?|"[^"]*&quot;items&quot;:.*?)"""
                                             r"""(?=<a\b[^>]*\bonclick\s*=|$)"""), F.lit(0))
    df = pages.select(c("url").alias("page_url"), F.posexplode(cards).alias("pos", "card"))
    df = df.withColumn("card", unescape(c("card")))
    df = df.withColumns({
        "items": F.from_json(F.regexp_extract("card", r'(?s)"items":(\[.*?\])', 1), _ITEMS),
        "vendor": F.regexp_extract("card", r'(?s)"vendor_name":"(.*?)"', 1),
        "parts": F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(
            "card", r"(?s)^<a\b[^>]*\bonclick\s*=\s*('[^']*'|\"[^\"]*\")[^>]*>", " "), r"<[^>]*>", " | "), r"\|"), strip),
            lambda p: p != "")})
    df = df.select("page_url", "pos", "vendor", "parts", F.posexplode("items").alias("ipos", "item"))
    df = df.where(text(c("item.item_id")) != "").withColumns({
        "raw_id": c("item.item_id"), "title": strip(F.coalesce(blank_to_null(c("item.item_name")), c("item.item_id")))})
    df = keep_first(df, "raw_id", ["page_url", "pos", "ipos"])
    low_title = F.lower("title")
    df = df.withColumns({
        "date_part": first_where(c("parts"), lambda p: (F.lower(p) != low_title) & matches(p, _DATE_PART)),
        "time_part": first_where(c("parts"), lambda p: matches(p, TIME_AS_PLACE))})
    joined = c("time_part").isNotNull() & c("date_part").isNotNull() & ~F.contains(F.lower("date_part"), F.lower("time_part"))
    not_venue = lambda p: any_of([
        F.lower(p) == low_title, p.isin(*_BUTTONS), matches(p, _DATE_PART), matches(p, TIME_AS_PLACE),
        F.lower(p).rlike(r"^(?:egp\s*)?[0-9]+(?:[.,][0-9]+)?(?:\s*egp)?$"), F.length(p) <= 2])
    df = df.withColumns({
        "date_display": F.when(joined, F.concat("date_part", F.lit(" · "), "time_part")).otherwise(
            F.coalesce("date_part", F.lit("TBA"))),
        "location": F.coalesce(first_where(c("parts"), lambda p: ~not_venue(p)), F.lit("Cairo Cultural Hub")),
        "start_date": F.coalesce(source_date(c("date_part"), ref_now.year), parse_datetime(c("date_part"), ref_now))})
    price = text(c("item.price"))
    ticket = F.when(~price.isin("", "0", "0.0", "0.00"), F.concat(price, F.lit(" EGP"))).otherwise("Free / Paid Tickets")
    seller = F.coalesce(blank_to_null(c("vendor")), F.lit("TicketsMarche Organizer"))
    hay = F.concat_ws(" ", "title", "location", F.array_join("parts", " | "))
    out = df.select(
        F.concat(F.lit("tm_"), "raw_id").alias("event_id"), "title", F.lit("TicketsMarche").alias("source"), "start_date",
        "date_display", "location", first_label(F.lower(hay), lx.TICKET_CITY_GROUPS, "Cairo").alias("city"),
        F.lit(country.capitalize()).alias("country"), F.concat(F.lit(f"{TICKET_HOST}/event/"), "raw_id").alias("url"),
        ticket.alias("ticket_type"), seller.alias("organizer"),
        F.concat("title", F.lit(" organized by "), seller, F.lit(". Tickets available on TicketsMarche ("), ticket,
                 F.lit("). Venue: "), "location", F.lit(".")).alias("description"))
    from ..operators.views import in_scope
    return out.where(in_scope(city))


__all__ = ["display_format", "inspect_forms", "meta", "page_metadata", "resolve_pages", "ticket_listing", "title_tag"]
