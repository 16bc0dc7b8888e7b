"""Event records from JSON-LD blocks in landed pages ``(url, html)``."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.dates import display_format, parse_datetime
from ..functions.patterns import blank_to_null, contains_any, strip, text
from ..functions.urls import stable_id
from ..operators.keyed import keep_first

_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


@dataclass(frozen=True)
class Feed:
    """What differs between sources that publish JSON-LD."""
    name: str
    prefix: str
    organizer: str
    paid_label: str = "Paid / Registration"
    typed_only: bool = False          # only items typed as events
    reject: tuple[str, ...] = ()      # words that mark foreign groups
    free_unless_priced: bool = False  # price rule of group meetups
    street_as_venue: bool = False


TICKETS = Feed("Eventbrite", "eb_", "Eventbrite Organizer")
MEETUPS = Feed("Meetup", "mu_", "Meetup Group", typed_only=True, reject=lx.MEETUP_REJECT_WORDS,
               free_unless_priced=True, street_as_venue=True)


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def ld_items(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD item of a page: lists, single events and ``itemListElement`` unwrapped.

    Rows keep (url, page order, item order); ``item`` is a variant.
    """
    blocks = (pages.select(F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all(
        "html", F.lit(_SCRIPT), F.lit(1))).alias("block", "raw")).withColumn("v", F.try_parse_json("raw"))
        .where("v IS NOT NULL"))
    # a single value is wrapped like a list of one, so one pass over the pages serves every shape
    every = (blocks.select("page_url", "block", F.posexplode(_list_of("v")).alias("top", "v"))
             .where(F.schema_of_variant("v").startswith("OBJECT"))
             .withColumn("elements", F.try_variant_get("v", "$.itemListElement", "variant")))
    listed = F.col("elements").isNotNull()
    parts = F.when(listed, F.try_variant_get("elements", "$", "array<variant>")).otherwise(F.array("v"))
    return every.select("page_url", "block", "top", listed.alias("listed"), F.posexplode(parts).alias("pos", "value")).select(
        "page_url", "block", "top", "pos", F.when(F.col("listed"), F.coalesce(
            F.try_variant_get("value", "$.item", "variant"), F.col("value"))).otherwise(F.col("value")).alias("item"), "listed")


def _list_of(column: str) -> Column:
    return F.when(F.schema_of_variant(column).startswith("ARRAY"), F.try_variant_get(F.col(column), "$", "array<variant>")).otherwise(F.array(column))


def _offers_free(feed: Feed) -> Column:
    kind = F.schema_of_variant(F.try_variant_get("item", "$.offers", "variant"))
    price = F.coalesce(_get("item", "$.offers.lowPrice"), _get("item", "$.offers.price"))
    zero = ("0", "0.0")
    if feed.free_unless_priced:
        plain = _get("item", "$.offers.price")
        paid = kind.startswith("OBJECT") & plain.isNotNull() & ~plain.isin("", *zero)
        label = F.concat(F.lit("Paid ("), plain, F.lit(" "), text(_get("item", "$.offers.priceCurrency")), F.lit(")"))
        return F.when(paid, label).otherwise("Free")
    one = kind.startswith("OBJECT") & ((_get("item", "$.offers.isAccessibleForFree") == "true") | price.isin(*zero))
    several = F.exists(F.try_variant_get("item", "$.offers", "array<variant>"), lambda o: (
        (F.try_variant_get(o, "$.isAccessibleForFree", "string") == "true")
        | F.coalesce(F.try_variant_get(o, "$.price", "string").isin(*zero), F.lit(False))))
    return F.when(F.coalesce(one, F.lit(False)) | F.coalesce(several, F.lit(False)), "Free").otherwise(feed.paid_label)


def _named(field: str, inner: str = "name") -> Column:
    """Name inside an object, or the value itself when it is plain text."""
    kind = F.schema_of_variant(F.try_variant_get("item", f"$.{field}", "variant"))
    return (F.when(kind.startswith("OBJECT"), _get("item", f"$.{field}.{inner}"))
            .when(kind == "STRING", _get("item", f"$.{field}")))


def events_from_jsonld(pages: DataFrame, feed: Feed, ref_now: datetime, city: str | None = None,
                       country: str = "egypt") -> DataFrame:
    """Event records of a source; the first occurrence of a link wins."""
    c = F.col
    items = ld_items(pages).where(F.schema_of_variant("item").startswith("OBJECT"))
    typed = F.coalesce(_get("item", "$['@type']") == "Event", F.lit(False))
    accepted = typed if feed.typed_only else typed | (c("listed") & F.try_variant_get("item", "$.startDate", "variant").isNotNull())
    items = items.where(accepted).withColumns({
        "title": strip(text(_get("item", "$.name"))), "url": _get("item", "$.url"),
        "description": text(_get("item", "$.description"))})
    items = items.where((c("title") != "") & (text(c("url")) != ""))
    if feed.reject:
        hay = F.lower(F.concat_ws(" ", "title", "url", "description"))
        items = items.where(~contains_any(hay, feed.reject))
    items = keep_first(items, "url", ["page_url", "block", "top", "pos"])
    venue = _named("location")
    if feed.street_as_venue:
        venue = F.coalesce(blank_to_null(venue), _get("item", "$.location.address.streetAddress"))
    place = F.initcap(F.lit(city)) if city else F.lit("Egypt")
    rows = items.withColumns({
        "start_date": parse_datetime(_get("item", "$.startDate"), ref_now),
        "end_date": parse_datetime(_get("item", "$.endDate"), ref_now)})
    locality = place if feed.street_as_venue else F.coalesce(
        blank_to_null(_get("item", "$.location.address.addressLocality")), place)
    return rows.select(
        stable_id(feed.prefix, c("url")).alias("event_id"), "title", F.lit(feed.name).alias("source"), "start_date", "end_date",
        F.coalesce(display_format(c("start_date")), F.lit("Date TBA")).alias("date_display"),
        F.coalesce(blank_to_null(strip(text(venue))), F.lit("TBA")).alias("location"), locality.alias("city"),
        F.lit(country.capitalize()).alias("country"), "url", _offers_free(feed).alias("ticket_type"),
        strip(F.coalesce(_named("organizer"), F.lit(feed.organizer))).alias("organizer"),
        F.substring(strip(c("description")), 1, 300).alias("description"))
