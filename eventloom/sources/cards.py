"""Event cards from page HTML, where a page carries no structured data.

Tag soup cannot be read by column functions, so this is the one place that parses HTML in Python:
page by page inside ``mapInPandas``, with the standard library parser.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_datetime
from ..functions.patterns import blank_to_null, strip, text
from ..functions.urls import stable_id
from ..operators.keyed import keep_first


@dataclass(frozen=True)
class CardFeed:
    """Where a source keeps the parts of a card: tests are (tag or '', class or '', attribute or '', value part or '')."""
    name: str
    prefix: str
    card: tuple
    link: tuple
    title: tuple
    date: tuple
    place: tuple
    organizer: str
    ticket: str
    no_place: str = "TBA"
    data_attributes: bool = False
    free_word: bool = False


# fixed values: card layouts of the sources
TICKET_CARDS = CardFeed(
    "Eventbrite", "eb_", (("section", "event-card-details", "", ""), ("div", "event-card", "", ""),
                          ("", "", "data-testid", "event-card")),
    (("a", "", "href", "/e/"),),
    (("h2", "", "", ""), ("h3", "", "", ""), ("", "event-card__title", "", ""), ("", "", "data-testid", "event-card-title")),
    (("p", "event-card__date", "", ""), ("div", "event-card__date", "", ""), ("time", "", "", "")),
    (("p", "event-card__location", "", ""), ("div", "event-card__location", "", "")), "Eventbrite Organizer", "Registration")
LISTING_CARDS = CardFeed(
    "AllEvents", "ae_", (("li", "event-card", "", ""), ("div", "event-card", "", "")),
    (("a", "event-card-link", "", ""), ("a", "", "href", "allevents.in/")),
    (("h3", "", "", ""), ("", "title", "", ""), ("", "event-item__title", "", "")),
    (("", "date", "", ""), ("", "datetime", "", "")),
    (("", "subtitle", "", ""), ("", "location", "", ""), ("", "venue", "", "")), "AllEvents Organizer",
    "Registration / Tickets", no_place="Venue TBA", data_attributes=True, free_word=True)
FAIR_CARDS = CardFeed(
    "10times", "10t_", (("tr", "event-card", "", ""), ("tr", "", "data-id", ""), ("", "event-card", "", "")),
    (("a", "", "href", "10times.com/"),),
    (("h2", "", "", ""), ("h3", "", "", ""), ("a", "event-name", "", ""), ("strong", "", "", "")),
    (("", "date", "", ""), ("td", "event-date", "", ""), ("time", "", "", "")),
    (("", "venue", "", ""), ("td", "event-venue", "", ""), ("", "city", "", "")), "10times Listed Organizer",
    "Trade Fair / Conference Registration", no_place="Egypt")

_SCHEMA = "page_url string, pos int, eid string, title string, link string, date_text string, place string, body string"


def _card_rows(feed: CardFeed):
    """A function over batches of pages; nested, with plain values, so that it travels to the executors whole."""
    card_tests, data_attributes = feed.card, feed.data_attributes
    field_tests = (("link", feed.link), ("title", feed.title), ("date", feed.date), ("place", feed.place))

    def run(batches):
        from html.parser import HTMLParser

        import pandas as pd

        void = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "wbr"}

        def fits(tag, attrs, tests):
            classes = (attrs.get("class") or "").split()
            for t, cls, attr, part in tests:
                if (not t or t == tag) and (not cls or cls in classes) and (not attr or (attr in attrs and part in (attrs[attr] or ""))):
                    return True
            return False

        class Cards(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.cards = [], []

            def handle_starttag(self, tag, attrs):
                a = dict(attrs)
                node = {"tag": tag, "card": None, "fields": []}
                open_cards = [n["card"] for n in self.stack if n["card"] is not None]
                for card in open_cards:
                    for field, tests in field_tests:
                        if field not in card["seen"] and fits(tag, a, tests):
                            card["seen"].add(field)
                            if field == "link":
                                card["link"] = a.get("href")
                            else:
                                node["fields"].append((card, field))
                if fits(tag, a, card_tests):
                    node["card"] = {"attrs": a, "seen": set(), "title": [], "date": [], "place": [], "text": [], "link": None}
                    self.cards.append(node["card"])
                if tag not in void:
                    self.stack.append(node)

            def handle_endtag(self, tag):
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i]["tag"] == tag:
                        del self.stack[i:]
                        return

            def handle_data(self, data):
                if not data.strip():
                    return
                for n in self.stack:
                    if n["card"] is not None:
                        n["card"]["text"].append(data.strip())
                    for card, field in n["fields"]:
                        card[field].append(data.strip())

        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"]):
                parser = Cards()
                parser.feed(html or "")
                parser.close()
                for i, c in enumerate(parser.cards):
                    a = c["attrs"] if data_attributes else {}
                    out.append((url, i, a.get("data-eid") or a.get("data-id"), a.get("data-name") or "".join(c["title"]),
                                a.get("data-link") or c["link"], "".join(c["date"]), "".join(c["place"]), " ".join(c["text"])))
            yield pd.DataFrame(out, columns=["page_url", "pos", "eid", "title", "link", "date_text", "place", "body"])

    return run


def raw_cards(pages: DataFrame, feed: CardFeed) -> DataFrame:
    return pages.select("url", "html").mapInPandas(_card_rows(feed), _SCHEMA)


def events_from_cards(pages: DataFrame, feed: CardFeed, ref_now: datetime, city: str | None = None,
                      country: str = "egypt") -> DataFrame:
    c = F.col
    link = F.regexp_extract(text(c("link")), r"^([^?]*)", 1) if feed.name == "Eventbrite" else text(c("link"))
    rows = raw_cards(pages, feed).withColumns({"url": link, "title": strip(text(c("title")))})
    rows = rows.where((c("url") != "") & (c("title") != ""))
    if feed.data_attributes:
        rows = rows.where((F.length("title") >= 3) & ~F.lower("title").isin("null", "none", "event")
                          & ~c("title").rlike(r"""^[\s\-_()\[\]{}|.,:;!?'"]*$"""))
    own = F.when(text(c("eid")) != "", F.concat(F.lit(feed.prefix), c("eid"))).otherwise(stable_id(feed.prefix, c("url")))
    rows = keep_first(rows.withColumn("event_id", own if feed.data_attributes else stable_id(feed.prefix, c("url"))),
                      "event_id", ["page_url", "pos"])
    ticket = F.lit(feed.ticket)
    if feed.free_word:
        ticket = F.when(F.lower(F.concat_ws(" ", "body", "title")).contains("free"), "Free").otherwise(ticket)
    return rows.select(
        "event_id", "title", F.lit(feed.name).alias("source"), parse_datetime(c("date_text"), ref_now).alias("start_date"),
        F.coalesce(blank_to_null(c("date_text")), F.lit("Date TBA")).alias("date_display"),
        F.coalesce(blank_to_null(strip(c("place"))), F.lit(feed.no_place)).alias("location"),
        (F.initcap(F.lit(city)) if city else F.lit("Egypt")).alias("city"), F.lit(country.capitalize()).alias("country"),
        "url", ticket.alias("ticket_type"), F.lit(feed.organizer).alias("organizer"), F.lit("").alias("description"),
        "page_url")


def cards_as_fallback(pages: DataFrame, structured_pages: DataFrame, feed: CardFeed, ref_now: datetime,
                      city: str | None = None) -> DataFrame:
    """Cards only of the pages that gave no structured events (``structured_pages`` holds their ``url``)."""
    rest = pages.join(structured_pages.select("url").distinct(), "url", "left_anti")
    return events_from_cards(rest, feed, ref_now, city).drop("page_url")
