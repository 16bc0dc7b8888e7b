"""Link normalisation and link choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .patterns import blank_to_null, contains_any, extract, strip, text

SEARCH_PAGE = "https://www.facebook.com/events/search/?q="
# fixed values: placeholder identifiers that never name a real page
MOCK_IDS = ("123456789012345", "829102948271029")


def part(url: Column, name: str, key: str | None = None) -> Column:
    args = [strip(text(url)), F.lit(name)] + ([F.lit(key)] if key else [])
    return F.try_parse_url(*args)


def canonical_url(url: Column) -> Column:
    """Scheme, host without ``www.``, path without trailing slash; search pages keep their question."""
    u = strip(text(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.replace(F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)), F.lit("www."),
                     F.lit(""))
    rest = F.regexp_replace(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    path = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), "/+$", ""))
    question = F.regexp_extract(rest, r"[?&]q=([^&#]*)", 1)
    asked = F.lower(strip(F.coalesce(F.try_url_decode(question), question)))
    plain = F.concat(scheme, F.lit("://"), host, path)
    search = host.contains("facebook.com") & path.contains("/events/search")
    return F.when(u == "", F.lit("")).when(search, F.concat(F.lit(SEARCH_PAGE), asked)).otherwise(plain)


def client_canonical_url(url: Column) -> Column:
    """Everything before ``?`` and ``#``, lower case, no trailing slash."""
    u = strip(text(url))
    bare = F.lower(F.regexp_replace(F.regexp_extract(u, r"^([^?#]*)", 1), "/+$", ""))
    return F.when(u.contains("facebook.com/events/search"), F.lower(u)).otherwise(bare)


def percent_encode(col: Column, keep: str = "!'()*") -> Column:
    """Percent-encoding with ``%20`` for blanks; ``keep`` lists marks left as they are."""
    out = F.replace(F.url_encode(text(col)), F.lit("+"), F.lit("%20"))
    for mark in keep:
        if mark != "*":
            out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return out if "*" in keep else F.replace(out, F.lit("*"), F.lit("%2A"))


def safe_event_url(post_direct: Column, proof: Column, url: Column, title: Column) -> Column:
    """The link to show: a direct numeric page, an existing search page, or a search for the title."""
    raw = strip(F.coalesce(blank_to_null(post_direct), blank_to_null(proof), blank_to_null(url), F.lit("")))
    tidy = F.regexp_replace(raw, r"\s+", "%20")
    number = extract(tidy, r"facebook\.com/events/([0-9]{10,20})/?$", 1, ignore_case=False)
    bare = strip(F.regexp_replace(text(title), r"\(.*?\)", ""))

    def ask(t: Column) -> Column:
        return F.concat(F.lit(SEARCH_PAGE), percent_encode(F.coalesce(blank_to_null(t), F.lit("Egypt Events"))))

    return (F.when((raw == "") | (raw == "#"), ask(text(title)))
            .when(~raw.contains("facebook.com"), raw)
            .when(tidy.contains("/events/search/"), tidy)
            .when(number.isNotNull() & ~number.isin(*MOCK_IDS),
                  F.concat(F.lit("https://www.facebook.com/events/"), number, F.lit("/")))
            .otherwise(ask(bare)))


def proof_source(asked: Column, post_direct: Column, proof: Column, profile: Column, url: Column) -> Column:
    """Best announcement link in order of precedence."""
    return F.coalesce(*[blank_to_null(c) for c in (asked, post_direct, proof, profile, url)],
                      F.lit("https://facebook.com/events"))


def domain(url: Column) -> Column:
    return F.coalesce(blank_to_null(part(url, "HOST")), F.lit("official-portal.eg"))


def is_short_link(url: Column) -> Column:
    return contains_any(F.lower(text(url)), lx.SHORT_LINK_HOSTS)


def stable_id(prefix: str, url: Column) -> Column:
    """Identifier derived from the canonical link; equal on every run; 128 bits, so links of any number keep apart."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_url(url), 256), 1, 32))
