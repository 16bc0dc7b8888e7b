"""Outreach: events expanded by the roles to contact, and the texts to send.

Roles carry no persons, addresses or phone numbers: nothing is invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.patterns import blank_to_null, text
from ..functions.urls import percent_encode


def target_event(events: DataFrame, event_id: str) -> DataFrame:
    """The event with this id; a neutral default record when there is none."""
    spark = events.sparkSession
    found = events.where(F.col("event_id") == event_id).limit(1)
    default = spark.range(1).select(*[
        F.lit({"event_id": event_id, "title": "Campus Career & Leadership Summit",
               "organizer": "Organizing Committee"}.get(f.name)).cast(f.dataType).alias(f.name) for f in events.schema])
    return default.where(found.agg(F.count("*") == 0).scalar()).unionByName(found)


def expand_roles(events: DataFrame, event_id: str | None = None, role: str | None = None, q: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Event x role rows: every event (or the first ``limit``) with three roles, or one event with all five."""
    single = bool(event_id) and event_id != "all"
    if single:
        # an unknown id falls back to the first event
        first = events.orderBy("seq").limit(1)
        hit = events.where(F.col("event_id") == event_id)
        events = hit.unionByName(first.where(hit.agg(F.count("*") == 0).scalar()))
    chosen = events if limit is None else events.orderBy("seq").limit(limit)
    roles = [r for r in lx.ROLES if single or r[0] <= 3]
    if role and role.lower() != "all":
        roles = [r for r in roles if role.lower() in r[2] or role.lower() in r[1].lower()]
    kinds = F.array(*[F.struct(
        F.lit(o).alias("ord"), F.lit(n).alias("role"), F.lit(k).alias("role_category"), F.lit(float(m)).alias("match"),
        F.lit(p).alias("purpose"), F.lit(f).alias("focus")) for o, n, k, m, p, f in roles]) if roles else None
    known = F.when(~text(F.col("organizer")).isin("", "Unknown"), F.col("organizer"))
    org = F.coalesce(known, blank_to_null(F.col("parallel_org")), F.lit("Organizing Committee"))
    base = chosen.withColumns({"organization": org, "_k": F.explode(kinds)}) if roles else chosen.limit(0).withColumns(
        {"organization": org, "_k": F.explode(F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
            ("ord", "int"), ("role", "string"), ("role_category", "string"), ("match", "double"), ("purpose", "string"),
            ("focus", "string"))])))})
    out = base.select(
        F.concat(F.lit("lead_"), "event_id", F.lit("_"), F.col("_k.ord").cast("string")).alias("lead_id"), "event_id",
        F.col("title").alias("event_title"), F.col("city").alias("event_city"),
        F.coalesce(blank_to_null(F.col("date_display")), F.lit("Upcoming")).alias("event_date"),
        "_k.role", "_k.role_category", "organization", F.col("_k.match").alias("strategic_score"),
        F.col("_k.purpose").alias("pitch_purpose"), F.col("_k.focus").alias("pitch_focus"))
    return filter_leads(out, q=q) if q and q.strip() else out


def filter_leads(leads: DataFrame, role_category: str = "all", q: str | None = None) -> DataFrame:
    """Role category equality and text over role, organisation, event and city."""
    out = leads if role_category == "all" else leads.where(F.col("role_category") == role_category)
    if q and q.strip():
        low = q.strip().lower()
        hit = F.lit(False)
        for name in ("role", "organization", "event_title", "event_city"):
            hit = hit | F.lower(text(F.col(name))).contains(low)
        out = out.where(hit)
    return out


def outreach(events: DataFrame, sender: dict, purpose: str = "event_collaboration", notes: str | None = None) -> DataFrame:
    """Subject, body and mail link per event.  ``sender``: name, email, phone, network."""
    c = F.col
    network = F.lit(sender["network"])
    org = F.coalesce(F.when(~text(c("organizer")).isin("", "Unknown"), c("organizer")), F.lit("Event Organizing Committee"))
    when_ = F.coalesce(blank_to_null(c("date_display")), F.lit("upcoming dates"))
    venue = F.coalesce(blank_to_null(c("location")), F.lit("your venue"))
    pr = purpose == "pr_collaboration"
    lead = "PR & Media Partnership Proposal: " if pr else "Event Collaboration & Booth Partnership: "
    subject = F.concat(F.lit(lead), network, F.lit(" x "), c("title"))

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if pr:
        middle = say("We saw that \"", c("title"), "\" takes place on ", when_, " at ", venue, " and would like to offer a "
                     "cross-promotion: mutual social media coverage, a place in our student newsletter and co-branded "
                     "posts. In return we would be glad to be named as a media partner.")
    else:
        middle = say("We follow the preparations for \"", c("title"), "\" (", when_, " at ", venue, ") and would like to take "
                     "part on the ground: an information booth for students, an engagement activity and promotion of "
                     "your event on campus. Could you send us your exhibitor terms?")
    body = say("Dear ", org, ",\n\nMy name is ", sender["name"], " from ", network, ". ", middle, "\n\nBest regards,\n",
               sender["name"], "\n", network, "\nEmail: ", sender["email"], "\nPhone: ", sender["phone"], "\n",
               f"\nAdditional note: {notes}\n" if notes else "")
    df = events.select("event_id", c("title").alias("event_title"), subject.alias("subject"), body.alias("body"))
    mail = F.concat(F.lit("mailto:?subject="), percent_encode(c("subject"), keep=""), F.lit("&body="),
                    percent_encode(c("body"), keep=""))
    return df.select("*", mail.alias("mailto_url"), F.lit(purpose).alias("purpose"))
