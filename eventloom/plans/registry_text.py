"""Queries over captions, contacts, questions, search and outreach."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import captions as C
from ..operators import contains, enrich, intents, leads, score, search, segments, views
from ..schema import conform
from ..session import Scratch, cut_lineage
from ..sources import payload, snapshots
from . import adapters as A
from . import jobs
from . import sqltext as S
from .registry import _PASSED, _SHOWN, ann, cap, dealt_ev, ev, full_ev, query, ts

# ------------------------------------------------------------------ captions
_TRIGGER = f"{S.has('lower(caption)', lx.TRIGGER_WORDS)} OR {S.has('lower(caption)', lx.TRIGGER_FRAGMENTS, False)}"
_VENUE = """CASE custkey % 6 WHEN 0 THEN 'The Greek Campus' WHEN 1 THEN 'Ain Shams University Al-Zaafaran Hall'
  WHEN 2 THEN 'Mansoura University Convention Center' WHEN 3 THEN 'Creativa Innovation Hub'
  WHEN 4 THEN 'Zewail City of Science and Technology' ELSE 'Campus Auditorium / TBA' END"""
_LINK = """CASE custkey % 3 WHEN 0 THEN 'https://forms.gle/k' || CAST(post_id AS VARCHAR)
  WHEN 1 THEN 'https://bit.ly/k' || CAST(post_id AS VARCHAR) END"""
_PHONE = "CASE post_id % 3 WHEN 0 THEN '010' || lpad(CAST(custkey AS VARCHAR), 8, '0') END"
_EMAIL = "CASE post_id % 3 WHEN 1 THEN 'info' || CAST(custkey AS VARCHAR) || '@club.org' END"
_HANDLE = "CASE post_id % 3 WHEN 1 THEN 'club_' || CAST(custkey AS VARCHAR) END"
_TICKET = "CASE WHEN custkey % 3 = 2 THEN 'Registration Required' ELSE 'Free' END"
_CITY = S.first_label("lower(caption)", lx.CAPTION_CITY_GROUPS, "'Cairo'")


@query("x1_is_event_post", f"SELECT post_id, {_TRIGGER} AS is_event FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.is_event_post(F.col("caption")).alias("is_event"))


@query("x1_event_posts_in_documents", f"""SELECT lang, count(*) AS n, count(*) FILTER ({_TRIGGER}) AS n_posts
  FROM (SELECT lang, lower(text) AS caption FROM documents) GROUP BY lang""")
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(C.is_event_post(F.col("text"))).alias("n_posts"))


@query("x2_registration_url", f"SELECT post_id, {_LINK} AS link FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.registration_url(F.col("caption")).alias("link"))


@query("x3_caption_contacts", f"SELECT post_id, {_EMAIL} AS email, {_PHONE} AS phone, {_HANDLE} AS instagram FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", enrich.caption_contacts(F.col("caption")).alias("k")).select("post_id", "k.*")


@query("x3_emails_in_documents", r"""SELECT doc_id, regexp_extract(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}') AS email
  FROM documents WHERE regexp_matches(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')""")
def _(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", enrich.caption_contacts(F.col("text"))["email"].alias("email")).where("email IS NOT NULL")


@query("x4_text_contacts", f"""SELECT post_id, {_EMAIL} AS email, {_HANDLE} AS instagram, CASE WHEN post_id % 2 = 0 THEN
  'company/club-' || CAST(custkey AS VARCHAR) END AS linkedin FROM cap""")
def _(spark, sf):
    page = F.when(F.col("post_id") % 2 == 0, F.concat(F.lit(" see linkedin.com/in/club-"), F.col("custkey").cast("string")))
    body = F.concat("caption", F.coalesce(page, F.lit("")))
    return cap(spark, sf).select("post_id", enrich.text_contacts(body).alias("k")).select(
        "post_id", "k.email", "k.instagram", "k.linkedin")


@query("x5_headline", "SELECT post_id, title FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.headline(F.col("caption")).alias("title"))


@query("x6_venue", f"SELECT post_id, {S.first_label('lower(caption)', lx.VENUES, S.q(lx.DEFAULT_VENUE))} AS venue FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.venue(F.lower("caption")).alias("venue"))


@query("x7_city", f"SELECT post_id, {_CITY} AS city FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.city(F.lower("caption")).alias("city"))


@query("x8_ticket_type", f"SELECT post_id, {_TICKET} AS ticket_type FROM cap")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.ticket_type(F.lower("caption")).alias("ticket_type"))


@query("x9_organizer", """SELECT o_orderkey AS post_id, c_name AS organizer FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    return cap(spark, sf).select("post_id", C.organizer(F.col("caption")).alias("organizer"))


_CAPTION_DAY = """make_date(2026, CAST(extract(month FROM order_date) AS INT), CAST(extract(day FROM order_date) AS INT))"""


# ------------------------------------------------------- containment joins
@query("f8_keyword_search_many", """SELECT c_custkey AS qid, count(*) AS n_hits, min(seq) AS first_seq, max(seq) AS last_seq
  FROM (SELECT seq, lower(title || chr(1) || location || chr(1) || organizer || chr(1) || description || chr(1) || category) AS hay FROM ev) h
  JOIN (SELECT c_custkey, lower(c_mktsegment) || ' ' || CAST(c_custkey AS VARCHAR) AS k FROM customer) q ON contains(hay, k) GROUP BY c_custkey""")
def _(spark, sf):
    """A question per customer, put to all events at once."""
    asked = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("q"))
    found = views.keyword_many(ev(spark, sf), asked)
    return found.groupBy("qid").agg(F.count("*").alias("n_hits"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("q3_words_in_documents", """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name) || ' ' || lower(p_type), ' ')) AS word FROM part)
  SELECT word, count(*) AS n_docs, min(doc_id) AS first_doc FROM w JOIN documents ON contains(lower(text), word) GROUP BY word""")
def _(spark, sf):
    """Every word of the parts' names and types as a substring of whole documents."""
    words = A.table(spark, sf, "part").select(F.explode(F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")), " ")).alias("word")).distinct()
    found = contains.search_many(A.table(spark, sf, "documents").select("doc_id", "text"), F.lower("text"), words, F.col("word"))
    return found.groupBy("word").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_WIDE_HAY = "lower(title || ' ' || organizer || ' ' || description || ' ' || '' || ' ' || coalesce(parallel_org, ''))"


@query("j5_directory_of_any_size", f"""SELECT event_id, 'o' || CAST(m.ord AS VARCHAR) || '@club.org' AS organizer_email FROM (SELECT event_id, {_WIDE_HAY} AS hay FROM ev) h
  LEFT JOIN (SELECT hay, min(ord) AS ord FROM (SELECT DISTINCT {_WIDE_HAY} AS hay FROM ev) t
    JOIN (SELECT lower(title) AS key, min(seq) AS ord FROM ev GROUP BY 1) e ON contains(hay, key) GROUP BY hay) m ON m.hay = h.hay""")
def _(spark, sf):
    """Every event's title is a directory key; the first in order that an event's text contains gives the address."""
    e = full_ev(spark, sf)
    address = F.concat(F.lit("o"), F.col("seq").cast("string"), F.lit("@club.org"))
    directory = e.select(F.col("seq").alias("ord"), F.lower("title").alias("key"), address.alias("email"),
                         *[F.lit(None).cast("string").alias(n) for n in ("instagram", "linkedin", "phone")])
    return enrich.enrich_contacts(e, directory).select("event_id", "organizer_email")


@query("j5b_client_directory_of_any_size", """SELECT event_id, 'Firm ' || CAST(c_custkey AS VARCHAR) AS organizer,
  CAST(c_custkey AS VARCHAR) || '00' AS organizer_phone FROM ev JOIN customer ON organizer = c_name""")
def _(spark, sf):
    """Customers as the directory; their names stand in the events' descriptions."""
    key = F.col("c_custkey").cast("string")
    directory = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ord"), F.lower("c_name").alias("key"), F.concat(F.lit("Firm "), key).alias("name"), F.concat(key, F.lit(" 00")).alias("phone"),
        *[F.lit(None).cast("string").alias(n) for n in ("email", "instagram", "linkedin")])
    events = full_ev(spark, sf).withColumn("description", F.concat_ws(" ", "description", F.lit("by"), "organizer")).withColumn("organizer", F.lit(""))
    return enrich.enrich_client(events, directory).select("event_id", "organizer", "organizer_phone")


@query("j11_hub_table", """SELECT lower(n_name) AS hub, count(*) AS n_events, count(*) FILTER (contains(lower(category), 'flagship')
  OR contains(lower(title), 'techne') OR contains(lower(title), 'riseup')) AS n_flagship FROM ev JOIN nation ON contains(lower(city), lower(n_name)) GROUP BY 1""")
def _(spark, sf):
    return views.hub_rollup(ev(spark, sf), A.table(spark, sf, "nation").select(F.lower("n_name").alias("hub")))


# ------------------------------------------------------------ whole captions
@query("x10_analyze_caption", f"""SELECT post_id, e AS is_event, CASE WHEN e THEN title END AS title,
  CASE WHEN e THEN CASE WHEN post_id % 5 = 4 THEN 'Upcoming / Live' ELSE strftime({_CAPTION_DAY}, '%b %d, %Y') END END AS date_display,
  CASE WHEN e THEN {_CITY} END AS city, CASE WHEN e THEN {_TICKET} END AS ticket_type, CASE WHEN e THEN {_LINK} END AS registration_url,
  CASE WHEN e THEN {_EMAIL} END AS organizer_email, CASE WHEN e THEN substr(caption, 1, 280) END AS summary
  FROM (SELECT *, {_TRIGGER} AS e FROM cap)""")
def _(spark, sf):
    return C.analyze(cap(spark, sf).select("post_id", "caption"), "caption", A.CAPTION_NOW).select(
        "post_id", "cap.is_event", "cap.title", "cap.date_display", "cap.city", "cap.ticket_type", "cap.registration_url",
        "cap.organizer_email", "cap.summary")


@query("x11_analyze_caption_client", f"""SELECT post_id, title, CASE WHEN post_id % 5 IN (2, 3) THEN strftime({_CAPTION_DAY}, '%b %d, %Y')
  ELSE 'Upcoming / Live' END AS date_display, {S.first_label('lower(caption)', lx.CLIENT_CITY_GROUPS, "'Cairo'")} AS city,
  CASE WHEN custkey % 3 = 2 THEN 'Registration Required' ELSE 'Free Admission' END AS ticket_type FROM cap""")
def _(spark, sf):
    return C.analyze_client(cap(spark, sf).select("post_id", "caption"), "caption", A.CAPTION_NOW).select(
        "post_id", "cap.title", "cap.date_display", "cap.city", "cap.ticket_type")


# ------------------------------------------------------------------ contacts
_HAY = "lower(title || ' ' || organizer || ' ' || description || ' ' || coalesce(parallel_org, ''))"
_KEY = "CASE " + " ".join(f"WHEN contains({_HAY}, {S.q(d[0])}) THEN {S.q(d[1])}" for d in lx.DIRECTORY) + " END"


@query("j5_directory_contacts", f"SELECT event_id, {_KEY} AS organizer_email FROM ev")
def _(spark, sf):
    return enrich.enrich_contacts(full_ev(spark, sf)).select("event_id", "organizer_email")


_NAMES = "CASE " + " ".join(f"WHEN contains({_HAY}, {S.q(k)}) THEN {S.q(v)}" for k, v in lx.DIRECTORY_NAMES) + " END"


@query("j5b_client_contacts", f"""SELECT event_id, {_KEY.replace('organizer ||', "'' ||")} AS organizer_email,
  coalesce({_NAMES.replace('organizer ||', "'' ||")}, 'Organizing Committee') AS organizer FROM ev""")
def _(spark, sf):
    df = full_ev(spark, sf).withColumn("organizer", F.lit(""))
    return enrich.enrich_client(df).select("event_id", "organizer_email", "organizer")


# ----------------------------------------------------------------- questions
_QUESTIONS = """SELECT CAST(c_custkey AS BIGINT) AS qid, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'free hackathons in Tanta'
  WHEN 1 THEN 'top career fairs in october' WHEN 2 THEN 'show me art ' || CAST(c_nationkey AS STRING)
  WHEN 3 THEN 'flagship summits for ' || lower(c_mktsegment) WHEN 4 THEN 'any clashes in alex?' ELSE 'hi' END AS q FROM customer"""
_INTENT = """CASE qid % 6 WHEN 0 THEN 'tanta|Technology & Hackathons|true||false|||' WHEN 1 THEN '|Career Fair & Employment|false|HIGH|false|OCT||'
  WHEN 3 THEN '|Flagship Summits|false||false||' || s || '|' WHEN 4 THEN 'alexandria||false||true||?|' END"""


def _questions(spark, sf):
    return intents.parse_questions(A.view(spark, sf, _QUESTIONS))


@query("f18_parse_questions", f"""SELECT qid, {_INTENT} AS intent FROM (SELECT c_custkey AS qid, lower(c_mktsegment) AS s FROM customer)""")
def _(spark, sf):
    i = F.col("intent")
    parts = [F.coalesce(i[n].cast("string"), F.lit("")) for n in (
        "city", "category", "is_free", "priority", "has_clash", "month", "residual")]
    return _questions(spark, sf).select("qid", F.when(i.isNotNull(), F.concat(
        F.concat_ws("|", *parts), F.lit("|"))).alias("intent"))


@query("f19_apply_intents", """SELECT q.qid % 6 AS kind, e.event_id, count(*) AS n FROM ev e JOIN (SELECT c_custkey AS qid, lower(c_mktsegment) AS s
    FROM customer) q ON (q.qid % 6 = 0 AND contains(lower(city), 'tanta')
      AND (contains(lower(category), 'tech') OR contains(lower(title), 'tech') OR contains(lower(title), 'ai') OR contains(lower(title), 'hackathon'))
      AND (contains(lower(ticket_type), 'free') OR contains(lower(description), 'free') OR ticket_type = ''))
    OR (q.qid % 6 = 1 AND (contains(lower(category), 'career') OR contains(lower(title), 'job') OR contains(lower(title), 'career'))
      AND priority = 'HIGH' AND contains(upper(date_display), 'OCT'))
    OR (q.qid % 6 = 3 AND (contains(lower(category), 'flagship') OR score >= 9.0)
      AND (contains(lower(title), q.s) OR contains(lower(description), q.s) OR contains(lower(location), q.s)))
  GROUP BY 1, 2""")
def _(spark, sf):
    asked = _questions(spark, sf).drop("q").withColumn("kind", F.col("qid") % 6)
    return intents.apply_intents(conform(ev(spark, sf), "seq"), asked, count_by=["kind"])


# --------------------------------------------------------------------- leads
_ROLE_VALUES = ", ".join(f"({o}, {S.q(n)}, {S.q(k)}, {m})" for o, n, k, m, _p, _f in lx.ROLES)


@query("j4_lead_expansion", f"""SELECT 'lead_' || event_id || '_' || CAST(o AS VARCHAR) AS lead_id, role, organizer AS organization,
  CAST(m AS DOUBLE) AS strategic_score FROM ev CROSS JOIN (VALUES {_ROLE_VALUES}) r(o, role, k, m) WHERE o <= 3""")
def _(spark, sf):
    return leads.expand_roles(full_ev(spark, sf)).select("lead_id", "role", "organization", "strategic_score")


@query("j10_target_event", f"""SELECT 'lead_' || event_id || '_' || CAST(o AS VARCHAR) AS lead_id, role FROM
  (SELECT * FROM ev WHERE event_id = 'ev77') CROSS JOIN (VALUES {_ROLE_VALUES}) r(o, role, k, m)""")
def _(spark, sf):
    return leads.expand_roles(leads.target_event(full_ev(spark, sf), "ev77"), "ev77").select("lead_id", "role")


@query("f20_lead_filter", f"""SELECT 'lead_' || event_id || '_' || CAST(o AS VARCHAR) AS lead_id FROM ev
  CROSS JOIN (VALUES {_ROLE_VALUES}) r(o, role, k, m) WHERE o <= 3 AND k = 'marketing' AND (contains(lower(title), 'summit') OR
  contains(lower(city), 'summit') OR contains(lower(organizer), 'summit') OR contains(lower(role), 'summit'))""")
def _(spark, sf):
    return leads.filter_leads(leads.expand_roles(full_ev(spark, sf)), "marketing", "summit").select("lead_id")


@query("s15_lead_export", f"""SELECT 'lead_' || event_id || '_' || CAST(o AS VARCHAR) AS "Lead ID", role AS "Title", title AS "Event Title"
  FROM ev CROSS JOIN (VALUES {_ROLE_VALUES}) r(o, role, k, m) WHERE o <= 3""")
def _(spark, sf):
    return snapshots.lead_csv(leads.expand_roles(full_ev(spark, sf))).select("Lead ID", "Title", "Event Title")


_SENDER = {"name": "Nour Adel", "email": "nour@example.org", "phone": "+20 100", "network": "Campus Network"}


@query("x16_outreach_text", """SELECT event_id, 'Event Collaboration & Booth Partnership: Campus Network x ' || title AS subject,
  starts_with('mailto:?subject=', 'mailto') AS is_mail FROM ev""")
def _(spark, sf):
    out = leads.outreach(full_ev(spark, sf), _SENDER)
    return out.select("event_id", "subject", (F.col("mailto_url").startswith("mailto:?subject=Event%20Collaboration")
                                              & ~F.col("mailto_url").contains(" ")).alias("is_mail"))


# -------------------------------------------------------------------- search
_TOK = "regexp_extract_all(regexp_replace(strip_accents(lower(text)), '\\p{Mn}+', '', 'g'), '[\\p{L}\\p{N}]+')"


def _search_questions(spark, sf):
    b = A.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def _doc_index(spark, sf):
    return search.build_index(A.table(spark, sf, "documents"), "doc_id", ("text",))


@query("q1_inverted_index", f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM
  (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) GROUP BY term""")
def _(spark, sf):
    return _doc_index(spark, sf).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _stored_index(spark, sf, drop_toxic: bool = False) -> segments.Index:
    """The documents as a stored index; with ``drop_toxic`` in two segments (labelled ones, then the others) without those marked toxic."""
    root, docs = f"{Scratch(spark).root}/index", A.table(spark, sf, "documents")
    if not drop_toxic:
        segments.add(docs, root, "doc_id", ("text",))
        return segments.open_index(spark, root)
    labels = A.table(spark, sf, "labels")
    segments.add(docs.join(labels, "doc_id", "left_semi"), root, "doc_id", ("text",))
    segments.add(docs.join(labels, "doc_id", "left_anti"), root, "doc_id", ("text",))
    segments.delete(labels.where("toxic = 1"), root, "doc_id")
    return segments.open_index(spark, root)


@query("q1_stored_segments", f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM
  (SELECT doc_id, unnest({_TOK}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY 1, 2) GROUP BY term""")
def _(spark, sf):
    """Two segments, documents deleted, segments merged: the terms of what is left."""
    index = _stored_index(spark, sf, drop_toxic=True)
    segments.merge_segments(spark, index.root, most=1)
    return segments.open_index(spark, index.root).terms()


_BM25 = f"""WITH d AS (SELECT doc_id, {_TOK} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d),
  w AS (SELECT item_id AS qid, unnest(list_filter(list_transform(string_split_regex(text, '\\s+'),
      lambda x: regexp_replace(strip_accents(lower(x)), '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '')) AS p FROM benchmark),
  w2 AS (SELECT qid, p, row_number() OVER (PARTITION BY qid) AS pos, count(*) OVER (PARTITION BY qid) AS k FROM w),
  t AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY 1, 2, 3),
  h AS (SELECT qid, pos, k, doc_id, dl, sum(tf) AS tf FROM w2 JOIN p ON starts_with(p.term, w2.p) GROUP BY 1, 2, 3, 4, 5),
  f AS (SELECT qid, pos, count(*) AS df FROM h GROUP BY 1, 2),
  s AS (SELECT qid, doc_id, count(*) AS m, any_value(k) AS k, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6
      ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score
    FROM h JOIN f USING (qid, pos) CROSS JOIN n GROUP BY 1, 2)"""


@query("q2_ranked_search_scores", _BM25 + " SELECT qid, count(*) AS n_hits, round(max(score), 4) AS best FROM s WHERE m = k GROUP BY qid")
def _(spark, sf):
    hits = _stored_index(spark, sf).search(_search_questions(spark, sf), limit=1 << 30)
    return hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.round(F.max("score"), 4).alias("best"))


@query("q2_ranked_search_top", _BM25 + """ SELECT qid, doc_id AS id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid
  ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM s WHERE m = k QUALIFY rank <= 50""")
def _(spark, sf):
    return _stored_index(spark, sf).search(_search_questions(spark, sf))


_REST = _BM25.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", 1)


@query("q2_search_after_deletes", _REST + """ SELECT qid, doc_id AS id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid
  ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank FROM s WHERE m = k QUALIFY rank <= 50""")
def _(spark, sf):
    """Search over two segments with delete marks, before any merge."""
    return _stored_index(spark, sf, drop_toxic=True).search(_search_questions(spark, sf))


@query("q3_substring_search", """SELECT event_id FROM ev WHERE contains(lower(title), 'machinery 9') OR contains(lower(description), 'machinery 9')
  OR contains(lower(city), 'machinery 9') ORDER BY seq LIMIT 50""")
def _(spark, sf):
    return search.substring_search(ev(spark, sf), "Machinery 9 ")


@query("c7_weighted_keywords", """SELECT doc_id, round(sum(w), 6) AS weight, count(*) AS n_terms FROM (SELECT doc_id, list_distinct(
  regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS toks FROM documents) JOIN (VALUES ('the', 1.5), ('with', 2.0), ('les', 0.5)) t(term, w)
  ON list_contains(toks, term) GROUP BY doc_id""")
def _(spark, sf):
    weights = spark.createDataFrame([("The", 1.5), ("with", 2.0), ("les", 0.5)], "term string, weight double")
    return score.weighted_keywords(A.table(spark, sf, "documents"), "doc_id", "text", weights)


# ------------------------------------------------------------ joins and sets
_FRESH = "(SELECT * FROM ev WHERE seq % 3 = 0)"


def _fresh(spark, sf):
    return full_ev(spark, sf).where("seq % 3 = 0")


@query("j6_fresh_and_stored", """SELECT event_id, title || CASE WHEN seq % 3 = 0 THEN ' new' ELSE '' END AS title FROM ev""")
def _(spark, sf):
    fresh = _fresh(spark, sf).withColumn("title", F.concat("title", F.lit(" new")))
    return jobs.fresh_and_stored(fresh, full_ev(spark, sf)).select("event_id", "title")


@query("j7_import_admission", """SELECT min(seq) AS seq FROM ev WHERE seq % 3 <> 0 AND seq % 7 <> 0 GROUP BY organizer""")
def _(spark, sf):
    known = full_ev(spark, sf)
    known = known.where("seq % 3 = 0").unionByName(
        known.where("seq % 7 = 0").withColumn("event_id", F.lit("other")).withColumn("url", F.concat("url", F.lit("&x"))))
    new = full_ev(spark, sf).withColumns({"url": F.when(F.col("seq") % 7 == 0, F.concat("url", F.lit("&x"))).otherwise(
        F.concat(F.lit("https://o.example/"), "organizer"))})
    return payload.admit(new, known, ["seq"]).select("seq")


@query("j8_custom_rows", """SELECT event_id FROM ev WHERE seq % 5 NOT IN (0, 1, 2)""")
def _(spark, sf):
    e = cut_lineage(conform(dealt_ev(spark, sf), "seq"))  # read by several lookups, joined once
    other = F.lit("zz")
    curated = e.where("seq % 5 IN (0, 1, 2)").withColumns({
        "event_id": F.when(F.col("seq") % 5 == 0, F.col("event_id")).otherwise(other),
        "url": F.when(F.col("seq") % 5 == 1, F.col("url")).otherwise(F.lit("https://c.example/none")),
        "title": F.concat(F.col("title"), F.when(F.col("seq") % 5 == 2, F.lit(" !")).otherwise(F.lit(" extra words here")))})
    custom = e.withColumn("title", F.concat("title", F.lit(""), F.when(F.col("seq") % 5 == 2, F.lit("")).otherwise(
        F.concat(F.lit(" k"), F.col("seq").cast("string")))))
    kept = snapshots.merge_custom(curated.withColumn("title", F.when(F.col("seq") % 5 == 2, F.concat(
        F.col("title"), F.lit("u"), F.col("seq").cast("string"))).otherwise(F.col("title"))), custom.withColumn(
        "title", F.when(F.col("seq") % 5 == 2, F.concat(F.col("title"), F.lit("u"), F.col("seq").cast("string"))).otherwise(
            F.col("title"))))
    return kept.select("event_id")


@query("j9_title_repair", """SELECT 'c' || event_id AS event_id, title FROM ev WHERE seq % 4 = 1
  UNION ALL SELECT event_id, title FROM ev WHERE seq % 4 = 2 UNION ALL SELECT event_id, title || ' own' FROM ev WHERE seq % 4 = 3""")
def _(spark, sf):
    e = cut_lineage(conform(dealt_ev(spark, sf), "seq"))  # read by several lookups, joined once
    kind, bad = F.col("seq") % 4, F.lit("Interested")
    custom = e.where(kind > 0).withColumns({
        "title": F.when(kind == 3, F.concat("title", F.lit(" own"))).otherwise(bad),
        "event_id": F.when(kind == 1, F.concat(F.lit("c"), "event_id")).otherwise(F.col("event_id")),
        "url": F.when(kind == 2, F.lit("#")).otherwise(F.col("url"))})
    later = e.withColumns({"seq": F.col("seq") + 10_000_000, "title": F.concat("title", F.lit(" later"))})  # the first in order counts
    return snapshots.repair_titles(e.unionByName(later), custom).select("event_id", "title")


@query("u_all_bag_union", "SELECT source, count(*) * 2 AS n FROM ev GROUP BY source")
def _(spark, sf):
    e = ev(spark, sf)
    return jobs.union_sources([e, e]).groupBy("source").agg(F.count("*").alias("n"))


@query("u_pre_prepend", """SELECT event_id, CASE WHEN seq % 3 = 0 THEN seq ELSE seq + (SELECT max(seq) FROM ev WHERE seq % 3 = 0) END AS seq FROM ev""")
def _(spark, sf):
    return jobs.prepend(_fresh(spark, sf), full_ev(spark, sf).where("seq % 3 <> 0")).select("event_id", "seq")


@query("u_dist_distinct_union", "SELECT DISTINCT lower(trim(title)) AS k FROM ann WHERE trim(title) <> ''")
def _(spark, sf):
    from ..sources.social import union_items
    a = ann(spark, sf).select(F.lit("").alias("event_id"), "title")
    return union_items(a, a).select(F.lower(F.trim("title")).alias("k"))


# --------------------------------------------------------------- tables, jobs
@query("s13_sheet_export", """SELECT title AS "Event Title", date_display AS "Date & Time", printf('%.1f', score) AS "Score (1-10)",
  CASE WHEN coalesce(parallel_org, '') = '' THEN 'Independent' ELSE parallel_org END AS "Student Org / Partner" FROM ev""")
def _(spark, sf):
    return snapshots.to_sheet(full_ev(spark, sf)).select("Event Title", "Date & Time", "Score (1-10)", "Student Org / Partner")


@query("s2_sheet_import", """SELECT title, score, CASE WHEN coalesce(parallel_org, '') IN ('', 'Independent') THEN NULL ELSE parallel_org END AS parallel_org
  FROM ev WHERE NOT contains(lower(source), 'facebook') AND NOT contains(lower(source), 'summits')""")
def _(spark, sf):
    return snapshots.from_sheet(snapshots.to_sheet(full_ev(spark, sf))).select("title", "score", "parallel_org")


@query("s14_client_export", 'SELECT title AS "Title", city AS "City", url AS "URL" FROM ev')
def _(spark, sf):
    return snapshots.to_client_csv(full_ev(spark, sf)).select("Title", "City", "URL")


@query("s1_snapshot_gate", f"""SELECT event_id FROM ({_SHOWN}) WHERE NOT
  ({_PASSED})""")
def _(spark, sf):
    return snapshots.clean_snapshot(full_ev(spark, sf), A.REF_NOW).select("event_id")


@query("a12_quality_audit", """SELECT * FROM (SELECT 'rows_below_floor' AS "check", CAST(0 AS BIGINT) AS n UNION ALL
  SELECT 'duplicate_ids', count(*) FROM ev WHERE seq % 3 = 0 UNION ALL SELECT 'duplicate_links', count(*) FROM ev WHERE seq % 3 = 0
  UNION ALL SELECT 'rejected_rows', 0)""")
def _(spark, sf):
    e = full_ev(spark, sf)
    return snapshots.audit(e.unionByName(e.where("seq % 3 = 0")))


@query("a13_snapshot_parity", """SELECT 'a' AS copy, count(*) AS n_rows, TRUE AS all_equal FROM orders UNION ALL
  SELECT 'b', count(*), TRUE FROM orders""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    return snapshots.parity({"a": o, "b": o.repartition(3, "o_custkey")}).select("copy", "n_rows", "all_equal")


@query("b3_view_query", f"""SELECT event_id, priority FROM ({_SHOWN}) WHERE NOT
  ({_PASSED}) AND priority = 'HIGH' AND contains(lower(category), 'career')
  AND is_social_first""")
def _(spark, sf):
    rows, _metrics = jobs.view_query(full_ev(spark, sf), A.REF_NOW, priority="high", category="career", social_only=True)
    return rows.select("event_id", "priority")


@query("b3_view_metrics", f"""SELECT count(*) AS total_events, count(*) FILTER (priority = 'HIGH') AS high_priority,
  count(*) FILTER (priority = 'LOW') AS total_filtered FROM ({_SHOWN}) WHERE NOT
  ({_PASSED})""")
def _(spark, sf):
    _rows, metrics = jobs.view_query(full_ev(spark, sf), A.REF_NOW, priority="low")
    return metrics.select("total_events", "high_priority", "total_filtered")


@query("b4_purge", f"""SELECT event_id FROM ({_SHOWN}) WHERE NOT
  ({_PASSED})""")
def _(spark, sf):
    return jobs.purge(ev(spark, sf), A.REF_NOW).select("event_id")


_HEX = ("substr(md5('a' || {k}), 1, 8) || ' ' || substr(md5('b' || {k}), 1, 8) || ' ' || substr(md5('c' || {k}), 1, 8) || ' ' || "
        "substr(md5('d' || {k}), 1, 8) || ' ' || substr(md5('e' || {k}), 1, 6)").format(k="CAST(o_orderkey AS STRING)")


def _known(spark, sf, arms):
    """One record per order and arm (source, title, url, start), whose fate is known by construction."""
    o = A.table(spark, sf, "orders")
    parts = [o.select((F.col("o_orderkey") * 8 + n + 1).alias("seq"), F.expr(f"'p' || CAST(o_orderkey * 8 + {n} AS STRING)").alias("event_id"),
                      F.expr(title).alias("title"), F.lit(source).alias("source"), F.expr(url).alias("url"), F.expr(start).alias("start_date"),
                      F.lit("Tanta").alias("city"), F.lit("Egypt").alias("country"), F.lit("plain").alias("description"), F.lit("Hall 1").alias("location"),
                      F.lit("").alias("date_display")) for n, (source, title, url, start) in enumerate(arms)]
    return [conform(p, "seq") for p in parts]


_SOON = "CAST(DATE '2023-07-01' + CAST(o_orderkey % 150 AS INT) AS TIMESTAMP_NTZ)"
_PAGE = "'https://www.example.org/k/' || CAST(o_orderkey AS STRING)"


@query("e2_client_dedup", f"""SELECT 'p' || CAST(o_orderkey * 8 AS VARCHAR) AS event_id, {_HEX.replace('STRING', 'VARCHAR')} AS title FROM orders""")
def _(spark, sf):
    arms = [("Eventbrite", _HEX, _PAGE, _SOON), ("AllEvents", _HEX + " || ' annual edition'", _PAGE + " || '/copy'", _SOON),
            ("AllEvents", "'Null'", "''", _SOON), ("AllEvents", "reverse(" + _HEX + ")", _PAGE + " || '/old'", "TIMESTAMP_NTZ '2020-01-01 09:00:00'"),
            ("Meetup", "reverse(" + _HEX + ")", _PAGE + " || '?utm_source=z'", _SOON)]
    rows = reduce(DataFrame.unionByName, _known(spark, sf, arms))
    return jobs.deduplicate_client(rows, A.REF_NOW).select("event_id", "title")


@query("b1_known_pass", f"""SELECT 'p' || CAST(o_orderkey * 8 AS VARCHAR) AS event_id, {_HEX.replace('STRING', 'VARCHAR')} || ' annual edition' AS title,
  'Eventbrite, AllEvents' AS source, strftime(DATE '2023-07-01' + CAST(o_orderkey % 150 AS INT), '%Y-%m-%d') AS start_day FROM orders""")
def _(spark, sf):
    arms = [("Eventbrite", _HEX, _PAGE, _SOON), ("AllEvents", _HEX + " || ' annual edition'", _PAGE + " || '/copy'", _SOON),
            ("AllEvents", "reverse(" + _HEX + ")", _PAGE + " || '/far'", "TIMESTAMP_NTZ '2030-01-01 09:00:00'")]
    out = jobs.full_pass([p.drop("seq") for p in _known(spark, sf, arms)], A.REF_NOW)
    return out.select("event_id", "title", "source", F.date_format("start_date", "yyyy-MM-dd").alias("start_day"))


@query("b2_known_pass", f"""SELECT 'p' || CAST(o_orderkey * 8 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS event_id,
  {_HEX.replace('STRING', 'VARCHAR')} || ' annual edition' AS title FROM orders""")
def _(spark, sf):
    stored, fresh = _known(spark, sf, [("Eventbrite", _HEX + " || ' annual edition'", _PAGE, _SOON), ("AllEvents", _HEX, _PAGE + " || '/copy'", _SOON)])
    even = F.expr("CAST(substr(event_id, 2) AS BIGINT) DIV 8 % 2 = 0")
    # even orders come fresh before their stored copy, odd ones are stored only
    return jobs.incremental_pass(fresh.where(even), stored, A.REF_NOW).select("event_id", "title")


@query("b1_full_pass")
def _(spark, sf):
    e = ev(spark, sf)
    parts = [e.where(F.col("source") == s).drop("seq") for s in ("Eventbrite", "TicketsMarche", "Facebook Events",
                                                                 "Egypt Flagship Summits")]
    out = jobs.full_pass(parts, A.REF_NOW)
    return out.select("event_id", "title", "source", ts("start_date").alias("start_date"), "city", "score", "priority",
                      "category", "clash_count", "organizer_email")


@query("b2_incremental_pass")
def _(spark, sf):
    e = full_ev(spark, sf)
    out = jobs.incremental_pass(e.where("seq % 2 = 0"), e, A.REF_NOW)
    return out.select("event_id", "title", "source", ts("start_date").alias("start_date"), "city", "score", "priority")


@query("r3_weekly_counts_batch", """SELECT event_type AS city, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, count(*) AS n_events
  FROM events GROUP BY 1, 2""")
def _(spark, sf):
    from ..streaming.intake import weekly_counts
    e = A.table(spark, sf, "events").select(F.col("event_type").alias("city"), F.col("ts").cast("timestamp").alias("start_ts"))
    return weekly_counts(e).select("city", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "n_events")


