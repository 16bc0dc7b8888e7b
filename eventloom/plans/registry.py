"""Every operator as a query over the given tables, with its check in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import dates as D
from ..functions import text as T
from ..functions import urls as U
from ..functions.patterns import first_label, matches
from ..operators import clash, enrich, keyed, merge, quality, resolve, score, views
from ..schema import conform
from . import adapters as A
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TS = "yyyy-MM-dd HH:mm:ss"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = S.with_views(sql)
        return fn
    return register


def ev(spark, sf) -> DataFrame:
    return A.view(spark, sf, A.EV)


def dealt_ev(spark, sf) -> DataFrame:
    """The same rows, spread over the cores for costly work on each."""
    return A.view(spark, sf, A.EV, dealt=("orders",))


def full_ev(spark, sf) -> DataFrame:
    return conform(ev(spark, sf), "seq")


def cap(spark, sf) -> DataFrame:
    # captions are read by long chains of patterns
    return A.view(spark, sf, A.CAP, dealt=("orders",))


def ann(spark, sf) -> DataFrame:
    return A.view(spark, sf, A.ANN)


def ts(col) -> F.Column:
    return F.date_format(col, _TS)


NOW = S.q(A.REF_NOW.strftime("%Y-%m-%d %H:%M:%S"))
TODAY = S.q(A.REF_NOW.strftime("%Y-%m-%d"))

# ---------------------------------------------------------------- predicates
_FILTERS = {
    "f1_city_equals": (lambda: views.city_is("TANTA"), "lower(city) = 'tanta'"),
    "f2_city_contains": (lambda: views.city_contains("nation_1"), "contains(lower(city), 'nation_1')"),
    "f3_priority_equals": (lambda: views.priority_is("high"), "priority = 'HIGH'"),
    "f4_source_social": (lambda: views.source_matches("social"), S.contains_any("lower(source)", lx.SOCIAL_NETWORKS)),
    "f4_source_named": (lambda: views.source_matches("ticketsmarche"), "contains(lower(source), 'ticketsmarche')"),
    "f5_category_contains": (lambda: views.category_contains("career"), "contains(lower(category), 'career')"),
    "f6_smart_category_tech": (lambda: views.smart_category("Technology & Hackathons"),
                               "contains(lower(category), 'technology & hackathons') OR contains(lower(category), 'tech')"
                               " OR contains(lower(title), 'tech') OR contains(lower(title), 'ai')"
                               " OR contains(lower(title), 'hackathon')"),
    "f6_smart_category_flagship": (lambda: views.smart_category("Flagship Summits"),
                                   "contains(lower(category), 'flagship') OR score >= 9.0"
                                   " OR contains(lower(title), 'techne') OR contains(lower(title), 'riseup')"),
    "f7_partner_only": (lambda: views.has_partner(), "coalesce(parallel_org, '') <> ''"),
    "f7_partner_only_client": (lambda: views.has_partner(client=True),
                               "coalesce(parallel_org, '') NOT IN ('', 'Independent')"),
    "f7_social_only": (lambda: views.is_social(), "is_social_first OR "
                       + S.contains_any("lower(source)", lx.SOCIAL_NETWORKS)),
    "f8_keyword_search": (lambda: views.keyword("Machinery 1"),
                          " OR ".join(f"contains(lower({c}), 'machinery 1')" for c in (
                              "title", "location", "organizer", "description", "category"))),
    "f22_city_scope": (lambda: views.in_scope("giza") & views.in_scope("nationwide"), "lower(city) = 'giza'"),
}
for _name, (_pred, _cond) in _FILTERS.items():
    query(_name, f"SELECT event_id, city, priority, source FROM ev WHERE {_cond}")(
        lambda spark, sf, p=_pred: ev(spark, sf).where(p()).select("event_id", "city", "priority", "source"))

_CLASHED = f"""SELECT *, count(*) OVER (PARTITION BY lower(city), {S.week('start_date')}) AS n FROM ev
  WHERE start_date IS NOT NULL"""


@query("f7_clash_only", f"SELECT event_id, CAST(n AS INTEGER) AS clash_count FROM ({_CLASHED}) WHERE n >= 2")
def _(spark, sf):
    return clash.flag_clashes(full_ev(spark, sf)).where(views.has_clash()).select("event_id", "clash_count")


# the display text is written from the order date, so its meaning is known without reading it
_SHOWN = f"""SELECT e.*, CASE WHEN e.seq % 4 <> 3 THEN make_date(CASE WHEN e.seq % 4 = 2 THEN {A.REF_NOW.year}
    ELSE CAST(extract(year FROM o_orderdate + INTERVAL 25 YEAR) AS INT) END,
    CAST(extract(month FROM o_orderdate + INTERVAL 25 YEAR) AS INT),
    CAST(extract(day FROM o_orderdate + INTERVAL 25 YEAR) AS INT)) END AS shown
  FROM ev e JOIN orders ON o_orderkey = e.seq"""
_PASSED = f"""CASE WHEN end_date < TIMESTAMP {NOW} THEN TRUE WHEN shown < DATE {TODAY} THEN TRUE
  WHEN start_date IS NULL THEN FALSE WHEN shown >= DATE {TODAY} THEN FALSE
  WHEN CAST(start_date AS DATE) < DATE {TODAY} THEN TRUE
  WHEN CAST(start_date AS DATE) = DATE {TODAY} AND TIMESTAMP {NOW} - start_date > INTERVAL 6 HOUR THEN TRUE
  ELSE FALSE END"""


@query("f10_event_passed", f"SELECT event_id, {_PASSED} AS passed FROM ({_SHOWN})")
def _(spark, sf):
    passed = D.event_passed(F.col("end_date"), F.col("date_display"), F.col("start_date"), A.REF_NOW)
    return ev(spark, sf).select("event_id", passed.alias("passed"))


@query("f11_event_passed_by_day", f"""SELECT event_id, coalesce(coalesce(CAST(end_date AS DATE), shown,
  CAST(start_date AS DATE)) < DATE {TODAY}, FALSE) AS passed FROM ({_SHOWN})""")
def _(spark, sf):
    passed = D.event_passed_by_day(F.col("end_date"), F.col("date_display"), F.col("start_date"), A.REF_NOW)
    return ev(spark, sf).select("event_id", passed.alias("passed"))


# a display text without a year more than 60 days back means next year
_FILLED = f"""SELECT *, coalesce(start_date, CASE WHEN seq % 4 = 3 THEN NULL
  WHEN seq % 4 = 2 AND shown + INTERVAL 9 HOUR <= TIMESTAMP {NOW} - INTERVAL 61 DAY THEN shown + INTERVAL 1 YEAR + INTERVAL 9 HOUR
  ELSE shown + INTERVAL 9 HOUR END) AS filled FROM ({_SHOWN})"""


@query("f9_date_window", f"""SELECT event_id, {S.ts('filled')} AS start_date FROM
  (SELECT * EXCLUDE (start_date), filled AS start_date, filled FROM ({_FILLED}))
  WHERE NOT {_PASSED} AND (filled IS NULL OR filled <= TIMESTAMP {NOW} + INTERVAL 180 DAY)""")
def _(spark, sf):
    return quality.date_window(ev(spark, sf), A.REF_NOW).select("event_id", ts("start_date").alias("start_date"))


@query("f12_garbage_title", """SELECT event_id, defect IN (2, 3) AS garbage FROM raw""")
def _(spark, sf):
    raw = A.view(spark, sf, A.RAW)
    return raw.select("event_id", T.is_garbage_title(F.col("title")).alias("garbage"))


@query("f13_client_garbage_title", """SELECT event_id, defect IN (2, 3) AS garbage FROM raw""")
def _(spark, sf):
    raw = A.view(spark, sf, A.RAW)
    return raw.select("event_id", T.is_bad_client_title(F.col("title")).alias("garbage"))


@query("f14_reject_reason", """SELECT event_id, CASE defect WHEN 8 THEN CASE WHEN country = 'Italy' THEN 'country' ELSE 'link' END
  WHEN 2 THEN 'title' WHEN 3 THEN 'title' WHEN 6 THEN 'foreign' WHEN 9 THEN 'undated' END AS reason FROM raw""")
def _(spark, sf):
    return A.view(spark, sf, A.RAW).select("event_id", quality.reject_reason().alias("reason"))


@query("f15_merge_rejects", f"""SELECT doc_id FROM (SELECT doc_id, lower(text) AS t FROM documents)
  WHERE {S.contains_any('t', lx.MERGE_REJECT_WORDS)}
  UNION ALL SELECT CAST(seq AS BIGINT) AS doc_id FROM raw WHERE {S.contains_any('lower(location)', lx.MERGE_REJECT_WORDS)}
  OR contains(lower(location), 'main st')""")
def _(spark, sf):
    docs = ann(spark, sf).select(F.col("seq").alias("doc_id"), "event_id", F.col("description").alias("title"),
                                 "location", F.lit("").alias("url"))
    raw = A.view(spark, sf, A.RAW).select(F.col("seq").alias("doc_id"), "event_id", F.lit("").alias("title"), F.replace(
        "location", F.lit("Main St"), F.lit("Urbino")).alias("location"), F.lit("").alias("url"))
    return docs.unionByName(raw).where(quality.synthetic_or_foreign()).select("doc_id")


@query("f16_placeholder_title", f"""SELECT event_id, n, (length(trim(t)) < 3 OR lower(trim(t)) IN ({', '.join(S.q(w) for w in lx.BLANK_TITLES)})) AS placeholder FROM (
  SELECT event_id, n, CASE n WHEN 0 THEN title WHEN 4 THEN 'Untitled' ELSE substr(title, 1, CAST(n AS INT)) END AS t FROM ann, (SELECT unnest([0, 1, 2, 3, 4]) AS n))""")
def _(spark, sf):
    # whole titles, and of each title what is left when it is cut to three characters or less, or missing
    n = F.explode(F.array(*map(F.lit, range(5)))).alias("n")
    t = F.when(F.col("n") == 0, F.col("title")).when(F.col("n") == 4, "Untitled").otherwise(F.substr(F.col("title"), F.lit(1), F.col("n")))
    return ann(spark, sf).select("event_id", "title", n).select("event_id", "n", quality.is_placeholder_title(t).alias("placeholder"))


_WATCH = """SELECT 'wl' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_name AS city, r_name AS university,
  CASE WHEN s_suppkey % 3 = 0 THEN 'IEEE & Engineering' ELSE 'Career Center' END AS category,
  CAST(s_acctbal AS INTEGER) AS priority_score, 'https://www.example.org/w/' || CAST(s_suppkey AS VARCHAR) AS facebook_url,
  'Days and fairs' AS typical_events FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


def watch(spark, sf):
    return A.view(spark, sf, _WATCH.replace("VARCHAR", "STRING").replace("INTEGER", "INT"))


@query("f17_watchlist_filter", f"""SELECT id, name FROM ({_WATCH}) WHERE (contains(lower(city), 'nation_1') OR
  contains(lower(university), 'nation_1')) AND contains(lower(category), 'ieee')
  AND contains(lower(concat_ws(' ', name, university, city, typical_events)), 'supplier')""")
def _(spark, sf):
    return views.watchlist(watch(spark, sf), "nation_1", "ieee", "supplier").select("id", "name")


@query("o5_top_watch_sources", f"SELECT name, facebook_url FROM ({_WATCH}) ORDER BY priority_score DESC, id LIMIT 8")
def _(spark, sf):
    return views.top_watch_sources(watch(spark, sf))


@query("f21_api_projection", """SELECT event_id, url AS proof_url, organizer FROM ev""")
def _(spark, sf):
    return views.api_projection(full_ev(spark, sf)).select("event_id", "proof_url", "organizer")


@query("f23_topic_preset", """SELECT event_id FROM ev WHERE contains(lower(category), 'career fair & employment')
  OR contains(lower(category), 'career') OR contains(lower(category), 'employment') OR contains(lower(title), 'job')
  OR contains(lower(title), 'career')""")
def _(spark, sf):
    return views.by_topic(ev(spark, sf), "Business & Jobs").select("event_id")


# --------------------------------------------------------------- aggregations
_SOCIAL = S.contains_any("lower(source)", lx.SOCIAL_NETWORKS)


@query("a1_dashboard_metrics", f"""SELECT count(*) AS total_events, count(*) FILTER (priority = 'HIGH') AS high_priority,
  (SELECT count(*) FROM ({_CLASHED}) WHERE n >= 2) AS clashes, count(*) FILTER (coalesce(parallel_org, '') <> '') AS partner_orgs,
  count(*) FILTER (contains(lower(category), 'flagship') OR contains(lower(source), 'summit')) AS flagship_count,
  count(*) FILTER (contains(lower(source), 'ticketsmarche')) AS ticketsmarche_count,
  count(*) FILTER ({_SOCIAL}) AS social_count FROM ev""")
def _(spark, sf):
    return views.dashboard_metrics(clash.flag_clashes(full_ev(spark, sf)))


@query("a2_stats", """SELECT count(*) AS total_events, count(*) FILTER (priority = 'HIGH') AS high_priority,
  count(*) FILTER (priority = 'MEDIUM') AS medium_priority, count(*) FILTER (priority = 'LOW') AS low_priority,
  count(*) FILTER (starts_with(lower(category), 'flagship') OR score >= 9.5) AS flagship_events,
  count(*) FILTER (contains(lower(city), 'tanta')) AS city_events FROM ev""")
def _(spark, sf):
    return views.stats(ev(spark, sf))


@query("a3_client_kpis", """SELECT count(*) AS total_events, count(*) FILTER (score >= 8.5) AS high_priority,
  count(*) FILTER (contains(category, 'Flagship') OR score >= 9.8) AS flagship_count FROM ev""")
def _(spark, sf):
    return views.client_kpis(ev(spark, sf))


@query("a5_clash_groups", f"""SELECT lower(city) AS city, {S.week('start_date')} AS week, count(*) AS n_events FROM ev
  WHERE start_date IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    return clash.clash_summary(ev(spark, sf))


@query("w1_clash_report", f"""SELECT a.event_id, a.n AS clash_count, coalesce(array_to_string(list_slice(
    list_filter(g.l, lambda x: x.event_id <> a.event_id), 1, 3).list_transform(lambda x: x.title), ' | '), '') AS clash_details
  FROM (SELECT *, CAST(count(*) OVER (PARTITION BY lower(city), {S.week('start_date')}) AS INTEGER) AS n FROM ev
    WHERE start_date IS NOT NULL) a
  JOIN (SELECT lower(city) AS c, {S.week('start_date')} AS w, list(struct_pack(seq := seq, event_id := event_id, title := title)
    ORDER BY seq) AS l FROM ev WHERE start_date IS NOT NULL GROUP BY 1, 2) g
  ON g.c = lower(a.city) AND g.w = {S.week('a.start_date')} WHERE a.n >= 2""")
def clash_report(spark, sf):
    return (clash.flag_clashes(full_ev(spark, sf)).where("clash_warning")
            .select("event_id", "clash_count", F.array_join("clash_details", " | ").alias("clash_details"))
            .orderBy("event_id"))


@query("a6_calendar", f"""SELECT CAST(day AS VARCHAR) AS day, n AS n_events, n > 1 AS conflict, event_id FROM
  (SELECT *, dense_rank() OVER (ORDER BY day) AS r, count(*) OVER (PARTITION BY day) AS n FROM
    (SELECT event_id, coalesce(CAST(start_date AS DATE), shown, DATE '9999-12-31') AS day FROM ({_SHOWN}))) WHERE r <= 25""")
def _(spark, sf):
    return clash.calendar(ev(spark, sf), A.REF_NOW.year).select(F.col("day").cast("string").alias("day"), "n_events",
                                                                "conflict", "event_id")


@query("a7_digest", """SELECT event_id, score, (SELECT count(*) FILTER (contains(category, 'University') OR
  contains(category, 'Student')) FROM ev WHERE score >= 8.5) AS campus_count FROM ev WHERE score >= 8.5 ORDER BY seq LIMIT 12""")
def _(spark, sf):
    return views.digest(ev(spark, sf)).select("event_id", "score", "campus_count")


@query("a8_briefing", """SELECT string_agg(n || '. ' || title || ' (' || city || ') | Date: ' || date_display || ' | Score: '
  || printf('%.1f', score) || ' (' || priority || ') | Action: ' || recommended_action || ' | Link: ' || url, chr(10) ORDER BY n)
  AS briefing FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM ev) WHERE n <= 5""")
def _(spark, sf):
    return views.briefing(ev(spark, sf))


@query("a9_source_list", """SELECT seq, CASE WHEN o = 0 THEN 'A' WHEN o = 1 THEN 'A, B' ELSE 'Unlisted source' END AS sources FROM
  (SELECT o_orderkey AS seq, o_orderkey % 3 AS o FROM orders)""")
def _(spark, sf):
    o = A.table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "A, A,A ").when(F.col("o_orderkey") % 3 == 1, " A,B, A").otherwise(" , ")
    return o.select(F.col("o_orderkey").alias("seq"), T.unique_sources(raw).alias("sources"))


@query("a11_contact_addresses", """SELECT DISTINCT 'info' || CAST(o_custkey AS VARCHAR) || '@club.org' AS email FROM orders
  WHERE o_orderkey % 3 = 1""")
def _(spark, sf):
    found = cap(spark, sf).select(enrich.caption_contacts(F.col("caption"))["email"].alias("email"))
    return enrich.contact_addresses(found, "email")


# ---------------------------------------------------------------------- order
for _how, _ord in {"score_desc": "score DESC", "date_asc": "start_date"}.items():
    query(f"o2_sort_{_how}", "SELECT event_id, score FROM ev")(
        lambda spark, sf, h=_how: views.sort_events(ev(spark, sf), h).select("event_id", "score"))


for _how, _ord in {"score_desc": "score DESC NULLS LAST", "score_asc": "score NULLS FIRST", "date_asc": "start_date NULLS LAST"}.items():
    query(f"o2_page_{_how}", f"SELECT event_id, CAST(row_number() OVER (ORDER BY {_ord}, event_id) AS INT) AS place FROM ev QUALIFY place <= 200")(
        lambda spark, sf, h=_how: keyed.with_place(views.sort_events(ev(spark, sf), h).limit(200)).select("event_id", "place"))


@query("o1_timeline_top", """SELECT event_id, score FROM ev ORDER BY start_date NULLS LAST, score DESC, event_id LIMIT 100""")
def _(spark, sf):
    return ev(spark, sf).orderBy(*views.timeline_order()).limit(100).select("event_id", "score")


@query("o2_latest_top", "SELECT event_id, score FROM ev ORDER BY start_date DESC NULLS LAST, event_id LIMIT 100")
def _(spark, sf):
    return views.sort_events(ev(spark, sf), "date_desc").limit(100).select("event_id", "score")


@query("o3_effective_start_top", f"""SELECT event_id FROM ({_SHOWN}) ORDER BY coalesce(start_date, CAST(shown AS TIMESTAMP))
  NULLS LAST, event_id LIMIT 100""")
def _(spark, sf):
    return views.sort_by_timestamp(ev(spark, sf), A.REF_NOW.year).limit(100).select("event_id")


@query("o4_table_sort_title", "SELECT event_id, title FROM ev ORDER BY lower(title) COLLATE BINARY, event_id LIMIT 50"
       .replace(" COLLATE BINARY", ""))
def _(spark, sf):
    return views.sort_table(ev(spark, sf), "title", True).limit(50).select("event_id", "title")


@query("o6_quick_find", """SELECT event_id, title FROM ev WHERE contains(lower(title), 'building 1') OR contains(lower(city),
  'building 1') OR contains(lower(organizer), 'building 1') ORDER BY seq LIMIT 6""")
def _(spark, sf):
    return views.quick_find(ev(spark, sf), "building 1").select("event_id", "title")


@query("j11_hub_rollup", """SELECT hub, count(*) AS n_events, count(*) FILTER (contains(lower(category), 'flagship') OR
  contains(lower(title), 'techne') OR contains(lower(title), 'riseup')) AS n_flagship FROM ev JOIN (SELECT unnest(['cairo',
  'alexandria', 'tanta', 'giza', 'mansoura', 'assiut']) AS hub) ON contains(lower(city), hub) GROUP BY hub""")
def _(spark, sf):
    return views.hub_rollup(ev(spark, sf))


# ----------------------------------------------------------------------- text
@query("t1_ascii_digits", """SELECT post_id, CAST(custkey AS VARCHAR) AS digits FROM cap""")
def _(spark, sf):
    arabic = F.translate(F.col("custkey").cast("string"), "0123456789", lx.ARABIC_DIGITS)
    return cap(spark, sf).select("post_id", T.ascii_digits(arabic).alias("digits"))


def _sql_tokens(col: str, by: str, stop, longer: int) -> str:
    words = ", ".join(S.q(w) for w in stop)
    return (f"array_to_string(list_filter(string_split_regex(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}_\\s]', '{by}', 'g'),"
            f" '\\s+'), lambda x: x <> '' AND x NOT IN ({words}) AND length(x) > {longer}), ' ')")


@query("t2_comparison_title", f"SELECT event_id, {_sql_tokens('title', '', lx.TITLE_STOP, 0)} AS title FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("event_id", T.comparison_title(F.col("title")).alias("title"))


@query("t3_fuzzy_title", f"SELECT event_id, {_sql_tokens('title', ' ', lx.FUZZY_NOISE, 1)} AS title FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("event_id", T.fuzzy_title(F.col("title")).alias("title"))


@query("t4_alnum_key", "SELECT event_id, regexp_replace(lower(title), '[^a-zA-Z0-9؀-ۿ]', '', 'g') AS key FROM ann")
def _(spark, sf):
    return ann(spark, sf).select("event_id", T.alnum_key(F.col("title")).alias("key"))


@query("t5_fingerprint", f"""SELECT event_id, substr(sha256({_sql_tokens('title', '', lx.TITLE_STOP, 0)} || '|' || city || '|' ||
  coalesce({S.ts('start_date')}, '')), 1, 16) AS fingerprint FROM ann""")
def _(spark, sf):
    return ann(spark, sf).select("event_id", T.fingerprint(F.col("title"), F.col("city"), ts("start_date")).alias(
        "fingerprint"))


@query("t6_clean_entities", """SELECT event_id, CASE defect WHEN 5 THEN 'Art & Music "Night"' ELSE title END AS title FROM raw""")
def _(spark, sf):
    return A.view(spark, sf, A.RAW).select("event_id", T.clean_entities(F.col("title")).alias("title"))


@query("t7_clean_title", """SELECT event_id, CASE WHEN defect IN (2, 3) THEN 'Hall Session' ELSE title END AS title FROM raw""")
def _(spark, sf):
    noisy = F.concat(F.col("title"), F.lit("\n Interested \nHall Session · \nrest"))
    return A.view(spark, sf, A.RAW).select("event_id", T.clean_title(noisy).alias("title"))


@query("t8_recover_title", """SELECT event_id, CASE WHEN defect IN (2, 3) AND seq % 3 = 0 THEN 'Spring Meet 12'
  WHEN defect IN (2, 3) THEN 'Grand Party Night' ELSE title END AS title FROM raw""")
def _(spark, sf):
    url = F.when(F.col("seq") % 3 == 0, "https://www.facebook.com/events/spring-meet_12/99?x=1").otherwise(F.col("url"))
    desc = F.lit("Today 328 interested · 44 going Grand Party Night Gleem Hall downstairs")
    return A.view(spark, sf, A.RAW).select("event_id", T.recover_title(
        F.col("title"), desc, F.lit("Gleem Hall"), url).alias("title"))


@query("t9_city_name", f"""SELECT event_id, {S.first_label("lower(city || ' ' || title || ' ' || location)", lx.CITY_GROUPS,
       "upper(substr(city, 1, 1)) || lower(substr(city, 2))")} AS city FROM ev""".replace(
           "lower(substr(city, 2))", "regexp_replace(lower(substr(city, 2)), '_(.)', '_\\1')"))
def _(spark, sf):
    return ev(spark, sf).select("event_id", T.city_name(F.col("city"), F.col("title"), F.col("location")).alias("city"))


@query("t10_field_repair", f"""SELECT event_id, CASE defect WHEN 2 THEN location WHEN 5 THEN 'Art & Music "Night"' ELSE title END AS title,
  CASE WHEN defect IN (0, 1) THEN 'Tanta Cultural Hub' WHEN defect IN (2, 4) THEN 'Tanta, Egypt' ELSE location END AS location,
  CASE defect WHEN 0 THEN location WHEN 1 THEN date_display || ' · ' || location WHEN 2 THEN title ELSE date_display END AS date_display,
  {S.ts('''CASE defect WHEN 2 THEN TIMESTAMP '2023-10-16 09:00:00' WHEN 3 THEN start_date
    WHEN 0 THEN shown + INTERVAL 9 HOUR WHEN 1 THEN shown + INTERVAL 19 HOUR
    WHEN 7 THEN CASE WHEN start_date >= shown + INTERVAL 81 HOUR OR start_date < shown - INTERVAL 39 HOUR THEN shown + INTERVAL 9 HOUR
      ELSE start_date END ELSE start_date END''')} AS start_date
  FROM (SELECT *, make_date(2024, CAST(extract(month FROM order_date) AS INT), CAST(extract(day FROM order_date) AS INT)) AS shown
    FROM raw)""")
def _(spark, sf):
    return quality.repair_fields(A.view(spark, sf, A.RAW), A.REF_NOW).select(
        "event_id", "title", "location", "date_display", ts("start_date").alias("start_date"))


@query("t11_city_inference", f"""SELECT post_id, {S.first_label('lower(caption)', lx.SOCIAL_CITY_GROUPS, "'Cairo'")} AS social_city,
  {S.first_label('lower(caption)', lx.TICKET_CITY_GROUPS, "'Cairo'")} AS ticket_city FROM cap""")
def _(spark, sf):
    return cap(spark, sf).select(
        "post_id", T.infer_city(F.col("caption"), lx.SOCIAL_CITY_GROUPS, "Cairo").alias("social_city"),
        T.infer_city(F.col("caption"), lx.TICKET_CITY_GROUPS, "Cairo").alias("ticket_city"))


_CANON = """regexp_replace(lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' ||
  replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), 'www.', '') ||
  lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/+$', '')"""


@query("u1_canonical_url", f"SELECT page_id, {_CANON} AS link FROM pages")
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("link"))


@query("u2_client_canonical_url", """SELECT page_id, regexp_replace(lower(split_part(split_part(url, '?', 1), '#', 1)), '/+$', '')
  AS link FROM pages""")
def _(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", U.client_canonical_url(F.col("url")).alias("link"))


@query("u3_safe_event_url", """SELECT event_id, CASE seq % 3 WHEN 0 THEN url WHEN 1 THEN 'https://www.facebook.com/events/12345678901'
  || CAST(seq % 10 AS VARCHAR) || '/' ELSE 'https://www.facebook.com/events/search/?q=' || replace(title, ' ', '%20') END AS link FROM ev""")
def _(spark, sf):
    c = F.col
    direct = (F.when(c("seq") % 3 == 1, F.concat(F.lit("https://facebook.com/events/12345678901"),
                                                 (c("seq") % 10).cast("string")))
              .when(c("seq") % 3 == 2, F.lit("https://www.facebook.com/events/venue/workshop/1")))
    return ev(spark, sf).select("event_id", U.safe_event_url(direct, F.lit(""), c("url"), c("title")).alias("link"))


@query("u4_proof_source", """SELECT event_id, CASE WHEN seq % 2 = 0 THEN 'https://posts.example.com/' || CAST(seq AS VARCHAR) ELSE url END
  AS proof_url, CASE WHEN seq % 2 = 0 THEN 'posts.example.com' ELSE 'www.example.org' END AS proof_domain FROM ev""")
def _(spark, sf):
    post = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("https://posts.example.com/"), F.col("seq").cast("string")))
    none = F.lit(None).cast("string")
    df = ev(spark, sf).withColumn("proof_url", U.proof_source(none, post, none, none, F.col("url")))
    return df.select("event_id", "proof_url", U.domain(F.col("proof_url")).alias("proof_domain"))


@query("u5_proof_labels", """SELECT event_id, CASE WHEN seq % 2 = 0 THEN 'Direct Social Announcement Post'
  WHEN contains(lower(source), 'ticket') THEN 'Ticket Feed Listing' ELSE 'Official Organizer Announcement' END AS proof_type,
  CASE WHEN seq % 2 = 0 THEN 'Direct announcement post via ' ELSE 'Public event listing via ' END || source
  AS proof_evidence FROM ev""")
def _(spark, sf):
    df = full_ev(spark, sf).withColumn("post_direct_url", F.when(F.col("seq") % 2 == 0, "https://p.example.com/1"))
    return enrich.enrich_contacts(df).select("event_id", "proof_type", "proof_evidence")


@query("u6_short_link", """SELECT post_id, custkey % 3 <> 2 AS short FROM cap""")
def _(spark, sf):
    return cap(spark, sf).select("post_id", U.is_short_link(F.col("caption")).alias("short"))


# ---------------------------------------------------------------------- dates
@query("d1_parse_datetime", f"SELECT event_id, {S.ts('filled')} AS start_date FROM (SELECT * FROM ("
       + _FILLED.replace("coalesce(start_date, ", "coalesce(NULL, ") + "))")
def _(spark, sf):
    return ev(spark, sf).select("event_id", ts(D.parse_datetime(F.col("date_display"), A.REF_NOW)).alias("start_date"))


_CAP_DAY = "make_date(2026, CAST(extract(month FROM order_date) AS INT), CAST(extract(day FROM order_date) AS INT))"
_CAP_DATE = f"""CASE WHEN seq % 5 <> 4 THEN {_CAP_DAY} + CASE WHEN seq % 5 = 2 THEN INTERVAL 9 HOUR ELSE INTERVAL 10 HOUR END END"""
_CAP_LABEL = f"strftime({_CAP_DATE}, '%b %d, %Y')"


@query("d2_caption_date", f"""SELECT post_id, {S.ts(_CAP_DATE)} AS start_date, {_CAP_LABEL} AS date_display FROM cap""")
def _(spark, sf):
    got = D.caption_datetime(F.col("caption"), A.CAPTION_NOW)
    return cap(spark, sf).select("post_id", got.alias("d")).select(
        "post_id", ts("d.start_date").alias("start_date"), "d.date_display")


@query("d3_display_end", f"SELECT event_id, CAST(shown AS VARCHAR) AS concluding FROM ({_SHOWN})")
def _(spark, sf):
    return ev(spark, sf).select("event_id", D.display_end(F.col("date_display"), A.REF_NOW.year).cast("string").alias(
        "concluding"))


@query("d4_client_display_end", f"SELECT event_id, CAST(shown AS VARCHAR) AS concluding FROM ({_SHOWN})")
def _(spark, sf):
    return ev(spark, sf).select("event_id", D.display_end(F.col("date_display"), A.REF_NOW.year, client=True)
                                .cast("string").alias("concluding"))


@query("d5_source_date", f"""SELECT event_id, {S.ts(f'''CASE WHEN seq % 4 <> 3 THEN make_date({A.REF_NOW.year},
  CAST(extract(month FROM d) AS INT), CAST(extract(day FROM d) AS INT)) + CASE seq % 4 WHEN 0 THEN INTERVAL 9 HOUR
  WHEN 1 THEN INTERVAL 18 HOUR ELSE INTERVAL 20 HOUR END END''')} AS start_date FROM ev
  JOIN (SELECT o_orderkey, o_orderdate + INTERVAL 25 YEAR AS d FROM orders) ON o_orderkey = seq""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", ts(D.source_date(F.col("date_display"), A.REF_NOW.year)).alias("start_date"))


@query("d6_date_compatibility", """SELECT a.event_id AS a, count(*) AS n FROM ann a JOIN (SELECT seq, o_orderdate + INTERVAL 27 YEAR AS d
  FROM (SELECT o_orderkey AS seq, o_orderdate FROM orders)) b ON b.seq = a.seq
  WHERE a.start_date IS NULL OR abs(epoch(a.start_date) - epoch(b.d)) <= 345600 GROUP BY 1""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"),
                                           (F.col("o_orderdate") + F.expr("INTERVAL 27 YEAR")).alias("d"))
    return (ann(spark, sf).join(o, "seq").where(D.dates_compatible(F.col("start_date"), F.col("d")))
            .groupBy(F.col("event_id").alias("a")).agg(F.count("*").alias("n")))


@query("d7_week_key", f"SELECT o_orderkey, {S.week('o_orderdate')} AS week FROM orders")
def _(spark, sf):
    return A.table(spark, sf, "orders").select("o_orderkey", D.week_key(F.col("o_orderdate")).alias("week"))


@query("d8_tear_off", """SELECT event_id, CASE WHEN seq % 4 = 3 THEN 'DATE' ELSE upper(strftime(d, '%b')) END AS month,
  CASE WHEN seq % 4 = 3 THEN 'TBA' WHEN seq % 4 = 1 THEN '20' ELSE strftime(d, '%d') END AS day
  FROM ev JOIN (SELECT o_orderkey, o_orderdate + INTERVAL 25 YEAR AS d FROM orders) ON o_orderkey = seq""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", D.tear_off(F.col("date_display")).alias("b")).select("event_id", "b.*")


@query("d9_display_format", "SELECT event_id, strftime(start_date, '%b %d, %Y · %I:%M %p') AS shown FROM ev")
def _(spark, sf):
    return ev(spark, sf).select("event_id", D.display_format(F.col("start_date")).alias("shown"))


# -------------------------------------------------------------------- scoring
_SCORED = f"""SELECT *, {S.tier('tl', 'fl', 'org')} AS rule FROM (SELECT *, {S.partner('fl')} AS org FROM
  (SELECT post_id, lower(title) AS tl, lower(title || ' ' || note) AS fl FROM cap))"""


def scored(spark, sf) -> DataFrame:
    return score.evaluate(cap(spark, sf).withColumn("location", F.lit("")), description="note").select("post_id", "eval.*")


@query("c1_score_cascade", "SELECT post_id, rule, CASE rule " + " ".join(
    f"WHEN '{k}' THEN {v[0]}" for k, v in lx.OUTCOMES.items()) + " END::DOUBLE AS score, CASE rule " + " ".join(
    f"WHEN '{k}' THEN {S.q(v[2])}" for k, v in lx.OUTCOMES.items()) + " END AS category, concat_ws(',', org, CASE rule "
    + " ".join(f"WHEN '{k}' THEN {S.q(','.join(v[3]))}" for k, v in lx.OUTCOMES.items()) + f" END) AS tags FROM ({_SCORED})")
def _(spark, sf):
    return scored(spark, sf).select("post_id", "rule", "score", "category", F.array_join("tags", ",").alias("tags"))


@query("c1_tier_counts", f"SELECT rule, count(*) AS n FROM ({_SCORED}) GROUP BY rule")
def _(spark, sf):
    return scored(spark, sf).groupBy("rule").agg(F.count("*").alias("n"))


@query("c2_partner_org", f"SELECT post_id, org FROM ({_SCORED})")
def _(spark, sf):
    return scored(spark, sf).select("post_id", F.col("parallel_org").alias("org"))


def _outcome(i: int) -> str:
    return "CASE rule " + " ".join(f"WHEN '{k}' THEN {S.q(v[i]) if isinstance(v[i], str) else v[i]}" for k, v in lx.OUTCOMES.items()) + " END"


@query("c3_summit_uplift", f"""SELECT event_id, CASE WHEN summit THEN greatest({_outcome(0)}, 9.2) ELSE {_outcome(0)} END::DOUBLE AS score,
  CASE WHEN summit THEN 'HIGH' ELSE {_outcome(1)} END AS priority, CASE WHEN summit THEN 'Flagship Summits' ELSE {_outcome(2)} END AS category,
  CASE WHEN summit THEN recommended_action END AS action FROM (SELECT *, {S.tier('tl', 'fl', 'org')} AS rule FROM (SELECT *, {S.partner("fl || ' ' || ll")} AS org
  FROM (SELECT event_id, recommended_action, contains(lower(source), 'summit') AS summit, lower(title) AS tl, lower(title || ' ' || description) AS fl,
    lower(location) AS ll FROM ev)))""")
def _(spark, sf):
    """All events: those of summit sources are lifted and keep their action, the others get what the cascade says."""
    summit = score.is_summit_source(F.col("source"))
    return score.apply_scores(full_ev(spark, sf)).select("event_id", "score", "priority", "category", F.when(summit, F.col("recommended_action")).alias("action"))


@query("c4_snapshot_uplift", """SELECT event_id, CASE WHEN contains(lower(source), 'summit') THEN greatest(score, 9.2) ELSE score END
  AS score FROM ev""")
def _(spark, sf):
    return score.lift_summits(ev(spark, sf)).select("event_id", "score")


@query("c5_rescore_table", f"""SELECT event_id, {S.tier('tl', 'fl', 'org')} AS rule FROM (SELECT *, {S.partner("fl || ' ' || ll")} AS org
  FROM (SELECT event_id, lower(title) AS tl, lower(title || ' ' || description) AS fl, lower(location) AS ll FROM ev))""")
def _(spark, sf):
    return score.evaluate(ev(spark, sf)).select("event_id", "eval.rule")


_HAY = "lower(title || ' ' || note)"


@query("c6_client_score", f"""SELECT post_id, CASE
  WHEN regexp_matches(h, {S.q(lx.CLIENT_MEDICAL)}) AND NOT regexp_matches(h, {S.q(lx.CLIENT_MEDICAL_STUDENT)}) THEN 'medical'
  WHEN regexp_matches(h, {S.q(lx.CLIENT_LEISURE)}) THEN 'leisure' WHEN regexp_matches(h, {S.q(lx.CLIENT_INDUSTRIAL)}) THEN 'industrial'
  WHEN {S.contains_any('h', lx.CLIENT_SUMMIT_WORDS)} THEN 'summit' WHEN {S.contains_any('h', lx.CLIENT_HACKATHON_WORDS)} THEN 'hackathon'
  WHEN {S.contains_any('h', lx.CLIENT_CAREER_WORDS)} THEN 'career'
  WHEN regexp_matches(h, {S.q(lx.CLIENT_UNIVERSITY)}) AND regexp_matches(h, {S.q(lx.CLIENT_CONFERENCE)}) THEN 'university_conference'
  WHEN regexp_matches(h, {S.q(lx.CLIENT_CAMPUS)}) THEN 'campus' WHEN {S.contains_any('h', lx.CLIENT_TECH_WORDS)} THEN 'tech'
  ELSE 'default' END AS rule FROM (SELECT post_id, {_HAY} AS h FROM cap)""")
def _(spark, sf):
    none = F.lit(None)
    df = cap(spark, sf).select("post_id", "title", F.col("note").alias("description"), F.lit("").alias("location"),
                               F.lit("web").alias("source"), none.cast("string").alias("category"),
                               none.cast("double").alias("score"), none.cast("string").alias("recommended_action"))
    return score.evaluate_client(df).select("post_id", "eval.rule")


# ------------------------------------------------------------------ windows
@query("w2_keep_first", f"SELECT min(page_id) AS page_id FROM (SELECT page_id, {_CANON} AS link FROM pages) GROUP BY link")
def _(spark, sf):
    return keyed.keep_first(A.table(spark, sf, "pages"), U.canonical_url(F.col("url")), ["page_id"]).select("page_id")


@query("w3_arrival_order", """SELECT event_id, row_number() OVER (ORDER BY source, event_id) AS seq FROM (SELECT source, event_id FROM ev)""")
def _(spark, sf):
    return keyed.with_sequence(ev(spark, sf).select("source", "event_id"), ["source", "event_id"]).select("event_id", "seq")


@query("w4_first_line", """SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: length(x) >= 12)[1], '') AS line FROM conversations""")
def _(spark, sf):
    from ..functions.patterns import first_where, lines
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(first_where(
        lines(F.col("text")), lambda x: F.length(x) >= 12), F.lit("")).alias("line"))


# ------------------------------------------------------------- resolution
def _reposted(spark, sf, kinds):
    """Every order as a record, then again with its id, with its link, or with neither; titles too short to be compared."""
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_date"))
    again = o.crossJoin(spark.createDataFrame([(n,) for n in kinds], "n int"))  # one row of orders per kind
    k = F.col("k").cast("string")
    return again.select(
        (F.col("k") * 4 + F.col("n")).alias("seq"), "start_date", F.lit("ab").alias("title"),
        F.when(F.col("n") <= 1, F.concat(F.lit("k"), k)).otherwise(F.concat(F.lit("z"), F.col("n").cast("string"), k)).alias("event_id"),
        F.when(F.col("n") == 0, F.concat(F.lit("https://x.org/o/"), k)).when(F.col("n") == 2, F.concat(F.lit("https://x.org/o/"), k, F.lit("?ref=2")))
        .otherwise(F.concat(F.lit("https://x.org/n/"), F.col("n").cast("string"), F.lit("/"), k)).alias("url"))


@query("j1_id_candidates", """SELECT o_orderkey * 4 + n AS seq, CASE WHEN n = 3 THEN o_orderkey * 4 + 3 ELSE o_orderkey * 4 END AS leader,
  CASE n WHEN 1 THEN 'id' ELSE 'founder' END AS via FROM orders, (VALUES (0), (1), (3)) t(n)""")
def _(spark, sf):
    return resolve.resolve(_reposted(spark, sf, (0, 1, 3)))


@query("j2_link_candidates", """SELECT o_orderkey * 4 + n AS seq, CASE WHEN n = 3 THEN o_orderkey * 4 + 3 ELSE o_orderkey * 4 END AS leader,
  CASE n WHEN 2 THEN 'link' ELSE 'founder' END AS via FROM orders, (VALUES (0), (2), (3)) t(n)""")
def _(spark, sf):
    return resolve.resolve(_reposted(spark, sf, (0, 2, 3)))


_ANN_TOKENS = f"list_distinct(string_split({_sql_tokens('title', ' ', lx.FUZZY_NOISE, 1)}, ' '))"


@query("e4_jaccard_pairs", f"""WITH t AS (SELECT DISTINCT {_sql_tokens('title', ' ', lx.FUZZY_NOISE, 1)} AS f FROM ({A.ANN})),
  s AS (SELECT f, list_distinct(string_split(f, ' ')) AS w FROM t WHERE f <> '')
  SELECT a.f AS a, b.f AS b FROM s a JOIN s b ON a.f < b.f
  AND len(list_intersect(a.w, b.w)) >= 0.75 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""")
def _(spark, sf):
    titles = ann(spark, sf).select(T.fuzzy_title(F.col("title")).alias("fuzzy")).where("fuzzy <> ''").distinct()
    return resolve.jaccard_pairs(titles).select(F.col("l").alias("a"), F.col("r").alias("b"))


@query("e1_resolve_postings", """SELECT seq, min(seq) OVER (PARTITION BY orderkey) AS leader FROM postings""")
def resolved_postings(spark, sf):
    return resolve.resolve(A.view(spark, sf, A.POSTINGS)).select("seq", "leader")


@query("a4_merge_clusters", """SELECT min(seq) AS seq, count(*) AS n_members, arg_max(title, length(title) * 1000000 - seq % 1000) AS title,
  arg_max(priority, score * 1000000 - seq % 1000) AS priority, max(score) AS score, CASE WHEN count(*) = 1 THEN 'Eventbrite'
  WHEN count(*) = 2 THEN 'Eventbrite, AllEvents' ELSE 'Eventbrite, AllEvents, Facebook Events' END AS source FROM postings GROUP BY orderkey""")
def _(spark, sf):
    p = conform(A.view(spark, sf, A.POSTINGS), "seq")
    return merge.merge_clusters(p, resolve.resolve(p)).select("seq", "n_members", "title", "priority", "score", "source")


@query("a10_tag_union", """SELECT seq, CASE WHEN n >= 3 THEN 'Tag0|tag1|Tag2' WHEN n = 2 THEN 'Tag0|tag1' ELSE 'Tag0' END AS tags,
  CASE WHEN n >= 2 THEN 'Tanta' ELSE 'Egypt' END AS city, CASE WHEN n >= 3 THEN 'p2' END AS post_direct_url, repeat('d', CAST(n AS INT)) AS description,
  (n >= 4) AS is_social_first, n AS n_members
  FROM (SELECT min(seq) AS seq, count(*) AS n FROM postings GROUP BY orderkey)""")
def _(spark, sf):
    p = A.view(spark, sf, A.POSTINGS)
    n, none = F.col("seq") % 1000, F.lit(None).cast("string")
    p = p.withColumns({
        "tags": F.array(F.concat(F.when(n % 2 == 0, F.lit("Tag")).otherwise(F.lit("tag")), (n % 3).cast("string"))),
        "city": F.when(n == 0, F.lit("Egypt")).when(n == 1, F.lit("Tanta")).otherwise(F.lit("Cairo")),
        "post_direct_url": F.when(n >= 2, F.concat(F.lit("p"), n.cast("string"))).otherwise(none),
        "description": F.repeat(F.lit("d"), (n + 1).cast("int")), "is_social_first": n == 3})
    leaders = p.select("seq", (F.floor(F.col("seq") / 1000) * 1000).cast("long").alias("leader"))
    out = merge.merge_clusters(conform(p, "seq"), leaders)
    return out.select("seq", F.array_join("tags", "|").alias("tags"), "city", "post_direct_url", "description", "is_social_first", "n_members")


@query("e1_resolve_announcements")
def _(spark, sf):
    return resolve.resolve(ann(spark, sf))


@query("e2_client_resolve")
def _(spark, sf):
    return resolve.resolve(ann(spark, sf), resolve.CLIENT)
