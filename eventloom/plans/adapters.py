"""Event-shaped views over the given star-schema tables.

Each view is one SELECT that Spark and other ANSI engines read alike, so a check can repeat the same
input in SQL.  They are projections of whole tables: text is put together from the row's own values,
in a template chosen by its key.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

REF_NOW = datetime(2023, 6, 15, 12, 0)
CAPTION_NOW = datetime(2026, 3, 1, 9, 0)
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(extract(month FROM {d}) AS INT) * 3 - 2, 3)"
_DAY = "CAST(extract(day FROM {d}) AS INT)"


def mon(d: str) -> str:
    return _MON.format(d=d)


def dd(d: str) -> str:
    return f"lpad(CAST({_DAY.format(d=d)} AS STRING), 2, '0')"


def yyyy(d: str) -> str:
    return f"CAST(CAST(extract(year FROM {d}) AS INT) AS STRING)"


def pick(key: str, values) -> str:
    """CASE over ``key % n`` choosing one of n texts."""
    n = len(values)
    arms = " ".join(f"WHEN {i} THEN {v if v is None or v.startswith('=') else repr_sql(v)}".replace("THEN =", "THEN ")
                    for i, v in enumerate(values))
    return f"(CASE CAST({key} % {n} AS INT) {arms} END)"


def repr_sql(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


CITIES = ("Cairo", "Alexandria", "Tanta", "Giza", "Mansoura", "Assiut")
KINDS = ("Youth Summit", "Career Fair", "AI Hackathon", "Art Festival", "Startup Pitch Night", "Job Expo",
         "Leadership Workshop")
CATEGORIES = ("Flagship Summits", "Career & Recruitment Fairs", "Tech & Student Hackathons", "Social & Entertainment",
              "Youth Leadership & Skills Workshops", "Career & Recruitment Fairs", "Campus & Student Activities")

_CITY = ("CASE " + " ".join(f"WHEN n.n_nationkey = {i} THEN '{c}'" for i, c in enumerate(CITIES))
         + " ELSE n.n_name END")
_DATE = "(o.o_orderdate + INTERVAL 25 YEAR)"  # 2020 to 2026, never 29 February
_START = "(o.o_orderdate + INTERVAL 25 YEAR + INTERVAL 9 HOUR)"

EV = f"""
SELECT o.o_orderkey AS seq, 'ev' || CAST(o.o_orderkey AS STRING) AS event_id,
  {pick('o.o_orderkey', KINDS)} || ' ' || lower(c.c_mktsegment) || ' ' || CAST(o.o_custkey AS STRING) AS title,
  CASE WHEN o.o_orderkey % 50 = 0 THEN 'Egypt Flagship Summits' WHEN o.o_orderstatus = 'F' THEN 'Facebook Events'
       WHEN o.o_orderstatus = 'P' THEN 'TicketsMarche' ELSE 'Eventbrite' END AS source,
  CASE WHEN o.o_orderkey % 11 <> 0 THEN {_START} END AS start_date,
  CASE WHEN o.o_orderkey % 5 = 0 AND o.o_orderkey % 11 <> 0 THEN {_START} + INTERVAL 2 DAY END AS end_date,
  CASE CAST(o.o_orderkey % 4 AS INT)
    WHEN 0 THEN {mon(_DATE)} || ' ' || {dd(_DATE)} || ', ' || {yyyy(_DATE)} || ' · 09:00 AM'
    WHEN 1 THEN CAST({_DAY.format(d=_DATE)} AS STRING) || ' ' || {mon(_DATE)} || ' ' || {yyyy(_DATE)}
    WHEN 2 THEN {mon(_DATE)} || ' ' || {dd(_DATE)} ELSE 'TBA' END AS date_display,
  'Hall ' || CAST(o.o_custkey % 40 AS STRING) || ', ' || {_CITY} AS location, {_CITY} AS city, 'Egypt' AS country,
  'https://www.example.org/e/' || CAST(o.o_orderkey AS STRING) || '?ref=' || o.o_orderstatus AS url,
  {pick('o.o_custkey', ('Free', '250 EGP', 'Registration', ''))} AS ticket_type, c.c_name AS organizer,
  'Hosted for ' || lower(c.c_mktsegment) || ' people' || {pick('o.o_custkey', (', free entry', '', ' with zoom link'))}
    AS description,
  {pick('o.o_orderkey', CATEGORIES)} AS category,
  CAST(floor(o.o_totalprice / 5000) AS DOUBLE) / 10 AS score,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'HIGH' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END
    AS priority,
  'Plan ' || CAST(o.o_custkey % 5 AS STRING) AS recommended_action,
  {pick('o.o_custkey', ('IEEE', 'Independent', '=NULL', '=NULL', '=NULL', '', '=NULL', '=NULL', 'TEDx'))} AS parallel_org,
  CASE WHEN o.o_orderstatus = 'F' THEN TRUE ELSE FALSE END AS is_social_first
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

# One headline per scoring tier, then its description
CAPTION_TITLES = (
    "Student Oncology Awareness", "Advanced Cardiology Meeting", "Heavy Machinery and Packaging Show",
    "Rooftop Yoga Morning", "RiseUp Gathering", "Regional Job Fair", "Open Hackathon Weekend", "Founders Evening",
    "Open Evening", "IEEE Annual Gathering", "Toastmasters Weekly Session", "Tanta University International Meeting",
    "Faculty Welcome", "Student Chapter Gathering", "Public Speaking Workshop", "Evening Talk", "Python Developer Night",
    "Monthly Circle", "Folklore Volunteer Morning", "City Walk", "ملتقى التوظيف السنوي", "قمة الشباب", "وظائف اليوم")
CAPTION_NOTES = (
    "with the faculty of medicine", "latest surgical updates", "for factories", "bring a mat", "founders meet",
    "meet employers", "48 hours of building", "part of the delta youth series", "cv clinic and mock interviews",
    "robotics and radio", "speeches and feedback", "papers and panels", "tours for newcomers", "elections and plans",
    "speak with ease", "a mentorship circle", "tools and tips", "for devops people", "songs and dances",
    "walk with friends", "فرص كثيرة", "لقاء كبير", "تعال معنا")
_CAP_KIND = "o.o_orderkey"
VENUE_TEXTS = ("the Greek Campus", "Ain Shams hall", "Mansoura University hall", "Creativa hub", "Zewail City",
               "a room near the river")
_ISO = f"'2026-' || lpad(CAST(CAST(extract(month FROM {_DATE}) AS INT) AS STRING), 2, '0') || '-' || {dd(_DATE)}"
_DMY = (f"CAST({_DAY.format(d=_DATE)} AS STRING) || '/' || "
        f"CAST(CAST(extract(month FROM {_DATE}) AS INT) AS STRING) || '/2026'")
_ENG = f"{mon(_DATE)} ' ' {dd(_DATE)}".replace("' '", "|| ' ' ||") + " || ', 2026'"
_AR_MONTH = f"(CASE CAST(extract(month FROM {_DATE}) AS INT) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate((
        "يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر",
        "ديسمبر"), 1)) + " END)"
_ARA = (f"translate(CAST({_DAY.format(d=_DATE)} AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ' || {_AR_MONTH}"
        " || ' ' || '٢٠٢٦'")
_NL = "|| chr(10) ||"

CAP = f"""
SELECT o.o_orderkey AS post_id, o.o_orderkey AS seq, o.o_custkey AS custkey, {_DATE} AS order_date,
  {pick(_CAP_KIND, CAPTION_TITLES)} || ' ' || CAST(o.o_custkey % 97 AS STRING) AS title,
  {pick(_CAP_KIND, CAPTION_NOTES)} AS note,
  {pick('o.o_orderkey', ('🔥 Are you ready 🔥', '#tag', 'https://x.org/a', '✨ ✨'))} {_NL}
  '📌 ' || {pick(_CAP_KIND, CAPTION_TITLES)} || ' ' || CAST(o.o_custkey % 97 AS STRING) || ' ✨' {_NL}
  {pick(_CAP_KIND, CAPTION_NOTES)} {_NL}
  {pick('o.o_orderkey', ('=' + _ISO, '=' + _DMY, '=' + _ENG, '=' + _ARA, 'soon'))} {_NL}
  'Venue: ' || {pick('o.o_custkey', VENUE_TEXTS)} {_NL}
  {pick('o.o_custkey', ('Register now: https://forms.gle/', 'Join us https://bit.ly/', 'see you at https://other.org/'))}
    || 'k' || CAST(o.o_orderkey AS STRING) {_NL}
  {pick('o.o_orderkey', ('=' + "'Call 010' || lpad(CAST(o.o_custkey AS STRING), 8, '0')",
                         '=' + "'Mail info' || CAST(o.o_custkey AS STRING) || '@club.org or @club_' || CAST(o.o_custkey AS STRING)",
                         'no contact'))} {_NL}
  {pick('o.o_custkey', ('free entry', 'بدون رسوم', 'paid'))} {_NL}
  'Organized by: ' || c.c_name AS caption
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

# Records with values in the wrong column or pointing abroad, one defect per key class
RAW = f"""
SELECT o.o_orderkey AS seq, CAST(o.o_orderkey % 10 AS INT) AS defect, {_DATE} AS order_date,
  CASE WHEN o.o_orderkey % 10 = 9 THEN 'fb_live_' ELSE 'r' END || CAST(o.o_orderkey AS STRING) AS event_id,
  CASE CAST(o.o_orderkey % 10 AS INT) WHEN 2 THEN 'Fri, Oct 16' WHEN 3 THEN '328 interested · 44 going'
    WHEN 5 THEN 'Art &amp; Music &quot;Night&quot;' ELSE 'Delta Gathering ' || CAST(o.o_custkey AS STRING) END AS title,
  CASE CAST(o.o_orderkey % 10 AS INT) WHEN 0 THEN {dd(_DATE)} || ' ' || {mon(_DATE)} || ' 2024'
    WHEN 1 THEN '07:00 pm' WHEN 2 THEN 'Nile Music Evening ' || CAST(o.o_custkey AS STRING) WHEN 3 THEN 'Cairo'
    WHEN 4 THEN 'Delta Gathering ' || CAST(o.o_custkey AS STRING) WHEN 6 THEN '12 Main St, Alexandria, VA 22304'
    ELSE 'Hall ' || CAST(o.o_custkey % 9 AS STRING) END AS location,
  CASE CAST(o.o_orderkey % 10 AS INT) WHEN 0 THEN 'Delta Gathering ' || CAST(o.o_custkey AS STRING)
    WHEN 1 THEN {dd(_DATE)} || ' ' || {mon(_DATE)} || ' 2024' WHEN 2 THEN 'Upcoming'
    WHEN 7 THEN {mon(_DATE)} || ' ' || {dd(_DATE)} || ', 2024' ELSE 'TBA' END AS date_display,
  CASE WHEN o.o_orderkey % 10 IN (2, 9) THEN NULL ELSE o.o_orderdate + INTERVAL 25 YEAR END AS start_date,
  CAST(NULL AS TIMESTAMP) AS end_date, 'Tanta' AS city,
  CASE WHEN o.o_orderkey % 10 = 8 AND o.o_custkey % 2 = 0 THEN 'Italy' ELSE 'Egypt' END AS country,
  CASE WHEN o.o_orderkey % 10 = 8 AND o.o_custkey % 2 = 1 THEN 'https://www.facebook.com/events/'
    ELSE 'https://www.example.org/r/' || CAST(o.o_orderkey AS STRING) END AS url, 'plain text' AS description
FROM orders o
"""

# Several postings of each event: ids differ, titles vary slightly, some links agree
POSTINGS = """
SELECT l.l_orderkey * 1000 + l.n AS seq, 'p' || CAST(l.l_orderkey * 1000 + l.n AS STRING) AS event_id, l.l_orderkey AS orderkey,
  CASE CAST(l.n % 5 AS INT) WHEN 0 THEN h.t WHEN 1 THEN h.t || ' Tickets' WHEN 2 THEN 'The ' || h.t || '!'
    WHEN 3 THEN h.t || ' annual edition' ELSE substr(h.t, 1, 41) || 'x' END AS title,
  CASE CAST(l.n % 3 AS INT) WHEN 0 THEN 'Eventbrite' WHEN 1 THEN 'AllEvents' ELSE 'Facebook Events, Eventbrite' END AS source,
  h.d AS start_date, 'https://www.example.org/p/' || CAST(CASE WHEN l.n % 4 = 3 THEN l.l_orderkey * 1000 ELSE
    l.l_orderkey * 1000 + l.n END AS STRING) AS url,
  CAST(l.q AS DOUBLE) AS score, CASE WHEN l.q >= 40 THEN 'HIGH' WHEN l.q >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS priority
FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, l_shipdate) - 1 AS BIGINT) AS n, l_quantity AS q FROM lineitem) l
JOIN (SELECT o_orderkey, o_orderdate AS d, substr(md5('a' || CAST(o_orderkey AS STRING)), 1, 8) || ' '
        || substr(md5('b' || CAST(o_orderkey AS STRING)), 1, 8) || ' ' || substr(md5('c' || CAST(o_orderkey AS STRING)), 1, 8)
        || ' ' || substr(md5('d' || CAST(o_orderkey AS STRING)), 1, 8) || ' '
        || substr(md5('e' || CAST(o_orderkey AS STRING)), 1, 6) AS t FROM orders) h ON h.o_orderkey = l.l_orderkey
"""

# Announcements from free text: title is the first line
ANN = """
SELECT doc_id AS seq, 'd' || CAST(doc_id AS STRING) AS event_id, split_part(text, chr(10), 1) AS title,
  text AS description, source, lang AS city, source AS category, lang AS organizer, '' AS location,
  'https://www.example.org/d/' || CAST(doc_id AS STRING) AS url,
  CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2026-01-01 09:00:00' + CAST(n_chars % 360 AS INT) * INTERVAL 1 DAY END AS start_date
FROM documents
"""

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
           "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Run one of the view texts over the tables of a folder; rows of the ``dealt`` tables are spread over the cores first, for queries
    that do costly work on each row before any shuffle."""
    import re
    used = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    text = sql.replace("{", "{{").replace("}", "}}")
    text = text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", text)
    tables = {t: table(spark, sf_dir, t) for t in used}
    return spark.sql(text, **{t: spread(d) if t in dealt else d for t, d in tables.items()})
