"""Queries over pages, feeds, posts and posters written from the rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import stable_id
from ..schema import conform
from ..session import Scratch
from ..sources import cards, dirty, jsonld, pages, payload, posters, snapshots, social
from . import adapters as A
from .registry import cap, dealt_ev, ev, full_ev, query, ts

_NOW = A.REF_NOW
# an event page per order: single object, list, or itemListElement; one plain page in four carries cards instead
_EVENT_JSON = """'{"@type":"Event","name":"' || title || '","url":"' || url || '","startDate":"' || d || 'T18:30:00+02:00","location":' ||
  CASE WHEN seq % 2 = 0 THEN '{"name":"' || location || '","address":{"addressLocality":"' || city || '"}}' ELSE '"' || location || '"' END
  || ',"offers":' || CASE seq % 3 WHEN 0 THEN '{"price":"0"}' WHEN 1 THEN '[{"price":50},{"price":"0"}]' ELSE '{"price":"250","priceCurrency":"EGP"}' END
  || ',"organizer":' || CASE WHEN seq % 2 = 0 THEN '{"name":"' || organizer || '"}' ELSE '"' || organizer || '"' END || ',"description":"'
  || description || '"}'"""
_PAGES = f"""SELECT seq, 'https://pages.example/' || CAST(seq AS STRING) AS url, CASE CAST(seq % 4 AS INT)
  WHEN 0 THEN '<html><script type="application/ld+json">' || j || '</script></html>'
  WHEN 1 THEN '<script type=''application/ld+json''>[' || j || ',{{"@type":"Person","name":"x"}}]</script>'
  WHEN 2 THEN '<script type="application/ld+json">{{"itemListElement":[{{"item":' || j || '}}]}}</script>'
  ELSE '<ul><li class="x"><div class="event-card big"><a class="event-card-link" href="' || url || '"><h3>' || title ||
    '</h3></a><p class="event-card__date date">' || dd || '</p><p class="event-card__location location">' || location || '</p>' ||
    CASE WHEN seq % 8 = 3 THEN '<b>Free</b>' ELSE '' END || '</div></li></ul>' END AS html
  FROM (SELECT *, {_EVENT_JSON} AS j FROM (SELECT seq, title, 'https://www.example.org/e/' || CAST(seq AS STRING) AS url, location, city,
    organizer, description, '2026-' || lpad(CAST(CAST(extract(month FROM start0) AS INT) AS STRING), 2, '0') || '-' ||
      lpad(CAST(CAST(extract(day FROM start0) AS INT) AS STRING), 2, '0') AS d,
    lpad(CAST(CAST(extract(day FROM start0) AS INT) AS STRING), 2, '0') || ' ' || {A.mon('start0')} || ' 2026' AS dd
    FROM (SELECT *, coalesce(start_date, TIMESTAMP '2024-05-05 09:00:00') AS start0 FROM ({A.EV}))))"""


def event_pages(spark, sf):
    return A.view(spark, sf, _PAGES, dealt=("orders",))


_BASE = """SELECT seq, title, 'https://www.example.org/e/' || CAST(seq AS VARCHAR) AS url, location, city, organizer,
  strftime(coalesce(start_date, TIMESTAMP '2024-05-05 09:00:00'), '2026-%m-%d') AS d FROM ev"""


@query("s3_jsonld_events", f"""SELECT url, title, location, CASE WHEN seq % 2 = 0 THEN city ELSE 'Egypt' END AS city, organizer,
  CASE WHEN seq % 3 = 2 THEN 'Paid / Registration' ELSE 'Free' END AS ticket_type, d || ' 16:30:00' AS start_date
  FROM ({_BASE}) WHERE seq % 4 <> 3""")
def _(spark, sf):
    got = jsonld.events_from_jsonld(event_pages(spark, sf), jsonld.TICKETS, _NOW)
    return got.select("url", "title", "location", "city", "organizer", "ticket_type", ts("start_date").alias("start_date"))


@query("s4_group_meetups", f"""SELECT url, title, CASE WHEN seq % 2 = 0 THEN organizer ELSE 'Meetup Group' END AS organizer0,
  CASE WHEN seq % 3 = 2 THEN 'Paid (250 EGP)' ELSE 'Free' END AS ticket_type FROM ({_BASE}) WHERE seq % 4 <> 3""")
def _(spark, sf):
    got = jsonld.events_from_jsonld(event_pages(spark, sf), jsonld.MEETUPS, _NOW)
    seq = F.regexp_extract("url", "([0-9]+)$", 1).cast("long")
    return got.select("url", "title", F.when(seq % 2 == 0, F.col("organizer")).otherwise("Meetup Group").alias("organizer0"),
                      "ticket_type")


@query("s5_card_fallback", f"""SELECT url, title, location, CASE WHEN seq % 8 = 3 THEN 'Free' ELSE 'Registration / Tickets' END AS ticket_type,
  d || ' 09:00:00' AS start_date FROM ({_BASE}) WHERE seq % 4 = 3""")
def _(spark, sf):
    p = event_pages(spark, sf)
    got = cards.cards_as_fallback(p, jsonld.ld_items(p).select(F.col("page_url").alias("url")), cards.LISTING_CARDS, _NOW)
    return got.select("url", "title", "location", "ticket_type", ts("start_date").alias("start_date"))


@query("s6_ticket_listing", f"""SELECT 'tm_T' || CAST(seq AS VARCHAR) AS event_id, title, location, organizer, CASE WHEN seq % 2 = 0 THEN '250.00 EGP'
  ELSE 'Free / Paid Tickets' END AS ticket_type, strftime(CAST('2023' || substr(d, 5) AS DATE), '%m-%d') AS day FROM ({_BASE})""")
def _(spark, sf):
    c = F.col
    e = dealt_ev(spark, sf).withColumn("_s", F.coalesce("start_date", F.lit("2024-05-05 09:00:00").cast("timestamp_ntz")))
    html = F.concat(
        F.lit("""<div><a href="/e" onclick='push({"ecommerce":{"items":[{"item_name":"""), F.lit('"'), c("title"),
        F.lit('","item_id":"T'), c("seq").cast("string"), F.lit('","price":"'), F.when(c("seq") % 2 == 0, "250.00").otherwise("0"),
        F.lit('"}]},"vendor_name":"'), c("organizer"), F.lit("""" })'>Book Now</a><p>"""), F.date_format("_s", "MMM d"),
        F.lit(" | 07:00 PM | "), c("location"), F.lit(" | 250 EGP</p></div>"))
    got = pages.ticket_listing(e.select(F.concat(F.lit("p"), c("seq")).alias("url"), html.alias("html")), _NOW)
    return got.select("event_id", "title", "location", "organizer", "ticket_type", F.date_format("start_date", "MM-dd").alias("day"))


@query("s7_page_titles", r"""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS title FROM pages""")
def _(spark, sf):
    return pages.page_metadata(A.table(spark, sf, "pages")).select("page_id", F.col("meta_title").alias("title"))


@query("s7_resolve_all_pages", f"""SELECT 'https://pages.example/' || CAST(seq AS VARCHAR) AS url,
  CASE seq % 4 WHEN 1 THEN 'x' WHEN 3 THEN 'Youth & Campus Event' ELSE title END AS title, CASE WHEN seq % 2 = 0 THEN organizer
  ELSE 'Social Event Host' END AS organizer FROM ({_BASE})""")
def _(spark, sf):
    # listed items count like single ones; a page of cards has no metadata and gets the fallback
    return pages.resolve_pages(event_pages(spark, sf), _NOW).select("url", "title", "organizer")


@query("s8_nested_json", """SELECT CAST(seq AS VARCHAR) AS event_id, title, city AS location, 'Saturday, January 01, 2022' AS date_display FROM ev""")
def _(spark, sf):
    c = F.col
    raw = F.concat(F.lit('{"data":{"edges":[{"node":{"a":[{"id":"'), c("seq").cast("string"), F.lit('","name":"'), c("title"),
                   F.lit('","start_timestamp":1640995200,"event_place":{"name":"'), c("city"), F.lit('"}},{"id":"0","name":"12 going"}]}}]}}'))
    return social.harvest_json(ev(spark, sf).select(raw.alias("payload"))).select("event_id", "title", "location", "date_display")


@query("s9_rendered_posts", """SELECT 'fb_ext_' || CAST(seq AS VARCHAR) AS event_id, title, 'Fri, Oct 16 at 7 PM' AS date_display, location FROM ev""")
def _(spark, sf):
    c = F.col
    body = F.concat(F.lit("Fri, Oct 16 at 7 PM\nInterested\n"), c("title"), F.lit("\n"), c("location"), F.lit("\n12 going"))
    e = ev(spark, sf)
    links = e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.concat(F.lit("https://f.example/events/"), c("seq").cast("string"),
                     F.lit("/")).alias("href"), F.lit(None).cast("string").alias("heading"), F.when(c("seq") % 2 == 0, c("title"))
                     .otherwise("Going").alias("link_text"), body.alias("container_text"))
    return social.parse_rendered_posts(links).select("event_id", "title", "date_display", "location")


@query("s10_post_gate", """SELECT event_id, title FROM ev WHERE regexp_matches(lower(title), '\\b(event|summit|conference|workshop|webinar|hackathon|career fair)\\b')""")
def _(spark, sf):
    text = F.concat(F.lit("Interested\n"), F.col("title"), F.lit("\nmore"))
    got = social.posts_to_records(ev(spark, sf).select("url", text.alias("text")))
    e = ev(spark, sf).select("event_id", stable_id("ig_ext_", F.col("url")).alias("k"))
    return e.join(got.select(F.col("event_id").alias("k"), "title"), "k").select("event_id", "title")


@query("s11_yearly_catalogue", """SELECT event_id, strftime(CASE WHEN start_date < TIMESTAMP '2023-06-13 12:00:00' THEN start_date + INTERVAL 1 YEAR
  ELSE start_date END, '%Y-%m-%d %H:%M:%S') AS start_date FROM ev""")
def _(spark, sf):
    e = ev(spark, sf).withColumnRenamed("event_id", "id")
    return social.yearly_catalogue(e, _NOW).select("event_id", ts("start_date").alias("start_date"))


@query("s18_curated_posts", """SELECT event_id, CASE WHEN seq % 2 = 0 THEN 'https://p.example/1' ELSE url END AS proof_url,
  strftime(start_date, '%b %d, %Y') || ' · 7 PM' AS date_display FROM ev""")
def _(spark, sf):
    e = ev(spark, sf).withColumnRenamed("event_id", "id").withColumns({
        "venue": F.col("location"), "time_text": F.lit("7 PM"), "proof_url": F.lit(""), "registration_url": F.lit(None).cast("string"),
        "post_direct_url": F.when(F.col("seq") % 2 == 0, "https://p.example/1"), "organizer_profile_url": F.lit(None).cast("string")})
    got = social.curated_posts(e, "Facebook Events", "Announcement", "Announced by ", "Visit")
    return got.select("event_id", "proof_url", "date_display")


@query("s12_universal_payload", """SELECT seq AS payload_id, CASE seq % 3 WHEN 0 THEN title WHEN 1 THEN 'Spring Meet ' || CAST(seq AS VARCHAR) ELSE title END AS title
  FROM ev""")
def _(spark, sf):
    c = F.col
    p = (F.when(c("seq") % 3 == 0, F.concat(F.lit('[{"title":"'), c("title"), F.lit('"}]')))
         .when(c("seq") % 3 == 1, F.concat(F.lit("https://x.example/events/spring-meet_"), c("seq").cast("string")))
         .otherwise(F.concat(F.lit("✨ "), c("title"), F.lit(" ✨\nsee you there, 3 Oct 2026"))))
    return payload.read_payloads(ev(spark, sf).select(c("seq").alias("payload_id"), p.alias("payload")), _NOW).select("payload_id", "title")


@query("x12_poster_text", "SELECT post_id, title || chr(10) || note AS ocr_text FROM cap")
def _(spark, sf):
    svg = F.concat(F.lit('<svg xmlns="x"><text>'), F.col("title"), F.lit("</text> <text>"), F.col("note"), F.lit("</text></svg>"))
    got = posters.analyze_posters(cap(spark, sf).select(F.col("post_id").alias("path"), F.encode(svg, "UTF-8").alias("content")), A.CAPTION_NOW)
    return got.select(F.col("path").alias("post_id"), "ocr_text")


@query("x13_form_status", """SELECT url, seq % 3 <> 0 AND seq % 5 <> 0 AS is_open, title AS form_title, 'Full Name|Phone ' || organizer AS questions FROM ev""")
def _(spark, sf):
    c = F.col
    html = F.concat(F.lit("<html><head><title>"), c("title"), F.lit('</title></head><div role="heading">Full Name *</div><label for="p">Phone '),
                    c("organizer"), F.lit("</label><label>Full Name</label>"), F.when(c("seq") % 3 == 0, "<p>Registration is closed</p>").otherwise(""))
    p = ev(spark, sf).select("url", c("url").alias("resolved_url"), F.when(c("seq") % 5 == 0, 404).otherwise(200).alias("http_status"), html.alias("html"))
    return pages.inspect_forms(p, A.CAPTION_NOW).select("url", "is_open", "form_title", F.array_join("questions", "|").alias("questions"))


@query("x14_social_items", """SELECT 'fb_live_' || CAST(seq AS VARCHAR) AS event_id, CASE WHEN seq % 2 = 0 THEN 'Gathering at ' || location ELSE title END AS title,
  CASE WHEN seq % 2 = 0 THEN 'Fri, Oct 16' ELSE 'Oct 3, 2026' END AS date_display FROM ev""")
def _(spark, sf):
    c = F.col
    items = dealt_ev(spark, sf).select(  # titles and dates are read by long chains of patterns
        c("seq").cast("string").alias("event_id"), F.when(c("seq") % 2 == 0, "Fri, Oct 16").otherwise(c("title")).alias("title"),
        F.when(c("seq") % 2 == 0, F.concat(F.lit("Gathering at "), "location")).otherwise(c("location")).alias("location"),
        F.when(c("seq") % 2 == 0, "Upcoming").otherwise("Oct 3, 2026").alias("date_display"), "description")
    return social.items_to_records(items, A.CAPTION_NOW).select("event_id", "title", "date_display")


@query("x15_import_records", """SELECT 'i' || CAST(post_id AS VARCHAR) AS event_id, CASE WHEN post_id % 2 = 0 THEN title ELSE 'Given ' || CAST(post_id AS VARCHAR) END AS title,
  CASE post_id % 3 WHEN 1 THEN 'info' || CAST(custkey AS VARCHAR) || '@club.org' END AS organizer_email FROM cap
  WHERE post_id % 2 = 1 OR regexp_matches(lower(caption), '.')""")
def _(spark, sf):
    c = F.col
    items = cap(spark, sf).select(F.concat(F.lit("i"), c("post_id").cast("string")).alias("event_id"), F.when(c("post_id") % 2 == 1, F.concat(
        F.lit("Given "), c("post_id").cast("string"))).otherwise(c("title")).alias("title"), c("caption").alias("description"))
    none = F.lit(None).cast("string")
    items = items.withColumns({n: none for n in payload._FIELDS if n not in items.columns})
    return payload.import_records(items, A.CAPTION_NOW).select("event_id", "title", "organizer_email")


def _lines(df: DataFrame, header: str, line: F.Column, path: str) -> None:
    """Text files with a header line each and lines as they are."""
    df.select(line.alias(header)).write.mode("overwrite").option("quote", "\u0000").option("escape", "\u0000").option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("delimiter", "\u0001").csv(path)


@query("s2_dirty_sheets", """SELECT event_id, CASE WHEN seq % 3 = 2 THEN CASE seq % 5 WHEN 0 THEN 'too many values' WHEN 1 THEN 'open quote' WHEN 2 THEN 'no title'
    WHEN 3 THEN 'skipped source' END WHEN contains(lower(source), 'facebook') OR contains(lower(source), 'summits') THEN 'skipped source' END AS reason,
  CASE WHEN seq % 3 = 2 AND seq % 5 < 4 OR seq % 3 <> 2 AND (contains(lower(source), 'facebook') OR contains(lower(source), 'summits')) THEN NULL ELSE title END AS title,
  CASE WHEN seq % 3 = 2 AND seq % 5 < 4 OR seq % 3 <> 2 AND (contains(lower(source), 'facebook') OR contains(lower(source), 'summits')) THEN NULL
    WHEN seq % 3 = 1 THEN 5.0 WHEN seq % 3 = 2 THEN 7.5 ELSE score END AS score FROM ev""")
def _(spark, sf):
    """Sheets in three layouts, one of them with broken lines, read together: accepted rows, and the rest with the reason."""
    e, root, c = conform(dealt_ev(spark, sf), "seq"), f"{Scratch(spark).root}/sheets", F.col
    shown = snapshots.to_sheet(e.where("seq % 3 = 0")).columns
    whole = e.where("seq % 3 = 0")
    sheet = snapshots.to_sheet(whole.withColumn("description", F.concat_ws("|", "event_id", "description")))
    sheet.select(F.split_part("Description", F.lit("|"), F.lit(1)).alias("event_id"), *shown).write.csv(f"{root}/a", header=True, quoteAll=True, escape='"')
    e.where("seq % 3 = 1").select(F.lit("x").alias("remarks"), "source", "event_id", F.lit("nan").alias("score"), "title", F.lit("N/A").alias("organizer")).write.csv(
        f"{root}/b", header=True)
    kind = c("seq") % 5
    title = F.when(kind == 2, "nan").when(kind == 1, F.concat(F.lit('"'), c("title"))).otherwise(c("title"))
    line = F.concat_ws(",", "event_id", title, F.when(kind == 3, "Facebook Events").otherwise("AllEvents"), F.lit("7.5"), F.when(kind == 0, F.lit("one,more")))
    _lines(e.where("seq % 3 = 2"), "event_id,Event Title,Platform,Score (1-10)", line, f"{root}/c")
    rows, rejects = dirty.read_sheets(spark, [f"{root}/{d}" for d in "abc"])
    kept = dirty.accepted(rows)
    place = F.when(c("file").contains("/sheets/b/"), 3).otherwise(1)
    lost = rejects.select(F.replace(F.split_part("record", F.lit(","), place), F.lit('"'), F.lit("")).alias("event_id"), "reason", F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("score"))
    return kept.select("event_id", F.lit(None).cast("string").alias("reason"), "title", "score").unionByName(lost)


@query("s1_dirty_json", """SELECT seq, CASE seq % 6 WHEN 0 THEN 'broken' WHEN 1 THEN 'broken' WHEN 2 THEN 'no title' END AS reason,
  CASE WHEN seq % 6 > 2 THEN title END AS title, CASE WHEN seq % 6 = 4 THEN 0.0 WHEN seq % 6 > 2 THEN score END AS score FROM ev""")
def _(spark, sf):
    """JSON lines of two ages (score under its older name), cut off, with a wrong type or a blank title."""
    e, root, c = ev(spark, sf), f"{Scratch(spark).root}/json", F.col
    kind = c("seq") % 6
    title = F.when(kind == 2, " ").otherwise(c("title"))
    old, new = F.to_json(F.struct("event_id", title.alias("title"), c("score").alias("rating"))), F.to_json(F.struct("event_id", title.alias("title"), "score"))
    line = (F.when(kind == 0, F.concat(F.lit('{"event_id":"'), "event_id", F.lit('","title":"cut'))).when(kind == 3, old)
            .when(kind == 1, F.to_json(F.struct("event_id", title.alias("title"), F.lit("high").alias("score"))))
            .when(kind == 4, F.to_json(F.struct("event_id", title.alias("title")))).otherwise(new))
    e.select(line.alias("value")).write.text(root)
    rows, rejects = dirty.read_json(spark, root, {"rating": "score"})
    number = F.regexp_extract("record", r'"event_id":"ev(\d+)', 1).cast("long").alias("seq")
    lost = rejects.select(number, "reason", F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("score"))
    kept = dirty.accepted(rows).select(F.substr("event_id", F.lit(3)).cast("long").alias("seq"), F.lit(None).cast("string").alias("reason"), "title", "score")
    return kept.unionByName(lost)


def _poster_files(df: DataFrame, folder: str) -> None:
    """A file per row (part, name, kind, title), in a folder for each part: SVG, or PNG with its text plain, compressed, or compressed and international; kind 4 has a wrong checksum."""
    def write(batches):
        import zlib

        from pyarrow.fs import FileSystem

        def chunk(kind: bytes, body: bytes, wrong: int = 0) -> bytes:
            return len(body).to_bytes(4, "big") + kind + body + (zlib.crc32(kind + body) ^ wrong).to_bytes(4, "big")

        fs, top = FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                said = row["title"].encode()
                marked = {1: (b"tEXt", b"Comment\0" + said), 2: (b"zTXt", b"Comment\0\0" + zlib.compress(said)),
                          3: (b"iTXt", b"Comment\0\1\0en\0Remark\0" + zlib.compress(said)), 4: (b"tEXt", b"Comment\0" + said)}
                if row["kind"]:
                    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"x" * 13) + chunk(*marked[row["kind"]], row["kind"] == 4) + chunk(b"IEND", b"")
                else:
                    data = b'<svg xmlns="http://www.w3.org/2000/svg"><text>' + said + b"</text></svg>"
                place = f"{top}/{row['part']}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                with fs.open_output_stream(f"{place}/{row['name']}") as f:
                    f.write(data)
            yield batch.select(["kind"])
    df.mapInArrow(write, "kind int").write.format("noop").mode("overwrite").save()


@query("x12_poster_files", """SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 4 THEN NULL ELSE 'Comment ' END
  || 'Open day of ' || c_name || ' for ' || lower(c_mktsegment) AS ocr_text FROM customer""")
def _(spark, sf):
    """A poster file for every customer; a broken one has no text."""
    c, root = F.col, f"{Scratch(spark).root}/posters"
    title = F.concat(F.lit("Open day of "), "c_name", F.lit(" for "), F.lower("c_mktsegment"))
    rows = A.table(spark, sf, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # one row group in the given table
    part = F.pmod(F.xxhash64("c_custkey"), F.lit(1024)).cast("int")  # folders that can be listed side by side
    _poster_files(rows.select(part.alias("part"), F.concat(F.lit("p"), c("c_custkey").cast("string")).alias("name"), (c("c_custkey") % 5).cast("int").alias("kind"), title.alias("title")), root)
    got = posters.analyze_posters(posters.read_posters(spark, root), A.CAPTION_NOW, strict=True)
    return got.select(F.regexp_extract("path", "/p([0-9]+)$", 1).cast("long").alias("custkey"), F.nullif("ocr_text", F.lit("")).alias("ocr_text"))


@query("a13_differences", """SELECT o_orderkey, kind FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 499 = 1 THEN 'only left' WHEN o_orderkey % 499 = 2 THEN 'changed'
  WHEN o_orderkey % 499 = 3 THEN 'only right' END AS kind FROM orders) WHERE kind IS NOT NULL""")
def _(spark, sf):
    """Two stored copies of the orders with rows missing in either and rows changed."""
    root, place = Scratch(spark).root, F.col("o_orderkey") % 499
    orders = A.table(spark, sf, "orders")
    snapshots.write_hashed(orders.where(place != 3), f"{root}/a", "o_orderkey")
    changed = F.when(place == 2, F.col("o_totalprice") + 0.01).otherwise(F.col("o_totalprice"))
    snapshots.write_hashed(orders.where(place != 1).withColumn("o_totalprice", changed), f"{root}/b", "o_orderkey")
    return snapshots.differences(spark, f"{root}/a", f"{root}/b", "o_orderkey")
