"""Captions, pages, posters, contacts and scores on small fixtures."""

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions.captions import analyze
from eventloom.operators.enrich import enrich_contacts
from eventloom.operators.leads import outreach
from eventloom.operators.score import evaluate
from eventloom.operators.search import FIELDS, build_index, corpus, search
from eventloom.schema import event_frame
from eventloom.sources.jsonld import TICKETS, events_from_jsonld
from eventloom.sources.pages import inspect_forms, ticket_listing
from eventloom.sources.posters import analyze_posters

NOW = datetime(2026, 9, 19, 15, 0)


def read(spark, *captions):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(captions)], "i int, caption string")
    return [r["cap"] for r in analyze(df, "caption", NOW).orderBy("i").collect()]


def test_captions(spark):
    arabic, english, casual, form, franco, both = read(
        spark,
        "مستنيينكم في ملتقى التوظيف السنوي بجامعة القاهرة يوم 15-10-2026\nحضور مجاني لجميع الطلاب. اللينك في البايو للتسجيل!",
        "Join us at The Greek Campus for the Cairo AI Hackathon 2026!\nRegister now via link in bio.",
        "Had a great cup of coffee this morning with friends in Zamalek. Weather is lovely today!",
        "Annual Robotics Challenge 2026! Applications are open now.\nRegister: https://forms.gle/xYz987AbCdEf\nVenue: here",
        "Tanta University Student Union bootcamp! segel now el link fel bio for free admission.",
        "🔥 جاهزين؟ 🔥\nملتقى التوظيف وريادة الأعمال بجامعة طنطا 2026 - Tanta Career Summit\nيوم السبت ٢١ نوفمبر ٢٠٢٦ في مجمع سبرباي "
        "جامعة طنطا\nسجل الآن: https://forms.gle/TantaCareerSummit2026\nللتواصل: 01012345678 | info@tantasummit.org.eg | @tanta_youth_summit")
    assert arabic["is_event"] and arabic["ticket_type"] == "Free" and arabic["start_date"] == datetime(2026, 10, 15, 10)
    assert "Cairo University" in arabic["venue"]
    assert english["is_event"] and "Greek Campus" in english["venue"]
    assert not casual["is_event"] and casual["title"] is None
    assert form["registration_url"] == "https://forms.gle/xYz987AbCdEf"
    assert franco["is_event"] and franco["city"] == "Tanta"
    assert "ملتقى التوظيف" in both["title"] and both["city"] == "Tanta" and "Tanta University" in both["venue"]
    assert both["start_date"] == datetime(2026, 11, 21, 10) and both["organizer_phone"] == "01012345678"
    assert both["organizer_email"] == "info@tantasummit.org.eg" and both["organizer_instagram"] == "tanta_youth_summit"


def test_posters(spark):
    svg = ('<svg xmlns="http://www.w3.org/2000/svg"><text>Student Branch Career Expo 2026</text>'
           "<text>٢٨ نوفمبر ٢٠٢٦ - هندسة القاهرة (CUFE)</text><text>Register: https://forms.gle/Expo2026</text>"
           "<text>Contact: 01098765432 | @branch_cu</text></svg>")
    png = b"\x89PNG\r\n\x1a\n" + b"".join(
        len(d).to_bytes(4, "big") + k + d + b"\0\0\0\0" for k, d in ((b"IHDR", b"x" * 13), (b"tEXt", b"Comment\0Spring workshop day")))
    df = spark.createDataFrame([("a", svg.encode()), ("b", png)], "path string, content binary")
    got = {r["path"]: r for r in analyze_posters(df, NOW).collect()}
    cap = got["a"]["cap"]
    assert cap["is_event"] and cap["title"] == "Student Branch Career Expo 2026" and "Cairo University" in cap["venue"]
    assert cap["registration_url"] == "https://forms.gle/Expo2026" and cap["organizer_phone"] == "01098765432"
    assert cap["organizer_instagram"] == "branch_cu" and cap["start_date"] == datetime(2026, 11, 28, 10)
    assert got["b"]["ocr_text"] == "Comment Spring workshop day"


def test_forms(spark):
    open_, shut = ('<html><head><title>AI Summit 2026 Registration</title></head><div role="heading">Full Name</div></html>',
                   "<html><title>Career Fair</title><div>This form is no longer accepting responses.</div></html>")
    df = spark.createDataFrame([("https://forms.gle/a", open_, 200), ("https://f.org/b", shut, 200)],
                               "url string, html string, http_status int").withColumn("resolved_url", F.col("url"))
    got = {r["url"]: r for r in inspect_forms(df, NOW).collect()}
    a, b = got["https://forms.gle/a"], got["https://f.org/b"]
    assert a["is_open"] and a["was_shortened"] and a["questions"] == ["Full Name"] and not b["is_open"] and b["status"] == "CLOSED"


def test_ticket_listing(spark):
    def card(item, name, price, vendor, text):
        return (f"<div class=\"card\"><a href=\"/event/{item}\" onclick='push({{\"ecommerce\":{{\"items\":[{{\"item_name\":\"{name}\","
                f"\"item_id\":\"{item}\",\"price\":\"{price}\"}}]}},\"vendor_name\":\"{vendor}\"}})'>\n Book Now\n</a>\n<p>{text}</p></div>")
    html = (card("Tech_9999", "Egypt Tech Innovation Fest", "250.00", "Egypt Tech Council", "Oct 15 | 07:00 PM | Greek Campus Downtown")
            + card("Alex_8888", "Alexandria Youth Leadership Forum", "0", "Youth Association", "Nov 20 | 06:00 PM | Bibliotheca Alexandrina"))
    df = spark.createDataFrame([("p", html)], "url string, html string")
    got = {r["event_id"]: r for r in ticket_listing(df, NOW).collect()}
    e = got["tm_Tech_9999"]
    assert (e["title"], e["ticket_type"], e["city"], e["location"], e["organizer"]) == (
        "Egypt Tech Innovation Fest", "250.00 EGP", "Cairo", "Greek Campus Downtown", "Egypt Tech Council")
    assert e["start_date"].month == 10 and e["start_date"].day == 15 and e["date_display"] == "Oct 15 · 07:00 PM"
    assert [r["city"] for r in ticket_listing(df, NOW, city="alexandria").collect()] == ["Alexandria"]


def test_jsonld_shapes(spark):
    pages = [("list", '[{"@type":"Event","name":"A day","url":"u1","startDate":"2026-10-01","offers":{"price":0}}]'),
             ("elements", '{"itemListElement":[{"item":{"name":"B day","url":"u2","startDate":"2026-10-02T10:00:00Z","location":"Hall"}}]}'),
             ("dup", '{"@type":"Event","name":"A again","url":"u1"}'), ("bad", "{not json"), ("other", '{"@type":"Person","name":"x","url":"y"}')]
    df = spark.createDataFrame([(u, f'<script type="application/ld+json">{j}</script>') for u, j in pages], "url string, html string")
    got = {r["url"]: r for r in events_from_jsonld(df, TICKETS, NOW).collect()}
    assert set(got) == {"u1", "u2"}
    assert got["u2"]["location"] == "Hall" and got["u2"]["start_date"] == datetime(2026, 10, 2, 10)


def test_contacts(spark):
    df = event_frame(spark, [
        dict(event_id="1", title="Techne Summit Alexandria 2026", source="EgyptSummits", url="https://technesummit.com"),
        dict(event_id="2", title="Alex Youth Hackathon", source="Facebook", url="https://facebook.com/events/123",
             description="Contact alexhack@youth.org or call 01012345678. Follow @alexhackathon on IG."),
        dict(event_id="3", title="Plain", source="Web", url="https://a", post_direct_url="https://post/1")])
    a, b, c = enrich_contacts(df).orderBy("seq").collect()
    assert (a["organizer_email"], a["organizer_phone"]) == ("info@technesummit.com", "+20 120 000 8324")
    assert (b["organizer_email"], b["organizer_phone"], b["organizer_instagram"]) == (
        "alexhack@youth.org", "01012345678", "alexhackathon")
    assert (c["proof_url"], c["proof_type"]) == ("https://post/1", "Direct Social Announcement Post")


def test_scores(spark):
    cases = [("Cairo University Annual Career & Job Fair 2026", "Connect with top employers", "HIGH", 9.2),
             ("AI Hackathon Egypt 2026", "A 48-hour coding challenge", "HIGH", 8.9),
             ("IEEE Cairo University Student Branch Mega Annual Conference", "Workshops on robotics", "HIGH", 9.0),
             ("Enactus Egypt National Innovation Expo 2026", "Social projects", "HIGH", 9.8),
             ("Local Neighborhood Flower Gardening Gathering", "Sharing tips", "LOW", 4.0),
             ("6th ONCOAZHAR Conference", "Latest clinical oncology updates", "LOW", 2.5),
             ("27th Connected Banking Summit North Africa", "Fintech executives", "LOW", 3.0),
             ("Caribou Coffee Morning Cairo East Walk Mall", "Casual chat", "LOW", 2.8),
             ("RiseUp Summit 2026", "Flagship gathering", "HIGH", 9.8)]
    df = spark.createDataFrame([(i, t, d, "") for i, (t, d, _, _) in enumerate(cases)],
                               "i int, title string, description string, location string")
    got = [(r["eval"]["priority"], r["eval"]["score"]) for r in evaluate(df).orderBy("i").collect()]
    assert got == [(p, s) for _, _, p, s in cases]


def test_search(spark):
    df = event_frame(spark, [
        dict(event_id="riseup", title="RiseUp Summit 2026", description="The premier startup summit in Cairo.", city="Cairo"),
        dict(event_id="techne", title="Techne Summit Alexandria", description="Technology for founders", city="Alexandria"),
        dict(event_id="delta", title="Delta Career Fair Tanta", description="Annual job fair, café", city="Tanta")])
    q = spark.createDataFrame([(1, "startup"), (2, "Alexandria"), (3, "tant fair"), (4, ""), (5, "cafe")], "qid int, q string")
    hits = search(build_index(df), corpus(df, fields=FIELDS), q).collect()
    assert {(r["qid"], r["id"]) for r in hits} == {(1, "riseup"), (2, "techne"), (3, "delta"), (5, "delta")}


def test_outreach(spark):
    df = event_frame(spark, [dict(event_id="e", title="Tech Day", organizer="Tech Club", date_display="Oct 20", location="Hall")])
    who = {"name": "Nour", "email": "n@e.org", "phone": "+201", "network": "Net"}
    a, b = (outreach(df, who, p).first() for p in ("event_collaboration", "pr_collaboration"))
    assert "Event Collaboration & Booth Partnership" in a["subject"] and "booth" in a["body"] and "n@e.org" in a["body"]
    assert "PR & Media Partnership" in b["subject"] and "social media" in b["body"] and "cross-promotion" in b["body"]
    assert a["mailto_url"].startswith("mailto:?subject=Event%20")
