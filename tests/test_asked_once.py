"""Costly questions are put only to what still needs an answer."""

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions.patterns import first_where
from eventloom.plans import registry_sources  # noqa: F401
from eventloom.plans.registry import QUERIES
from eventloom.sources import social

from test_spread import tables  # noqa: F401


def test_nothing_is_asked_behind_the_first_hit(spark):
    """F12, F16: every line of a caption was trimmed and put to the patterns of a headline, though the first or second was it."""
    rows = spark.createDataFrame([(1, ["a", "b", "stop"]), (2, ["a"]), (3, []), (4, None)], "i int, xs array<string>")

    def hit(x):
        return F.when(x == "stop", F.raise_error(F.lit("asked")).cast("boolean")).otherwise(x == "b")

    got = {r.i: r.x for r in rows.select("i", first_where(F.col("xs"), hit).alias("x")).collect()}
    assert got == {1: "b", 2: None, 3: None, 4: None}
    shown = rows.select(first_where(F.col("xs"), lambda x: x == "B", F.upper).alias("x")).where("x IS NOT NULL").collect()
    assert [r.x for r in shown] == ["B"]


def test_descriptions_are_not_read_for_a_date_that_is_shown(spark, monkeypatch):
    """F18"""
    now = datetime(2026, 3, 1, 9, 0)
    items = spark.createDataFrame([("1", "Open evening of makers", "Oct 3, 2026", "see you on 5 Nov 2026"), ("2", "Open evening of singers", "Upcoming", "see you on 5 Nov 2026")],
                                  "event_id string, title string, date_display string, description string")
    got = {r.event_id: (r.start_date, r.date_display) for r in social.items_to_records(items, now).collect()}
    assert got == {"fb_live_1": (datetime(2026, 10, 3, 9, 0), "Oct 3, 2026"), "fb_live_2": (datetime(2026, 11, 5, 9, 0), "Nov 05, 2026")}
    asked = F.raise_error(F.lit("read"))
    monkeypatch.setattr(social, "caption_datetime", lambda col, ref: F.struct(asked.cast("timestamp_ntz").alias("start_date"), asked.cast("string").alias("date_display")))
    kept = social.items_to_records(items.where("event_id = '1'"), now).select("start_date", "date_display").collect()
    assert [tuple(r) for r in kept] == [(datetime(2026, 10, 3, 9, 0), "Oct 3, 2026")]


def test_items_are_dealt_to_all_cores(spark, tables):  # noqa: F811
    """rows of a table of one row group were read by one task."""
    plan = QUERIES["x14_social_items"](spark, tables)._jdf.queryExecution().sparkPlan().toString()
    assert "RoundRobinPartitioning" in plan
