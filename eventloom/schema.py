"""The event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", _TEXT), T.StructField("title", _TEXT), T.StructField("source", _TEXT),
    T.StructField("start_date", T.TimestampNTZType()), T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("date_display", _TEXT), T.StructField("location", _TEXT), T.StructField("city", _TEXT),
    T.StructField("country", _TEXT), T.StructField("url", _TEXT), T.StructField("ticket_type", _TEXT),
    T.StructField("organizer", _TEXT), T.StructField("description", _TEXT), T.StructField("category", _TEXT),
    T.StructField("tags", T.ArrayType(_TEXT)), T.StructField("score", T.DoubleType()),
    T.StructField("priority", _TEXT), T.StructField("recommended_action", _TEXT), T.StructField("parallel_org", _TEXT),
    T.StructField("clash_warning", T.BooleanType()), T.StructField("clash_count", T.IntegerType()),
    T.StructField("clash_details", T.ArrayType(_TEXT)), T.StructField("raw_caption", _TEXT),
    T.StructField("organizer_email", _TEXT), T.StructField("organizer_instagram", _TEXT),
    T.StructField("organizer_linkedin", _TEXT), T.StructField("organizer_phone", _TEXT),
    T.StructField("proof_url", _TEXT), T.StructField("proof_type", _TEXT), T.StructField("proof_evidence", _TEXT),
    T.StructField("registration_url", _TEXT), T.StructField("organizer_profile_url", _TEXT),
    T.StructField("post_direct_url", _TEXT), T.StructField("is_social_first", T.BooleanType()),
])
# fixed values: what a record holds when a source says nothing
DEFAULTS = {
    "date_display": "", "location": "TBA / Online", "city": "Egypt", "country": "Egypt", "ticket_type": "Unknown",
    "organizer": "Unknown", "description": "", "category": "General", "score": 0.0, "priority": "LOW",
    "recommended_action": "", "clash_warning": False, "clash_count": 0, "is_social_first": False,
    "proof_type": "Official Announcement",
}


def conform(df: DataFrame, *extra: str) -> DataFrame:
    """Bring a frame to the event schema: missing columns added, defaults filled in."""
    cols = []
    for f in EVENT_SCHEMA:
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in DEFAULTS:
            col = F.coalesce(col, F.lit(DEFAULTS[f.name]))
        elif f.name in ("tags", "clash_details"):
            col = F.coalesce(col, F.array().cast("array<string>"))
        cols.append(col.alias(f.name))
    return df.select(*[F.col(x) for x in extra], *cols)


def event_frame(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Small frame of records for tests and interactive use; ``seq`` numbers the rows unless given."""
    names = EVENT_SCHEMA.fieldNames()
    data = [(r.get("seq", i), *(r.get(n) for n in names)) for i, r in enumerate(rows, 1)]
    schema = T.StructType([T.StructField("seq", T.LongType()), *EVENT_SCHEMA.fields])
    return conform(spark.createDataFrame(data, schema), "seq")
