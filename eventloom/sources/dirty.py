"""Reading files as they come: broken lines, layouts that change from file to file, marks for missing values.

Every reader returns (rows, rejects): what can be used, in the event schema, and the rest as (file, record, reason), so that nothing goes
unseen. Lines are read one by one, so a broken line spoils itself only and large files are split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import contains_any
from ..functions.text import missing_to_null
from ..schema import EVENT_SCHEMA, conform
from ..session import cut_lineage
from .snapshots import MIN_ROWS, SHEET_COLUMNS, SHEET_SKIPPED_SOURCES, _blank, from_sheet

MOST_COLUMNS = 64  # of a sheet; a line with more values is broken
HEADER_NAMES = 3  # known names that make a line a header
CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str | list[str], aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines of any age. ``aliases`` maps older names to fields; a field takes its own name's value first. Fields that a file lacks
    are missing. Rejected: lines that are no JSON object or hold a value of the wrong type (``broken``), blank titles (``no title``)."""
    aliases = aliases or {}
    older = [T.StructField(a, EVENT_SCHEMA[f].dataType) for a, f in aliases.items()]
    schema = T.StructType([*EVENT_SCHEMA.fields, *older, T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    read = cut_lineage(raw.withColumn("_file", F.col("_metadata.file_path")))  # parsed once, for rows and rejects
    for alias, name in aliases.items():
        read = read.withColumn(name, F.coalesce(name, alias))
    reason = F.when(F.col(CORRUPT).isNotNull(), "broken").when(_blank(F.col("title")), "no title")
    told = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*EVENT_SCHEMA.fieldNames())))
    rejects = read.where(reason.isNotNull()).select(F.col("_file").alias("file"), told.alias("record"), reason.alias("reason"))
    return conform(read.where(reason.isNull())), rejects


def read_sheets(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Comma-separated sheets, each with its own header: sheet names or field names, in any order, beside columns that nobody knows.

    A line with three or more known names is the header of its file. Rejected: files without one (``no header``), lines with more values
    than their header (``too many values``), with a quote that does not close (``open quote``), without a title (``no title``), and
    sources that have their own readers (``skipped source``). A line with fewer values lacks the last ones.
    """
    names = [f"_c{k}" for k in range(MOST_COLUMNS)]
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("line")).where("line <> ''")
    cells = F.from_csv("line", ", ".join(f"{n} string" for n in names), {"escape": '"'})
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    lines = cut_lineage(text.select("file", "line", odd.alias("odd"), cells.alias("c")).select("file", "line", "odd", F.array(*[f"c.{n}" for n in names]).alias("values")))
    known = ["event_id", *SHEET_COLUMNS, *SHEET_COLUMNS.values()]
    is_header = F.size(F.array_intersect("values", F.array(*map(F.lit, known)))) >= HEADER_NAMES
    headers = lines.where(is_header).groupBy("file").agg(F.min("values").alias("header"))  # one row a file
    filled = F.array_max(F.transform("header", lambda h, i: F.when(h.isNotNull(), i + 1)))
    rows = lines.where(~is_header).join(headers, "file", "left").withColumn("width", filled)

    def cell(name: str) -> Column:
        return missing_to_null(F.get("values", (F.array_position("header", F.lit(name)) - 1).cast("int")))

    fields = {f: F.coalesce(cell(h), cell(f)) for h, f in SHEET_COLUMNS.items()}
    sheet = rows.select("file", "line", "odd", "values", "width", cell("event_id").alias("event_id"), *[v.alias(f) for f, v in fields.items()])
    beyond = F.exists(F.slice("values", F.col("width") + 1, F.lit(MOST_COLUMNS)), lambda v: v.isNotNull())
    reason = (F.when(F.col("width").isNull(), "no header").when(F.col("odd"), "open quote").when(beyond, "too many values")
              .when(F.col("title").isNull(), "no title").when(contains_any(F.lower(F.coalesce("source", F.lit(""))), SHEET_SKIPPED_SOURCES), "skipped source"))
    judged = cut_lineage(sheet.withColumn("reason", reason))
    rejects = judged.where("reason IS NOT NULL").select("file", F.col("line").alias("record"), "reason")
    return from_sheet(judged.where("reason IS NULL").drop("file", "line", "odd", "values", "width", "reason")), rejects


def accepted(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame | None:
    """The rows, or None when there are fewer than ``min_rows`` of them: such a file must not replace a table."""
    return rows if rows.limit(min_rows).count() >= min_rows else None


def counted(rejects: list[DataFrame]) -> DataFrame:
    """(reason, n) over the rejects of several readers."""
    return reduce(DataFrame.unionByName, rejects).groupBy("reason").agg(F.count("*").alias("n"))
