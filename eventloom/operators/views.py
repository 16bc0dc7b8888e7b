"""Filters, sort orders, metrics and small reports over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.dates import display_end, epoch_micros
from ..functions.patterns import any_of, contains_any, text
from .contains import search_many


def _is_all(value: str | None) -> bool:
    return not value or value.lower() == "all"


def _low(name: str) -> Column:
    return F.lower(text(F.col(name)))



# ---------------------------------------------------------------- predicates
def city_is(city: str) -> Column:
    return F.lit(True) if _is_all(city) else _low("city") == city.lower()


def city_contains(city: str) -> Column:
    return F.lit(True) if _is_all(city) else _low("city").contains(city.lower())


def priority_is(priority: str) -> Column:
    return F.lit(True) if _is_all(priority) else F.upper(text(F.col("priority"))) == priority.upper()


def from_social(networks=lx.SOCIAL_NETWORKS) -> Column:
    return contains_any(_low("source"), networks)


def source_matches(source: str) -> Column:
    if _is_all(source):
        return F.lit(True)
    return from_social() if source.lower() == "social" else _low("source").contains(source.lower())


def category_contains(category: str) -> Column:
    return F.lit(True) if _is_all(category) else _low("category").contains(category.lower())


def smart_category(category: str, families=lx.CATEGORY_FAMILIES) -> Column:
    """Category text, or the words and scores of the family the request names."""
    if _is_all(category):
        return F.lit(True)
    want, cat, title = category.lower(), _low("category"), _low("title")
    rules = [cat.contains(want)]
    for name, cats, titles, floor in families:
        if name in want:
            rules += [contains_any(cat, cats), contains_any(title, titles)]
            if floor is not None:
                rules.append(F.coalesce(F.col("score") >= floor, F.lit(False)))
    return any_of(rules)


def has_partner(client: bool = False) -> Column:
    p = text(F.col("parallel_org"))
    return (p != "") & (p != "Independent") if client else p != ""


def has_clash() -> Column:
    return F.coalesce(F.col("clash_warning"), F.lit(False))


def is_social(client: bool = False) -> Column:
    networks = ("facebook", "instagram") if client else lx.SOCIAL_NETWORKS
    return F.coalesce(F.col("is_social_first"), F.lit(False)) | from_social(networks)


KEYWORD_FIELDS = ("title", "location", "organizer", "description", "category")


def keyword(q: str, columns=KEYWORD_FIELDS) -> Column:
    return any_of(_low(c).contains(q.lower()) for c in columns)


def in_scope(city: str | None, column: str = "city") -> Column:
    """City scope of a source; the whole country means no restriction."""
    if not city or city.lower() in lx.WHOLE_COUNTRY:
        return F.lit(True)
    return F.lower(text(F.col(column))) == city.lower()


def topic_settings(topic: str) -> dict:
    """Filter settings of a topic chip."""
    low = (topic or "").strip().lower()
    if low == "all":
        return {"category": "all", "priority": "all", "city": "all", "social_only": False}
    for words, settings in lx.TOPIC_PRESETS:
        if any(w in low for w in words):
            return dict(settings)
    return {}


def by_topic(df: DataFrame, topic: str) -> DataFrame:
    s = topic_settings(topic)
    out = df.where(smart_category(s.get("category", "all")) & city_contains(s.get("city", "all"))
                   & priority_is(s.get("priority", "all")))
    return out.where(is_social(client=True)) if s.get("social_only") else out


# --------------------------------------------------------------------- order
def sort_events(df: DataFrame, how: str = "score_desc") -> DataFrame:
    c = F.col
    orders = {
        "score_desc": [c("score").desc_nulls_last()], "score_asc": [c("score").asc_nulls_first()],
        "date_asc": [c("start_date").asc_nulls_last()], "date_desc": [c("start_date").desc_nulls_last()],
    }
    return df.orderBy(*orders[how], c("event_id"))


def timeline_order() -> list[Column]:
    """Undated last, earlier first, higher score first."""
    return [F.col("start_date").asc_nulls_last(), F.col("score").desc(), F.col("event_id")]


def effective_start(ref_year: int) -> Column:
    """Start, else concluding display date, else unknown."""
    return F.coalesce(F.col("start_date"),
                      display_end(F.col("date_display"), ref_year, client=True).cast("timestamp_ntz"))


def sort_by_timestamp(df: DataFrame, ref_year: int, descending: bool = False) -> DataFrame:
    at = effective_start(ref_year)
    return df.orderBy(at.desc_nulls_first() if descending else at.asc_nulls_last(), "event_id")


def sort_table(df: DataFrame, column: str = "priority", ascending: bool = False, ref_year: int = 2026) -> DataFrame:
    at = {"title": _low("title"), "city": _low("city"), "date": effective_start(ref_year)}.get(
        column, F.coalesce("score", F.lit(0.0)))
    order = at.asc_nulls_last() if ascending else at.desc_nulls_first()
    return df.orderBy(order, "event_id")


# ------------------------------------------------------------------- metrics
def metric_columns() -> list[Column]:
    flagship = _low("category").contains("flagship") | _low("source").contains("summit")
    return [
        F.count("*").alias("total_events"), F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
        F.count_if(has_clash()).alias("clashes"), F.count_if(has_partner()).alias("partner_orgs"),
        F.count_if(flagship).alias("flagship_count"),
        F.count_if(_low("source").contains("ticketsmarche")).alias("ticketsmarche_count"),
        F.count_if(from_social()).alias("social_count")]


def dashboard_metrics(df: DataFrame) -> DataFrame:
    return df.agg(*metric_columns())


def stats(df: DataFrame, city: str = "tanta") -> DataFrame:
    p = F.upper(text(F.col("priority")))
    flagship = _low("category").startswith("flagship") | F.coalesce(F.col("score") >= 9.5, F.lit(False))
    return df.agg(
        F.count("*").alias("total_events"), F.count_if(p == "HIGH").alias("high_priority"),
        F.count_if(p == "MEDIUM").alias("medium_priority"), F.count_if(p == "LOW").alias("low_priority"),
        F.count_if(flagship).alias("flagship_events"),
        F.count_if(_low("city").contains(city)).alias("city_events"))


def client_kpis(df: DataFrame) -> DataFrame:
    score = F.coalesce("score", F.lit(0.0))
    return df.agg(F.count("*").alias("total_events"), F.count_if(score >= 8.5).alias("high_priority"),
                  F.count_if(text(F.col("category")).contains("Flagship") | (score >= 9.8)).alias("flagship_count"))


# ------------------------------------------------------------------- reports
def digest(df: DataFrame, min_score: float = 8.5, fallback: int = 10, cards: int = 12) -> DataFrame:
    """Digest cards: events at or above the score, or the first ten when there is none.

    Every card carries the number of campus events in the whole selection.
    """
    order = [F.col("seq")]
    high = df.where(F.col("score") >= min_score)
    first = df.orderBy(*order).limit(fallback)
    none = high.agg(F.count("*") == 0).scalar()
    pool = high.orderBy(*order).limit(cards).unionByName(first.where(none))
    campus = F.count_if(F.col("category").contains("University") | F.col("category").contains("Student"))
    count = F.when(none, first.agg(campus).scalar()).otherwise(high.agg(campus).scalar())
    return pool.orderBy(*order).limit(cards).withColumn("campus_count", count)


def briefing(df: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` events of the current order as one text."""
    c = F.col
    top = df.orderBy("seq").limit(k).withColumn("_n", F.row_number().over(_ordered()))
    line = F.concat(
        c("_n").cast("string"), F.lit(". "), c("title"), F.lit(" ("), c("city"), F.lit(") | Date: "),
        F.coalesce(F.nullif("date_display", F.lit("")), F.lit("TBA")), F.lit(" | Score: "),
        F.format_number("score", 1), F.lit(" ("), c("priority"), F.lit(") | Action: "),
        F.coalesce(F.nullif("recommended_action", F.lit("")), F.lit("Deploy youth booth")), F.lit(" | Link: "), c("url"))
    lines = top.select("_n", line.alias("_l")).agg(F.sort_array(F.collect_list(F.struct("_n", "_l"))).alias("_a"))
    return lines.select(F.array_join(F.transform("_a", lambda r: r["_l"]), "\n").alias("briefing"))


def _ordered():
    from pyspark.sql import Window
    return Window.orderBy("seq")  # over the k rows of the report only


def keyword_many(df: DataFrame, questions: DataFrame, fields: tuple[str, ...] = KEYWORD_FIELDS) -> DataFrame:
    """Every (question, record) pair of the keyword search, for any number of questions (``qid``, ``q``) at once.

    A question must lie inside one field, so the fields are joined by a character that no question may contain.
    """
    hay = F.concat_ws("\x00", *(_low(f) for f in fields))
    asked = questions.select("qid", F.lower(F.trim("q")).alias("_q")).where("_q <> ''").where(~F.col("_q").contains("\x00"))
    return search_many(df, hay, asked, F.col("_q")).drop("_q")


def quick_find(df: DataFrame, q: str, k: int = 6) -> DataFrame:
    return df.where(keyword(q, ("title", "city", "organizer"))).orderBy("seq").limit(k)


def hub_rollup(df: DataFrame, hubs=lx.HUBS) -> DataFrame:
    """Events and flagship events per regional hub.

    Cities are counted first; only the distinct city names are compared with the hubs: a short list, or a frame of any length with the
    column hub.
    """
    flagship = (_low("category").contains("flagship") | _low("title").contains("techne")
                | _low("title").contains("riseup"))
    per_city = df.groupBy(_low("city").alias("_city")).agg(
        F.count("*").alias("_n"), F.count_if(flagship).alias("_f"))
    if isinstance(hubs, DataFrame):
        met = search_many(per_city, F.col("_city"), hubs.select("hub").distinct(), F.col("hub"))
        return met.groupBy("hub").agg(F.sum("_n").alias("n_events"), F.sum("_f").alias("n_flagship"))
    hit = F.filter(F.array(*map(F.lit, hubs)), lambda h: F.col("_city").contains(h))
    return (per_city.select(F.explode(hit).alias("hub"), "_n", "_f").groupBy("hub")
            .agg(F.sum("_n").alias("n_events"), F.sum("_f").alias("n_flagship")))


def api_projection(df: DataFrame) -> DataFrame:
    """Columns served to clients; a missing announcement link falls back to the event link."""
    proof = F.coalesce(F.nullif("proof_url", F.lit("")), F.col("url"))
    return df.withColumn("proof_url", proof).drop("raw_caption", "seq")


# ------------------------------------------------------------------ watchlist
def watchlist(df: DataFrame, city: str | None = None, category: str | None = None, q: str = "") -> DataFrame:
    """Watched source pages by city or university, category and free text."""
    out = df
    if city and not _is_all(city.strip()):
        low = city.strip().lower()
        out = out.where(_low("city").contains(low) | _low("university").contains(low))
    if category and not _is_all(category.strip()):
        out = out.where(_low("category").contains(category.strip().lower()))
    if q.strip():
        hay = F.lower(F.concat_ws(" ", "name", "university", "city", "typical_events"))
        out = out.where(hay.contains(q.strip().lower()))
    return out


def top_watch_sources(df: DataFrame, k: int = 8, city: str | None = None) -> DataFrame:
    return (watchlist(df, city).orderBy(F.coalesce("priority_score", F.lit(90)).desc(), "id").limit(k)
            .select("name", "facebook_url"))
