"""Ordered rule cascade that classifies and scores a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.patterns import contains_any, has_phrase, matches, strip, text
from ..session import cut_lineage
from .keyed import salted_lookup


def partner_org(hay: Column) -> Column:
    """First known youth organisation named in the text."""
    out = None
    for name, words, fragments in lx.PARTNER_ORGS:
        hit = has_phrase(hay, words)
        if fragments:
            hit = hit | has_phrase(hay, fragments, whole_words=False)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _graded(title: Column, full: Column, phrases, name: str) -> Column:
    """``<name>_title`` when the first phrase found in the text is in the title too, else ``<name>_text``.

    Most texts hold no phrase of the list, and most others hold none in the title: one alternation each
    answers those, and only the remainder walks the list.
    """
    chain = None
    for p in phrases:
        chain = (F.when if chain is None else chain.when)(has_phrase(title, (p,)), F.lit(f"{name}_title"))
        chain = chain.when(has_phrase(full, (p,)), F.lit(f"{name}_text"))
    return F.when(has_phrase(title, phrases), chain).otherwise(F.lit(f"{name}_text"))


def rule(title: Column, full: Column, org: Column) -> Column:
    """Label of the first tier that applies; ``title`` and ``full`` are lower case."""
    workshop = lx.WORKSHOP + lx.TRAINING
    university = has_phrase(title, lx.UNIVERSITY)
    conference = has_phrase(title, lx.CONFERENCE)
    leisure = has_phrase(title, lx.LEISURE) | (
        has_phrase(full, lx.LEISURE) & ~has_phrase(title, lx.SUMMIT + lx.CAREER))
    medical = has_phrase(full, lx.MEDICAL)
    return (F.when(medical & has_phrase(full, lx.STUDENT_HEALTH), "health_student")
            .when(medical, "medical")
            .when(has_phrase(full, lx.INDUSTRIAL), "industrial")
            .when(leisure, "leisure")
            .when(has_phrase(title, lx.SUMMIT), "summit_title")
            .when(has_phrase(title, lx.CAREER), "career_title")
            .when(has_phrase(full, lx.HACKATHON), "hackathon")
            .when(has_phrase(full, lx.SUMMIT), "summit_text")
            .when(has_phrase(full, lx.CAREER), "career_text")
            .when(org.isNotNull() & contains_any(full, lx.MAJOR_WORDS), "partner_major")
            .when(org.isNotNull(), "partner")
            .when(university & conference, "university_conference")
            .when(university | (conference & has_phrase(full, lx.UNIVERSITY)), "campus")
            .when(has_phrase(full, lx.STUDENT_ORG), "student_org")
            .when(has_phrase(full, workshop), _graded(title, full, workshop, "workshop"))
            .when(has_phrase(full, lx.TECH), _graded(title, full, lx.TECH, "tech"))
            .when(has_phrase(full, lx.CULTURE), _graded(title, full, lx.CULTURE, "culture"))
            .otherwise("general"))


def _outcome_table(outcomes: dict) -> Column:
    pairs = []
    for label, (score, priority, category, *rest) in outcomes.items():
        tags, action = rest if len(rest) == 2 else ((), rest[0])
        pairs += [F.lit(label), F.struct(
            F.lit(float(score)).alias("score"), F.lit(priority).alias("priority"), F.lit(category).alias("category"),
            F.array(*map(F.lit, tags)).cast("array<string>").alias("tags"), F.lit(action).alias("action"))]
    return F.create_map(*pairs)


def evaluate(df: DataFrame, title: str = "title", description: str = "description", location: str = "location",
             into: str = "eval") -> DataFrame:
    """Add a struct with rule, score, priority, category, tags, action and partner organisation."""
    keep = df.columns
    t, d, loc = (strip(text(F.col(x))) for x in (title, description, location))
    df = df.withColumns({"_tl": F.lower(t), "_fl": F.lower(F.concat(t, F.lit(" "), d)),
                         "_al": F.lower(F.concat_ws(" ", t, d, loc))})
    df = df.withColumn("_org", partner_org(F.col("_al")))
    df = df.withColumn("_rule", rule(F.col("_tl"), F.col("_fl"), F.col("_org")))
    df = df.withColumn("_o", F.element_at(_outcome_table(lx.OUTCOMES), F.col("_rule")))
    org = F.col("_org")
    tags = F.when(org.isNotNull(), F.concat(F.array(org), F.col("_o.tags"))).otherwise(F.col("_o.tags"))
    action = F.replace(F.col("_o.action"), F.lit("{org}"), F.coalesce(org, F.lit("")))
    return df.withColumn(into, F.struct(
        F.col("_rule").alias("rule"), F.col("_o.score").alias("score"), F.col("_o.priority").alias("priority"),
        F.col("_o.category").alias("category"), tags.alias("tags"), action.alias("action"),
        org.alias("parallel_org"))).select(*keep, into)


def is_summit_source(source: Column) -> Column:
    return F.lower(text(source)).contains("summit")


def apply_scores(df: DataFrame) -> DataFrame:
    """Score records and lift those of summit sources; a summit's own action is kept."""
    keep = df.columns
    summit, e = is_summit_source(F.col("source")), F.col("eval")
    own = F.nullif(F.col("recommended_action"), F.lit(""))
    scored = evaluate(df)
    return scored.withColumns({
        "score": F.when(summit, F.greatest(e["score"], F.lit(lx.SUMMIT_SOURCE_FLOOR))).otherwise(e["score"]),
        "priority": F.when(summit, "HIGH").otherwise(e["priority"]),
        "category": F.when(summit, lx.FLAGSHIP_CATEGORY).otherwise(e["category"]),
        "tags": e["tags"],
        "recommended_action": F.when(summit, F.coalesce(own, e["action"])).otherwise(e["action"]),
        "parallel_org": F.coalesce(F.nullif(F.col("parallel_org"), F.lit("")), e["parallel_org"]),
    }).select(*keep)


def lift_summits(df: DataFrame) -> DataFrame:
    """Uplift applied when a stored snapshot is loaded."""
    summit = is_summit_source(F.col("source"))
    return df.withColumns({
        "category": F.when(summit, lx.FLAGSHIP_CATEGORY).otherwise(F.col("category")),
        "score": F.when(summit, F.greatest("score", F.lit(lx.SUMMIT_SOURCE_FLOOR))).otherwise(F.col("score")),
        "priority": F.when(summit, "HIGH").otherwise(F.col("priority")),
    })


def client_rule(hay: Column, source: Column, category: Column) -> Column:
    summit = (is_summit_source(source) | F.lower(text(category)).contains("summit")
              | contains_any(hay, lx.CLIENT_SUMMIT_WORDS))
    return (F.when(matches(hay, lx.CLIENT_MEDICAL) & ~matches(hay, lx.CLIENT_MEDICAL_STUDENT), "medical")
            .when(matches(hay, lx.CLIENT_LEISURE), "leisure")
            .when(matches(hay, lx.CLIENT_INDUSTRIAL), "industrial")
            .when(summit, "summit")
            .when(contains_any(hay, lx.CLIENT_HACKATHON_WORDS), "hackathon")
            .when(contains_any(hay, lx.CLIENT_CAREER_WORDS), "career")
            .when(matches(hay, lx.CLIENT_UNIVERSITY) & matches(hay, lx.CLIENT_CONFERENCE), "university_conference")
            .when(matches(hay, lx.CLIENT_CAMPUS), "campus")
            .when(contains_any(hay, lx.CLIENT_TECH_WORDS), "tech").otherwise("default"))


def evaluate_client(df: DataFrame, into: str = "eval") -> DataFrame:
    """Second profile: ten tiers over title, description and location; given values win.

    Needs title, description, location, source, category, score and recommended_action (NULL when not given).
    """
    keep = df.columns
    hay = F.lower(F.concat_ws(" ", *(text(F.col(x)) for x in ("title", "description", "location"))))
    df = df.withColumn("_hay", hay).withColumn(
        "_rule", client_rule(F.col("_hay"), F.col("source"), F.col("category")))
    df = df.withColumn("_o", F.element_at(_outcome_table(lx.CLIENT_OUTCOMES), F.col("_rule")))
    summit = F.col("_rule") == "summit"
    given = F.nullif(F.col("score"), F.lit(0.0))
    score = F.when(summit, F.greatest(F.coalesce(given, F.lit(9.8)), F.lit(9.2))).otherwise(F.col("_o.score"))
    action = F.when(summit, F.coalesce(F.nullif(F.col("recommended_action"), F.lit("")), F.col("_o.action")))
    return df.withColumn(into, F.struct(
        F.col("_rule").alias("rule"), score.alias("score"), F.col("_o.priority").alias("priority"),
        F.col("_o.category").alias("category"), action.otherwise(F.col("_o.action")).alias("action"))).select(*keep, into)


def weighted_keywords(df: DataFrame, id_col: str, text_col: str, weights: DataFrame) -> DataFrame:
    """Sum of configured term weights per text: an optional extra for configured
    weights that no default rule reads.  ``weights`` holds ``(term, weight)``.

    Terms are written out first, so that Spark knows their size and sends a short list to the words instead of sorting all words. Words
    travel without their text: a term that is one whole word is decided by its equality, others are checked on the texts (by digest) that
    contain their first word.
    """
    word = r"([\p{L}\p{N}_]+)"
    terms = cut_lineage(weights.select(F.lower("term").alias("_term"), "weight").withColumn("_w", F.regexp_extract("_term", word, 1)).where("_w <> ''"))
    texts = df.select(id_col, F.lower(text(F.col(text_col))).alias("_text"))
    whole_words = terms.where("_term <> _w").isEmpty()
    digest = F.lit(None).cast("binary") if whole_words else F.unhex(F.md5("_text"))
    words = (texts.select(id_col, digest.alias("_t"), F.array_distinct(F.regexp_extract_all("_text", F.lit(word), F.lit(1))).alias("_all"))
             .select(id_col, "_t", F.explode("_all").alias("_w")))
    hits = words.join(terms, "_w")
    if not whole_words:
        asked = hits.where("_term <> _w")
        found_in = texts.select(F.unhex(F.md5("_text")).alias("_t"), "_text").join(asked.select("_t").distinct(), "_t", "left_semi").dropDuplicates(["_t"])
        checked = salted_lookup(asked, found_in, ["_t"], "inner").where(F.col("_text").contains(F.col("_term"))).select(hits.columns)
        hits = hits.where("_term = _w").unionByName(checked)
    return hits.groupBy(id_col).agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n_terms"))
