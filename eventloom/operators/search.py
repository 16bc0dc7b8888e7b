"""Full-text search: inverted index, prefix terms, BM25 ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import strip, text
from ..session import cut_lineage
from .keyed import marked, top_per_key

FIELDS = ("title", "description", "city", "location", "category", "organizer")
K1, B = 1.2, 0.75
SHARDS = 64


def fold(col: Column) -> Column:
    """Lower case without diacritics: decomposed marks are dropped, common Latin letters mapped."""
    accented = "àáâãäåāăąçćčďèéêëēęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűýÿžźż"
    plain = "aaaaaaaaacccdeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"
    return F.regexp_replace(F.translate(F.lower(text(col)), accented, plain), r"\p{Mn}+", "")


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(fold(col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def build_index(df: DataFrame, id_col: str = "event_id", fields=FIELDS) -> DataFrame:
    """Postings (term, id, tf, dl): term frequency over all fields and length of the document.

    Counting is partial per partition; the shard column spreads the postings of a frequent term.
    """
    all_tokens = F.flatten(F.array(*(tokens(F.col(f)) for f in fields)))
    doc = df.select(F.col(id_col).alias("id"), all_tokens.alias("_t")).withColumn("dl", F.size("_t"))
    return (doc.select("id", "dl", F.explode("_t").alias("term")).groupBy("term", "id", "dl")
            .agg(F.count("*").alias("tf")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int")))


def corpus(df: DataFrame, id_col: str = "event_id", fields=FIELDS) -> DataFrame:
    """One row: number of documents and their mean length."""
    size = sum((F.size(tokens(F.col(f))) for f in fields[1:]), F.size(tokens(F.col(fields[0]))))
    return df.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avg_dl"))


def query_terms(queries: DataFrame, qid: str = "qid", q: str = "q") -> DataFrame:
    """(qid, pos, prefix, n_terms): every word of a question is a prefix that must occur."""
    bare = F.filter(F.transform(F.split(strip(text(F.col(q))), r"\s+"),
                                lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")), lambda w: w != "")
    # an underscore separates words in the index
    parts = F.transform(bare, lambda w: F.regexp_extract_all(fold(w), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    flat = F.flatten(parts)
    return (queries.select(F.col(qid).alias("qid"), F.posexplode(F.filter(flat, lambda w: w != "")).alias("pos", "prefix"),
                           F.size(flat).alias("n_terms")))


def search(index: DataFrame, stats: DataFrame, queries: DataFrame, limit: int = 50, vocabulary: DataFrame | None = None) -> DataFrame:
    """Ranked hits (qid, id, score, rank): all prefixes required, BM25 with the prefix as one term.

    Every distinct prefix is looked up once for all questions: prefixes meet the vocabulary by an equi-join on the whole prefix (each
    term is cut to the lengths that questions have), their terms the postings, and the hits (prefix, id, tf) are written. A question's
    candidates are the documents of its rarest prefix; only they are looked up under its other prefixes, the next rarest first, so a
    common word in many questions costs its postings once and not once a question. A prefix's document frequency counts documents with
    any of its terms.
    """
    terms = cut_lineage(query_terms(queries))
    prefixes = terms.select("prefix").distinct().withColumn("width", F.length("prefix"))
    widths = prefixes.agg(F.sort_array(F.collect_set("width"))).scalar()  # a few numbers: lengths of words
    words = (vocabulary if vocabulary is not None else index.select("term").distinct()).withColumn("width", F.explode(widths)).where("width <= length(term)")
    wanted = words.withColumn("prefix", F.substr(F.col("term"), F.lit(1), F.col("width"))).join(prefixes, ["width", "prefix"]).select("term", "prefix")
    hits = cut_lineage(index.join(wanted, "term").groupBy("prefix", "id", "dl").agg(F.sum("tf").alias("tf")))
    freq = cut_lineage(hits.groupBy("prefix").agg(F.count("*").alias("df")))
    # place 1 is the rarest prefix of a question; one that has no document leaves the question without hits
    rarity = W.partitionBy("qid").orderBy("df", "prefix")
    asked = (terms.groupBy("qid", "prefix", "n_terms").agg(F.count("*").alias("times")).join(freq, "prefix", "left").withColumn("df", F.coalesce("df", F.lit(0)))
             .withColumn("place", F.row_number().over(rarity)).withColumn("n_prefixes", F.count("*").over(W.partitionBy("qid"))))
    asked = cut_lineage(asked)

    def under(places: Column, found: DataFrame | None) -> DataFrame:
        """Hits (qid, id, prefix, ...) of the prefixes at some places, for found documents only."""
        own = asked.where(places)
        if found is None:
            return own.join(hits, "prefix")
        # a common prefix has hits in most documents, few of which were found
        asked_for = cut_lineage(found.join(own, "qid"))
        h = F.xxhash64("prefix", "id")
        return asked_for.join(hits.where(marked(h, asked_for.select(h.alias("h")).distinct())), ["prefix", "id"])

    def passed(rows: DataFrame, upto: Column) -> DataFrame:
        return rows.groupBy("qid", "id").agg(F.count("*").alias("_m"), F.first(upto).alias("_n")).where("_m = _n").select("qid", "id")

    first = cut_lineage(under(F.col("place") == 1, None).select("qid", "id"))
    next_few = F.col("place").between(2, 4)
    several = asked.where("n_prefixes > 1").select("qid").distinct()
    near = passed(under(next_few, first.join(several, "qid", "left_semi")), F.least(F.col("n_prefixes") - 1, F.lit(3)))
    candidates = cut_lineage(first.join(several, "qid", "left_anti").unionByName(near))
    n_docs, avg_dl = stats.select("n_docs").scalar(), stats.select("avg_dl").scalar()
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    full = under(F.lit(True), candidates).withColumns({"n_docs": n_docs, "avg_dl": avg_dl})
    scored = (full.groupBy("qid", "id").agg(F.count("*").alias("_m"), F.first("n_prefixes").alias("_n"), F.sum(part).alias("score")).where("_m = _n"))
    ranked = top_per_key(scored.withColumn("score", F.round("score", 6)), ["qid"], [F.col("score").desc(), F.col("id")],
                         limit, rank="rank")
    return ranked.select("qid", "id", "score", "rank")


def substring_search(df: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Fallback: substring of title, description or city."""
    low = q.strip().lower()
    cond = F.lower("title").contains(low) | F.lower("description").contains(low) | F.lower("city").contains(low)
    return df.where(cond).orderBy("seq").limit(limit).select("event_id")
