"""Benchmark decontamination over a positional inverted index, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

WORDS, SHARE = 13, 20
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MOST_BROADCAST_ROWS = 4_000_000  # of small numeric rows or words; a larger side is shuffled instead


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST_ROWS else df


class Index:
    """Postings (row, term, pos) of the training words that the test set has, written to the shared folder.

    ``row`` names a document by a hash of its id and text; positions count from 1. A posting of term -1 stands for the document itself:
    its pos is the number of words. Beside it lie the terms of the test items, item_pos counting from 0.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"):
        self.scratch = scratch = Scratch(docs.sparkSession)
        own = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.xxhash64(F.col(item_text)).alias("version"), tokens(F.col(item_text)).alias("words"))
        placed = own.distinct().select("item", "version", F.size("words").alias("length"), F.posexplode("words").alias("item_pos", "word")).withColumn("word", lowered(F.col("word")))
        self.terms = scratch.keep(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
        n_terms = self.terms.count()
        self.item_terms = scratch.keep(placed.join(sized(self.terms, n_terms), "word").select("item", "version", "length", "item_pos", "term"))
        known = self.terms.union(docs.sparkSession.createDataFrame([("", -1)], "word string, term long"))
        marked = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(key).alias("doc"), tokens(F.col(text)).alias("words"))
        spread = marked.select("row", "doc", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
        self.postings = scratch.keep(spread.withColumn("word", lowered(F.col("word"))).join(sized(known, n_terms), "word").select(
            "row", "term", F.when(F.col("term") < 0, F.col("n")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("term") < 0, F.col("doc")).alias("doc")))

    def documents(self) -> DataFrame:
        """(row, doc, n_words), one per document row."""
        return self.postings.where("term < 0").select("row", "doc", F.col("pos").alias("n_words"))

    def windows(self, words: int = WORDS) -> DataFrame:
        """The two rarest terms of every test window: (item, version, first, first_pos, second, second_pos), distinct.

        A window is ``words`` consecutive item words, a shorter item one window; one with a term that training lacks is left out.
        """
        counts = self.postings.where("term >= 0").groupBy("term").agg(F.count("*").alias("n"))
        rated = self.item_terms.join(sized(counts, self.terms.count()), "term", "left")
        at = rated.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("item_pos") - words + 1),
                                                             F.greatest(F.lit(0), F.least(F.col("item_pos"), F.col("length") - words)))))
        window = at.groupBy("item", "version", "start").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item_pos", "term"))).alias("all"))
        window = window.where(F.col("all")[0]["n"] > 0)
        second = F.coalesce(F.get("all", F.lit(1)), F.col("all")[0])
        return window.select("item", "version", F.col("all")[0]["term"].alias("first"), F.col("all")[0]["item_pos"].alias("first_pos"),
                             second["term"].alias("second"), second["item_pos"].alias("second_pos")).distinct()

    def alignments(self, words: int = WORDS) -> DataFrame:
        """(row, item, version, shift) at which the rarest two terms of some window stand in their places; pos = item_pos + shift."""
        rare = self.scratch.keep(self.windows(words))
        n_rare = rare.count()
        heads = self.postings.join(sized(rare, n_rare).withColumnRenamed("first", "term"), "term").select(
            "row", "item", "version", (F.col("pos") - F.col("first_pos")).alias("shift"), F.col("second").alias("term"), (F.col("pos") - F.col("first_pos") + F.col("second_pos")).alias("pos"))
        others = self.postings.join(sized(rare.select(F.col("second").alias("term")).distinct(), n_rare), "term", "left_semi").select("row", "term", "pos")
        return heads.join(others, ["row", "term", "pos"], "left_semi").select("row", "item", "version", "shift").distinct()

    def phrases(self, words: int = WORDS) -> DataFrame:
        """Exact matches (row, item, start, stop): runs of at least ``words`` item words, or the whole of a shorter item, stop exclusive."""
        found = self.scratch.keep(self.alignments(words))
        rows = self.scratch.keep(found.select("row").distinct())
        near = self.postings.where("term >= 0").join(sized(rows, rows.count()), "row", "left_semi").select("row", "term", "pos").distinct()
        wanted = found.join(sized(self.item_terms, self.item_terms.count()), ["item", "version"]).select(
            "row", "item", "version", "shift", "length", "term", "item_pos", (F.col("item_pos") + F.col("shift")).alias("pos"))
        met = wanted.join(near, ["row", "term", "pos"]).select("row", "item", "version", "shift", "length", "pos")
        line = Window.partitionBy("row", "item", "version", "shift").orderBy("pos")
        runs = met.withColumn("run", F.col("pos") - F.row_number().over(line)).groupBy("row", "item", "version", "shift", "length", "run").agg(
            F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
        return runs.where(F.col("stop") - F.col("start") >= F.least(F.lit(words), "length")).select("row", "item", "start", "stop").distinct()

    def proximity(self, within: int = 5, words: int = WORDS) -> DataFrame:
        """Looser matches (row, item): the two rarest terms of some window stand at most ``within`` words from their distance."""
        rare = self.scratch.keep(self.windows(words))
        n_rare = rare.count()
        heads = self.postings.join(sized(rare, n_rare).withColumnRenamed("first", "term"), "term").select(
            "row", "item", F.col("second").alias("term"), F.explode(F.sequence(F.col("pos") - F.col("first_pos") + F.col("second_pos") - within,
                                                                              F.col("pos") - F.col("first_pos") + F.col("second_pos") + within)).alias("pos"))
        others = self.postings.join(sized(rare.select(F.col("second").alias("term")).distinct(), n_rare), "term", "left_semi").select("row", "term", "pos")
        return heads.join(others, ["row", "term", "pos"], "left_semi").select("row", "item").distinct()


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: row, key, n_words, n_hit, items (sorted texts of their ids), contaminated.

    A word is hit inside any occurrence of a test window; contaminated means at least one hit word in ``share`` words. Null and empty
    texts have no words; items without words match nothing and items with a null id are left out; items that share an id are one item.
    Repeated rows get the same result; an empty table on either side gives no matches. Hit words are the union of a document's runs,
    so a passage in many documents costs each of them its own length, and no list is longer than a document or the test set.
    """
    index = Index(docs, items, key, text)
    runs = index.scratch.keep(index.phrases(words))
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    union = runs.select("row", "start", "stop").distinct().withColumn("from", F.greatest("start", F.coalesce(F.max("stop").over(before), F.col("start"))))
    hits = union.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.col("from"))).cast("long").alias("n_hit"))
    listed = runs.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = index.documents().join(hits, "row", "left").join(listed, "row", "left").select(
        "row", F.col("doc").alias(key), F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    bad = report(docs, items, key, text).where("contaminated").select(F.col("row").alias("__llm_row")).distinct()
    return docs.join(bad, F.xxhash64(F.col(key), F.col(text)) == F.col("__llm_row"), "left_anti")


_TOKENS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH items AS (SELECT item_id, {_TOKENS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), {WORDS}) AS k, md5(array_to_string(words[i:i + least(len(words), {WORDS}) - 1], ' ')) AS h
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
docs AS (SELECT doc_id, {_TOKENS} AS words FROM documents),
spots AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM docs),
hits AS (
  SELECT s.doc_id, s.i, w.k, w.item_id
  FROM (SELECT doc_id, i, k, md5(array_to_string(words[i:i + k - 1], ' ')) AS h FROM spots, (SELECT DISTINCT k FROM windows) ks WHERE i + k - 1 <= len(words)) s
  JOIN windows w ON s.h = w.h AND s.k = w.k),
per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.words)) AS contaminated
FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN named USING (doc_id)"""
