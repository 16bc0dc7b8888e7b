"""A stored search index: immutable posting segments, delete marks, merging, pruned reads.

Below one folder, every part Parquet:

* ``postings/segment=s/cell=c``: (term, id, tf, dl) in order of terms; a cell holds the terms of some first characters
* ``terms/segment=s/cell=c``: (term, df), the vocabulary of the segment
* ``documents/segment=s``: (id, dl)
* ``deletes/mark=m``: (id, upto): the id is gone from segments up to that number; a later segment may hold it again
* ``manifest/version=v``: (kind, number) of the live segments and marks, written last; the greatest whole version is the index
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import delete_folder, spread, whole_folders
from .search import query_terms, tokens

CELLS = 32
_COLUMNS = {"postings": "term string, id {}, tf long, dl int", "terms": "term string, df long"}
FILE_ROWS = 4_000_000  # postings of a file, about
MOST_SEGMENTS = 8


def cell(term: Column) -> Column:
    """The cell of a term or prefix, by its first character."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(CELLS)).cast("int")


def _live(spark: SparkSession, root: str) -> tuple[int, list[int], list[int]]:
    """Version, segments and delete marks of the index; -1 and none without one."""
    version = max((int(n.removeprefix("version=")) for n in whole_folders(spark, f"{root}/manifest")), default=-1)
    if version < 0:
        return version, [], []
    rows = spark.read.schema("kind string, number int").parquet(f"{root}/manifest/version={version}").collect()
    return version, *(sorted(r["number"] for r in rows if r["kind"] == kind) for kind in ("segment", "mark"))


def _publish(spark: SparkSession, root: str, version: int, segments: list[int], marks: list[int]) -> None:
    rows = [("segment", s) for s in segments] + [("mark", m) for m in marks]
    spark.createDataFrame(rows, "kind string, number int").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")


def _free_number(spark: SparkSession, root: str) -> int:
    """Greater than that of any segment ever begun, so a broken write is never taken up again."""
    used = {int(n.removeprefix("segment=")) for n in whole_folders(spark, f"{root}/postings", any_state=True)}
    return max(used, default=0) + 1


def _first_of_runs(words: Column) -> Column:
    """Where each distinct word begins in a sorted list."""
    def changes(i: Column) -> Column:
        return (i == 0) | (F.get(words, i) != F.get(words, i - 1))

    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), changes)).otherwise(F.array().cast("array<int>"))


def _counts(words: Column, first: Column) -> Column:
    """(term, tf) of a document, from its sorted words."""
    return F.transform(first, lambda at, j: F.struct(F.get(words, at).alias("term"), (F.coalesce(F.get(first, j + 1), F.size(words)) - at).cast("long").alias("tf")))


def _write_segment(spark: SparkSession, root: str, number: int, postings: DataFrame, documents: DataFrame, n_postings: int, one_row_each: bool = True) -> None:
    """``postings`` (term, id, tf, dl) dealt to cells; a cell of many postings is split by id. Without ``one_row_each`` a document may
    have several postings of a term, which are added up where they meet."""
    documents.write.mode("overwrite").parquet(f"{root}/documents/segment={number}")
    n = max(1, -(-n_postings // FILE_ROWS))
    dealt = postings.withColumns({"cell": cell(F.col("term")), "_part": F.pmod(F.xxhash64("id"), F.lit(n))}).repartition(min(CELLS * n, 4096), "cell", "_part")
    if not one_row_each:
        dealt = dealt.groupBy("cell", "_part", "term", "id", "dl").agg(F.sum("tf").alias("tf"))
    (dealt.select(*postings.columns, "cell").sortWithinPartitions("cell", "term", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/postings/segment={number}"))
    stored = spark.read.schema(T.StructType([*postings.schema.fields, T.StructField("cell", T.IntegerType())])).parquet(f"{root}/postings/segment={number}")
    (stored.groupBy("cell", "term").agg(F.count("*").alias("df")).repartition(CELLS, "cell").sortWithinPartitions("cell", "term")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{root}/terms/segment={number}"))


def add(df: DataFrame, root: str, id_col: str = "event_id", fields: tuple[str, ...] = ("text",)) -> int:
    """Store the documents of a frame as one more segment; texts are cut into words once. Ids that the index holds already are replaced."""
    spark = df.sparkSession
    version, segments, marks = _live(spark, root)
    number = _free_number(spark, root)
    words = F.flatten(F.array(*(tokens(F.col(f)) for f in fields)))
    counted = (spread(df.select(F.col(id_col).alias("id"), *fields)).select("id", F.sort_array(words).alias("_t")).select("id", F.size("_t").alias("dl"), "_t")
               .withColumn("_first", _first_of_runs(F.col("_t"))).select("id", "dl", _counts(F.col("_t"), F.col("_first")).alias("terms")))
    staged = f"{root}/staged/segment={number}"
    counted.write.mode("overwrite").parquet(staged)
    counted = spark.read.schema(counted.schema).parquet(staged)
    documents = counted.select("id", "dl").distinct()
    rows, n_postings = counted.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    postings = counted.select("id", "dl", F.explode("terms").alias("p")).select("p.term", "id", "p.tf", "dl")
    _write_segment(spark, root, number, postings, documents, n_postings, one_row_each=rows == documents.count())
    if segments:
        # only ids that an older segment holds need a mark
        older = Index(spark, root, segments, [])._read("documents").select("id").distinct()
        _write_marks(spark, root, number, documents.select("id").distinct().join(older, "id", "left_semi"), number - 1)
        marks = [*marks, number]
    _publish(spark, root, version + 1, [*segments, number], marks)
    delete_folder(spark, staged)
    return number


def _write_marks(spark: SparkSession, root: str, mark: int, ids: DataFrame, upto: int) -> None:
    ids.select("id", F.lit(upto).alias("upto")).write.mode("overwrite").parquet(f"{root}/deletes/mark={mark}")


def delete(ids: DataFrame, root: str, id_col: str = "event_id") -> None:
    """Mark ids as gone; the postings stay until their segment is merged."""
    spark = ids.sparkSession
    version, segments, marks = _live(spark, root)
    if segments:
        mark = _free_number(spark, root)  # marks take their numbers from the same count
        spark.createDataFrame([], "cell int").write.mode("overwrite").parquet(f"{root}/postings/segment={mark}")  # taken
        _write_marks(spark, root, mark, ids.select(F.col(id_col).alias("id")).distinct(), segments[-1])
        _publish(spark, root, version + 1, segments, [*marks, mark])


@dataclass
class Index:
    """A version of a stored index."""
    spark: SparkSession
    root: str
    segments: list[int]
    marks: list[int]

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{name}/segment={s}" for s in self.segments]
        rows = self.spark.read.option("basePath", f"{self.root}/{name}")
        if name != "documents":  # a segment of documents without words has no file that tells the columns
            id_type = self._read("documents").schema["id"].dataType.simpleString()
            rows = rows.schema(f"{_COLUMNS[name].format(id_type)}, segment int, cell int")
        return rows.parquet(*paths)

    def _without_deleted(self, rows: DataFrame) -> DataFrame:
        if not self.marks:
            return rows
        paths = [f"{self.root}/deletes/mark={m}" for m in self.marks]
        gone = self.spark.read.parquet(*paths).groupBy("id").agg(F.max("upto").alias("upto"))
        r, g = rows.alias("r"), gone.alias("g")
        return r.join(g, (F.col("r.id") == F.col("g.id")) & (F.col("r.segment") <= F.col("g.upto")), "left_anti")

    def documents(self) -> DataFrame:
        return self._without_deleted(self._read("documents")).select("id", "dl")

    def postings(self, cells: list[int] | None = None) -> DataFrame:
        """(term, id, tf, dl), of some cells only; other folders are not opened."""
        rows = self._read("postings")
        rows = rows if cells is None else rows.where(F.col("cell").isin(cells))
        return self._without_deleted(rows).select("term", "id", "tf", "dl")

    def vocabulary(self, cells: list[int] | None = None) -> DataFrame:
        """Distinct terms; those of deleted documents may be among them until a merge."""
        rows = self._read("terms")
        return (rows if cells is None else rows.where(F.col("cell").isin(cells))).select("term").distinct()

    def terms(self) -> DataFrame:
        """(term, df, cf) over the documents there are."""
        return self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def statistics(self) -> DataFrame:
        """One row: number of documents and their mean length."""
        return self.documents().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))

    def search(self, queries: DataFrame, limit: int = 50) -> DataFrame:
        """Ranked hits (qid, id, score, rank); only the cells of the questions' words are read."""
        from .search import search
        cells = [r["cell"] for r in query_terms(queries).select(cell(F.col("prefix")).alias("cell")).distinct().collect()]  # at most CELLS
        return search(self.postings(cells), self.statistics(), queries, limit, self.vocabulary(cells))


def open_index(spark: SparkSession, root: str) -> Index:
    _, segments, marks = _live(spark, root)
    if not segments:
        raise ValueError(f"no index in {root}")
    return Index(spark, root, segments, marks)


def merge_segments(spark: SparkSession, root: str, most: int = MOST_SEGMENTS) -> list[int]:
    """Merge the smallest segments into one until ``most`` are left, without the deleted documents; returns the live segments.

    Folders of merged segments and of marks that no segment needs are deleted after the new version is there.
    """
    version, segments, marks = _live(spark, root)
    if len(segments) <= most:
        return segments
    sizes = {r["segment"]: r["n"] for r in Index(spark, root, segments, [])._read("documents").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    old = sorted(sorted(segments, key=lambda s: (sizes.get(s, 0), s))[:len(segments) - most + 1])
    chosen, number = Index(spark, root, old, marks), _free_number(spark, root)
    _write_segment(spark, root, number, chosen.postings(), chosen.documents(), chosen.postings().count())
    left = [s for s in segments if s not in old]
    upto = {m: spark.read.parquet(f"{root}/deletes/mark={m}").agg(F.max("upto").alias("u")).first()["u"] for m in marks}
    needed = [m for m in marks if any(s <= (upto[m] or 0) for s in left)]
    _publish(spark, root, version + 1, [*left, number], needed)
    for s in old:
        for name in ("postings", "terms", "documents"):
            delete_folder(spark, f"{root}/{name}/segment={s}")
    for m in set(marks) - set(needed):
        delete_folder(spark, f"{root}/deletes/mark={m}")
    return [*left, number]
