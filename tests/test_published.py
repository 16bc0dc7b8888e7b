"""Published tables: whole versions, refusals and failures that change nothing, one evaluation."""

import glob

import pytest
from pyspark.sql import functions as F

from eventloom.sources import published


def shown(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_refusals_and_clean_up(spark, tmp_path):
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    one = spark.createDataFrame([(1, "x"), (2, " "), (3, "y"), (4, "z"), (5, "w")], "n int, title string").repartition(3)
    assert published.publish(one, roots)
    assert not published.publish(one.withColumn("title", F.lit(" ")), roots)
    assert not published.publish(one.where("false"), roots)
    for root in roots:
        assert published.versions(root) == [1] and shown(published.read(spark, root)) == [(1, "x"), (3, "y"), (4, "z"), (5, "w")]
    files = glob.glob(f"{roots[0]}/data/*")
    assert len(files) == len({f for f in files})
    assert published.publish(one.withColumn("title", F.lit("same")), roots)
    assert shown(published.read(spark, roots[1])) == [(k, "same") for k in range(1, 6)]
    assert shown(published.read(spark, roots[1], 1)) == [(1, "x"), (3, "y"), (4, "z"), (5, "w")]
    assert published.forget(roots[0]) == len(files) and published.versions(roots[0]) == [2]
    assert shown(published.read(spark, roots[0])) == [(k, "same") for k in range(1, 6)]
    assert published.versions(roots[1]) == [1, 2]


def test_a_failing_task_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "a")
    rows = spark.range(100).select("id", F.lit("t").alias("title"))
    assert published.publish(rows, [root])
    broken = rows.repartition(4).withColumn("title", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, [root])
    assert published.versions(root) == [1] and shown(published.read(spark, root)) == [(k, "t") for k in range(100)]


def test_the_frame_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(50).select("id", F.lit("t").alias("title")).mapInArrow(count, "id long, title string")
    assert published.publish(rows, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert seen.value == 50
