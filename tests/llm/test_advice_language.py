"""Cases of the second review."""

from pyspark.sql import functions as F

from eventloom.llm import langid, registry


# 3 language identification

def test_language_without_labels(spark, tmp_path):
    rows = [(1, "some text", None), (2, None, None), (None, "12", None), (7, "more of it", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert net.languages == []
    again = langid.predict(docs.withColumn("score", F.lit("own")), net)
    assert again.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and dict(again.dtypes)["score"] == "double"
    for name, table in (("unlabelled", docs), ("none", docs.where("false"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = registry.op3_language_id(spark, f"{tmp_path}/{name}").collect()
        assert len(got) == table.count() and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got)
