"""quality.kept: the rows that score enough, of which Python gets each text once and gives back none."""

from pyspark.sql import functions as F

from quillon.llm import quality


def test_kept_sends_texts_once(spark):
    rows = [(i, ("good words stand here. " if i % 2 else "$$ 00 ") * (1 + i % 9), "en" if i % 3 else None, "src", None if i % 5 == 0 else i, f"other {i}") for i in range(300)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "src", 0, "x"), (None, "no id", None, None, 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 300, 2)] + [(i, i % 2) for i in range(1, 300, 4)], "doc_id long, quality int")
    got = quality.kept(docs, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and got.columns == docs.columns
    want = quality.score(docs, quality.train(docs, labels), docs.columns, "_s").where(F.col("_s") >= quality.KEEP_FROM).drop("_s")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and 0 < want.count() < len(rows)
