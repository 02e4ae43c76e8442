"""Counted features: rows of one key add up, and only texts are shuffled."""
from collections import Counter

from pyspark.sql import functions as F

from glasstrail.functions import vectors as vec
from glasstrail.operators import semantic as op


def test_counts_equal_grouping(spark):
    rows = [(1, "red red fox"), (2, ""), (3, None), (1, "fox den"), (None, "red fox"), (None, "den"), (4, "ab " * 5000), (5, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = op.feature_counts(docs, "doc_id", F.col("text"))
    plain = docs.select("doc_id", F.explode(vec.features(F.col("text"))).alias("feature")).collect()
    assert {(r.doc_id, r.feature): r.n for r in out.collect()} == Counter((r.doc_id, r.feature) for r in plain)
    assert out.count() == len({(r.doc_id, r.feature) for r in plain})
    assert op.feature_counts(docs.limit(0), "doc_id", F.col("text")).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "explode" not in plan
