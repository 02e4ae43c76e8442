"""Lists that used to end at a fixed number."""
from datetime import date

from pyspark.sql import functions as F

from glasstrail.functions import extract as x
from glasstrail.operators import rules, semantic
from glasstrail.operators.querylog import annotate


def test_every_email_and_address(spark):
    mails = [f"user{n}@example.org" for n in range(40)]
    streets = [f"{n} Garden Road" for n in range(11, 31)]
    row = spark.createDataFrame([(" ; ".join(mails), ", ".join(streets))], "a string, b string").select(x.emails("a").alias("m"), x.addresses("b").alias("s")).first()
    assert row["m"] == mails and row["s"] == streets


def test_every_term_and_phrase(spark):
    words = [f"{a}{b}" for a in "abcdefg" for b in ("lorem", "ipsum")]
    text = " the ".join(" ".join(words[k:k + 2]) for k in range(0, 14, 2))
    row = annotate(spark.createDataFrame([(1, text)], "query_id int, text string"), date(2026, 9, 30)).first()
    assert row["terms"] == words and row["phrases"] == [" ".join(words[k:k + 2]) for k in range(0, 14, 2)]


def test_every_semantic_hit_and_term(spark):
    caps = spark.createDataFrame([(n, "", "orange kettle") for n in range(90)], "capture_id int, filename string, ocr_text string")
    asked = spark.createDataFrame([(1, "orange kettle"), (2, " ".join(f"word{n}" for n in range(30)) + " orange kettle")], "query_id int, text string")
    assert semantic.search(asked, caps, semantic.concept_table(spark)).filter("query_id = 1").count() == 90
    late = semantic.prefilter(asked.filter("query_id = 2"), caps, spark.createDataFrame([], "query_id int, word string, rank int"))
    assert late.count() == 90


def test_time_rules_meet_every_capture(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rules, "match", lambda contexts, *_: seen.append(contexts.count()) or contexts)
    rules.time_based(spark.range(120).select(F.col("id").alias("capture_id"), F.col("id").alias("date_added")), None)
    assert seen == [120]
