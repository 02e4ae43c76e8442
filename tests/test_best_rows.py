"""The best rows equal the ranked ladder's, and only the best carry texts and reasons."""
from glasstrail.functions.scoring import lexical_sql
from glasstrail.plans import search as plan
from glasstrail.registry.core import Inputs
from glasstrail.registry.fulltext import documents, query_frame


def test_best_equals_ranked_ladder(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    i = Inputs(spark, "/root/testdata/sf0.001")
    lib, queries = plan.library(documents(i)), query_frame(i).filter("query_id IN (2, 5, 7, 18, 25)")
    columns = ["query_id", "capture_id", "rung", "score", "reasons", "rank", "q.raw", "d.ocr_text"]
    want = plan.ranked(plan.ladder(lib, queries), 20).select(*columns).collect()
    got = plan.best(lib, queries, 20).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 60


def test_score_alone_works_no_reasons_out():
    assert "␟" in lexical_sql(0) and "␟" not in lexical_sql(0, with_reasons=False)


def test_candidates_are_dealt_by_capture_in_parts_that_grow(spark, monkeypatch):
    """One shuffle of what the index meets, in more parts for more documents, and never by query."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    i = Inputs(spark, "/root/testdata/sf0.001")
    lib = plan.library(documents(i))
    monkeypatch.setattr(plan, "TASK_DOCUMENTS", 50)
    frame = plan.candidates(lib, query_frame(i))
    text = frame._jdf.queryExecution().executedPlan().toString()
    parts = -(-lib.docs.count() // 50)
    assert parts > 8 and [line for line in text.split("\n") if "Exchange hash" in line and f", {parts})" in line]
    assert text.count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in text
