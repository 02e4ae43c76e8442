"""Searches never send the index, captures or vectors through the driver, whatever the planner takes their size for."""
import pytest
from pyspark.sql import functions as F

from glasstrail.operators import fulltext, semantic
from glasstrail.registry.core import Inputs
from glasstrail.registry.fulltext import query_frame
from glasstrail.plans.search import query_terms

ROOT = "/root/testdata/sf0.001"


def plans(spark):
    i = Inputs(spark, ROOT)
    index, q = fulltext.token_index(i.cap), query_frame(i)
    terms, phrases = query_terms(q), q.select("query_id", F.explode("phrases").alias("phrase"))
    questions = q.select("query_id", F.col("raw").alias("text"))
    return {"any": lambda: fulltext.match_any(index, terms), "all": lambda: fulltext.match_all(index, terms), "phrases": lambda: fulltext.match_phrases(index, phrases),
            "order": lambda: fulltext.candidate_order(fulltext.match_any(index, terms), i.cap, q), "vectors": lambda: semantic.search(questions, i.cap, semantic.concept_table(spark))}


@pytest.mark.parametrize("name", ["any", "all", "phrases", "order", "vectors"])
@pytest.mark.parametrize("few", [True, False])
def test_large_side_is_not_broadcast(spark, monkeypatch, name, few):
    if not few:
        monkeypatch.setattr(fulltext, "FEW", 0)
    text = plans(spark)[name]()._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in text
    assert few or name == "vectors" or "SortMergeJoin" in text


def test_many_needles_find_the_same(spark, monkeypatch):
    made = plans(spark)
    few = {n: {tuple(r) for r in made[n]().collect()} for n in ("any", "all", "phrases")}
    monkeypatch.setattr(fulltext, "FEW", 0)
    assert few == {n: {tuple(r) for r in made[n]().collect()} for n in few}
