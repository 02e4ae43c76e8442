"""Entity names read off a capture's own row are those of the entity graph."""
from pyspark.sql import functions as F

from glasstrail.registry.core import Inputs


def test_names_in_row_equal_the_graph(spark):
    from glasstrail.registry.graph import edges
    from glasstrail.registry.rules import labels_of
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    i = Inputs(spark, "/root/testdata/sf0.001")
    graph = edges(i).groupBy("capture_id").agg(F.array_sort(F.collect_set("display")).alias("labels"))
    found = labels_of(i.cap)
    assert {tuple(map(str, r)) for r in found.collect() if r["labels"]} == {tuple(map(str, r)) for r in graph.collect()}
    plan = labels_of(i.cap)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
