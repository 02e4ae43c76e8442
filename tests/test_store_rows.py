"""A search of the stored library that needs rows and scores alone, and batches that are read once."""
import pytest
from pyspark.sql import functions as F

from glasstrail.plans import search as plan
from glasstrail.plans.store import Store
from glasstrail.registry.core import Inputs
from glasstrail.registry.fulltext import QUERIES as SEARCHES

ROOT = "/root/testdata/sf0.001"


def test_rows_without_ranks_are_the_ranked_ones(spark, tmp_path):
    i, queries = Inputs(spark, ROOT), spark.createDataFrame(SEARCHES, plan.QUERY_DDL)
    store = Store(spark, str(tmp_path))
    store.create(i.cap.filter("capture_id % 3 = 0"))
    late = i.cap.limit(40).withColumns({"seq": F.lit(1).cast("bigint"), "deleted": F.lit(False)})
    changes = i.cap.withColumns({"seq": F.lit(2).cast("bigint"), "deleted": F.col("capture_id") % 10 == 7})
    store.apply(late.withColumn("ocr_text", F.lit("late pixel")).unionByName(changes), 1)
    found = store.search(queries, ranks=False)
    assert "reasons" not in found.columns and "rank" not in found.columns
    columns = ["query_id", "capture_id", "seq", "rung", "score"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, store.search(queries).select(*columns).collect()))
    fresh = plan.ladder(plan.documents(i.cap.filter("capture_id % 10 <> 7")), queries)
    assert sorted(map(tuple, found.drop("seq", "date_added").select("query_id", "capture_id", "rung", "score").collect())) == sorted(map(tuple, fresh.select("query_id", "capture_id", "rung", "score").collect()))
    with pytest.raises(ValueError):
        store.search(queries, 5, ranks=False)
