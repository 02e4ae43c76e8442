"""The stored, pruned and incremental library against the search that extracts everything anew."""
import pytest
from pyspark.sql import functions as F

from glasstrail.plans import search as plan
from glasstrail.plans.store import Store
from glasstrail.registry.core import Inputs
from glasstrail.registry.fulltext import QUERIES as SEARCHES, documents

ROOT = "/root/testdata/sf0.001"
COLUMNS = ["query_id", "capture_id", "rung", "score"]


def rows(frame, *columns):
    return sorted(map(tuple, frame.select(*(columns or COLUMNS)).collect()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("library")))
    store.create(Inputs(spark, ROOT).cap)
    return store


def test_same_rows_and_ranks(spark, stored):
    queries = spark.createDataFrame(SEARCHES, plan.QUERY_DDL)
    fresh = plan.ladder(plan.documents(Inputs(spark, ROOT).cap), queries)
    assert rows(stored.search(queries)) == rows(fresh)
    ranks = [*COLUMNS, "rank"]
    assert rows(stored.search(queries, 5), *ranks) == rows(plan.ranked(fresh, 5), *ranks)
    one = plan.ranked(plan.ladder(plan.documents(Inputs(spark, ROOT).cap), queries.filter("query_id = 5")))
    assert rows(stored.search(queries.filter("query_id = 5")), *ranks) == rows(one, *ranks)
    texts = stored.texts(stored.search(queries.filter("query_id = 2"), 3)).collect()
    assert len(texts) == 3 and all("pixel" in r["ocr_text"].lower() for r in texts)


def test_a_search_reads_the_parts_of_its_tokens(spark, stored):
    queries = spark.createDataFrame([plan.make_query(1, "usb cable", ["usb", "cable"])], plan.QUERY_DDL)
    needles = stored.needles(queries, stored.versions()).cache()
    files = lambda frame: frame.select(F.input_file_name()).distinct().count()
    read, whole = files(stored.postings(needles, stored.versions())), files(stored.read("postings"))
    tokens = needles.select("token").distinct().count()
    assert read <= tokens < whole
    assert "PartitionFilters" in stored.postings(needles, stored.versions())._jdf.queryExecution().toString()


def change(i, ids, text, seq, deleted=False):
    """Changes of some captures: another text, or the stored one if None."""
    rows = i.cap.filter(ids)
    return (rows if text is None else rows.withColumn("ocr_text", text)).withColumns({"seq": F.lit(seq).cast("bigint"), "deleted": F.lit(deleted)})


def test_batches_of_changes_answer_like_a_fresh_library(spark, tmp_path):
    i = Inputs(spark, ROOT)
    queries = spark.createDataFrame([q for q in SEARCHES if q[0] not in (18,)], plan.QUERY_DDL)
    store = Store(spark, str(tmp_path))
    store.create(i.cap.filter("capture_id % 4 <> 3").withColumn("ocr_text", F.when(F.col("capture_id") % 3 == 0, F.lit("draft pixel 9a amazon.in ₹6,500")).otherwise(F.col("ocr_text"))))
    gone = "capture_id % 10 = 7"
    batches = {1: change(i, "capture_id % 3 = 0", F.lit("second draft headphones github"), 1), 2: change(i, "capture_id % 3 = 0", None, 4).unionByName(change(i, "capture_id % 3 = 0", F.lit("late"), 2)),
               3: change(i, "capture_id % 4 = 3", None, 3).unionByName(change(i, gone, None, 9, True))}
    expected = rows(plan.ladder(plan.documents(i.cap.filter(f"NOT ({gone})")), queries))
    for v in (2, 1, 3):  # the late batch changes nothing
        store.apply(batches[v], v)
    assert rows(store.search(queries)) == expected
    store.compact(4)
    assert store.versions() == [4] and rows(store.search(queries)) == expected


def test_a_batch_that_died_is_invisible(spark, tmp_path):
    i = Inputs(spark, ROOT)
    store = Store(spark, str(tmp_path))
    store.create(i.cap.limit(50))
    queries = spark.createDataFrame([plan.make_query(1, "orphan", ["orphan"])], plan.QUERY_DDL)
    half = plan.documents(change(i, "capture_id < 40", F.lit("orphan word"), 1).drop("seq", "deleted")).withColumn("seq", F.lit(1).cast("bigint"))
    store._write(half, "docs", 1)
    assert store.search(queries).count() == 0
    store.apply(change(i, "capture_id < 40", F.lit("orphan word"), 1), 1)
    assert store.search(queries).count() == i.cap.filter("capture_id < 40 AND status <> 'FAILED'").count()
