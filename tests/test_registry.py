"""Contract of the registered queries, and a sample of them against SQL at the smallest scale."""
import duckdb
import pytest
from check import TABLES, canon

import __spark_entry__ as entry_module
from glasstrail.plans import search as plan
from glasstrail.registry.core import Inputs
from glasstrail.registry.fulltext import QUERIES as SEARCHES, documents as searched

ROOT = "/root/testdata/sf0.001"
SAMPLE = ["capture_predicate", "discover_reconcile", "agg_index_stats", "f_content_types", "fts_phrase", "p_classify", "x_dates", "w_canonical", "q_describe", "o_suggest",
          "j_time_proximity", "e_grounding", "sem_cosine", "vis_palette", "st_status_counts", "st_sessions_batch", "relaxation_ladder"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


def test_every_counterpart_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert len(entry_module.queries()) >= 241


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and all("Pixel 9a" in r["ocr_text"] for r in rows)


@pytest.mark.parametrize("key", SAMPLE)
def test_against_sql(spark, con, key):
    df = entry_module.queries()[key](spark, ROOT)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry_module.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_stored_library_answers_like_a_fresh_one(spark, tmp_path):
    """Search over stored facts, tokens and keys returns the rows of the search that extracts them."""
    inputs = Inputs(spark, ROOT)
    docs, queries = searched(inputs), spark.createDataFrame(SEARCHES, plan.QUERY_DDL)
    columns = ["query_id", "capture_id", "rung", "score"]
    plan.save_library(inputs.cap, str(tmp_path))
    stored = plan.open_library(spark, str(tmp_path))
    plain = plan.documents(inputs.cap)
    assert sorted(map(tuple, plan.ladder(stored, queries).select(*columns).collect())) == sorted(map(tuple, plan.ladder(plain, queries).select(*columns).collect()))
    found = {r["query_id"] for r in plan.ladder(docs, queries).select("query_id").distinct().collect()}
    assert {19, 20, 21, 22, 23, 24} <= found
