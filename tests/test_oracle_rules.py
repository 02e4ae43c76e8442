"""SQL counterparts state the extraction's rules on values that the small tables don't hold."""
import shutil
from datetime import datetime

import duckdb
import pytest

from glasstrail.registry import QUERIES, oracle_texts

CODES = ["agg_signal_summary", "c_snapshot", "candidate_hydrate", "d_detail", "f_content_types", "f_filter_chip", "j_semi_exists", "x_all_facts", "x_codes"]
ASKS = ["thingh dealy of", "it is large", "which way", "an amount of it", "remembered cost", "before it appeared", "why", "plain words", ""]


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Orders whose codes are 666666, 888888 and their neighbours, some with copies of their hash; turns of free prose."""
    folder = tmp_path_factory.mktemp("made")
    con = duckdb.connect()
    day = datetime(1995, 3, 4, 5, 6)
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR)")
    con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?, ?, '1-URGENT')", [(k, 7 if k % 16 == 2 else k, "F", 1000.5 + k % 90, day) for k in [2, 18, 34, *range(566660, 566690), 788882, 788890, 122222 * 3]])
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, 9, 'user', ?)", [(10 * n, t) for n, t in enumerate(ASKS)])
    for name in ("orders", "conversations"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    shutil.copy("/root/testdata/sf0.001/embeddings.parquet", f"{folder}/embeddings.parquet")  # pixels
    return con, str(folder)


@pytest.mark.parametrize("key", [*CODES, "q_assistant_intent"])
def test_equal_on_rare_values(spark, made, key):
    con, folder = made
    frame = QUERIES[key](spark, folder)
    columns = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_texts()[key]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
