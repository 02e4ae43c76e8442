"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glasstrail import registry  # noqa: E402
from glasstrail.plans import search as plan  # noqa: E402
from glasstrail.plans.store import Store  # noqa: E402
from glasstrail.registry.core import Inputs  # noqa: E402
from glasstrail.session import build_session  # noqa: E402

SHAPES = {
    "search_date_window": plan.make_query(1, "screenshots from 1998", window=(883612800, 915148800), label="1998"),
    "search_keyword": plan.make_query(2, "Pixel", ["pixel"]),
    "search_phrase": plan.make_query(3, "Pixel 9a", ["pixel", "9a"], ["pixel 9a"]),
    "search_exact_price": plan.make_query(4, "₹6,500", prices=[plan.exact(6500.0)]),
    "search_price_bound": plan.make_query(5, "pixel below ₹40,000", ["pixel"], prices=[plan.at_most(40000.0)]),
    "search_phrase_price": plan.make_query(6, "Pixel 9a for ₹39,999", ["pixel", "9a"], ["pixel 9a"], [plan.exact(39999.0)]),
    "search_domain": plan.make_query(7, "screenshots from amazon.in", hosts=["amazon.in"]),
}
OPERATORS = ["agg_index_stats", "agg_timeline", "agg_top_words", "x_prices", "p_redact", "p_classify", "w_canonical", "fts_phrase",
             "j_time_proximity", "g_normalize", "o_suggest", "c_followup_carry", "e_grounding", "w_sequences", "sem_embed"]


def batch_of(n: int) -> list[tuple]:
    """The seven shapes, repeated with other prices."""
    shapes = list(SHAPES.values())
    out = []
    for k in range(n):
        q = list(shapes[k % 7])
        q[0] = k + 1
        q[4] = [(kind, cur, lo + k if kind == "EXACT" else lo, hi + k) for kind, cur, lo, hi in q[4]]
        out.append(tuple(q))
    return out


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    inputs = Inputs(spark, root)
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        t = time.time()
        run()
        times[name] = round(time.time() - t, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    folder = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    stored = Store(spark, folder)
    timed("library_build", lambda: stored.create(inputs.cap))

    def search(*wanted) -> None:
        """The whole ladder over the stored library: facts, tokens and keys are read, not extracted."""
        frame = spark.createDataFrame(list(wanted), plan.QUERY_DDL)
        stored.search(frame, 50).select("query_id", "capture_id", "rung", "score", "rank").collect()

    search(SHAPES["search_keyword"])  # start the JVM and its code cache
    for name, q in SHAPES.items():
        timed(name, lambda q=q: search(q))

    timed("search_batch_100", lambda: search(*batch_of(100)))
    for key in OPERATORS:
        timed(key, lambda key=key: registry.QUERIES[key](spark, root).write.format("noop").mode("overwrite").save())
    sf = root.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
