"""The chained search, evidence from it, and alerts by prefix and phrase."""
import pytest
from pyspark.sql import functions as F

from glasstrail.functions import vectors as vec
from glasstrail.operators import semantic
from glasstrail.plans import search as plan
from glasstrail.plans.fusion import search_all
from glasstrail.weights import HybridWeights

TEXTS = [(1, "Pixel 9a handset ₹39,999 on https://amazon.in", 100, "a"), (2, "Pixel 9a handset ₹39,999 on https://amazon.in", 200, "a"), (3, "Pixel case", 300, "c"),
         (4, "handset pixe tablet", 400, "d"), (5, "boarding pass to delhi", 500, "e"), (6, "flight flights fligh booking", 600, "f")]
QUERIES = [plan.make_query(1, "pixel handset", ["pixel"]), plan.make_query(2, "pixel", ["pixel"], sort="NEWEST"), plan.make_query(3, "flightz booking", ["flightz"]),
           plan.make_query(4, "flightz booking", ["flightz"], hosts=["nowhere.example"]), plan.make_query(5, "pixel", ["pixel"], prices=[plan.exact(39999.0)])]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"{i}.png", t, s, "DONE", h, 100, 100) for i, t, s, h in TEXTS]
    caps = spark.createDataFrame(rows, "capture_id long, filename string, ocr_text string, date_added long, status string, content_hash string, width int, height int")
    labels = spark.createDataFrame([(1, "Pixel 9a"), (2, "Pixel 9a"), (1, "₹39,999")], "capture_id long, label string")
    visuals = spark.createDataFrame([(i, i) for i, *_ in TEXTS], "capture_id long, dhash long")
    probes = spark.createDataFrame([(2, 3)], "query_id long, visual_id long")
    queries = spark.createDataFrame(QUERIES, plan.QUERY_DDL)
    out = search_all(plan.documents(caps), queries, labels, visuals, probes, semantic.concept_table(spark)).collect()
    body = vec.embeddable_text(F.col("ocr_text"), F.col("filename"))
    docs, asked = {}, {}
    for r in semantic.embed(caps, "capture_id", body).collect():
        docs.setdefault(r["capture_id"], {})[r["dim"]] = r["w"]
    for r in semantic.embed(queries.selectExpr("query_id", "raw AS text"), "query_id", F.col("text")).collect():
        asked.setdefault(r["query_id"], {})[r["dim"]] = r["w"]
    cosine = lambda a, b: sum(w * docs[b].get(k, 0.0) for k, w in asked[a].items())
    return {(r["query_id"], r["capture_id"]): r for r in out}, cosine


def test_similarity_is_real_and_counts(found):
    rows, cosine = found
    w = HybridWeights()
    assert any(r["similarity"] > 0 for r in rows.values())
    for (q, c), r in rows.items():
        if q == 1:
            assert r["similarity"] == pytest.approx(cosine(q, c) if cosine(q, c) >= 0.25 else 0.0)
            want = 100 * (w.lexical * min(1, r["score"] / 256) + w.semantic * r["similarity"] + w.entity * r["entity"])
            assert r["hybrid"] == pytest.approx(want, abs=1e-6)


def test_labels_come_from_the_graph(found):
    rows, _ = found
    assert rows[1, 1]["entity"] == 1.0 and rows[1, 3]["entity"] == 0.0
    assert rows[5, 1]["entity"] == 1.0


def test_vectors_add_rows_and_answer_alone(found):
    rows, cosine = found
    assert cosine(1, 4) >= 0.25 and rows[1, 4]["rung"] == "SEMANTIC" and rows[1, 4]["score"] == 0
    assert rows[3, 6]["rung"] == "SEMANTIC" and rows[3, 6]["similarity"] == pytest.approx(cosine(3, 6))
    assert not [k for k in rows if k[0] == 4]


def test_copies_fold_and_order_holds(found):
    rows, _ = found
    assert rows[1, 1]["representative_id"] == rows[1, 2]["representative_id"] == 2 and rows[1, 1]["rank"] == rows[1, 2]["rank"]
    for q in (1, 2):
        heads = sorted((r["rank"], c) for (k, c), r in rows.items() if k == q and r["representative_id"] == c)
        assert [n for n, _ in heads] == list(range(1, len(heads) + 1))
        want = [-dict((i, s) for i, _, s, _ in TEXTS)[c] if q == 2 else -rows[q, c]["hybrid"] for _, c in heads]
        assert want == sorted(want)
    assert (2, 3) not in rows and (1, 3) in rows  # the image asked with steps aside


def test_evidence_keeps_every_engine_row(spark):
    from glasstrail.registry import evidence as e
    from glasstrail.registry.core import Inputs
    i = Inputs(spark, "/root/testdata/sf0.001")
    held = i.cap.filter("status <> 'FAILED'").filter(F.lower("ocr_text").rlike(r"(?<![\p{L}\p{N}])pixel")).count()
    got = e._searched(i).filter("query_id = 2 AND engine_rank IS NOT NULL").count()
    assert got == held > 60


def test_alerts_by_prefix_and_phrase(spark, tmp_path):
    from glasstrail.streaming import jobs
    rows = [(1, "Pixels here"), (2, "boarding pass, delhi"), (3, "pass boarding"), (4, "pixel 9a")]
    spark.createDataFrame(rows, "capture_id long, ocr_text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("capture_id long, ocr_text string").parquet(str(tmp_path / "in"))
    asked = spark.createDataFrame([(1, ["pix"], []), (2, [], ["boarding pass"]), (3, ["pixel", "9"], [])], "query_id long, terms array<string>, phrases array<string>")
    assert sorted(map(tuple, jobs.live_search(stream, asked).select("query_id", "capture_id").collect())) == [(1, 1), (1, 4), (2, 2), (3, 4)]
