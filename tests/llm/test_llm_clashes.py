"""Extra columns named like those that the operators use inside."""
from pyspark.sql import functions as F

from glasstrail.llm import common, licenses, mixing, quality, simhash

TEXTS = ["a b c d e f g", "a b c d e f g", "other words here now", None, ""]
NAMES = ["host", "node", "root", "bucket", "place", "q_source", "pick_hash", "__text", "n", "own_0", "further_0", "host_rate", "kept", "digest", "id_key", "again"]


def frame(spark):
    rows = [(i, t, f"s{i % 2}", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


def kept(rows, *replaced):
    return all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES if n not in replaced) and len(rows) == len(TEXTS)


def test_per_row_judge_and_components(spark):
    docs = frame(spark)
    assert kept(licenses.scanned(docs).collect())
    judged = quality.judge(quality.with_counts(docs), "source").collect()
    assert kept(judged, "host_rate", "kept") and all(isinstance(r["kept"], bool) for r in judged)
    linked = simhash.with_components(simhash.with_fingerprints(docs)).collect()
    assert kept(linked, "root") and {r["doc_id"]: r["component_id"] for r in linked}[1] == 0


def test_mixed_and_whole_stages(spark):
    docs = frame(spark)
    sized = mixing.with_sizes(docs.withColumn("pick_hash", mixing.pick_hash("doc_id", "text")))
    assert kept(mixing.mixed(sized).collect(), "pick_hash")
    for stage in (quality.kept_documents, simhash.deduplicated, mixing.mixed_documents):
        assert stage(docs).columns == docs.columns and stage(docs).count() >= 0
    assert common.free_name(docs, "host") == "host_"
