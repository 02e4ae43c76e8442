"""The fit of the toxicity net reads every labelled row that isn't held out, in shards."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasstrail.llm import toxicity


def _tables(spark, n=400):
    docs = spark.createDataFrame([(i, ["en", "fr"][i % 2], f"word{i % 7} word{i % 11} " + ("vile " if i % 4 == 0 else "nice ") * 3) for i in range(n)], "doc_id long, lang string, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_every_labelled_row_is_read_once(spark, monkeypatch, limit):
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", limit)
    docs, labels = _tables(spark)
    read = {"first": set(), "second": set(), "all": 0}
    plain = toxicity._start_values, toxicity._round, toxicity._raws

    def start(first, share):
        read["first"] |= {r["doc_id"] for r in first.collect()}
        return plain[0](first, share)

    def one_round(net, second, shards, epochs, seed):
        assert shards > 5
        read["second"] |= {r["doc_id"] for r in second.collect()}
        return plain[1](net, second, shards, epochs, seed)

    def raws(texts, net):
        out = plain[2](texts, net)
        read["all"] = out.count()
        return out

    for name, f in zip(("_start_values", "_round", "_raws"), (start, one_round, raws)):
        monkeypatch.setattr(toxicity, name, f)
    net, thresholds = toxicity.trained(docs, labels, rows=20, epochs=2, least_steps=20)
    usable = {i for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    part = {r["doc_id"]: r["part"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(5)).alias("part")).collect()}
    assert read["first"] == {i for i in usable if part[i] < 2} and read["second"] == {i for i in usable if part[i] in (2, 3)}
    assert read["all"] == len(usable) and set(thresholds) == {"en", "fr"}
    rows = toxicity.scored(docs, net, thresholds).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows]) > 0.97


def test_start_values_count_all_rows(spark):
    docs, labels = _tables(spark, 90)
    rows = docs.join(labels, "doc_id").withColumnRenamed("toxic", "label")
    both, toxic = np.zeros(3 * toxicity.BUCKETS), np.zeros(3 * toxicity.BUCKETS)
    for r in rows.collect():
        ids = toxicity.word_ids(r["text"].encode())
        for slot in {j * toxicity.BUCKETS + int(b) for j in range(3) for b in ids[:, j]}:
            both[slot] += 1
            toxic[slot] += r["label"]
    assert np.array_equal(toxicity._start_values(rows.repartition(5), 0.25).ravel(), toxicity._log_odds(toxic, both, 0.25))
