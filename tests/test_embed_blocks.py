"""Embeddings: blocks of whole texts equal a plain loop over each text's features, however texts are put together."""
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from glasstrail.functions import ngrams, vectors as vec
from glasstrail.operators import semantic as op


def plain(features, dimension):
    sums = Counter()
    for feature, n in Counter(features or ()).items():
        h = 2166136261
        for c in feature:
            h = (h ^ ord(c)) * 16777619 & 4294967295
        sums[h % dimension] += 1 + math.log(n)
    norm = math.sqrt(sum(w * w for w in sums.values()))
    return {d: w / norm for d, w in sums.items()}


def texts():
    rnd = random.Random(7)
    odd = ["", None, " \t\n", "a", "ab", "the", "the other there the", "a b c", "x1 x1 x1", "İstanbul STRASSE ß ǅ", "日本語 テキスト 日本語 𝒳𝒴𝒵 𝒳𝒴", "non breaking space",
           "tab\tnew\nline\x0bfeed\fand\rback", "co-op it's ₹1,250 (50%)", "^the$ he$ ^th", "été ٥٦ ½ x²", "q" * 300 + " " + "q" * 299, "ab " * 4000, "w" * 70000]
    words = ["".join(rnd.choices("abcdeéж", k=rnd.randint(1, 9))) for _ in range(400)]
    longer = ["z" + str(k) * 40 for k in range(90)]  # more long words than are hashed one by one
    return odd + [" ".join(rnd.choices(words, k=rnd.randint(1, 200))) for _ in range(60)] + [" ".join(longer), " ".join(rnd.choices(longer, k=300))]


def embedded(docs, dimension):
    out = op.embed(docs, "doc_id", F.col("text"), dimension)
    found = {}
    for r in out.collect():
        assert found.setdefault(r.doc_id, {}).setdefault(r.dim, r.w) is r.w  # once per dimension
    return out, found


def test_equal_to_a_plain_loop(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(2)
    wanted = {r.doc_id: r.features for r in docs.select("doc_id", vec.features(F.col("text")).alias("features")).collect()}
    for dimension in (512, 77):
        out, found = embedded(docs, dimension)
        for k, features in wanted.items():
            want = plain(features, dimension)
            got = found.get(k, {})
            assert got.keys() == want.keys() and all(abs(got[d] - w) < 1e-12 for d, w in want.items()), k
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Repartition" in plan  # cleaned texts go to Python, not arrays of features


def test_blocks_do_not_matter(spark, monkeypatch):
    import pyarrow as pa
    cleaned = [r.t for r in spark.createDataFrame([(t,) for t in texts()], "text string").select(vec.cleaned(F.col("text")).alias("t")).collect()]

    def run(array):
        return {(int(k), int(d)): float(w) for at, dim, ws in ngrams.sparse_vectors(array, 512) for k, d, w in zip(at, dim, ws)}

    whole = run(pa.array(cleaned))
    monkeypatch.setattr(ngrams, "CELLS", 3 * 512)
    monkeypatch.setattr(ngrams, "BYTES", 500)
    assert run(pa.array(cleaned)) == whole
    assert run(pa.array([None, "zz", *cleaned]).slice(2)) == whole
    assert run(pa.array([], pa.string())) == {}


def test_keys_of_any_kind(spark):
    docs = spark.createDataFrame([("a", "red fox"), (None, "red fox"), ("c", None)], "text string, body string")
    rows = op.embed(docs, "text", F.col("body")).collect()
    assert {r.text for r in rows} == {"a", None} and len(rows) == 2 * len({r.dim for r in rows})
    assert op.embed(docs.limit(0), "text", F.col("body")).count() == 0
