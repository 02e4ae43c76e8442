"""Operators over groups: near duplicates, mixing, URL templates, vectors and the pipeline."""
import collections

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from glasstrail.llm import mixing, queries, simhash, urls, vectors
from glasstrail.llm.components import components

ROOT = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_links_meet_every_pair_even_in_crowds(spark):
    rng = np.random.default_rng(2)
    center = int(rng.integers(1 << 62))
    values = {center ^ sum(1 << int(b) for b in rng.choice(64, size=k, replace=False)) for k in (0, 1, 1, 2, 2, 3) for _ in range(40)}
    values |= {int(x) for x in rng.integers(0, 1 << 63, size=200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowd in (1, 5, 1000):
        got = [tuple(r) for r in simhash.links(df, crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_rows_and_copies(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base.upper(), base + " x", "other " + base[500:], None, "", "a", "a b", "A  B", base, " \n"]
    rows = [(i if i != 7 else None, t, "c", 1) for i, t in enumerate(texts)] + [(0, base, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    prints = simhash.with_fingerprints(df.select("doc_id", "text"), keep=["doc_id"])
    got = collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.with_components(prints).collect())
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = union(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    assert got == collections.Counter((r[0], fps[i], least.get(root[i])) for i, r in enumerate(rows))
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert simhash.deduplicated(df.limit(0)).count() == 0


def test_simhash_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    root = union(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op9_simhash"](spark, ROOT).collect()}
    assert got == {d: (f"{fp:016x}", root[d]) for d, fp in fps.items()}


def brute_targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, total = budget - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return {s: fixed.get(s, rest * weight[s] / total if total else 0.0) for s in order}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def check_mix(rows):
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    for s, w in want.items():
        assert target[s] == pytest.approx(w) and abs(taken[s] - w) <= max(2, 0.002 * w), (s, taken[s], w)


def test_mix_query(spark):
    once, again = ([r.asDict() for r in queries.QUERIES["op8_mix"](spark, ROOT).orderBy("doc_id").collect()] for _ in range(2))
    assert once == again and len(once) == 200
    check_mix(once)


def test_mix_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 0 else i % 170, ["é", "b", "B", None, "big", "empty"][i % 6] if i % 3 else "big",
             None if i % 31 == 0 else "" if i % 6 == 5 and i % 3 else "w " * int(rng.integers(0, 30)), 5, 6) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size int, copies int")
    hashed = df.select("doc_id", "source", "text").withColumn("pick_hash", mixing.pick_hash("doc_id", "text"))
    mixed = mixing.mixed(mixing.with_sizes(hashed, keep=["doc_id", "source", "pick_hash"])).collect()
    assert len(mixed) == 400
    check_mix(mixed)
    docs = mixing.mixed_documents(df)
    assert docs.columns == df.columns and docs.count() == sum(r["copies"] for r in mixed)
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_knapsack_stays_in_its_bounds():
    rng = np.random.default_rng(5)
    for _ in range(100):
        counts = {int(s): int(rng.integers(1, 9)) for s in rng.integers(0, 200, size=rng.integers(1, 12))}
        budget = int(rng.integers(0, sum(s * c for s, c in counts.items()) + 5))
        taken = mixing.fit(counts, budget)
        assert all(0 <= taken[s] <= c for s, c in counts.items())
        left = budget - sum(s * n for s, n in taken.items())
        assert left >= 0 and (left <= max(counts) or taken == counts)
    assert sum(s * n for s, n in mixing.fit({3: 1000, 7: 500, 50: 20}, 4321).items()) == 4321


def test_url_rules_and_odd_urls(spark):
    given = {None: ("", "", None), "no scheme.org/x": ("", "", None), "http://Example.ORG/en/12?q#f": ("example.org", "/en/12", "example.org/en/1"),
             "http://a.example.org/es/": ("a.example.org", "/es/", "example.org/es/"), "x://org": ("org", "", None), "x://org/": ("org", "/", "org/"),
             "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/"), "http://b.com/de/1": ("b.com", "/de/1", "com/de/"), "http://b.com?x/fr/": ("b.com", "", None),
             "http://ÀB.com/fr/x": ("Àb.com", "/fr/x", "com/fr/"), "http://u.net/a/b/c/d/e": ("u.net", "/a/b/c/d/e", None), "://": ("", "", None)}
    rows = [(i, u, "h", "p", "v") for i, u in enumerate(given)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, verdict string")
    got = urls.judged(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == given[r["url"]]
        assert r["verdict"] == ("allow" if r["rule"] is None or r["rule"] in ("org/", "com/fr/") else "block") or r["rule"] is None
    assert urls.judged(df.limit(0)).count() == 0


def test_url_templates_spread_to_unlabelled_pages(spark):
    """Below one host, pages of a branch that rules block take the rest of that branch with them; others stay."""
    pages = [f"http://a.example.org/es/{i}/bad" for i in range(30)] + [f"http://a.com/de/{i}" for i in range(40)] + [f"http://a.com/en/{i}" for i in range(9)]
    pages += [f"http://b.com/fr/{i}" for i in range(40)] + [f"http://b.com/en/{i}" for i in range(9)]
    got = urls.judged(spark.createDataFrame(list(enumerate(pages)), "page_id bigint, url string")).collect()
    assert {r["verdict"] for r in got if r["host"] == "a.com" and r["rule"] is None} == {"block"}
    assert {r["verdict"] for r in got if r["host"] == "b.com"} == {"allow"}


def brute_vectors(rows, least=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float)) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    root, links = union(range(len(rows)), pairs), collections.Counter(x for p in pairs for x in p)
    ids = collections.defaultdict(list)
    for i, (v, _) in enumerate(rows):
        if v is not None:
            ids[root[i]].append(v)
    return [(v, links[i], min(ids[root[i]], default=None)) for i, (v, _) in enumerate(rows)]


def test_vectors_crowds_copies_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    center = rng.normal(size=32)
    rows = [(i, [float(x) for x in center + 0.05 * rng.normal(size=32)]) for i in range(120)] + [(200 + i, [float(x) for x in rng.normal(size=32)]) for i in range(150)]
    rows += [(500 + i, rows[3][1]) for i in range(30)] + [(600, [2 * x for x in rows[130][1]]), (None, rows[140][1]), (3, rows[140][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 32), (703, [float("nan")] * 32), (704, [None] + [1.0] * 31), (705, [float("inf")] * 32), (706, [1.0] * 5), (707, [1.0] * 5), (None, None)]
    df = spark.createDataFrame([(a, b, "n", 0) for a, b in rows], "vec_id bigint, embedding array<double>, node string, weight int")
    want = collections.Counter(brute_vectors(rows))
    for block in (16, 512):
        got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.deduplicated(df, block=block).collect())
        assert got == want
    assert vectors.deduplicated(df.limit(0)).count() == 0


def test_vector_recall_at_the_limit(spark):
    """Random pairs with a cosine just above 0.9: at least nine in ten are found, and nothing below is linked."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.903 if i % 2 else 0.897
        rows += [(2 * i, a.tolist()), (2 * i + 1, (cosine * a + np.sqrt(1 - cosine ** 2) * b).tolist())]
    got = vectors.deduplicated(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    links = {r["vec_id"]: r["n_links"] for r in got}
    assert sum(links[2 * i] for i in range(0, 400, 2)) == 0
    assert sum(links[2 * i] for i in range(1, 400, 2)) >= 180


def test_code_grows_with_the_rows():
    """At every size unlike vectors seldom share a direction, and pairs at a cosine of 0.9 nearly always do."""
    rng = np.random.default_rng(3)
    for rows in (1_000, 100_000, 100_000_000):
        parts, codes, expected = shape = vectors.code_shape(rows)
        assert codes <= vectors.MOST_CODES and expected * rows <= codes ** parts
        code = vectors.code_of(64, shape)
        a, b = rng.normal(size=(2, 300, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
        found = list(zip(code.directions(a), code.directions(b)))
        assert all(expected <= len(x) == len(set(x.tolist())) for x, _ in found)
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in found]) >= 0.97


def test_vectors_of_the_given_table(spark):
    """The query's result on the given table equals all pairs in numpy, but for pairs that the filters may miss."""
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {r[0]: r[1] for r in brute_vectors(rows)}
    got = {r["vec_id"]: r["n_links"] for r in queries.op5_vector_dedup(spark, ROOT).collect()}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_pipeline(spark):
    """Stages keep the columns of documents, their decisions last, and run() gives the last stage's rows."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash", "secrets", "mix", "bpe"]
    (_, good), (_, unique), (_, hidden), (_, mix), _ = corpus_pipeline.STAGES
    for stage in (good, unique, hidden, mix):
        assert stage(spark, docs, ROOT).columns == docs.columns
        assert stage(spark, docs.limit(0), ROOT).count() == 0
    kept = {r["doc_id"] for r in queries.QUERIES["op7_quality_rules"](spark, ROOT).filter("kept").collect()}
    assert {r["doc_id"] for r in good(spark, docs, ROOT).collect()} == kept
    rows = corpus_pipeline.run(spark, ROOT).collect()
    assert rows and {r["doc_id"] for r in rows} <= kept and all(r["ids_sha256"] for r in rows)
    again = corpus_pipeline.run(spark, ROOT)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
