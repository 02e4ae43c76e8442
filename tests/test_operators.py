import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from glasstrail.functions.money import format_money
from glasstrail.functions.snippets import snippet_sql
from glasstrail.operators import components, evidence, fulltext, graph, ordered, ranking, rules, visual, windows
from glasstrail.operators import querylog as ql

TODAY = date(2026, 9, 30)


def test_previous_and_running_sum_cross_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 4), k) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, t long, id long")
    prev = {r["id"]: r["prev"]["id"] if r["prev"] else None for r in ordered.with_previous(df, ["g"], "t", "id", ["id"], chunks=7).collect()}
    total = {r["id"]: r["s"] for r in ordered.with_running_sum(df, ["g"], "t", "id", F.lit(1), "s", chunks=7).collect()}
    for g in (0, 1):
        line = sorted((t, k) for gg, t, k in rows if gg == g)
        for n, (_, k) in enumerate(line):
            assert prev[k] == (line[n - 1][1] if n else None)
            assert total[k] == n + 1


def test_carry_forward_crosses_chunks(spark):
    rows = [(1, k, f"v{k}" if k in (1, 8) else None) for k in range(14)]
    out = {r["turn"]: r["c"] for r in ordered.carry_forward(spark.createDataFrame(rows, "g int, turn long, v string"), ["g"], "turn", "v", "c", chunks=5).collect()}
    assert [out[k] for k in range(14)] == [None] + ["v1"] * 7 + ["v8"] * 6


def test_chunks_split_one_group_whatever_the_ids(spark):
    """One group holds all rows and ids are hashes: the carry table has a row per chunk, not per row."""
    df = spark.range(1500).select(F.lit(1).alias("g"), (F.col("id") % 9).alias("t"), F.xxhash64("id").alias("id"))
    rows = ordered.chunked(df, ["g"], ["t", "id"], 12)
    assert 6 < rows.select("g", "_chunk").distinct().count() <= 12
    assert max(r["count"] for r in rows.groupBy("_chunk").count().collect()) < 500


def test_near_in_time_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.randint(0, 20000)) for _ in range(300)]
    out = ordered.near_in_time(spark.createDataFrame(rows, "g int, t long"), ["g"], "t", 1800).collect()
    for r in out:
        near = [t for g, t in rows if g == r["g"] and abs(t - r["t"]) <= 1800]
        assert (r["n_near"], r["first_near"], r["last_near"]) == (len(near), min(near), max(near))


@pytest.mark.parametrize("bands", [9, 5, 3])
def test_hamming_pairs_miss_nothing(spark, bands):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    hashes = list({b ^ sum(1 << rng.randrange(63) for _ in range(rng.randint(0, 6))) for b in base for _ in range(12)})
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes] + [-1, -2, 0]
    found = {(r["a"], r["b"]) for r in visual.hamming_pairs(spark.createDataFrame([(h,) for h in signed], "dhash long"), 8, bands).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 8}
    assert found == want


def test_components_follow_long_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101)]
    out = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(41)) and out[101] == 100


def test_collapse_equals_the_ordered_loop(spark):
    rng = random.Random(4)
    rows = [(1, k, rng.randint(0, 2), rng.randint(0, 2), rng.choice([None, None, "h1", "h2", "h3"]), rng.choice(["aa", "bb", " "])) for k in range(80)]
    df = spark.createDataFrame(rows, "query_id int, capture_id long, score int, date_added long, content_hash string, ocr_text string")
    got = {r["capture_id"]: r["representative_id"] for r in ranking.collapse_duplicates(df).collect()}
    hashes, texts, want = {}, {}, {}
    for _, k, _s, _d, h, t in sorted(rows, key=lambda r: (-r[2], -r[3], r[1])):
        rep = hashes.get(h) if h is not None else texts.get(t) if t.strip() else None
        if rep is None:
            rep = k
            if h is not None:
                hashes[h] = k
            if t.strip():
                texts[t] = k
        want[k] = rep
    assert got == want


def test_phrase_needs_neighbouring_words_in_one_field(spark):
    caps = spark.createDataFrame([(1, "a.png", "pixel 9a here"), (2, "a.png", "9a pixel"), (3, "pixel.9a", "x"), (4, "pixel", "9a")], "capture_id long, filename string, ocr_text string")
    hits = fulltext.match_phrases(fulltext.token_index(caps), spark.createDataFrame([(1, "pixel 9a")], "query_id long, phrase string"))
    assert {r["capture_id"] for r in hits.collect()} == {1, 3}


def test_prefix_terms(spark):
    caps = spark.createDataFrame([(1, "a", "pixelated photo"), (2, "a", "pixel phone"), (3, "a", "phone")], "capture_id long, filename string, ocr_text string")
    terms = spark.createDataFrame([(1, "pixel"), (1, "pho")], "query_id long, term string")
    index = fulltext.token_index(caps)
    assert {r["capture_id"] for r in fulltext.match_all(index, terms).collect()} == {1, 2}
    assert fulltext.match_all(index, terms, prefix=False).count() == 0


def test_snippet_window_and_highlights(spark):
    text = "start " * 60 + "needle here " + "end " * 80
    row = spark.createDataFrame([(text, ["needle"])], "t string, n array<string>").select(F.expr(snippet_sql("t", "n")).alias("s")).first()["s"]
    lo, hi = map(int, row["highlights"][0].split("-"))
    assert row["text"][lo:hi + 1] == "needle" and row["text"].startswith("…") and row["text"].endswith("…")


@pytest.mark.parametrize("amount,want", [(1234567.0, "₹12,34,567"), (999.0, "₹999"), (1000.5, "₹1,000.50"), (100000.0, "₹1,00,000")])
def test_money(spark, amount, want):
    assert spark.range(1).select(format_money(F.lit("INR"), F.lit(amount)).alias("m")).first()["m"] == want


@pytest.mark.parametrize("raw", ["Pixel9a", "PIXEL 9A", "  pixel   9a "])
def test_product_names(spark, raw):
    assert spark.range(1).select(graph.product_name(F.lit(raw)).alias("p")).first()["p"] == "pixel 9a"


@pytest.mark.parametrize("host,want", [("smile.amazon.in", "amazon"), ("www.bbc.co.uk", "bbc"), ("amazon.in", "amazon")])
def test_company_names(spark, host, want):
    assert spark.range(1).select(graph.company_name(F.lit(host)).alias("c")).first()["c"] == want


def test_sequence_of_three(spark):
    words = "alpha beta gamma delta epsilon zeta"
    rows = [(1, 1000, words), (2, 1100, words), (3, 1200, words + " more"), (4, 1300, "nothing alike"), (5, 90000, words)]
    out = windows.sequences(spark.createDataFrame(rows, "capture_id long, date_added long, ocr_text string")).collect()
    assert [(r["first_id"], r["last_id"], r["size"]) for r in out] == [(1, 3, 3)]


def test_event_group_span(spark):
    rows = [("7QK2LP", 1, 0), ("7QK2LP", 2, 86400 * 2), ("FAR", 3, 0), ("FAR", 4, 86400 * 30)]
    out = windows.event_groups(spark.createDataFrame(rows, "code string, capture_id long, date_added long")).collect()
    assert [(r["code"], r["size"]) for r in out] == [("7QK2LP", 2)]


def test_rule_fires_once(spark):
    ctx = spark.createDataFrame([(42, 0, {"merchant": "Example Store"}, ["NEW_SCREENSHOT"])], "capture_id long, date_added long, ctx map<string,string>, triggers array<string>")
    table = spark.createDataFrame([(1, "r", True, "NEW_SCREENSHOT", "merchant|contains|example", "ARCHIVE", ""), (2, "s", True, "NEW_SCREENSHOT", "merchant|==|other", "ARCHIVE", "")], rules.RULE_DDL)
    first = rules.match(ctx, table)
    assert [r["rule_id"] for r in first.collect()] == [1]
    assert rules.match(ctx, table, first).count() == 0


def test_equal_evidence_keeps_engine_order(spark):
    rows = [(1, 10, 0, False, False, False), (1, 20, 1, True, False, False)]
    out = evidence.rank(spark.createDataFrame(rows, "query_id long, capture_id long, engine_rank int, entity_hit boolean, temporal_hit boolean, graph_hit boolean")).orderBy("rank").collect()
    assert [r["capture_id"] for r in out] == [10, 20] and out[0]["score"] == out[1]["score"] == 0.5


@pytest.mark.parametrize("text,terms,intent", [
    ("Pixel phones below ₹40,000", ["pixel", "phones"], "SEARCH"), ("Find the screenshot where I saw AirPods for ₹12,999", ["airpods"], "FIND"),
    ("Find the Amazon screenshot from last month", ["amazon"], "FIND"), ("show duplicate screenshots", [], "FILTER"), ("Pixel 9", ["pixel", "9"], "SEARCH"), (" ", [], "BROWSE"),
])
def test_query_annotation(spark, text, terms, intent):
    row = ql.annotate(spark.createDataFrame([(1, text)], "query_id long, text string"), TODAY).first()
    assert (row["terms"], row["intent"]) == (terms, intent)


def test_query_price_shapes(spark):
    rows = [(1, "around 40000"), (2, "Pixel phones below ₹40,000"), (3, "for ₹12,999"), (4, "order 40000")]
    out = {r["query_id"]: [(p["kind"], round(p["min"]), round(p["max"])) for p in r["prices"]] for r in ql.annotate(spark.createDataFrame(rows, "query_id long, text string"), TODAY).collect()}
    assert out == {1: [("RANGE", 38000, 42000)], 2: [("AT_MOST", 0, 40000)], 3: [("EXACT", 12999, 12999)], 4: []}
