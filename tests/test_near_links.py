"""Links between near hashes, per hash, against all pairs."""
import collections
import itertools
import random

import numpy as np
import pytest

from glasstrail.operators import visual


def _hashes(rng):
    out = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            h = centre
            for _ in range(rng.choice([0, 1, 2, 4, 6])):
                h ^= 1 << rng.randrange(64)
            out.add(h)
    return out | {0, (1 << 64) - 1, (1 << 63) | 255, 255}


@pytest.mark.parametrize("equal,stripe,few,crowded", [(2, 20_000, 512, 100_000), (2, 7, 2, 100_000), (3, 7, 3, 0)])
def test_links_equal_all_pairs(spark, monkeypatch, equal, stripe, few, crowded):
    monkeypatch.setattr(visual, "FEW", few)
    monkeypatch.setattr(visual, "CROWDED", crowded)
    codes = _hashes(random.Random(11))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    expected, edges = {}, {h: h for h in codes}
    for h in codes:
        gaps = [g for o in codes if o != h and (g := (o ^ h).bit_count()) <= 8]
        if gaps:
            expected[signed(h)] = (len(gaps), min(gaps), max(gaps))
    frame = spark.createDataFrame([(signed(h),) for h in codes for _ in range(1 + h % 3)] + [(None,)], "dhash long")
    links = visual.near_links(frame, 8, equal, stripe)
    rows = links.collect()
    assert {r["dhash"]: (r["near"], r["nearest"], r["widest"]) for r in rows} == expected

    def components(pairs):
        top = {signed(h): signed(h) for h in codes}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                low = min(top[a], top[b])
                changed |= top[a] != low or top[b] != low
                top[a] = top[b] = low
        return top

    every = [(signed(a), signed(b)) for a in codes for b in codes if (a ^ b).bit_count() <= 8]
    assert components([(r["dhash"], m) for r in rows for m in r["met"]]) == components(every)


def test_a_crowd_stores_no_pairs(spark):
    """2,000 hashes within 8 bits of one another have 2 million links, but only a few rows per hash leave a block."""
    crowd = [sum(1 << b for b in (i % 16, 16 + i // 16 % 16, 32 + i // 256 % 16)) for i in range(2000)]
    links = visual.near_links(spark.createDataFrame([(h,) for h in crowd], "dhash long"))
    assert {r["near"] for r in links.collect()} == {1999}
    assert links.selectExpr("sum(size(met)) AS n").first()["n"] <= 45 * 2000
    assert visual.near_links(spark.createDataFrame([], "dhash long")).count() == 0


def test_crowded_groups_equal_all_pairs(spark):
    """Groups of more than 25 hashes are dealt out by blocks, and blocks of more than 9 are cut."""
    codes = sorted(_hashes(random.Random(12)))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    gaps = {signed(h): [g for o in codes if o != h and (g := (o ^ h).bit_count()) <= 8] for h in codes}
    rows = visual.near_links(spark.createDataFrame([(signed(h),) for h in codes], "dhash long"), 8, 2, 9, 25).collect()
    assert {r["dhash"]: (r["near"], r["nearest"], r["widest"]) for r in rows} == {h: (len(g), min(g), max(g)) for h, g in gaps.items() if g}


def test_dense_blocks_equal_all_pairs():
    """Floods of near copies, where only hashes meet that differ from the commonest bits in as many bands as a pair has to."""
    rng = random.Random(13)
    masks = [(1 << 64 * (b + 1) // 10) - (1 << 64 * b // 10) for b in range(10)]
    choices = list(itertools.combinations(range(10), 2))
    codes = set()
    for centre in (rng.getrandbits(64) for _ in range(3)):
        codes |= {centre ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(53)) ^ (rng.random() < 0.1) * (1 << rng.randrange(64)) for _ in range(700)}
    hashes = np.sort(np.array(sorted(codes), dtype=np.uint64).view(np.int64))
    near, widest = collections.Counter(), collections.Counter()
    for b in range(9):
        for band in visual._grouped(hashes, [c for c in choices if c[0] == b], masks, 8):
            for r in band.to_pylist():
                near[r["dhash"]] += r["near"]
                widest[r["dhash"]] = max(widest[r["dhash"]], r["widest"])
    u = hashes.view(np.uint64)
    gap = np.bitwise_count(u[:, None] ^ u[None, :]).astype(int)
    assert [near[h] for h in hashes.tolist()] == ((gap <= 8).sum(1) - 1).tolist()
    assert [widest[h] for h in hashes.tolist()] == np.where(gap <= 8, gap, 0).max(1).tolist()


def test_a_hash_is_sent_once_per_band(spark):
    """Nine rows of one hash and a band leave for the groups; a row per pair of bands (45) was sent before."""
    plan = visual.near_links(spark.createDataFrame([(5,), (7,)], "dhash long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "choice" not in plan and "value" not in plan.split("Exchange hashpartitioning")[2].split("\n")[1]


def test_components_over_least_hashes_alone(spark):
    codes = [(i * 7 + 3) << 20 for i in range(40)] + [sum(1 << b for b in range(k)) for k in range(0, 60, 5)]
    frame = spark.createDataFrame([(n, h) for n, h in enumerate(codes)] + [(900 + k, 12345 << 30) for k in range(2)], "capture_id long, dhash long")
    got = {r["dhash"]: r["group_hash"] for r in visual.near_duplicate_groups(frame).collect()}
    everyone = sorted({*codes, 12345 << 30})
    top = {h: h for h in everyone}
    for _ in everyone:
        for a in everyone:
            for b in everyone:
                if (a ^ b).bit_count() <= 8:
                    top[a] = top[b] = min(top[a], top[b])
    assert got == {h: top[h] for h in everyone if h == 12345 << 30 or any((h ^ o).bit_count() <= 8 for o in everyone if o != h)}
