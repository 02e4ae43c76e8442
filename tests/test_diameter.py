"""Largest distance inside near-duplicate groups, against all pairs."""
import random

from glasstrail.operators import visual


def test_diameters_equal_all_pairs(spark):
    rng = random.Random(5)
    rows, best = [], {}
    for g in range(40):
        centre, hashes = rng.getrandbits(64), set()
        for _ in range(rng.choice([1, 2, 3, 30, 120])):
            h = centre
            for _ in range(rng.choice([0, 1, 3, 8, 20])):
                h ^= 1 << rng.randrange(64)
            hashes.add(h)
        if g == 7:  # all equally far from each other and from the centre
            hashes = {1 << b for b in range(64)}
        if g == 8:
            hashes = {0, (1 << 64) - 1, 1}
        best[g] = max((x ^ y).bit_count() for x in hashes for y in hashes)
        rows += [(g, h - (1 << 64) if h >> 63 else h) for h in hashes for _ in range(1 + g % 2)]
    frame = spark.createDataFrame(rows, "group_hash bigint, dhash bigint")
    assert {r["group_hash"]: r["max_distance"] for r in visual.group_diameters(frame).collect()} == best
    assert visual.group_diameters(frame.limit(0)).count() == 0
