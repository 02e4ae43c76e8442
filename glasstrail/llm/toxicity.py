"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of three embeddings, of two independent hashes of the word and one of its first bytes, so that one
colliding hash doesn't make a rare word look toxic. Filters of several widths run over the words, their maximum over the whole text
and a logistic layer give the score. Embeddings start from the smoothed log odds of their bucket in two fifths of the labelled rows;
the rest is learned by Adam on two other fifths; the last fifth calibrates the score, so 0.5 is its best threshold. All of them
give a threshold per language for the column ``flagged``. Language, source and id are no inputs of the score.

The fit reads every labelled row that isn't held out. Counts are sums; weights are learned in shards from the same start, a shard
per task, and averaged, round by round. Only the net and counts of fixed size reach the driver. Scoring runs in one Arrow pass over whole texts. Null texts are
empty and score like a text without words. Without labels of both classes the score is their share (0 without any).
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, checkpointed, held_out, per_row

BUCKETS, DIMS, PREFIX = 1 << 17, 8, 5
#: Filters of each width.
FILTERS = {1: 8, 2: 4, 3: 4}
#: About so many rows of one class mix are learned by one task in a round; more rows give more shards.
SHARD_ROWS = 4_000
ROUNDS = 2
#: Most labelled rows whose ids and labels (16 bytes each) are broadcast; more are joined by shuffle, once, and the texts stored.
BROADCAST_LABELS = 1_000_000
#: Bins of the raw scores in which the calibration counts rows.
BINS = 20_000
_WORD_MAP = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def word_ids(text: bytes):
    """Three bucket numbers of every word, one row each."""
    import numpy as np

    words = text.translate(_WORD_MAP).split()
    crc = zlib.crc32
    ids = np.empty((len(words), 3), dtype=np.uint32)
    ids[:, 0] = [crc(w) for w in words]
    ids[:, 1] = (ids[:, 0] ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B) >> np.uint32(15)
    ids[:, 2] = [crc(w[:PREFIX], 0x5BD1E995) for w in words]
    ids[:, 0] >>= np.uint32(15)  # the top and a mixed half of one checksum
    ids[:, 1] &= np.uint32(BUCKETS - 1)
    ids[:, 2] &= np.uint32(BUCKETS - 1)
    return ids


@dataclass
class Net:
    """Embeddings ``e`` (3, BUCKETS, DIMS), filters ``w`` by width (width, DIMS, n) with biases, and the logistic layer."""
    e: object
    w: dict
    b: dict
    out: object
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def features(self, ids: list):
        """Maxima of all filters for each text, and the words where they are taken (-1: nowhere)."""
        import numpy as np

        sizes = np.array([len(i) for i in ids])
        most = max(self.w)
        starts = np.cumsum(sizes + most) - sizes  # `most` rows of zeros before each text, so no filter spans two texts
        x = np.zeros((int((sizes + most).sum()) + most, self.e.shape[2]), dtype=np.float32)
        rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]) if len(ids) else np.zeros(0, int)
        flat = np.concatenate(ids) if len(ids) else np.zeros((0, 3), np.uint32)
        x[rows] = self.e[0][flat[:, 0]] + self.e[1][flat[:, 1]] + self.e[2][flat[:, 2]]
        maxima, where = [], []
        for k, w in self.w.items():
            n = len(x) - k + 1
            y = sum(x[j:j + n] @ w[j] for j in range(k))
            lows = np.full((len(ids), w.shape[2]), 0.0, dtype=np.float32)
            at = np.full((len(ids), w.shape[2]), -1)
            for i, (s, size) in enumerate(zip(starts, sizes)):
                if size >= k:
                    part = y[s:s + size - k + 1]
                    at[i] = part.argmax(axis=0)
                    lows[i] = part[at[i], np.arange(w.shape[2])]
            maxima.append(np.maximum(lows + np.where(at >= 0, self.b[k], 0), 0))
            where.append(at)
        return maxima, where, x, starts

    def raw(self, ids: list):
        import numpy as np

        return np.concatenate(self.features(ids)[0], axis=1) @ self.out + self.bias

    def score(self, ids: list):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(ids) + self.shift, -30, 30)))


def _log_odds(toxic, both, share: float):
    """Per embedding and bucket: smoothed log odds of the toxic class against its share."""
    import numpy as np

    share, strength = float(np.clip(share, 0.01, 0.99)), 4.0
    p = (toxic + strength * share) / (both + strength)
    return (np.log(p / (1 - p)) - np.log(share / (1 - share))).astype(np.float32)


def fresh(seed: int = 5) -> Net:
    """The net before any row is read."""
    import numpy as np

    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (3, BUCKETS, DIMS)).astype(np.float32)
    e[:, :, 1:] *= 0.2
    w = {k: rng.normal(0, 0.1, (k, DIMS, n)).astype(np.float32) for k, n in FILTERS.items()}
    for k in w:
        w[k][0, 0] = np.abs(w[k][0, 0]) + 0.3
    return Net(e, w, {k: np.zeros(n, dtype=np.float32) for k, n in FILTERS.items()}, np.full(sum(FILTERS.values()), 0.2, dtype=np.float32), -1.0)


def learn(net: Net, ids: list, y, epochs: int, rate: float = 0.02, seed: int = 5) -> None:
    """Adam over the rows of one shard, in place."""
    import numpy as np

    rng, rows_of = np.random.default_rng(seed), np.arange(len(y))
    e, w, b = net.e, net.w, net.b
    params = [net.out, *w.values(), *b.values()]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    bias_m = bias_s = 0.0
    for _ in range(epochs):
        rng.shuffle(rows_of)
        for s in range(0, len(rows_of), 32):
            rows = rows_of[s:s + 32]
            texts = [ids[i] for i in rows]
            maxima, where, x, starts = net.features(texts)
            f = np.concatenate(maxima, axis=1)
            err = (1 / (1 + np.exp(-np.clip(f @ net.out + net.bias, -30, 30))) - y[rows]) / len(rows)
            grads = [f.T @ err + 1e-4 * net.out]
            gw, gb, at = {}, {}, 0
            deltas: list[tuple] = []
            for (k, weight), top, pos in zip(w.items(), maxima, where):
                g = err[:, None] * net.out[None, at:at + top.shape[1]] * (top > 0)
                at += top.shape[1]
                gb[k] = g.sum(axis=0)
                gw[k] = np.zeros_like(weight)
                for i, j in zip(*np.nonzero(g)):
                    p = pos[i, j]
                    if p >= 0:
                        gw[k][:, :, j] += g[i, j] * x[starts[i] + p:starts[i] + p + k]
                        deltas += [(texts[i][p + d], g[i, j] * weight[d, :, j]) for d in range(k)]
            grads += [*gw.values(), *gb.values()]
            step += 1
            for p, g, m, v in zip(params, grads, moment, square):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            bias_m += 0.1 * (err.sum() - bias_m)
            bias_s += 0.001 * (err.sum() ** 2 - bias_s)
            net.bias -= float(rate * (bias_m / (1 - 0.9 ** step)) / (np.sqrt(bias_s / (1 - 0.999 ** step)) + 1e-8))
            for three, d in deltas:
                for j in range(3):
                    e[j, three[j]] -= np.float32(0.5) * d


def _flat(net: Net):
    """Filters, biases and the logistic layer as one array."""
    import numpy as np

    return np.concatenate([net.out, *[v.ravel() for v in net.w.values()], *net.b.values(), [net.bias]]).astype(np.float64)


def _unflat(net: Net, flat) -> None:
    parts, at = [net.out, *net.w.values(), *net.b.values()], 0
    for p in parts:
        p[...] = flat[at:at + p.size].reshape(p.shape)
        at += p.size
    net.bias = float(flat[at])


def _start_values(first: DataFrame, share: float):
    """Log odds of every bucket, from all rows of ``first``: texts with a word in it, and the toxic ones among them."""
    import numpy as np

    def run(batches):
        seen = np.zeros((2, 3 * BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, y in zip(byte_texts(batch.column("text")), batch.column("label").to_pylist()):
                ids = word_ids(text)
                for j in range(3):
                    slots = np.unique(ids[:, j]) + j * BUCKETS
                    seen[0, slots] += 1
                    seen[1, slots] += y
        used = np.flatnonzero(seen[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0, used]), pa.array(seen[1, used])], names=["slot", "n", "toxic"])

    counts = first.select("text", "label").mapInArrow(run, "slot long, n long, toxic long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    got = counts.toArrow()  # at most 3 * BUCKETS rows
    slots, both, toxic = got["slot"].to_numpy(), np.zeros(3 * BUCKETS), np.zeros(3 * BUCKETS)
    both[slots], toxic[slots] = got["n"].to_numpy(), got["toxic"].to_numpy()
    return _log_odds(toxic, both, share).reshape(3, BUCKETS)


def _round(net: Net, second: DataFrame, shards: int, epochs: int, seed: int) -> None:
    """Every shard learns from ``net``; the net moves by the mean change: of all shards, or for an embedding of those that changed it."""
    import numpy as np

    shared = second.sparkSession.sparkContext.broadcast(net)
    names = [f"v{i}" for i in range(DIMS)]

    def run(table: pa.Table) -> pa.Table:
        start = shared.value
        own = Net(start.e.copy(), {k: v.copy() for k, v in start.w.items()}, {k: v.copy() for k, v in start.b.items()}, start.out.copy(), start.bias)
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        ids = [word_ids(t) for column in table.column("text").chunks for t in byte_texts(column)]
        learn(own, ids, table.column("label").to_numpy().astype(np.float32), epochs, seed=seed)
        moved = (own.e - start.e).reshape(-1, DIMS)
        slots = np.flatnonzero(moved.any(axis=1))
        dense = _flat(own) - _flat(start)
        dense = np.pad(dense, (0, -len(dense) % DIMS)).reshape(-1, DIMS)
        values = np.concatenate([moved[slots].astype(np.float64), dense])
        return pa.table([np.concatenate([slots, 3 * BUCKETS + np.arange(len(dense))]), *values.T], names=["slot", *names])

    dealt = second.withColumn("shard", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(shards)))
    moves = dealt.groupBy("shard").applyInArrow(run, "slot long, " + ", ".join(f"{n} double" for n in names))
    got = moves.groupBy("slot").agg(*[F.avg(n).alias(n) for n in names]).toArrow()  # the size of the net at most
    slots, values = got["slot"].to_numpy(), np.stack([got[n].to_numpy() for n in names], axis=1)
    words = slots < 3 * BUCKETS
    net.e.reshape(-1, DIMS)[slots[words]] += values[words].astype(np.float32)
    dense = values[~words][np.argsort(slots[~words])].ravel()
    flat = _flat(net)
    _unflat(net, flat + dense[:len(flat)])
    shared.unpersist()


def _calibrated(net: Net, raws: DataFrame) -> None:
    """Put 0.5 in the middle of the widest gap among the thresholds with the fewest errors, false alarms counting twice."""
    import numpy as np

    low, high = raws.agg(F.min("raw"), F.max("raw")).first()
    if low is None or low == high:
        return
    bin_ = F.floor((F.col("raw") - F.lit(low)) / F.lit((high - low) / BINS))
    got = raws.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("t"), F.min("raw").alias("low"), F.max("raw").alias("high")).orderBy("low").collect()
    n, t, lows, highs = (np.array([r[c] for r in got], dtype=float) for c in ("n", "t", "low", "high"))
    if len(got) < 2 or t.sum() in (0, n.sum()):
        return
    errors = np.concatenate([[0], np.cumsum(t)]) + 2 * np.concatenate([np.cumsum((n - t)[::-1])[::-1], [0]])  # the first i bins pass as clean
    gaps = lows[1:] - highs[:-1]
    cost = np.where(gaps > 1e-6, errors[1:-1], np.inf)  # a threshold stands between two different values
    if np.isfinite(cost.min()):
        i = int(np.where(cost == cost.min(), gaps, -1).argmax())
        net.shift = -float((highs[i] + lows[i + 1]) / 2)


def language_thresholds(net: Net, raws: DataFrame) -> dict:
    """Per language the score above which labelled texts have the fewest errors; 0.5 where one class is missing."""
    import numpy as np

    grid = np.linspace(0.05, 0.95, 37)
    x = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("raw") * net.scale + net.shift))
    passed = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= 1 / (1 + F.exp(-x))))
    counts: dict = {}
    for r in raws.filter("lang IS NOT NULL").groupBy("lang", "label", passed.alias("passed")).agg(F.count("*").alias("n")).collect():  # 76 rows a language at most
        counts.setdefault(r["lang"], np.zeros((2, len(grid) + 1)))[r["label"], r["passed"]] += r["n"]
    out = {}
    for lang, c in sorted(counts.items()):
        out[lang] = 0.5
        if c.sum(axis=1).all():
            under = np.cumsum(c, axis=1)[:, :-1]  # rows below each threshold
            errors = under[1] + c[0].sum() - under[0]
            best = grid[errors == errors.min()]
            out[lang] = float(round(best[np.abs(best - 0.5).argmin()], 3))
    return out


def _raws(texts: DataFrame, net: Net) -> DataFrame:
    """``(label, lang, part, raw)`` of every row of ``texts``, stored."""
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def derive(column: pa.Array) -> list[list]:
        out: list[float] = []
        for s in range(0, len(column), 100):
            out += shared.value.raw([word_ids(t) for t in byte_texts(column[s:s + 100])]).tolist()
        return [out]

    return checkpointed(per_row(texts, "text", pa.schema([("raw", pa.float64())]), "raw double", derive, ["label", "lang", "part"]))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SHARD_ROWS, epochs: int = 6, least_steps: int = 500, seed: int = 13) -> tuple[Net, dict]:
    """Net and language thresholds from every labelled row that isn't held out; a shard learns about ``rows`` of them."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    usable = checkpointed(usable)
    few = usable.count() <= BROADCAST_LABELS
    texts = docs.select("doc_id", "lang", "text").filter(~held_out(F.col("doc_id"))).join(F.broadcast(usable) if few else usable, "doc_id")
    texts = (texts if few else checkpointed(texts)).withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)))
    net = fresh()
    n = {(r["part"], r["label"]): r["n"] for r in texts.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    toxic, total = sum(v for (_, y), v in n.items() if y), sum(n.values())
    if toxic in (0, total):
        net.scale, net.shift = 0.0, 30.0 if toxic else -30.0
        return net, {}
    count = lambda parts, ys=(0, 1): sum(n.get((p, y), 0) for p in parts for y in ys)
    if count((0, 1), (0,)) and count((0, 1), (1,)):
        net.e[:, :, 0] = _start_values(texts.filter("part < 2"), count((0, 1), (1,)) / count((0, 1))) * 0.5
    if count((2, 3)):
        shards = -(-count((2, 3)) // rows)
        visits = max(epochs, -(-least_steps * 32 * shards // count((2, 3))))
        for k in range(ROUNDS):
            _round(net, texts.filter("part IN (2, 3)").select("doc_id", "text", "label"), shards, -(-visits // ROUNDS), k + 5)
    raws = _raws(texts, net)
    _calibrated(net, raws.filter("part = 4"))
    return net, language_thresholds(net, raws)


def scored(docs: DataFrame, net: Net, thresholds: dict, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Rows with ``score``, ``predicted`` and ``flagged`` (by the language's threshold); the net is broadcast, its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def derive(column: pa.Array) -> list[list]:
        out: list[float] = []
        ids, held = [], 0
        for text in byte_texts(column):
            ids.append(word_ids(text))
            held += len(ids[-1])
            if held > 100_000:
                out += shared.value.score(ids).tolist()
                ids, held = [], 0
        return [out + (shared.value.score(ids).tolist() if ids else [])]

    done = per_row(docs, "text", pa.schema([("score", pa.float64())]), "score double", derive, keep)
    limit = F.lit(threshold)
    for lang, t in thresholds.items():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return done.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("flagged", F.col("score") >= limit)
