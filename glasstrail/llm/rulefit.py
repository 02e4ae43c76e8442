"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

Shallow trees are grown on a bounded labelled sample by boosting; every path from a root to a node is a conjunctive
rule. A lasso logistic regression keeps few rules, and the kept ones become one Spark expression over the statistics,
which come from one Arrow pass over whole texts. Labels are read only from rows that are not held out;
language, source and id are no inputs.

Null texts are empty and score like an empty text. Without labels of both classes the score is their share (0.5 without
any). Repeated rows are scored each.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_texts, held_out, per_row

STATS = ("n_words", "mean_word", "max_word", "upper_share", "digit_share", "symbols_per_word", "bangs_per_word", "pipes_per_word", "points_per_word",
         "distinct_words", "distinct_triples", "adjacent_repeats", "distinct_lines", "mean_line", "short_words", "wide_share")
ADDED = pa.schema([(s, pa.float64()) for s in STATS])
DDL = ", ".join(f"{s} double" for s in STATS)
#: Most labelled rows a fit reads; they are the ones with the least seeded hash of their id.
SAMPLE_ROWS = 12_000


def _counter(chars: str) -> bytes:
    return bytes(b for b in range(256) if chr(b) not in chars)


_UPPER, _LOWER, _DIGITS = _counter("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _counter("abcdefghijklmnopqrstuvwxyz"), _counter("0123456789")
_SYMBOLS, _POINTS = _counter("#*$%&<>^~_{}[]\\"), _counter(".,;:?")


def statistics(text: bytes) -> tuple[float, ...]:
    """The numbers of ``STATS`` for one UTF-8 text."""
    words = text.split()
    n = len(words) or 1
    count = lambda drop: len(text.translate(None, drop))
    upper, lower = count(_UPPER), count(_LOWER)
    sizes = [len(w) for w in words]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    triples = max(1, len(words) - 2)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return (float(len(words)), sum(sizes) / n, float(max(sizes, default=0)), upper / max(1, upper + lower), count(_DIGITS) / max(1, len(text)),
            count(_SYMBOLS) / n, text.count(b"!") / n, text.count(b"|") / n, count(_POINTS) / n, len(set(words)) / n,
            len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 1.0, repeats / n, len(set(lines)) / max(1, len(lines)),
            len(words) / max(1, len(lines)), sum(s <= 3 for s in sizes) / n, (len(text) - len(text.decode("utf-8", "ignore"))) / max(1, len(text)))


def with_statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def derive(column: pa.Array) -> list[list]:
        rows = [statistics(t) for t in byte_texts(column)]
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in STATS]

    return per_row(df, text, ADDED, DDL, derive, keep)


@dataclass
class Rule:
    """A conjunction of ``(statistic, at most, threshold)`` terms and its weight."""
    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for stat, at_most, t in self.terms:
            out = out & (F.col(stat) <= t if at_most else F.col(stat) > t)
        return out


@dataclass
class Model:
    base: float = 0.0
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The compiled model: the logistic function of the weights of the rules that hold."""
        total = F.lit(self.base)
        for rule in self.rules:
            total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(bins, residual, rows, edges, depth, feature_pool, min_rows):
    """One tree on binned features as nested dicts; each node's rows are split where the residuals' variance drops most."""
    import numpy as np

    node = {"value": float(residual[rows].mean()) if len(rows) else 0.0, "rows": rows}
    if depth == 0 or len(rows) < 2 * min_rows:
        return node
    best, r = (1e-9, None, None), residual[rows]
    total, n = r.sum(), len(rows)
    for f in feature_pool:
        b = bins[rows, f]
        k = len(edges[f]) + 1
        c, s = np.cumsum(np.bincount(b, minlength=k))[:-1], np.cumsum(np.bincount(b, weights=r, minlength=k))[:-1]
        ok = (c >= min_rows) & (n - c >= min_rows)
        if not ok.any():
            continue
        gain = np.where(ok, s ** 2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total ** 2 / n, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (gain[i], f, i)
    if best[1] is None:
        return node
    _, f, i = best
    left = bins[rows, f] <= i
    node |= {"split": (f, float(edges[f][i])), "left": _grow(bins, residual, rows[left], edges, depth - 1, feature_pool, min_rows),
             "right": _grow(bins, residual, rows[~left], edges, depth - 1, feature_pool, min_rows)}
    return node


def _paths(node, terms=()):
    """Every root-to-node path below the root."""
    if terms:
        yield terms
    if "split" in node:
        f, t = node["split"]
        yield from _paths(node["left"], (*terms, (f, True, t)))
        yield from _paths(node["right"], (*terms, (f, False, t)))


def _lasso(matrix, y, penalty, steps=300):
    """Logistic weights with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    import numpy as np

    n, k = matrix.shape
    x = np.hstack([matrix, np.ones((n, 1))])
    step = 4.0 * n / max(1e-9, np.linalg.norm(x, 2) ** 2)
    w, z, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(steps):
        gradient = x.T @ (1 / (1 + np.exp(-np.clip(x @ z, -30, 30))) - y) / n
        new = z - step * gradient
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def fit(values, labels, trees: int = 30, depth: int = 3, rate: float = 0.3, seed: int = 7, penalties=(0.003, 0.001, 0.0003)) -> Model:
    """Grow trees on all rows, choose the penalty on a fifth of them, then fit the weights on all."""
    import numpy as np

    x, y = np.asarray(values, dtype=float).reshape(-1, len(STATS)), np.asarray(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 48))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    found: dict[tuple, None] = {}
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least = max(3, len(y) // 1000)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        pool = rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False)
        tree = _grow(bins, y - p, rows, edges, depth, pool, least)
        found.update(dict.fromkeys(_paths(tree)))
        raw += rate * 4 * _predict(tree, bins, edges)
    rules = list(found)
    matrix = np.stack([np.all([(x[:, f] <= t) if at_most else (x[:, f] > t) for f, at_most, t in r], axis=0) for r in rules], axis=1).astype(float)
    test = rng.random(len(y)) < 0.2
    loss = {}
    for penalty in penalties:
        w = _lasso(matrix[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(matrix[test] @ w[:-1] + w[-1]))), 1e-6, 1 - 1e-6)
        loss[penalty] = -np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)) if test.any() else 0.0
    w = _lasso(matrix, y, min(loss, key=loss.get))
    return Model(float(w[-1]), [Rule(tuple((STATS[f], bool(a), float(t)) for f, a, t in r), float(v)) for r, v in zip(rules, w) if abs(v) > 1e-4])


def _predict(node, bins, edges):
    import numpy as np

    out = np.full(len(bins), node["value"])
    if "split" in node:
        f, t = node["split"]
        left = bins[:, f] <= int(np.searchsorted(edges[f], t, side="left"))
        out[left] = _predict(node["left"], bins[left], edges)
        out[~left] = _predict(node["right"], bins[~left], edges)
    return out


def labelled_sample(labels: DataFrame, label: str, rows: int, seed: int = 11) -> DataFrame:
    """At most ``rows`` of the rows that a model may learn from: those with the least seeded hash of their id."""
    usable = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    return usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "label").limit(rows)


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample: ``rows`` labels at most, so the broadcast of their ids and the statistics collected are bounded too."""
    sample = labelled_sample(labels, label, rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = with_statistics(texts, keep=["doc_id", "label"]).orderBy(F.xxhash64("doc_id"), "doc_id", *STATS, "label").limit(2 * rows).toPandas()
    return fit(got[list(STATS)].to_numpy(), got["label"].to_numpy())


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Rows with their statistics, ``score`` and ``predicted``."""
    return with_statistics(docs, keep=keep).withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
