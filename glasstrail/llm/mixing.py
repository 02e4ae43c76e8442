"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are word counts. Targets share a budget by weight, stop at a multiple of their source's size, and the excess is
shared anew (water filling). Documents are counted by (source, exact size). Per source a bounded knapsack picks how many
copies of each size are taken, each document at most ``most`` times: a proportional share of each size first, then
larger sizes that still fit, then dynamic programming over the remaining budget, which a few of the longest or ``ROOM`` words bound. Which documents
of a size are taken follows from a seeded hash, so reruns agree.

Nothing is collected: the state of a source is one row per distinct size. Ranks inside one (source, size) are taken in
``BUCKETS`` hash ranges, so a size that holds a third of all rows is not one group.

Null texts have size 0; a null source is a source of its own, the last one. Repeated rows count as often as they stand.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import byte_texts, checkpointed, non_null, per_row

BUCKETS = 1024
#: Least budget, in words, that the exact knapsack fills; it is larger where one document is.
ROOM = 100_000
ADDED = pa.schema([("size", pa.int64())])


def with_sizes(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return per_row(df, text, ADDED, "size bigint", lambda column: [[len(t.split()) for t in byte_texts(column)]], keep)


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with ``place`` from 0: ranks inside range partitions plus the rows before them."""
    dealt = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    return inside.join(before, "part").select(*sources.columns, (F.col("inside") + F.col("before") - 1).alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Raises the level of words per weight until the sources that aren't at their limit take up the rest of the budget;
    a round needs three sums. It ends when no further source reaches its limit.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = checkpointed(ranked_sources(sources).withColumn("weight", weight))
    limit = most * F.col("source_size")
    budget = share * float(placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        at_limit = limit <= level * F.col("weight")
        used, free, n = placed.agg(F.coalesce(F.sum(F.when(at_limit, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_limit, F.col("weight"))), F.lit(0.0)),
                                   F.count(F.when(at_limit, 1))).first()
        if n == full or free == 0:
            break
        full, level = n, (budget - used) / free
    target = F.least(limit, F.lit(level) * F.col("weight")) if free else limit
    return placed.select("source", "source_size", "weight", target.cast("double").alias("target"))


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each size to take, each size at most as often as counted, so that their sum is as near the budget as
    this finds: never above it, and short of it only by what no choice among the items left could fill.

    A proportional share of every size leaves a remainder; larger sizes fill it while they fit; the rest is an exact bounded
    knapsack, a bit set of reachable sums per size (binary splitting), walked back to the choice.
    """
    total = sum(s * c for s, c in counts.items())
    if budget >= total:
        return dict(counts)
    taken = {s: c * budget // total for s, c in counts.items()}
    rest = budget - sum(s * n for s, n in taken.items())
    longest = max(counts)
    for s in sorted(counts, reverse=True):
        if rest <= longest:
            break
        more = min(counts[s] - taken[s], (rest - longest + s - 1) // s)
        taken[s] += more
        rest -= more * s
    room = max(4 * longest, ROOM)  # what goes back into the knapsack, so that it has a choice
    for s in sorted(counts):
        back = min(taken[s], (room - rest) // s) if s else 0
        if back > 0:
            taken[s] -= back
            rest += back * s
    items, sums, steps, mask = [], 1, [], (1 << (rest + 1)) - 1
    for s in sorted(counts):
        left, chunk = min(counts[s] - taken[s], rest // s if s else 0), 1
        while left > 0 and not sums >> rest & 1:
            take = min(chunk, left)
            items.append((s, take))
            steps.append(sums)
            sums |= sums << (s * take) & mask
            left, chunk = left - take, chunk * 2
    at = sums.bit_length() - 1
    for (s, take), before in zip(reversed(items), reversed(steps)):
        if not before >> at & 1:
            taken[s] += take
            at -= s * take
    return taken


FIT = "source string, size bigint, copies bigint"


def _fit_group(group):
    import pandas as pd

    counts = dict(zip(group["size"].tolist(), (group["n"] * group["most"]).tolist()))
    taken = fit(counts, int(group["budget"].iloc[0]))
    return pd.DataFrame({"source": [group["source"].iloc[0]] * len(taken), "size": list(taken), "copies": list(taken.values())})


def _prefixed(frame: DataFrame, *names: str):
    """``frame`` with prefixed columns, and null-safe equality of ``names`` with them."""
    return frame.select(*[F.col(c).alias(f"r_{c}") for c in frame.columns]), [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in names]


def mixed(sized: DataFrame, seed: int = 0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """Rows with ``source``, ``size`` and ``pick_hash`` (a hash of what tells documents apart), and further columns, plus
    ``source_size``, ``target``, ``copies`` and ``taken`` (words). A document is taken 0, 1, ... up to ``most`` times.
    Further columns named like the added ones are replaced; any other name may occur."""
    further = [c for c in sized.columns if c not in ("source", "size", "pick_hash", "source_size", "target", "copies", "taken")]
    sized = sized.select("source", "size", "pick_hash", *[F.col(f"`{c}`").alias(f"further_{i}") for i, c in enumerate(further)])
    bucket = F.pmod(F.shiftright("pick_hash", 40), F.lit(BUCKETS))
    keyed = sized.withColumn("pick_hash", F.xxhash64(F.lit(seed), "pick_hash")).withColumn("bucket", bucket)
    counted = checkpointed(keyed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    lengths = checkpointed(counted.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goal = checkpointed(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    goal = goal.withColumn("budget", F.round("target").cast("bigint"))
    with_goal = lengths.withColumnRenamed("source", "of").join(goal, F.col("of").eqNullSafe(F.col("source"))).select("source", "size", "n", "budget", F.lit(int(most)).alias("most"))
    chosen = with_goal.groupBy("source").applyInPandas(_fit_group, FIT)
    right, on = _prefixed(chosen, "source", "size")
    chosen = checkpointed(lengths.join(right, on).select("source", "size", F.expr("r_copies div n").alias("passes"), F.expr("r_copies % n").alias("extra")))
    order = Window.partitionBy("source", "size").orderBy("bucket")  # at most BUCKETS rows
    running = counted.withColumn("before", F.sum("n").over(order) - F.col("n"))
    right, on = _prefixed(chosen, "source", "size")
    running = running.join(right, on).withColumn("extra", F.greatest(F.lit(0), F.least("n", F.col("r_extra") - F.col("before"))).cast("bigint"))
    running = running.select("source", "size", "bucket", "extra", F.col("r_passes").alias("passes"))
    right, on = _prefixed(goal.select("source", "source_size", "target"), "source")
    quota = checkpointed(running.join(right, on).select("source", "size", "bucket", "extra", "passes", F.col("r_source_size").alias("q_source_size"), F.col("r_target").alias("q_target")))
    quota = quota.select(non_null(F.col("source")).alias("q_source"), "size", "bucket", F.col("extra").alias("q_extra"), F.col("passes").alias("q_passes"), "q_source_size", "q_target")
    place = F.row_number().over(Window.partitionBy("q_source", "size", "bucket").orderBy("pick_hash"))  # in the join's partitions
    placed = keyed.withColumn("q_source", non_null(F.col("source"))).join(quota, ["q_source", "size", "bucket"]).withColumn("place", place)
    copies = (F.col("q_passes") + F.when(F.col("place") <= F.col("q_extra"), 1).otherwise(0)).cast("bigint")
    return placed.select("source", "size", F.col("pick_hash"), *[F.col(f"further_{i}").alias(c) for i, c in enumerate(further)], F.col("q_source_size").alias("source_size"), F.col("q_target").alias("target"), copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def pick_hash(*columns: str):
    """What tells documents apart for the seeded choice."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    own = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)])
    at = {c: f"own_{own.index(c)}" for c in ("doc_id", "source", "text")}
    sized = with_sizes(plain.withColumn("source", F.col(at["source"])).withColumn("pick_hash", pick_hash(at["doc_id"], at["text"])), at["text"],
                       [*plain.columns, "source", "pick_hash"])
    sized = sized.select(*plain.columns, "source", "pick_hash", "size")
    taken = mixed(sized, **options).filter("copies > 0")
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)])

