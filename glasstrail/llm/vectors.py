"""Embedding near-duplicates by spherical-cap filters.

The filter directions are a structured random product code: the dimensions form a few blocks, every block has ``codes`` random
unit vectors, and each choice of one per block, put together, is a direction, so codes ** parts directions need only
parts * codes products. A vector is list-decoded to all directions whose product exceeds a limit: only code vectors that
can still reach it with the best of the other blocks are combined. A vector that exceeds it in fewer directions than the
average takes its best ones instead. Vectors meet at shared directions and are verified by cosine in double precision.

The code grows with the rows (``code_shape``): ``ROOM`` directions for each vector, so the number of unlike vectors that meet at a
direction stays the same at every size, and a direction that one vector holds is dropped before vectors are moved. The number of a
vector's directions grows as a power (1 - least) / (1 + least) of the code, 0.053 at a cosine of 0.9, and with its
blocks, which keeps the recall (the tests measure it).

Equal vectors are one node with a multiplicity. A direction held by more than ``BLOCK`` vectors is cut into random blocks and
every two blocks meet in a group of their own, so no group grows with the input. A pair that shares several directions counts at the least
one only. Groups return a count and a local component root for each vector, never pairs.

Null, empty or zero vectors, and vectors with null or non-finite components, link with nothing; vectors of different
lengths don't link. Ids may be null or repeat: every row is a vector; a component's id is its least id that is not null.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed
from .components import components

EXPECTED, BLOCK, SEED = 64, 512, 17
#: Directions for each vector, at least LEAST_CODE of them.
ROOM, LEAST_CODE = 1024, 1 << 16
#: Groups up to this size are compared many at a time; those with a link and larger ones go one at a time.
SMALL = 32
#: Most code vectors of a block: a larger code has more blocks.
MOST_CODES = 8192
#: Shorter vectors are turned into this many dimensions by an orthonormal map, which keeps their cosines.
LEAST_DIMS = 32
#: Random vectors that the limit is measured on.
PROBES = 50


def code_shape(rows: int, least: float = 0.9) -> tuple[int, int, int]:
    """``(parts, codes, expected)`` for this many vectors: blocks, code vectors of each, and directions of a vector."""
    size, parts = max(LEAST_CODE, ROOM * rows), 2
    while MOST_CODES ** parts < size:
        parts += 1
    codes = math.ceil(size ** (1 / parts))
    spread = (1 - least) / (1 + least)
    return parts, codes, math.ceil(EXPECTED * parts / 2 * (codes ** parts / LEAST_CODE) ** spread)


@lru_cache(maxsize=4)
def code_of(dims: int, shape: tuple[int, int, int]) -> Code:
    """A worker's code for vectors of one length, kept from task to task."""
    return Code(dims, *shape)


class Code:
    """The product code for vectors of one length, and the limit that gives random vectors ``expected`` directions on average."""

    def __init__(self, dims: int, parts: int, codes: int, expected: int):
        import numpy as np

        rng = np.random.default_rng([SEED, dims])
        self.expected = expected
        self.map = np.linalg.qr(rng.normal(size=(LEAST_DIMS, dims)))[0].T if dims < LEAST_DIMS else None
        wide = max(dims, LEAST_DIMS)
        self.book = []
        for part in np.array_split(np.arange(wide), parts):
            code = rng.normal(size=(codes, len(part)))
            self.book.append((part, code / np.linalg.norm(code, axis=1, keepdims=True) / math.sqrt(parts)))
        probe = rng.normal(size=(PROBES, wide))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        # Each probe's 8 * expected best products hold nearly all of the best of all probes.
        best = np.concatenate([strongest([row @ c.T for row, c in ((v[part], c) for part, c in self.book)], 8 * expected)[0] for v in probe])
        self.limit = float(-np.partition(-best, PROBES * expected)[PROBES * expected])

    def directions(self, vectors) -> list:
        """Sorted direction numbers of each unit vector."""
        import numpy as np

        turned = vectors if self.map is None else vectors @ self.map
        out = []
        for s in range(0, len(turned), 256):  # a block of products stays small however large the code is
            products = [turned[s:s + 256, part] @ code.T for part, code in self.book]
            best = [p.max(axis=1) for p in products]
            for i in range(len(products[0])):
                row = [p[i] for p in products]
                numbers = exceeding(row, [float(b[i]) for b in best], self.limit)
                out.append(np.sort(numbers if len(numbers) >= self.expected else strongest(row, self.expected)[1]))
        return out


def exceeding(products: list, best: list[float], limit: float):
    """Numbers of all directions whose product, the sum of one entry of each block, reaches the limit."""
    import numpy as np

    sums, numbers = np.zeros(1), np.zeros(1, dtype=np.int64)
    for j, p in enumerate(products):
        rest = sum(best[j + 1:])
        near = np.flatnonzero(p >= limit - rest - sum(best[:j]))
        total = sums[:, None] + p[near][None, :]
        keep = total >= limit - rest
        sums, numbers = total[keep], (numbers[:, None] * len(p) + near[None, :])[keep]
    return numbers


def strongest(products: list, count: int):
    """Products and numbers of the ``count`` best directions: a prefix of one of them is among the best prefixes."""
    import numpy as np

    sums, numbers = np.zeros(1), np.zeros(1, dtype=np.int64)
    for p in products:
        near = np.argpartition(-p, count - 1)[:count] if len(p) > count else np.arange(len(p))
        sums, numbers = (sums[:, None] + p[near][None, :]).ravel(), (numbers[:, None] * len(p) + near[None, :]).ravel()
        if len(sums) > count:
            top = np.argpartition(-sums, count - 1)[:count]
            sums, numbers = sums[top], numbers[top]
    return sums, numbers


def usable(vector: Column) -> Column:
    """True for vectors that can link: finite components, none null, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(values, dims: int):
    import numpy as np

    v = np.asarray(values, dtype=np.float64).reshape(-1, dims)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def with_directions(nodes: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``(node, dims, directions)``: each vector's length and the numbers of all directions it exceeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_length.setdefault(len(v), []).append(i)
            for dims, rows in by_length.items():
                for s in range(0, len(rows), 2000):
                    part = rows[s:s + 2000]
                    found = code_of(dims, shape).directions(_unit([vectors[i] for i in part], dims))
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in part], pa.int64()), pa.array([dims] * len(part), pa.int32()),
                                                      pa.array(found, pa.list_(pa.int64()))], ["node", "dims", "directions"])

    return nodes.select("node", "vector").mapInArrow(run, "node bigint, dims int, directions array<bigint>")


def _local_roots(i, j, n: int):
    """Component roots (least index) of ``n`` points linked by the index arrays i, j."""
    import numpy as np

    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def verify_group(node, side, vectors, earlier, weight, least: float):
    """``(node, links, root)`` of the members that link with another one whose least shared direction is this one.

    ``side`` is 0 and 1 for the two blocks of a group of different blocks, and 2 in a block with itself; ``earlier()`` gives the
    members' lesser directions, which few groups need.
    """
    import numpy as np

    cosine = vectors @ vectors.T >= least
    if side.min() == 2:
        np.fill_diagonal(cosine, False)
    else:
        cosine &= side[:, None] != side[None, :]
    if not cosine.any():
        return None
    columns: dict[int, int] = {}
    cells = [(r, columns.setdefault(d, len(columns))) for r, ds in enumerate(earlier()) for d in ds]
    if cells:
        seen = np.zeros((len(node), len(columns)), dtype=np.float32)
        seen[tuple(np.array(cells).T)] = 1
        cosine &= seen @ seen.T == 0
    i, j = np.nonzero(np.triu(cosine))
    links = cosine @ weight
    hit = np.flatnonzero(links)
    root = _local_roots(i, j, len(node))
    return node[hit], links[hit], node[root[hit]]


def _values(rows: pa.Table):
    lists = rows["vector"].combine_chunks()
    bounds = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]


def worth_a_look(rows: pa.Table, spans, least: float) -> list[int]:
    """Numbers of the groups, bounded by ``spans``, that are large or hold two vectors with the cosine; all small ones are compared at once."""
    import numpy as np

    sizes = np.diff(spans)
    look = sizes > SMALL
    small = np.repeat(~look & (sizes > 1), sizes)
    of, dims = np.repeat(np.arange(len(sizes)), sizes), rows["dims"].to_numpy()
    for wide in np.unique(dims[small]):
        chosen = np.flatnonzero(small & (dims == wide))
        unit = _unit(_values(rows.take(pa.array(chosen)).select(["vector"])), int(wide))
        mine, step = of[chosen], 1
        while len(near := np.flatnonzero(mine[step:] == mine[:-step])):
            look[mine[near[np.einsum("ij,ij->i", unit[near], unit[near + step]) >= least - 1e-9]]] = True  # the group itself decides exactly
            step += 1
    return np.flatnonzero(look).tolist()


MET = "node bigint, links bigint, root bigint"


def _verified(least: float):
    """Verify the groups of a partition that is sorted by group; only the last group of a batch waits for the next batch."""
    import numpy as np

    def group(rows: pa.Table) -> tuple | None:
        return verify_group(rows["node"].to_numpy(), rows["side"].to_numpy(), _unit(_values(rows), rows["dims"][0].as_py()),
                            lambda: rows["earlier"].to_pylist(), rows["weight"].to_numpy(), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def verified(rows: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
            bounds = np.array([0, *ends])
            for at in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(bounds[1:] // 4096)) + 1):  # whole groups, some 4,096 rows
                part = rows.slice(int(bounds[at[0]]), int(bounds[at[-1] + 1] - bounds[at[0]]))
                spans = bounds[at[0]:at[-1] + 2] - bounds[at[0]]
                found = [f for g in worth_a_look(part, spans, least) if (f := group(part.slice(int(spans[g]), int(spans[g + 1] - spans[g])))) is not None]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in range(3)], ["node", "links", "root"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            keys = np.stack([rows[c].to_numpy() for c in ("dims", "direction", "a", "b")])
            ends = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            yield from verified(rows, ends)
            waiting = rows.slice(ends[-1]) if ends else rows
        if waiting is not None and waiting.num_rows:
            yield from verified(waiting, [waiting.num_rows])

    return run


def linked(nodes: DataFrame, least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``(node, links, root)`` rows of ``(node, vector, weight)``: partial counts and local component roots, to be summed."""
    listed = checkpointed(with_directions(nodes, code_shape(nodes.count(), least)))
    each = listed.select("node", "dims", F.explode("directions").alias("direction"))
    sizes = checkpointed(each.groupBy("dims", "direction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = each.join(sizes, ["dims", "direction"]).groupBy("node", "dims").agg(F.collect_list(F.struct("direction", "n")).alias("shared"))  # a vector's directions
    met = shared.join(nodes, "node").select("node", "dims", "weight", "vector", "shared", F.explode("shared").alias("at"))
    met = met.withColumn("direction", F.col("at.direction")).withColumn("blocks", F.ceil(F.col("at.n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node", "direction"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lesser = F.expr("transform(filter(shared, x -> x.direction < direction), x -> x.direction)")
    rows = met.select("dims", "direction", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node",
                      F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
                      "weight", "vector", lesser.alias("earlier"))
    dealt = rows.repartition("dims", "direction", "a", "b").sortWithinPartitions("dims", "direction", "a", "b")
    return dealt.mapInArrow(_verified(least), MET)


def deduplicated(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", least: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    given = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).withColumn("usable", usable(F.col("vector")))
    same = given.filter("usable").groupBy("vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"))
    nodes = checkpointed(same).withColumn("node", F.monotonically_increasing_id())  # numbers of stored rows stay the same
    nodes = checkpointed(nodes)
    met = checkpointed(linked(nodes.select("node", "vector", "weight"), least, block))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = (nodes.select("node", "first_id", "weight").join(counts, "node", "left")
              .join(roots, "node", "left").select("node", "first_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    placed = checkpointed(placed)
    named = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = nodes.select("node", F.col("vector").alias("of")).join(placed.join(named, "component").select("node", "n_links", "component_id"), "node")
    good = given.filter("usable").join(found, F.col("vector") == F.col("of")).select("vec_id", "n_links", "component_id")
    alone = given.filter("not usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
