"""SimHash near-duplicates: fingerprints in one Arrow pass, links by pigeonring filtering, components of links.

Pigeonring: the 64 bits form a ring of ``SEGMENTS`` segments. If two fingerprints differ in at most t bits, some
segment starts a chain whose every prefix of l segments differs in at most l * t / SEGMENTS bits (rounded down). With
three segments and t = 2 the budgets are 0, 1 and 2: the first segment is equal, which makes it a join key, the first
two differ in one bit at most, and all three in two. The conditions stand in the join, so only rows that pass come out.

Equal fingerprints are one node. A key held by more than ``crowd`` fingerprints is split by the chain's second budget:
segments that differ in at most one bit agree after masking some one bit, so (key, bit, masked value) meets every pair
that the budget allows. Each linked pair is met; none is dropped.

Null and empty texts have the fingerprint zero and link like any other. Ids may repeat or be null: rows with the same
fingerprint share its component, whose id is the least id that is not null (null if there is none).
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import byte_texts, checkpointed, free_name, non_null, per_row
from .components import components

#: Bit ranges (shift, width) of the ring's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
LIMIT = 2
ADDED = pa.schema([("fp", pa.int64())])


def fingerprint(text: bytes) -> int:
    """Bits set in over half of the XXH64 (seed 42) of all 3-word shingles, as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # of bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= 3:
        hashes = [digest(joined, 42)]
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        starts += [at]
        hashes = [digest(joined[a:b - 1], 42) for a, b in zip(starts, starts[3:])]
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 100_000):
        part = np.array(hashes[i:i + 100_000], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return per_row(df, text, ADDED, "fp bigint", lambda column: [[fingerprint(t) for t in byte_texts(column)]], keep)


def _segment(x: Column, i: int) -> Column:
    shift, width = SEGMENTS[i % 3]
    return F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, crowd: int = 64) -> DataFrame:
    """Distinct pairs ``(a, b)``, a < b, of the distinct values ``fp`` that differ in at most two bits."""
    keyed = fps.select("fp", F.posexplode(F.array(*[_segment(F.col("fp"), i) for i in range(3)])).alias("seg", "key"))
    sizes = checkpointed(keyed.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = keyed.join(sizes, ["seg", "key"])  # a key alone has no candidate
    second = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).when(F.col("seg") == 1, _segment(F.col("fp"), 2)).otherwise(_segment(F.col("fp"), 0))
    bits = max(width for _, width in SEGMENTS)
    calm = shared.filter(F.col("n") <= crowd).select("fp", "seg", "key", F.lit(-1).alias("bit"), F.lit(0).cast("bigint").alias("masked"))
    full = (shared.filter(F.col("n") > crowd).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
            .select("fp", "seg", "key", "bit", second.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))).alias("masked")))
    left = calm.unionByName(full)
    right = left.select(F.col("fp").alias("b"), *["seg", "key", "bit", "masked"])
    differ = F.col("fp").bitwiseXOR(F.col("b"))
    seg = F.col("x.seg")
    chain = F.when(seg == 0, F.bit_count(_segment(differ, 1))).when(seg == 1, F.bit_count(_segment(differ, 2))).otherwise(F.bit_count(_segment(differ, 0)))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("seg", "key", "bit", "masked")]
    met = left.alias("x").join(right.alias("y"), [*same, F.col("fp") < F.col("b"), chain <= 1, F.bit_count(differ) <= LIMIT,
                                                         (chain == 1) | (F.col("x.bit") <= 0)])  # equal second segments agree under every mask: once is enough
    return met.select(F.col("fp").alias("a"), "b").distinct()


def with_components(fingerprinted: DataFrame, doc_id: str = "doc_id", crowd: int = 64) -> DataFrame:
    """Rows of ``(doc_id, fp, ...)`` with ``root``, a fingerprint that names the component, and ``component_id``, the
    least id among all rows whose fingerprints are linked. Columns of these two names are replaced; any other may occur."""
    fingerprinted = fingerprinted.drop("root", "component_id")
    node = free_name(fingerprinted, "node")
    nodes = checkpointed(fingerprinted.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = components(checkpointed(links(nodes.select("fp"), crowd)))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = checkpointed(linked.select(F.col("fp").alias(node), "root").join(named, "root"))
    return fingerprinted.join(ids, F.col("fp") == F.col(node), "left").drop(node)


def deduplicated(docs: DataFrame, crowd: int = 64) -> DataFrame:
    """One document of each component, with its own columns: the one with the least id (null last), then the least hash
    of its text. Repeated rows leave one."""
    own = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)])
    doc_id, text = f"own_{own.index('doc_id')}", f"own_{own.index('text')}"
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest")
    small = checkpointed(with_fingerprints(plain.select(F.col(doc_id).alias("doc_id"), digest, F.col(text)), text, keep=["doc_id", "digest"]))
    placed = with_components(small, crowd=crowd)
    chosen = (placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("best"))
              .select(non_null(F.col("best.doc_id")).alias("id_key"), F.col("best.digest").alias("digest")))
    left = plain.withColumn("id_key", non_null(F.col(doc_id))).withColumn("digest", digest).join(chosen, ["id_key", "digest"], "left_semi")
    again = F.row_number().over(Window.partitionBy("id_key", "digest").orderBy(doc_id))  # in the join's partitions
    return left.withColumn("again", again).filter("again = 1").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)])


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
