"""Shared helpers of the training-data operators."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpointed

__all__ = ["checkpointed", "documents", "table", "byte_texts", "char_texts", "per_row", "held_out", "sha256_hex"]

#: Largest relation, in rows, that a plan may broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of one table below ``root``, which may be any path Spark can read."""
    frame = spark.read.parquet(f"{root}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def documents(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return table(spark, root, "documents", *columns)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def char_texts(column: pa.Array) -> list[str]:
    """Each text as a string; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_row(df: DataFrame, text: str, added: pa.Schema, ddl: str, derive: Callable[[pa.Array], list[list]],
            keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns derived from its text column in one Arrow pass, without a shuffle.

    ``derive`` takes the text array and returns one list per added column. ``keep`` names the columns to
    carry along (all of them by default); a kept column named like an added one is replaced.
    """
    new = added.names
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(free_name(df, "__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                values = derive(part.column(len(kept)))
                arrays = [pa.array(v, added.field(i).type) for i, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *arrays], names=[*kept, *new])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(kept)]]
    return source.mapInArrow(run, ", ".join([*kinds, ddl]))


def small_side(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored relation, to be broadcast if it has ``rows`` rows at most; a larger one is joined by shuffle."""
    return F.broadcast(stored) if stored.limit(rows + 1).count() <= rows else stored


def non_null(column: Column) -> Column:
    """A string key that tells null from every value, so that joins and windows on it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
