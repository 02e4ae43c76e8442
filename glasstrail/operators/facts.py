"""Text blocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def blocks_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """LINE and WORD blocks of a text, in reading order."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "text")).withColumn("level", F.lit("LINE"))
    words = (lines.select(key, "pos", F.explode(F.split("text", " ", -1)).alias("text")).withColumn("level", F.lit("WORD")))
    return lines.unionByName(words)


def join_lines(blocks: DataFrame, key: str) -> DataFrame:
    """Non-blank LINE blocks joined in order. One screen's lines are a bounded list."""
    kept = blocks.filter((F.col("level") == "LINE") & (F.trim("text") != ""))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n").alias("text"))
