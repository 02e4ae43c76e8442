"""Structured Streaming jobs. Sinks are idempotent per batch, so a restarted job repeats no effect."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import extract as x
from ..operators import rules
from ..session import shared_folder
from ..sources.captures import TODAY, derived_captures


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared storage the cluster names."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def source(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Stream over the files of one table."""
    schema = spark.read.parquet(f"{root}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 100).parquet(root)


def capture_stream(spark: SparkSession, root: str) -> DataFrame:
    return derived_captures(source(spark, root, "orders"))


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run until the available input is used up; results land in files."""
    folder = work_folder(stream.sparkSession, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run ``write(batch, batch_id, folder)`` for every micro-batch and return the folder."""
    folder = work_folder(stream.sparkSession, name)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
         .foreachBatch(lambda df, k: write(df, k, folder)).trigger(availableNow=True).start())
    q.awaitTermination()
    return folder


def overwrite_batch(df: DataFrame, batch: int, folder: str, part: str = "out") -> None:
    """Each batch owns its folder, so running it twice leaves one copy."""
    df.write.mode("overwrite").parquet(f"{folder}/{part}/batch={batch}")


def ingest(captures: DataFrame) -> DataFrame:
    """Captures to facts. A row without text gets a failure note and never stops the batch."""
    facts = captures.select("capture_id", "date_added", x.all_facts("ocr_text", TODAY).alias("f"))

    def write(df: DataFrame, batch: int, folder: str) -> None:
        overwrite_batch(df.dropDuplicates(["capture_id"]), batch, folder)

    folder = run_batches(facts, "ingest", write)
    return captures.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def event_time(column: str = "date_added") -> Column:
    return F.timestamp_seconds(F.col(column))


def dedup_by_hash(captures: DataFrame, delay: str = "3650 days") -> DataFrame:
    """First capture of every content hash; the state is bounded by the watermark."""
    stream = captures.filter("content_hash IS NOT NULL").withColumn("at", event_time()).withWatermark("at", delay)
    return run_to_files(stream.dropDuplicatesWithinWatermark(["content_hash"]).select("content_hash", "capture_id"), "dedup")


def status_counts(captures: DataFrame) -> DataFrame:
    """Live counters: every batch writes the changed counts, the newest of each status is current."""
    folder = run_batches(captures.groupBy("status").agg(F.count("*").alias("n")), "status", overwrite_batch, "update")
    rows = captures.sparkSession.read.parquet(f"{folder}/out")
    return rows.groupBy("status").agg(F.max_by("n", "batch").alias("n"))


def live_search(captures: DataFrame, queries: DataFrame) -> DataFrame:
    """Alerts: new captures that hold every term of a standing query as the start of a word, and every phrase.

    ``queries``: query_id, terms and, optionally, phrases. A text meets a query by the prefixes of its words as long as the
    query's first term, so standing queries are found by equality.
    """
    phrases = F.coalesce("phrases", F.array().cast("array<string>")) if "phrases" in queries.columns else F.array().cast("array<string>")
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+", -1), lambda w: w != "")
    standing = queries.select("query_id", F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.lower(t)).alias("terms"),
                              F.transform(phrases, lambda p: F.array_join(split(p), " ")).alias("phrases"))
    standing = standing.withColumn("key", F.coalesce(F.get("terms", F.lit(0)), F.get(F.split(F.get("phrases", F.lit(0)), " "), F.lit(0)))).filter("key <> ''")
    lengths = standing.agg(F.collect_set(F.length("key")).alias("lengths"))
    texts = captures.select("capture_id", split("ocr_text").alias("words")).crossJoin(F.broadcast(lengths))  # one row
    prefixes = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.filter("lengths", lambda n: n <= F.length(w)), lambda n: F.left(w, n)))))
    hits = texts.select("capture_id", "words", F.explode(prefixes).alias("key")).join(standing, "key")
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    held = (F.forall("terms", lambda t: F.exists("words", lambda w: F.startswith(w, t)))
            & F.forall("phrases", lambda p: F.contains(line, F.concat(F.lit(" "), p, F.lit(" ")))))
    return run_to_files(hits.filter(held).select("query_id", "capture_id"), "alerts")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per user, the open ones included: complete output, of which the newest batch counts."""
    stream = events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    grouped = stream.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    flat = grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    folder = run_batches(flat, "sessions", overwrite_batch, "complete")
    return last_batch(events.sparkSession, folder)


def last_batch(spark: SparkSession, folder: str) -> DataFrame:
    """What the newest batch of a complete output holds."""
    rows = spark.read.parquet(f"{folder}/out")
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def day_timeline(events: DataFrame, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events per day, or per sliding day, the days still open included."""
    stream = events.select("event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    window = F.window("ts", "1 day") if slide is None else F.window("ts", "1 day", slide)
    grouped = stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    flat = grouped.select(F.to_date("w.start").alias("day"), F.col("w.start").alias("start"), "event_type", "n")
    folder = run_batches(flat, "timeline", overwrite_batch, "update")
    rows = events.sparkSession.read.parquet(f"{folder}/out")
    return rows.groupBy("day", "start", "event_type").agg(F.max_by("n", "batch").alias("n"))


def rules_once(contexts: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Rule firings at most once per (rule, capture): each batch is matched against the log of the batches before it."""
    spark = contexts.sparkSession

    def write(df: DataFrame, batch: int, folder: str) -> None:
        earlier = None
        if batch > 0:
            earlier = spark.read.parquet(f"{folder}/log").filter(F.col("batch") < batch).select("rule_id", "capture_id")
        hits = rules.match(df, rule_table, earlier).select("rule_id", "capture_id", "action")
        overwrite_batch(hits, batch, folder, "log")

    folder = run_batches(contexts, "rules", write)
    return spark.read.parquet(f"{folder}/log").select("rule_id", "capture_id", "action")
