"""Catalogue upkeep: discovery, child tables, upserts, status changes.

Storage is append-only Parquet, so an update is a new snapshot computed by joins and windows.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import lexicon as lx
from ..functions.base import contains_any


def looks_like_capture(filename: Column, path: Column) -> Column:
    """Is an image file a screen capture, by folder and by name?"""
    low_name, low_path = F.lower(F.trim(filename)), F.lower(path)
    name = F.when(low_name.contains("."), F.regexp_replace(low_name, r"\.[^.]*$", "")).otherwise(low_name)
    extension = F.when(low_name.contains("."), F.substring_index(low_name, ".", -1)).otherwise("")
    starts = ends = F.lit(False)
    for p in lx.CAPTURE_PREFIXES:
        starts = starts | name.startswith(p)
    for s in lx.CAPTURE_SUFFIXES:
        ends = ends | name.endswith(s)
    by_name = starts | ends | name.contains("_screenshot") | name.contains("screenshot_")
    in_folder = F.coalesce(contains_any(low_path, lx.CAPTURE_FOLDERS), F.lit(False))
    excluded = F.coalesce(contains_any(low_path, lx.CAPTURE_EXCLUSIONS), F.lit(False))
    return ~excluded & extension.isin(lx.CAPTURE_EXTENSIONS) & (in_folder | by_name)


def scan_files(spark: SparkSession, path: str, include_all: bool = False) -> DataFrame:
    """File catalogue of a folder tree, newest first; the bytes are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("file_size")))
    files = (files.withColumn("filename", F.substring_index("path", "/", -1))
             .withColumn("folder", F.regexp_replace("path", "[^/]*$", "")))
    if not include_all:
        files = files.filter(looks_like_capture(F.col("filename"), F.col("folder")))
    return files.orderBy(F.desc("modified"), F.desc("path"))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def reconcile(stored: DataFrame, found: DataFrame, key: str, watched: list[str], remove_missing: bool = False) -> DataFrame:
    """One snapshot row per key with its ``change``: insert, update, keep or stale.

    An existing row is refreshed when a watched column changed or it was never completed.
    """
    s = stored.select(F.col(key), F.struct(*[F.col(c) for c in watched], F.col("status")).alias("s"))
    f = found.select(F.col(key), F.struct(*[F.col(c) for c in watched]).alias("f"))
    changed = F.lit(False)
    for c in watched:
        changed = changed | ~F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}"))
    change = (F.when(F.col("s").isNull(), "insert")
              .when(F.col("f").isNull(), "stale" if remove_missing else "keep")
              .when(changed | (F.col("s.status") != "COMPLETED"), "update").otherwise("keep"))
    status = F.when(change.isin("insert", "update"), "PENDING").otherwise(F.col("s.status"))
    values = [F.coalesce(F.col(f"f.{c}"), F.col(f"s.{c}")).alias(c) for c in watched]
    return s.join(f, key, "full_outer").select(key, *values, status.alias("status"), change.alias("change"))


def replace_children(old: DataFrame, new: DataFrame, batch: DataFrame, key: str = "capture_id") -> DataFrame:
    """Children of the processed batch are replaced, all others kept."""
    return old.join(batch.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Latest version per key. Aggregation, not a window, so hot keys combine before the shuffle."""
    rows = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    values = [c for c in old.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.struct("_gen", sequence)).alias("v")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def cascade_delete(child: DataFrame, parents: DataFrame, key: str = "capture_id") -> DataFrame:
    return child.join(parents.select(key), key, "left_semi")


def orphan_sweep(entities: DataFrame, edges: DataFrame, key: str = "entity_id") -> DataFrame:
    return entities.join(edges.select(key), key, "left_semi")


def keep_latest(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """Newest ``keep`` rows overall (a top-k, never a global sort)."""
    return rows.orderBy(*order).limit(keep)


def record_history(log: DataFrame, keep: int = 25) -> DataFrame:
    """Search history: blank text skipped, one row per case-folded query, newest ``keep``."""
    text = F.trim("text")
    merged = (log.select(text.alias("text"), "ts", "log_id").filter(F.col("text") != "")
              .groupBy(F.lower("text").alias("query_key"))
              .agg(F.max("ts").alias("last_ts"), F.max_by("text", F.struct("ts", "log_id")).alias("text")))
    return keep_latest(merged, [F.desc("last_ts"), F.asc("query_key")], keep)


def is_sensitive_query(text: Column) -> Column:
    """Queries that look like a one-time code are never logged."""
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return (digits >= 4) & text.rlike(lx.HISTORY_CODE_CONTEXT) & text.rlike(r"\d{4,}")


def rebuild_reset(captures: DataFrame) -> DataFrame:
    cleared = {"status": F.lit("PENDING"), "ocr_text": F.lit(""), "content_hash": F.lit(None).cast("string")}
    return captures.withColumns({k: v for k, v in cleared.items() if k in captures.columns})


def empty_copy(table: DataFrame) -> DataFrame:
    """The empty replacement that wiping a table writes."""
    return table.limit(0)


def wipe(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts before and after every table is replaced by its empty copy."""
    counts = []
    for name, table in tables.items():
        for stage, rows in (("before", table), ("after", empty_copy(table))):
            n = F.count("*")
            zero = F.lit(0).cast("bigint")
            counts.append(rows.agg(n.alias("n")).select(F.lit(name).alias("tbl"), *[(F.col("n") if s == stage else zero).alias(s) for s in ("before", "after")]))
    union = reduce(DataFrame.unionByName, counts)
    return union.groupBy("tbl").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))


def set_status(captures: DataFrame, target: str, when: Column) -> DataFrame:
    return captures.withColumn("status", F.when(when, target).otherwise(F.col("status")))


def mark_failed(captures: DataFrame, errors: DataFrame, key: str = "capture_id", limit: int = 500) -> DataFrame:
    rows = captures.join(errors.select(key, F.col("error").alias("_e")), key, "left")
    return (rows.withColumn("status", F.when(F.col("_e").isNotNull(), "FAILED").otherwise(F.col("status")))
            .withColumn("processing_error", F.left("_e", F.lit(limit))).drop("_e"))


def mark_completed(captures: DataFrame, results: DataFrame, key: str = "capture_id") -> DataFrame:
    r = results.select(key, F.struct("ocr_text", "content_hash", "duplicate_of").alias("_r"))
    done = F.col("_r").isNotNull()
    return captures.join(r, key, "left").withColumns({
        "ocr_text": F.coalesce("_r.ocr_text", "ocr_text"),
        "content_hash": F.when(done, F.col("_r.content_hash")).otherwise(F.col("content_hash")),
        "duplicate_of": F.col("_r.duplicate_of"),
        "status": F.when(done, "COMPLETED").otherwise(F.col("status")),
    }).drop("_r")


def pending_batch(captures: DataFrame, size: int = 12) -> DataFrame:
    return captures.filter(F.col("status") == "PENDING").orderBy("date_added", "capture_id").limit(size)


def stale_rows(captures: DataFrame, derived: DataFrame, expected: dict[str, str], need_text: bool) -> DataFrame:
    """Completed captures whose derived row is missing or was made by another version."""
    base = captures.filter(F.col("status") == "COMPLETED")
    if need_text:
        base = base.filter(F.trim("ocr_text") != "")
    joined = base.select("capture_id").join(derived.select("capture_id", *expected), "capture_id", "left")
    stale = F.lit(False)
    for c, v in expected.items():
        stale = stale | ~F.col(c).eqNullSafe(F.lit(v))
    return joined.filter(stale).select("capture_id")


def analysis_backlog(captures: DataFrame, topics: DataFrame) -> DataFrame:
    return captures.filter(F.col("status") != "FAILED").join(topics.select("capture_id"), "capture_id", "left_anti").select("capture_id")


def reclassify(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Automatic categories are replaced, a user's own choice survives."""
    return old.filter(F.col("source") == "user").unionByName(fresh)


def visible_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.groupBy("capture_id", "kind").agg(F.max("dismissed").alias("dismissed"), F.max("removed").alias("removed"), F.max("accepted").alias("accepted"))
    joined = suggestions.join(d, ["capture_id", "kind"], "left")
    hidden = F.coalesce(F.col("dismissed"), F.lit(False)) | F.coalesce(F.col("removed"), F.lit(False))
    return joined.filter(~hidden).select(*suggestions.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def archive_flags(captures: DataFrame, state: DataFrame) -> DataFrame:
    latest = state.groupBy("capture_id").agg(F.max_by("archived", "changed_at").alias("archived"))
    return captures.select("capture_id").join(latest, "capture_id", "left").withColumn("archived", F.coalesce("archived", F.lit(False)))


