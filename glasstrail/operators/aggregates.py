"""Aggregations. Every one combines on the map side before it shuffles."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.base import let, text_array


def status_counts(captures: DataFrame) -> DataFrame:
    return captures.groupBy("status").agg(F.count("*").alias("n"))


def index_stats(captures: DataFrame) -> DataFrame:
    """All counters in one row: one pass per capture, then one over the distinct hashes."""
    statuses = ("COMPLETED", "PENDING", "PROCESSING", "FAILED")
    per_hash = captures.groupBy("content_hash").agg(
        F.count("*").alias("n"), F.count("duplicate_of").alias("dups"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses])
    return per_hash.agg(
        F.sum("n").alias("total"), *[F.sum(s.lower()).alias(s.lower()) for s in statuses],
        F.sum("dups").alias("duplicate_items"),
        F.count_if(F.col("content_hash").isNotNull() & (F.col("n") > 1)).alias("duplicate_groups"))


def duplicate_hashes(captures: DataFrame) -> DataFrame:
    return (captures.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n")).filter("n > 1"))


def duplicate_members(captures: DataFrame) -> DataFrame:
    """Members of duplicate groups. A semi-join on counted hashes, so no group is sorted in one task."""
    return captures.join(duplicate_hashes(captures).select("content_hash"), "content_hash", "left_semi")


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.countDistinct("capture_id").alias("n"))


def latest_members(rows: DataFrame, limit: int) -> DataFrame:
    return (rows.groupBy("capture_id").agg(F.max("row_id").alias("last_row"))
            .orderBy(F.desc("last_row"), "capture_id").limit(limit))


def top_entities(edges: DataFrame, entity: list[str], min_count: int = 2, limit: int = 60) -> DataFrame:
    return (edges.groupBy(*entity).agg(F.countDistinct("capture_id").alias("n")).filter(F.col("n") >= min_count)
            .orderBy(F.desc("n"), *entity).limit(limit))


def totals(rows: DataFrame, *by: str, exact: bool = False) -> DataFrame:
    amount = F.col("amount").cast("decimal(38,2)") if exact else F.col("amount")
    return rows.groupBy(*by).agg(F.round(F.sum(amount), 6).alias("total"))


def expenses_by_category(rows: DataFrame) -> DataFrame:
    """Totals per currency and category plus the currency total; currencies are never mixed."""
    named = rows.withColumn("category", F.coalesce("category", F.lit("Other")))
    rolled = named.rollup("currency", "category").agg(F.sum("amount").alias("total"), F.grouping("currency").alias("g"))
    return rolled.filter("g = 0").select("currency", F.coalesce("category", F.lit("ALL")).alias("category"), F.round("total", 6).alias("total"))


def collection_summary(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(
        F.count("*").alias("members"), F.max_by("capture_id", F.struct("date_added", "capture_id")).alias("cover_id"))


def timeline(captures: DataFrame, categories: DataFrame, top: int = 2) -> DataFrame:
    """Per UTC day: captures and the most frequent categories."""
    days = captures.select("capture_id", F.floor(F.col("date_added") / 86400).alias("epoch_day"))
    per_day = days.groupBy("epoch_day").agg(F.count("*").alias("captures"))
    counts = (days.join(categories.filter("category <> 'OTHER'").select("capture_id", "category"), "capture_id")
              .groupBy("epoch_day", "category").agg(F.count("*").alias("n")))
    best = counts.groupBy("epoch_day").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category"))), 1, top).alias("c"))
    return (per_day.join(best, "epoch_day", "left")
            .select("epoch_day", "captures", F.coalesce(F.array_join("c.category", "|"), F.lit("")).alias("categories")))


def word_counts(rows: DataFrame, key: str, text: str, stop: list[str], min_length: int = 4) -> DataFrame:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1),
                     lambda w: (F.length(w) >= min_length) & ~w.rlike("^[0-9]+$") & ~F.array_contains(text_array(stop), w))
    return rows.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def top_words(rows: DataFrame, key: str, text: str, limit: int = 8) -> DataFrame:
    """Most frequent words per document; ties in alphabetical order."""
    counts = word_counts(rows, key, text, lx.TOP_WORD_STOP)
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def top_words_in_row(text: Column, limit: int = 8) -> Column:
    """The words of ``top_words`` in rank order, from the text alone: sorted, counted by runs, sorted by number."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1),
                     lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$") & ~F.array_contains(text_array(lx.TOP_WORD_STOP), w))
    places = lambda b: F.filter(F.transform(b["w"], lambda w, k: F.when((k == 0) | (w != F.get(b["w"], k - 1)), k)), lambda k: k.isNotNull())
    runs = lambda b, c: F.transform(c["at"], lambda k, n: F.struct((k - F.coalesce(F.get(c["at"], n + 1), F.size(b["w"]))).alias("n"), F.get(b["w"], k).alias("word")))
    counts = let(lambda b: let(lambda c: runs(b, c), at=places(b)), w=F.array_sort(words))
    return F.transform(F.slice(F.array_sort(counts), 1, limit), lambda c: c["word"])


def price_answer(prices: DataFrame, by: list[str]) -> DataFrame:
    return prices.groupBy(*by).agg(F.countDistinct("amount").alias("n_prices"), F.min("amount").alias("lowest"), F.max("amount").alias("highest"))


def signal_summary(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()])


