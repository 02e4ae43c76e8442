"""Embeddings, categories, concepts, groups and summaries."""
from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import lexicon as lx
from ..functions import money, vectors as vec
from ..functions.base import bind, index_tokens, let, quote
from ..functions.ngrams import sparse_vectors
from .fulltext import meet

MIN_SIMILARITY = 0.25


def embed(rows: DataFrame, key: str, text: Column, dimension: int = vec.DIMENSION) -> DataFrame:
    """Sparse unit vectors ``(key, dim, w)``.

    A row is a document, so its features are made, counted, hashed and summed inside the row's batch; nothing is shuffled, and
    only the cleaned text goes to the Python worker.
    """
    def run(batches):
        for batch in batches:
            for at, dim, w in sparse_vectors(batch.column(1), dimension):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(dim.astype("int32")), pa.array(w)], names=[key, "dim", "w"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    return rows.select(F.col(key), vec.cleaned(text).alias(f"{key}_text")).mapInArrow(run, f"`{key}` {kind}, dim int, w double")


def feature_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, feature, n)`` over all rows of a key.

    Rows are dealt out by key as texts; the many times larger features are made and counted after that, a key at a time.
    """
    def run(batches):
        held, counts = None, Counter()
        for batch in batches:
            keys, features, n = [], [], []
            for k, found in zip(batch.column(key).to_pylist(), batch.column("features").to_pylist()):
                if k != held:
                    keys += [held] * len(counts)
                    features += counts.keys()
                    n += counts.values()
                    held, counts = k, Counter()
                counts.update(found or ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(features, pa.string()), pa.array(n, pa.int64())], names=[key, "feature", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([held] * len(counts), kind), pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=[key, "feature", "n"])

    dealt = rows.select(F.col(key), text.alias("text")).repartition(key).sortWithinPartitions(key)
    kind = to_arrow_type(dealt.schema[key].dataType)
    return dealt.select(F.col(key), vec.features(F.col("text")).alias("features")).mapInArrow(run, f"`{key}` {dealt.schema[key].dataType.simpleString()}, feature string, n long")


def dense(sparse: DataFrame, key: str, dimension: int = vec.DIMENSION) -> DataFrame:
    """One array per key from the sparse form; a vector has at most ``dimension`` entries."""
    packed = sparse.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "w")))).alias("m"))
    return packed.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)),
                                          lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vector"))


def similarity_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Cosine of paired vectors; model, version and dimension must agree, so they are join keys."""
    keys = [*on, "model", "version", "dimension"]
    return left.withColumnRenamed("vector", "va").join(right.withColumnRenamed("vector", "vb"), keys).withColumn(
        "similarity", vec.cosine(F.col("va"), F.col("vb"))).drop("va", "vb")


def concept_table(spark: SparkSession, concepts: dict[str, str] | None = None) -> DataFrame:
    """``(word, concept, pos)``; a replaceable query-expansion vocabulary of fixed size."""
    source = concepts or lx.CONCEPTS
    rows = [(w, c, p) for c, words in source.items() for p, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "word string, concept string, pos int")


def query_concepts(terms: DataFrame, concepts: DataFrame, limit: int | None = 3) -> DataFrame:
    """Best concepts per query: a concept named by a term counts 2, a member word 1; ties go to the named one."""
    t = terms.select("query_id", F.lower("term").alias("word")).distinct()
    member = concepts.select("word", "concept")
    names = concepts.select("concept").distinct()
    # A concept listing its own name scores that word twice per listing, as a member and as a name.
    listed = t.join(member, "word").select("query_id", "concept", F.when(F.col("concept") == F.col("word"), 2).otherwise(1).alias("s"), (F.col("concept") == F.col("word")).alias("named"))
    named = t.join(names, t["word"] == names["concept"]).select("query_id", "concept", F.lit(2).alias("s"), F.lit(True).alias("named"))
    scored = listed.unionByName(named).groupBy("query_id", "concept").agg(F.sum("s").alias("score"), F.max("named").alias("named"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("named"), "concept")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def expand_terms(terms: DataFrame, concepts: DataFrame, limit: int | None = 12) -> DataFrame:
    """Words of the best concepts, or of all, that the query does not hold, in (concept rank, list) order."""
    best = query_concepts(terms, concepts, None if limit is None else 3).select("query_id", "concept", F.col("rank").alias("concept_rank"))
    words = best.join(concepts, "concept").groupBy("query_id", "word").agg(F.min(F.struct("concept_rank", "pos")).alias("o"))
    own = terms.select("query_id", F.lower("term").alias("word")).distinct()
    fresh = words.join(own, ["query_id", "word"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("o.concept_rank", "o.pos")
    ranked = fresh.withColumn("rank", F.row_number().over(w)).select("query_id", "word", "rank")
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _weight_sql(words: dict[str, float], text: str) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {v}D ELSE 0D END" for w, v in words.items())


def category_sql(text: str, hosts: str, has_price: str, has_code: str, limit: int = 3) -> str:
    """SQL for the ranked categories of one row: ``array<struct<o, n, category>>`` with ``o = -confidence``."""
    options = []
    for n, (category, words, rule_hosts, host_weight, price_weight, code_weight) in enumerate(lx.CATEGORY_RULES):
        bonus = ["0D"]
        if rule_hosts:
            bonus.append(f"CASE WHEN exists(_c.h, h -> h RLIKE {quote('|'.join(re.escape(h) for h in rule_hosts))}) THEN {host_weight}D ELSE 0D END")
        if price_weight:
            bonus.append(f"CASE WHEN _c.p THEN {price_weight}D ELSE 0D END")
        if code_weight:
            bonus.append(f"CASE WHEN _c.k THEN {code_weight}D ELSE 0D END")
        body = (f"CASE WHEN _b.hit + _b.more >= 1.5D THEN named_struct('o', -greatest(0.15D, least(1D, _b.hit / {sum(words.values())}D)), 'n', {n}, 'category', '{category}') END")
        options.append(bind(body, hit=_weight_sql(words, "_c.t"), more=" + ".join(bonus)))
    other = "array(named_struct('o', -1D, 'n', 99, 'category', 'OTHER'))"
    ranked = f"slice(array_sort(array_compact(array({', '.join(options)}))), 1, {limit})"
    chosen = bind(f"CASE WHEN size(_b.r) > 0 THEN _b.r ELSE {other} END", r=ranked)
    return (f"transform(array(struct(concat(' ', lower({text}), ' ') AS t, transform({hosts}, h -> lower(h)) AS h, {has_price} AS p, {has_code} AS k)), _c -> {chosen})[0]")


def classify(rows: DataFrame, key: str, text: str, hosts: str, has_price: str, has_code: str, limit: int = 3) -> DataFrame:
    """``(key, category, confidence, rank)`` from the keyword rules, OTHER when none reaches 1.5.

    The rule list is fixed and small, so it is unrolled into one projection: no join, no shuffle.
    Arguments are SQL over ``rows``.
    """
    ranked = F.expr(category_sql(text, hosts, has_price, has_code, limit))
    return rows.select(key, F.posexplode(ranked).alias("rank", "r")).select(
        key, F.col("r.category").alias("category"), (-F.col("r.o")).alias("confidence"), (F.col("rank") + 1).alias("rank"))


def effective_categories(categories: DataFrame) -> DataFrame:
    """A capture's user rows first, then by confidence."""
    w = Window.partitionBy("capture_id").orderBy(F.when(F.col("source") == "user", 0).otherwise(1), F.desc("confidence"), "category")
    return categories.withColumn("rank", F.row_number().over(w))


def smart_groups(members: DataFrame, words: DataFrame, min_size: int = 3, limit: int = 12) -> DataFrame:
    """Groups by category, else host, else word: size, newest member and label.

    ``members``: capture_id, date_added, category, host, word; ``words``: capture_id, word.
    """
    key = (F.when(F.col("category").isNotNull() & (F.col("category") != "OTHER"), F.concat(F.lit("category:"), "category"))
           .when(F.col("host").isNotNull(), F.concat(F.lit("host:"), "host"))
           .when(F.col("word").isNotNull(), F.concat(F.lit("word:"), "word")))
    keyed = members.withColumn("group_key", key).filter(F.col("group_key").isNotNull())
    groups = (keyed.groupBy("group_key").agg(F.count("*").alias("size"), F.max_by("capture_id", F.struct("date_added", "capture_id")).alias("cover_id"))
              .filter(F.col("size") >= min_size))
    counts = (keyed.select("capture_id", "group_key").join(words.select("capture_id", F.lower("word").alias("w")).distinct(), "capture_id")
              .filter((F.length("w") >= 4) & ~F.col("w").isin(lx.GROUP_WORD_STOP))
              .groupBy("group_key", "w").agg(F.count("*").alias("n"))
              .groupBy("group_key").agg(F.max(F.struct("n", "w")).alias("top")))
    labels = F.create_map(*[F.lit(x) for kv in lx.CATEGORY_LABELS.items() for x in kv])
    out = groups.join(counts, "group_key", "left")
    value = F.regexp_replace("group_key", "^[a-z]+:", "")
    word = F.when(F.col("top.n") >= 2, F.concat(F.upper(F.left("top.w", F.lit(1))), F.substring("top.w", 2, 1000)))
    name = F.coalesce(F.try_element_at(labels, value), value)
    label = (F.when(~F.col("group_key").startswith("category:"), F.coalesce(word, value))
             .when(word.isNull() | (F.lower(word) == F.lower(name)), name).otherwise(F.concat(word, F.lit(" / "), name)))
    return out.select("group_key", "size", "cover_id", label.alias("label")).orderBy(F.desc("size"), "group_key").limit(limit)


def summary(text: Column, filename: Column, prices: Column, hosts: Column, date_texts: Column) -> Column:
    """``headline — largest price — shortest host — first date``, at most four parts."""
    headline = F.left(F.get(F.filter(F.transform(F.split(text, r"\r\n|\n|\r", -1), lambda x: F.trim(x)), lambda x: F.length(x) >= 3), F.lit(0)), F.lit(60))
    top = F.array_max(F.transform(prices, lambda p: F.struct(p["amount"].alias("a"), p["currency"].alias("c"))))
    short = F.array_min(F.transform(hosts, lambda h, i: F.struct(F.length(h).alias("n"), i.alias("i"), h.alias("h"))))
    short_host = F.array_join(F.slice(F.split(F.regexp_replace(short["h"], r"^www\.", ""), r"\."), 1, 2), ".")
    money_text = let(lambda st: money.format_money(st["t"]["c"], st["t"]["a"]), t=top)
    parts = F.slice(F.array_distinct(F.array_compact(F.array(headline, money_text, F.nullif(short_host, F.lit("")), F.get(date_texts, F.lit(0))))), 1, 4)
    return let(lambda st: F.when(st["s"] == "", F.regexp_replace(filename, r"\.[^.]*$", "")).otherwise(st["s"]), s=F.array_join(parts, " — "))


def prefilter(queries: DataFrame, captures: DataFrame, expansions: DataFrame, max_terms: int | None = None) -> DataFrame:
    """``(query_id, capture_id)`` sharing at least one exact token with the query or its expansion."""
    words = F.filter(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "")), lambda w: F.length(w) >= 2)
    own = queries.select("query_id", F.posexplode(words).alias("pos", "token"))
    more = expansions.select("query_id", (F.col("rank") + 1000).alias("pos"), F.col("word").alias("token"))
    terms = own.unionByName(more).groupBy("query_id", "token").agg(F.min("pos").alias("pos"))
    if max_terms is not None:
        w = Window.partitionBy("query_id").orderBy("pos")
        terms = terms.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_terms)
    terms = terms.select("query_id", "token")
    postings = captures.select("capture_id", F.explode(F.array_distinct(F.concat(index_tokens(F.col("filename")), index_tokens(F.col("ocr_text"))))).alias("token"))
    return meet(postings, terms, "token").select("query_id", "capture_id").distinct()


def search(queries: DataFrame, captures: DataFrame, concepts: DataFrame, floor: float = MIN_SIMILARITY, limit: int | None = None, max_terms: int | None = None) -> DataFrame:
    """Captures per query by cosine among token-sharing candidates, the best ``limit`` or all; ``rank`` only where limited.

    Without ``max_terms`` every word of the query and every word of its concepts finds candidates.
    """
    terms = queries.select("query_id", F.explode(index_tokens(F.col("text"))).alias("term"))
    candidates = prefilter(queries, captures, expand_terms(terms, concepts, 12 if max_terms is not None else None), max_terms)
    wanted = captures.join(candidates.select("capture_id").distinct(), "capture_id", "left_semi")
    docs = embed(wanted, "capture_id", vec.embeddable_text(F.col("ocr_text"), F.col("filename")))
    qs = embed(queries, "query_id", F.col("text")).withColumnRenamed("w", "qw")
    # Query vectors have few non-zero dimensions: only those entries of a document take part.
    scored = (docs.hint("merge").join(meet(candidates, qs, "query_id"), ["capture_id", "dim"])
              .groupBy("query_id", "capture_id").agg(F.sum(F.col("qw") * F.col("w")).alias("similarity")))
    scored = scored.withColumn("similarity", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity")))).filter(F.col("similarity") >= floor)
    if limit is None:
        return scored
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "capture_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def nearest_in_group(rows: DataFrame, probes: DataFrame, group: str, key: str, limit: int = 8) -> DataFrame:
    """Members of each probe's group by cosine to the probe, the probe itself excluded."""
    p = probes.select(group, F.col(key).alias("probe_id"), F.col("vector").alias("pv"))
    scored = rows.join(p, group).filter(F.col(key) != F.col("probe_id")).select("probe_id", key, vec.cosine(F.col("vector"), F.col("pv")).alias("similarity"))
    w = Window.partitionBy("probe_id").orderBy(F.desc(F.round("similarity", 9)), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


