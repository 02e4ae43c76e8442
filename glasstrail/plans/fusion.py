"""The whole search as one plan: ladder, vectors, hybrid score, collapse of duplicates, order."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import ranking, semantic
from ..operators.ordered import with_rank
from ..operators.querylog import price_texts_sql
from ..session import stored
from .search import Library, ladder, library

#: What a query names: phrases, terms, hosts and prices.
NAMED = f"array_distinct(transform(concat(q.phrases, q.terms, q.hosts, {price_texts_sql('q.prices')}), x -> lower(x)))"
_FILTERED = "size(hosts) + size(phones) + size(codes) + size(types) + size(colors) > 0 OR start_s IS NOT NULL OR long_only"


def search_all(docs: DataFrame | Library, queries: DataFrame, labels: DataFrame, visuals: DataFrame, probes: DataFrame, concepts: DataFrame) -> DataFrame:
    """``(query_id, capture_id, representative_id, rung, score, similarity, entity, hybrid, rank, reasons)``, nothing cut.

    ``labels``: capture_id, label (entity graph), or capture_id, labels, sorted and distinct; ``visuals``: capture_id, dhash; ``probes``: query_id, visual_id (image asked with).
    A query that the ladder answers also gets what only the vectors find; a text without filters that no rung answers gets
    the vectors' captures alone, with the rung SEMANTIC. Copies carry the rank of the capture that stands for them.
    The image asked with steps aside before copies are folded, so its copies stay.
    """
    lib = docs if isinstance(docs, Library) else library(docs)
    lexical = stored(ladder(lib, queries).select("query_id", "capture_id", "rung", "score", "reasons"))
    asked = queries.select("query_id", F.trim("raw").alias("text")).filter("text <> ''")
    vectors = stored(semantic.search(asked, lib.docs, concepts, limit=None, max_terms=None).select("query_id", "capture_id", "similarity"))
    plain = queries.filter(f"size(terms) + size(phrases) > 0 AND NOT ({_FILTERED})")
    # The parts are stored, so no later step plans them again.
    rows = stored(ranking.semantic_union(lexical, vectors).drop("only_vector").unionByName(ranking.semantic_fallback(plain, lexical, vectors), allowMissingColumns=True))
    visuals = stored(visuals.select("capture_id", "dhash"))
    hashes = probes.join(visuals.select(F.col("capture_id").alias("visual_id"), F.col("dhash").alias("query_hash")), "visual_id", "left")
    words = queries.select("query_id", F.explode("terms").alias("term"))
    topic = semantic.query_concepts(words, concepts, 1).select("query_id", "concept")
    q = queries.select("query_id", F.struct(*queries.columns).alias("q")).join(hashes, "query_id", "left").join(topic, "query_id", "left")
    names = stored(labels if "labels" in labels.columns else labels.groupBy("capture_id").agg(F.array_sort(F.collect_set("label")).alias("labels")))
    d = (lib.docs.select("capture_id", F.struct("date_added", "content_hash", "ocr_text").alias("d"), "colors")
         .join(visuals, "capture_id", "left").join(names, "capture_id", "left"))
    none = F.array().cast("array<string>")
    rows = (rows.join(q, "query_id").join(d, "capture_id").filter("visual_id IS NULL OR capture_id <> visual_id")
            .withColumns({"rung": F.coalesce("rung", F.lit("SEMANTIC")), "score": F.coalesce("score", F.lit(0)), "reasons": F.coalesce("reasons", none), "labels": F.coalesce("labels", none)}))
    scored = ranking.hybrid(rows, wanted=NAMED)
    related = F.when(F.col("similarity") > 0, F.concat(F.lit("Related to \""), F.coalesce("concept", F.get("q.phrases", F.lit(0)), F.trim("q.raw")), F.lit("\"␟SEMANTIC")))
    more = ranking.multimodal_reasons(F.col("q.colors"), F.col("colors"), F.col("query_hash"), F.col("dhash"), F.expr(NAMED), F.transform("labels", lambda v: F.lower(v)))
    scored = stored(scored.select(
        "query_id", "capture_id", "rung", "score", "similarity", "entity", F.round("hybrid", 9).alias("hybrid"), F.col("q.sort").alias("sort"), "d.date_added", "d.content_hash", "d.ocr_text",
        F.concat("reasons", F.array_compact(F.array(related)), more).alias("reasons")))
    folded = stored(ranking.collapse_duplicates(scored, by=("hybrid", "score")))
    heads = folded.filter("capture_id = representative_id").join(scored, ["query_id", "capture_id"])
    by_time = F.when(F.col("sort") == "NEWEST", -F.col("date_added")).when(F.col("sort") == "OLDEST", F.col("date_added")).cast("double")
    timed = F.col("sort").isin("NEWEST", "OLDEST")
    zero = lambda c: F.when(timed, F.lit(0)).otherwise(-F.col(c)).cast("double")
    order = {"_a": F.coalesce(by_time, -F.col("hybrid")), "_b": zero("score"), "_c": zero("date_added")}
    ranks = with_rank(heads.select("query_id", "representative_id", *[c.alias(k) for k, c in order.items()]), ["query_id"], [*order, "representative_id"])
    return (folded.join(ranks.select("query_id", "representative_id", "rank"), ["query_id", "representative_id"]).join(scored, ["query_id", "capture_id"])
            .select("query_id", "capture_id", "representative_id", "rung", "score", "similarity", "entity", "hybrid", "rank", "reasons"))
