"""Evidence for questions, grounding of answers and conversation tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions.base import bind, quote
from ..functions.privacy import sensitive_kinds, sensitivity_level
from ..session import checkpointed
from ..weights import EvidenceWeights

PRICE = r"(?i)(?:₹|\$|€|£)\s*[\d,]+(?:\.\d+)?|(?:rs|inr|usd|eur|gbp)\.?\s*[\d,]+(?:\.\d+)?"
HOST = r"[a-z0-9-]+\.[a-z]{2,}"
MASKED = "I found matching screenshots, but their details are sensitive and stay masked until you reveal them."
NOTHING_VERIFIED = "I found screenshots but could not state a verified answer from them."


def price_keys(text: str) -> Column:
    """``CUR:amount`` of every price in a text, distinct, in order."""
    currency = ("CASE WHEN contains(p, '₹') OR contains(lower(p), 'rs') OR contains(lower(p), 'inr') THEN 'INR' WHEN contains(p, '$') OR contains(lower(p), 'usd') THEN 'USD' "
                "WHEN contains(p, '€') OR contains(lower(p), 'eur') THEN 'EUR' ELSE 'GBP' END")
    number = quote(r"[\d,]+(?:\.\d+)?")
    amount = f"try_cast(replace(regexp_extract(p, {number}, 0), ',', '') AS double)"
    return F.expr(f"array_distinct(filter(transform(regexp_extract_all({text}, {quote(PRICE)}, 0), p -> concat({currency}, ':', string({amount}))), k -> k IS NOT NULL))")


def hosts_in(text: str) -> Column:
    return F.expr(f"array_distinct(regexp_extract_all(lower({text}), {quote(HOST)}, 0))")


def excerpt(text: str, length: int = 360) -> Column:
    clean = f"array_join(filter(transform(split({text}, '\\n', -1), v -> trim(v)), v -> v <> ''), ' · ')"
    return F.expr(bind(f"CASE WHEN length(_b.c) <= {length} THEN _b.c ELSE concat(rtrim(left(_b.c, {length})), '…') END", c=clean))


def candidates(engine: DataFrame, fallback: DataFrame, captures: DataFrame, questions: DataFrame, edges: DataFrame, window_limit: int | None = 30) -> DataFrame:
    """Engine hits (or the plain search where there are none) and captures of the asked period, with their flags.

    ``engine``/``fallback``: query_id, capture_id, engine_rank; ``questions``: query_id, entity, keyword, start_s, end_s.
    """
    engine, fallback = checkpointed(engine), checkpointed(fallback)
    empty_ids = questions.select("query_id").join(engine.select("query_id"), "query_id", "left_anti")
    found = engine.unionByName(fallback.join(empty_ids, "query_id", "left_semi"))
    names = checkpointed(edges.select("capture_id", F.lower("display").alias("label"), "normalized").distinct())
    about = questions.filter("entity IS NOT NULL").select("query_id", F.lower("entity").alias("entity"))
    # Labels are matched once per distinct label, then spread to captures by equality.
    vocabulary = names.select("label", "normalized").distinct().join(F.broadcast(about), F.contains(F.col("label"), F.col("entity")) | (F.col("normalized") == F.col("entity")))
    tagged = names.join(vocabulary.select("query_id", "label", "normalized", F.contains("label", F.col("entity")).alias("named"), (F.col("normalized") == F.col("entity")).alias("member")), ["label", "normalized"])
    flags = tagged.groupBy("query_id", "capture_id").agg(F.max("member").alias("entity_hit"), F.max("named").alias("graph_hit"))
    periods = questions.filter("start_s IS NOT NULL").select("query_id", "start_s", "end_s", "keyword", F.col("entity").isNotNull().alias("needs"))
    days = periods.select("query_id", F.explode(F.expr("sequence(start_s div 86400, (end_s - 1) div 86400)")).alias("day"))
    inside = (captures.select("capture_id", "date_added", "ocr_text", F.expr("date_added div 86400").alias("day")).join(days, "day").join(periods, "query_id")
              .filter("date_added >= start_s AND date_added < end_s AND (keyword = '' OR contains(lower(ocr_text), keyword))")
              .join(flags.filter("graph_hit").select("query_id", "capture_id", F.lit(True).alias("has_label")), ["query_id", "capture_id"], "left")
              .filter("NOT needs OR has_label"))
    w = Window.partitionBy("query_id").orderBy(F.desc("date_added"), F.desc("capture_id"))
    if window_limit is not None:
        inside = inside.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= window_limit)
    extra = (inside.join(found.select("query_id", "capture_id"), ["query_id", "capture_id"], "left_anti")
             .select("query_id", "capture_id", F.lit(None).cast("int").alias("engine_rank"), F.col("needs").alias("entity_hit"), F.lit(True).alias("temporal_hit"), F.lit(False).alias("graph_hit")))
    no = F.lit(False)
    ranked = (found.join(flags, ["query_id", "capture_id"], "left").join(captures.select("capture_id", "date_added"), "capture_id")
              .join(periods.select("query_id", "start_s", "end_s"), "query_id", "left")
              .select("query_id", "capture_id", "engine_rank", F.coalesce("entity_hit", no).alias("entity_hit"),
                      F.coalesce(F.expr("date_added >= start_s AND date_added < end_s"), no).alias("temporal_hit"), F.coalesce("graph_hit", no).alias("graph_hit")))
    return ranked.unionByName(extra)


def rank(rows: DataFrame, limit: int | None = 8, w: EvidenceWeights = EvidenceWeights()) -> DataFrame:
    """Evidence score per question; equal scores keep the engine's order."""
    counts = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    engine = F.when(F.col("engine_rank").isNull(), 0.0).otherwise(1.0 - F.col("engine_rank") / F.col("n"))
    score = (w.engine * engine + F.when(F.col("entity_hit"), w.entity).otherwise(0.0) + F.when(F.col("temporal_hit"), w.temporal).otherwise(0.0)
             + F.when(F.col("graph_hit"), w.graph).otherwise(0.0))
    scored = rows.join(counts, "query_id").withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("engine_rank"), "capture_id")
    out = scored.withColumn("rank", F.row_number().over(order)).drop("n")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def evidence(captures: DataFrame) -> DataFrame:
    """Excerpt, prices, hosts and sensitivity of each capture."""
    return captures.select("capture_id", "date_added", excerpt("ocr_text").alias("excerpt"), price_keys("ocr_text").alias("prices"),
                           hosts_in("ocr_text").alias("hosts"), sensitivity_level(sensitive_kinds(F.col("ocr_text"))).alias("sensitivity"))


def compare(rows: DataFrame, by: str) -> DataFrame:
    """Distinct prices and hosts of each set; the sets of values are small by nature of a comparison."""
    prices = rows.select(by, F.explode("prices").alias("v")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("v")).alias("prices"))
    hosts = rows.select(by, F.explode("hosts").alias("v")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("v")).alias("hosts"))
    return rows.groupBy(by).agg(F.count("*").alias("n")).join(prices, by, "left").join(hosts, by, "left")


def ground(answers: DataFrame, evidence_rows: DataFrame) -> DataFrame:
    """Drop sentences whose price, year, host or count the evidence does not hold.

    ``answers``: question_id, answer; ``evidence_rows``: question_id, date_added, prices, hosts, sensitivity.
    """
    sentences = answers.select("question_id", F.posexplode(F.split("answer", r"(?<=[.!?])\s+", -1)).alias("pos", "sentence"))
    claims = sentences.select("question_id", "pos", F.explode(F.concat(
        F.transform(price_keys("sentence"), lambda v: F.struct(F.lit("price").alias("kind"), v.alias("v"))),
        F.transform(F.regexp_extract_all("sentence", F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda v: F.struct(F.lit("year").alias("kind"), v.alias("v"))),
        F.transform(hosts_in("sentence"), lambda v: F.struct(F.lit("host").alias("kind"), v.alias("v"))),
        F.transform(F.slice(F.regexp_extract_all("sentence", F.lit(r"(?i)\b(\d+)\s+screenshots?\b"), F.lit(1)), 1, 1), lambda v: F.struct(F.lit("count").alias("kind"), v.alias("v"))),
    )).alias("c")).select("question_id", "pos", "c.kind", "c.v")
    known = evidence_rows.select("question_id", F.explode(F.concat(
        F.transform("prices", lambda v: F.struct(F.lit("price").alias("kind"), v.alias("v"))),
        F.array(F.struct(F.lit("year").alias("kind"), F.year(F.timestamp_seconds("date_added")).cast("string").alias("v"))),
        F.transform("hosts", lambda v: F.struct(F.lit("host").alias("kind"), v.alias("v"))))).alias("k")).select("question_id", "k.kind", "k.v").distinct()
    exact = claims.filter("kind IN ('price', 'year')").join(known, ["question_id", "kind", "v"], "left_anti").select("question_id", "pos")
    h = known.filter("kind = 'host'").select(F.col("question_id").alias("q2"), F.col("v").alias("known_host"))
    hosts = claims.filter("kind = 'host'").join(h, (F.col("question_id") == F.col("q2")) & F.endswith("known_host", F.col("v")), "left_anti").select("question_id", "pos")
    sizes = evidence_rows.groupBy("question_id").agg(F.count("*").alias("n"), F.max(F.col("sensitivity") != "NORMAL").alias("sensitive"))
    counts = (claims.filter("kind = 'count'").join(sizes, "question_id", "left").filter(F.col("v").try_cast("bigint") > F.coalesce("n", F.lit(0))).select("question_id", "pos"))
    wrong = exact.unionByName(hosts).unionByName(counts).distinct()
    marked = sentences.join(wrong.withColumn("wrong", F.lit(True)), ["question_id", "pos"], "left")
    kept = marked.groupBy("question_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("wrong").isNull(), F.struct("pos", "sentence")))), lambda s: s["sentence"]), " ").alias("text"),
        F.count("wrong").alias("removed"))
    out = kept.join(sizes.select("question_id", "sensitive"), "question_id", "left").withColumn("text", F.trim("text"))
    leak = F.coalesce("sensitive", F.lit(False)) & F.col("text").rlike(lx.LEAK)
    return out.select("question_id", F.when(leak, MASKED).when(F.col("text") == "", NOTHING_VERIFIED).otherwise(F.col("text")).alias("validated"),
                      ((F.col("removed") == 0) & ~leak).alias("passed"), "removed")


def confidence(n: Column) -> Column:
    return F.when(n == 0, "NO_MATCH").when(n == 1, "FOUND_ONE").otherwise("FOUND_MULTIPLE")


def snapshot(name: str, ids: DataFrame) -> DataFrame:
    return ids.select("capture_id").dropDuplicates().withColumn("snapshot", F.lit(name))
