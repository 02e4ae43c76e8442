"""Ranking and fusion."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import closeness_sql, recency_sql
from ..operators import ranking as op, visual
from ..plans import search as plan
from ..weights import HybridWeights
from .core import SHARED, Inputs, query, shared
from .fulltext import documents, query_frame

# Lexical scores by brute force over every answered pair.
_NORM = "lower(trim(regexp_replace(ocr_text, '\\s+', ' ', 'g')))"
shared("scored", f"""
  SELECT *, CAST(CASE WHEN len(terms) = 0 THEN 0 WHEN nh = len(terms) THEN 60 WHEN nh >= ceil(len(terms) * 0.6) THEN 40 ELSE 0 END + CASE WHEN nh > 0 THEN 10 ELSE 0 END
    + 100 * len(list_filter(phrases, lambda p: contains({_NORM}, p) OR contains(replace({_NORM}, ' ', ''), replace(p, ' ', ''))))
    + CASE WHEN len(list_filter(terms, lambda t: contains(lower(filename), t))) > 0 THEN 20 ELSE 0 END
    + CASE WHEN kind IS NOT NULL AND coalesce(amount BETWEEN pmin AND pmax, false) THEN 50 ELSE 0 END + CASE WHEN host IS NOT NULL AND coalesce(chost = host, false) THEN 40 ELSE 0 END
    + CASE WHEN code IS NOT NULL AND coalesce(ccode = code, false) THEN 50 ELSE 0 END + CASE WHEN start_s IS NOT NULL AND date_added >= start_s AND date_added < end_s THEN 30 ELSE 0 END AS BIGINT) AS score
  FROM (SELECT *, len(list_filter(terms, lambda t: contains({_NORM}, t) OR contains(lower(filename), t))) AS nh FROM answers)""")
shared("top50", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, date_added DESC, capture_id) AS rank FROM scored) WHERE rank <= 50")


def scored(i: Inputs, reasons: bool = True):
    return plan.ladder(documents(i), query_frame(i), reasons=reasons)


def best(i: Inputs):
    return plan.best(documents(i), query_frame(i), 50)


@query("rank_lexical", "SELECT query_id, score, count(*) AS n, sum(capture_id)::BIGINT AS ids FROM scored GROUP BY 1, 2")
def rank_lexical(i: Inputs):
    return scored(i, reasons=False).groupBy("query_id", F.col("score").cast("bigint").alias("score")).agg(F.count("*").alias("n"), F.sum("capture_id").alias("ids"))


@query("rank_recency", f"SELECT event_id, CAST(trunc(6 * (1 - least(greatest(floor((1706745600 - floor(epoch(ts))) / 86400), 0) / 365.0, 1))) AS INTEGER) AS bonus FROM (SELECT event_id, ts - INTERVAL 1 DAY * (event_id % 700) AS ts FROM events)")
def rank_recency(i: Inputs):
    e = i.events.selectExpr("event_id", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) - 86400 * (event_id % 700) AS e")
    return e.select("event_id", F.expr(recency_sql("e", 1706745600, 6)).alias("bonus"))


@query("price_closeness", """
  SELECT capture_id, round(CASE WHEN amount BETWEEN 5000 AND 60000 THEN 1 ELSE greatest(0.0, 1 - (CASE WHEN amount < 5000 THEN 5000 - amount ELSE amount - 60000 END) / (2 * 55000.0)) END, 6) AS closeness FROM price_f""")
def price_closeness(i: Inputs):
    rows = i.prices.select("capture_id", F.expr("named_struct('currency', currency, 'amount', amount)").alias("p"),
                           F.expr("named_struct('kind', 'RANGE', 'currency', 'INR', 'min', 5000D, 'max', 60000D)").alias("f"))
    return rows.select("capture_id", F.round(F.expr(closeness_sql("f", "p")), 6).alias("closeness"))


@query("rank_order", "SELECT query_id, capture_id, score, CAST(rank AS INTEGER) AS rank FROM top50")
def rank_order(i: Inputs):
    return best(i).select("query_id", "capture_id", F.col("score").cast("bigint").alias("score"), "rank")


@query("match_reasons", """
  SELECT query_id, capture_id, array_to_string(list_filter([CASE WHEN len(h) > 0 THEN concat(h[1], '␟TERM') END,
      CASE WHEN len(phrases) > 0 AND contains(lower(ocr_text), phrases[1]) THEN concat(phrases[1], '␟PHRASE') END,
      CASE WHEN coalesce(amount BETWEEN pmin AND pmax, false) THEN concat(money, '␟PRICE') END, CASE WHEN coalesce(chost = host, false) THEN concat(host, '␟URL') END,
      CASE WHEN coalesce(ccode = code, false) THEN 'One-time code␟OTP' END, CASE WHEN query_id = 1 THEN '1998␟DATE' END,
      CASE WHEN list_contains(types, 'DUPLICATES') AND list_contains(ctypes, 'DUPLICATES') THEN 'Duplicate␟DUPLICATE' END], lambda v: v IS NOT NULL), '|') AS reasons
  FROM (SELECT *, list_filter(terms, lambda t: contains(lower(ocr_text), t)) AS h,
      CASE WHEN amount >= 100000 THEN concat('₹', CAST(amount AS BIGINT) // 100000, ',', lpad(CAST(CAST(amount AS BIGINT) // 1000 % 100 AS VARCHAR), 2, '0'), ',', lpad(CAST(CAST(amount AS BIGINT) % 1000 AS VARCHAR), 3, '0'))
        WHEN amount >= 1000 THEN concat('₹', CAST(amount AS BIGINT) // 1000, ',', lpad(CAST(CAST(amount AS BIGINT) % 1000 AS VARCHAR), 3, '0')) ELSE concat('₹', CAST(amount AS BIGINT)) END AS money FROM top50)""")
def match_reasons(i: Inputs):
    return best(i).select("query_id", "capture_id", F.array_join("reasons", "|").alias("reasons"))


# Hybrid inputs: vector similarity from the free-text questions, colours and hashes from the visuals.
shared("hyb", """
  SELECT t.query_id, t.capture_id, t.score, t.date_added, least(1.0, t.score / 256.0) * 100 AS lexical, CASE WHEN asked = 0 THEN 0 ELSE met / asked END AS metadata,
    CASE WHEN list_contains(v.colors, 'blue') THEN 1.0 ELSE 0.0 END AS overlap,
    greatest(0.0, 1 - bit_count(xor(v.dhash, p.dhash)) / 24.0) AS near, bit_count(xor(v.dhash, p.dhash)) AS bits, v.colors,
    CASE WHEN len(wanted) = 0 OR len(labels) = 0 THEN 0 ELSE len(list_filter(wanted, lambda w: len(list_filter(labels, lambda l: contains(l, w) OR contains(w, l))) > 0)) / len(wanted) END AS entity, wanted, labels
  FROM (SELECT *, (kind IS NOT NULL)::INT + (host IS NOT NULL)::INT + (code IS NOT NULL)::INT + (start_s IS NOT NULL)::INT AS asked,
      coalesce(amount BETWEEN pmin AND pmax, false)::INT + coalesce(chost = host, false)::INT + coalesce(ccode = code, false)::INT + (start_s IS NOT NULL)::INT AS met,
      list_distinct(list_concat(list_concat(phrases, terms), CASE WHEN host IS NULL THEN [] ELSE [host] END)) AS wanted, CASE WHEN chost IS NULL THEN [] ELSE [chost] END AS labels FROM top50) t
  JOIN vis v USING (capture_id) CROSS JOIN (SELECT dhash FROM vis WHERE capture_id = (SELECT min(capture_id) FROM vis)) p""")


def _signals(i: Inputs, found, slim: bool = False):
    """What ``hybrid`` needs; ``slim`` works out the signals of text and names first, so ids, numbers and colours alone are moved to the visuals."""
    from .visual import visuals
    v = visuals(i).select("capture_id", "colors", "dhash")
    probe = v.agg(F.min_by("dhash", "capture_id").alias("query_hash")).withColumn("scope", F.lit(1))
    rows = found.withColumn("q", F.col("q").withField("colors", F.array(F.lit("blue"))))
    rows = rows.withColumns({"labels": F.col("d.hosts"), "similarity": F.lit(0.0), "scope": F.lit(1), "date_added": F.col("d.date_added")})
    if slim:
        rows = rows.select("query_id", "capture_id", "score", "date_added", "similarity", "scope", F.expr(op.metadata_share_sql("reasons")).alias("metadata"),
                           F.expr(op.entity_score_sql(op.NAMED, "labels")).alias("entity"), F.struct("q.colors").alias("q"))
    return rows.join(v, "capture_id").join(F.broadcast(probe), "scope")


def _hybrid(i: Inputs):
    return op.hybrid(_signals(i, best(i)))


@query("hybrid_score", "SELECT query_id, capture_id, round(lexical * 0.4 + metadata * 100 * 0.2 + greatest(overlap, near) * 100 * 0.1 + entity * 100 * 0.05, 6) AS hybrid FROM hyb")
def hybrid_score(i: Inputs):
    return _hybrid(i).select("query_id", "capture_id", F.round("hybrid", 6).alias("hybrid"))


#: Settings of the sweep: the default one, words first, pictures and names first.
SETTINGS = {"default": HybridWeights(), "words": HybridWeights(0.7, 0.1, 0.1, 0.05, 0.05, 400.0), "looks": HybridWeights(0.2, 0.1, 0.2, 0.3, 0.2, 128.0)}

shared("hyb_all", SHARED["hyb"].replace("FROM top50)", "FROM scored)"))


@query("hybrid_sweep", f"""
  SELECT setting, query_id, capture_id, hybrid, row_number() OVER (PARTITION BY setting, query_id ORDER BY hybrid DESC, score DESC, date_added DESC, capture_id) AS rank FROM (
    SELECT setting, query_id, capture_id, score, date_added,
      round((least(1.0, score / ceiling) * 100 * wl + metadata * 100 * wm + greatest(overlap, near) * 100 * wv + entity * 100 * we) / (wl + ws + wm + wv + we), 6) AS hybrid
    FROM hyb_all CROSS JOIN (VALUES {", ".join(f"('{k}', {w.lexical}::DOUBLE, {w.semantic}::DOUBLE, {w.metadata}::DOUBLE, {w.visual}::DOUBLE, {w.entity}::DOUBLE, {w.lexical_ceiling}::DOUBLE)" for k, w in SETTINGS.items())})
      AS s(setting, wl, ws, wm, wv, we, ceiling))""")
def hybrid_sweep(i: Inputs):
    """Every answered row, none cut, under three settings; its rows come from the ladder, so the similarity is 0 as in ``hybrid_score``."""
    return op.weight_sweep(_signals(i, scored(i), slim=True), SETTINGS, digits=6)


@query("metadata_share", "SELECT query_id, capture_id, round(metadata, 6) AS share FROM hyb")
def metadata_share(i: Inputs):
    return _hybrid(i).select("query_id", "capture_id", F.round("metadata", 6).alias("share"))


@query("palette_overlap", "SELECT capture_id, round((list_contains(colors, 'blue')::INT + list_contains(colors, 'pink')::INT) / 2, 6) AS share FROM vis")
def palette_overlap(i: Inputs):
    from ..functions.scoring import palette_overlap_sql
    from .visual import visuals
    return visuals(i).select("capture_id", F.round(F.expr(palette_overlap_sql("array('Blue', 'pink')", "colors")), 6).alias("share"))


@query("visual_score", "SELECT query_id, capture_id, round(greatest(overlap, near), 6) AS visual FROM hyb")
def visual_score(i: Inputs):
    return _hybrid(i).select("query_id", "capture_id", F.round("visual", 6).alias("visual"))


@query("entity_score", "SELECT query_id, capture_id, round(entity, 6) AS entity FROM hyb")
def entity_score(i: Inputs):
    return _hybrid(i).select("query_id", "capture_id", F.round("entity", 6).alias("entity"))


@query("multimodal_reasons", """
  SELECT query_id, capture_id, array_to_string(list_filter([CASE WHEN overlap > 0 THEN 'Blue tones␟VISUAL' END, CASE WHEN bits <= 16 THEN 'Visually similar␟VISUAL' END,
    CASE WHEN entity > 0 THEN concat(labels[1], '␟ENTITY') END], lambda v: v IS NOT NULL), '|') AS reasons FROM hyb""")
def multimodal_reasons(i: Inputs):
    rows = _hybrid(i).withColumn("wanted", F.expr("array_distinct(transform(concat(q.phrases, q.terms, q.hosts), x -> lower(x)))"))
    reasons = op.multimodal_reasons(F.col("q.colors"), F.col("colors"), F.col("query_hash"), F.col("dhash"), F.col("wanted"), F.col("labels"))
    return rows.select("query_id", "capture_id", F.array_join(reasons, "|").alias("reasons"))


# The first seven questions share ids with the structured queries, so both result sets join by query_id.
shared("vec60", "SELECT query_id, capture_id, sim FROM sem_hits WHERE rank <= 60")


def _vectors(i: Inputs):
    from ..operators import semantic
    from .semantic import question_frame
    return semantic.search(question_frame(i), i.cap, semantic.concept_table(i.spark), limit=60, max_terms=15).select("query_id", "capture_id", "similarity")


@query("semantic_union", """
  SELECT query_id, capture_id, coalesce(t.score, 0) AS score, round(coalesce(v.sim, 0), 6) AS similarity FROM top50 t LEFT JOIN vec60 v USING (query_id, capture_id)
  UNION ALL SELECT query_id, capture_id, 0, round(sim, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, capture_id) AS rn FROM vec60 v
    WHERE NOT EXISTS (SELECT 1 FROM top50 t WHERE t.query_id = v.query_id AND t.capture_id = v.capture_id) AND query_id IN (SELECT query_id FROM top50)) WHERE rn <= 20""")
def semantic_union(i: Inputs):
    lexical = best(i).select("query_id", "capture_id", F.col("score").cast("bigint").alias("score"))
    return op.semantic_union(lexical, _vectors(i), 20).select("query_id", "capture_id", "score", F.round("similarity", 6).alias("similarity"))


@query("semantic_fallback", "SELECT query_id, capture_id, round(sim, 6) AS similarity FROM vec60 WHERE query_id NOT IN (SELECT query_id FROM top50 WHERE rung = 0)")
def semantic_fallback(i: Inputs):
    lexical = scored(i).filter("rung = 'EXACT'")
    from .semantic import question_frame
    out = op.semantic_fallback(question_frame(i), lexical, _vectors(i))
    return out.select("query_id", "capture_id", F.round("similarity", 6).alias("similarity"))


@query("visual_only_search", """
  SELECT v.capture_id, CAST(bit_count(xor(v.dhash, p.dhash)) AS INTEGER) AS distance, CASE WHEN bit_count(xor(v.dhash, p.dhash)) = 0 THEN 'Identical pixels' WHEN bit_count(xor(v.dhash, p.dhash)) <= 8 THEN 'Near duplicate'
    WHEN bit_count(xor(v.dhash, p.dhash)) <= 16 THEN 'Very similar' ELSE 'Similar' END AS label
  FROM vis v CROSS JOIN (SELECT * FROM vis WHERE capture_id = (SELECT min(capture_id) FROM vis)) p WHERE v.capture_id <> p.capture_id AND bit_count(xor(v.dhash, p.dhash)) <= 24
  ORDER BY distance, capture_id LIMIT 100""")
def visual_only_search(i: Inputs):
    from .visual import visuals
    v = visuals(i)
    near = visual.similar_to(v, v.orderBy("capture_id").limit(1), visual.VISUAL_ONLY_BITS, 100)
    return near.withColumn("label", visual.distance_label(F.col("distance")))


@query("distance_label", """
  SELECT label, count(*) AS n FROM (SELECT CASE WHEN d = 0 THEN 'Identical pixels' WHEN d <= 8 THEN 'Near duplicate' WHEN d <= 16 THEN 'Very similar' ELSE 'Similar' END AS label
    FROM (SELECT bit_count(xor(a.dhash, b.dhash)) AS d FROM vis a JOIN vis b ON b.capture_id = a.capture_id + 500)) GROUP BY 1""")
def distance_label(i: Inputs):
    from ..functions.vectors import hamming
    from .visual import visuals
    v = visuals(i).select("capture_id", "dhash")
    pair = v.join(v.select((F.col("capture_id") - 500).alias("capture_id"), F.col("dhash").alias("other")), "capture_id")
    return pair.groupBy(visual.distance_label(hamming(F.col("dhash"), F.col("other"))).alias("label")).agg(F.count("*").alias("n"))


_COLLAPSE_IN = "SELECT query_id, capture_id, score, date_added, CASE WHEN capture_id % 3 = 0 THEN NULL ELSE content_hash END AS content_hash, regexp_replace(ocr_text, '[0-9]+', '', 'g') AS ocr_text FROM scored"


@query("collapse_duplicates", f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, date_added DESC, capture_id) AS rn, ocr_text AS txt FROM ({_COLLAPSE_IN})),
    h AS (SELECT *, CASE WHEN content_hash IS NOT NULL THEN min(rn) OVER (PARTITION BY query_id, content_hash) END AS hrep FROM r),
    p AS (SELECT *, CASE WHEN content_hash IS NULL THEN rn = min(CASE WHEN content_hash IS NULL THEN rn END) OVER (PARTITION BY query_id, txt)
        AND rn < coalesce(min(CASE WHEN hrep = rn THEN rn END) OVER (PARTITION BY query_id, txt), 1e12) ELSE hrep = rn END AS is_rep FROM h),
    z AS (SELECT *, CASE WHEN content_hash IS NOT NULL THEN hrep ELSE max(CASE WHEN is_rep THEN rn END) OVER (PARTITION BY query_id, txt ORDER BY rn) END AS rep FROM p)
  SELECT z.query_id, z.capture_id, y.capture_id AS representative_id FROM z JOIN r y ON y.query_id = z.query_id AND y.rn = z.rep""")
def collapse_duplicates(i: Inputs):
    rows = scored(i).select("query_id", "capture_id", "score", F.col("d.date_added").alias("date_added"),
                            F.when(F.col("capture_id") % 3 != 0, F.col("d.content_hash")).alias("content_hash"),
                            F.regexp_replace("d.ocr_text", "[0-9]+", "").alias("ocr_text"))
    return op.collapse_duplicates(rows)


@query("sort_mode", """
  SELECT query_id, capture_id, CAST(rn AS INTEGER) AS rank FROM (SELECT query_id, capture_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN sort = 'NEWEST' THEN -date_added ELSE -score END, CASE WHEN sort = 'NEWEST' THEN 0 ELSE -date_added END, capture_id) AS rn FROM scored)
  WHERE rn <= 50""")
def sort_mode(i: Inputs):
    rows = scored(i, reasons=False).select("query_id", "capture_id", "score", F.col("d.date_added").alias("date_added"), F.col("q.sort").alias("sort"))
    return plan.sort_results(rows, 50).select("query_id", "capture_id", "rank")


@query("exclude_self", "SELECT query_id, capture_id FROM top50 WHERE capture_id <> (SELECT min(capture_id) FROM top50)")
def exclude_self(i: Inputs):
    rows = best(i).select("query_id", "capture_id")
    probe = rows.agg(F.min("capture_id").alias("capture_id"))
    return rows.join(F.broadcast(probe), "capture_id", "left_anti")


@query("provider_boost", """
  SELECT query_id, capture_id, CAST(rn AS INTEGER) AS rank FROM (SELECT query_id, capture_id, row_number() OVER (PARTITION BY query_id ORDER BY (capture_id % 100 = 0) DESC, score DESC, date_added DESC, capture_id) AS rn FROM scored) WHERE rn <= 50""")
def provider_boost(i: Inputs):
    rows = scored(i, reasons=False).select("query_id", "capture_id", "score", F.col("d.date_added").alias("date_added"))
    boosted = i.cap.filter("capture_id % 100 = 0").select("capture_id")
    return op.boost(rows, rows.join(boosted, "capture_id", "left_semi"), 50).select("query_id", "capture_id", "rank")


@query("search_end_to_end")
def search_end_to_end(i: Inputs):
    """Every structured query through ladder, vectors, graph labels, hybrid score, collapse and sort; query 22 also asks with an image."""
    from ..operators import semantic
    from ..plans.fusion import search_all
    from .rules import labels_of
    from .visual import visuals
    labels = labels_of(i.cap)
    probes = i.cap.agg(F.min("capture_id").alias("visual_id")).select(F.lit(22).cast("bigint").alias("query_id"), "visual_id")
    out = search_all(documents(i), query_frame(i), labels, visuals(i), probes, semantic.concept_table(i.spark))
    return out.withColumns({"score": F.col("score").cast("bigint"), "similarity": F.round("similarity", 6), "entity": F.round("entity", 6), "hybrid": F.round("hybrid", 6), "reasons": F.array_join("reasons", "|")})
