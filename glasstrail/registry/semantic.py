"""Embeddings, categories, concepts, groups and summaries."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import extract as x, vectors as vec
from ..operators import semantic as op
from ..sources.captures import spread
from .core import Inputs, query, shared

shared("cat_f", """
  SELECT o_orderkey AS capture_id,
    CASE o_orderkey % 8 WHEN 0 THEN 'SHOPPING' WHEN 1 THEN 'FLIGHTS' WHEN 3 THEN 'SHOPPING' WHEN 4 THEN 'RECEIPTS' WHEN 6 THEN 'TECHNOLOGY' ELSE 'OTHER' END AS category,
    CASE o_orderkey % 8 WHEN 0 THEN 3.5::DOUBLE / 10 WHEN 1 THEN 3.0::DOUBLE / 9 WHEN 3 THEN 0.15::DOUBLE WHEN 4 THEN 0.15::DOUBLE WHEN 6 THEN 1.5::DOUBLE / 5.3 ELSE 1.0::DOUBLE END AS confidence
  FROM orders""")


def categories(i: Inputs):
    t = F.col("ocr_text")
    facts = spread(i.cap.select("capture_id", "ocr_text")).select(
        "capture_id", "ocr_text", F.transform(x.urls(t), lambda u: u["host"]).alias("hosts"),
        (F.size(x.prices(t)) > 0).alias("has_price"), (F.size(x.codes(t)) > 0).alias("has_code"))
    return op.classify(facts, "capture_id", "ocr_text", "hosts", "has_price", "has_code")


def features_sql(source: str, key: str, text: str) -> str:
    """SQL for ``(key, feature)`` with repeats."""
    return f"""
      SELECT {key}, unnest(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))),
          flatten(list_transform(w, lambda v: list_transform(range(1, length(v) + 1), lambda k: substr(concat('^', v, '$'), k, 3)))))) AS feature
      FROM (SELECT {key}, list_filter(list_transform(string_split_regex(lower({text}), '\\s+'), lambda v: regexp_replace(v, '[^\\pL\\p{{Nd}}]', '', 'g')), lambda v: length(v) >= 2) AS w FROM {source})"""


def embed_sql(source: str, key: str, text: str) -> str:
    """SQL for the sparse unit vectors ``(key, dim, w)``."""
    fnv = """CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(feature, ''), lambda c: unicode(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 512 AS INTEGER)"""
    return f"""
      SELECT {key}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, dim, sum(1 + ln(n)) AS w FROM (SELECT {key}, feature, count(*) AS n FROM ({features_sql(source, key, text)}) GROUP BY 1, 2)
        JOIN (SELECT feature, {fnv} AS dim FROM (SELECT DISTINCT feature FROM ({features_sql(source, key, text)}))) USING (feature) GROUP BY 1, 2)"""


@query("sem_features", f"SELECT doc_id, feature, count(*) AS n FROM ({features_sql('documents', 'doc_id', 'text')}) GROUP BY 1, 2")
def sem_features(i: Inputs):
    return op.feature_counts(i.documents, "doc_id", F.col("text"))


@query("sem_embed", f"SELECT doc_id, dim, round(w, 6) AS w FROM ({embed_sql('documents', 'doc_id', 'text')})")
def sem_embed(i: Inputs):
    return op.embed(i.documents, "doc_id", F.col("text")).select("doc_id", "dim", F.round("w", 6).alias("w"))


@query("sem_embeddable_text", "SELECT capture_id, concat(ocr_text, chr(10), capture_id) AS body FROM cap")
def sem_embeddable_text(i: Inputs):
    return i.cap.select("capture_id", vec.embeddable_text(F.col("ocr_text"), F.col("filename")).alias("body"))


@query("sem_cosine", """
  WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS e FROM n)
  SELECT a.vec_id, round(greatest(-1.0, least(1.0, list_dot_product(a.e, b.e))), 6) AS similarity FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def sem_cosine(i: Inputs):
    unit = i.embeddings.select("vec_id", vec.normalised(F.col("embedding")).alias("vector"), F.lit("driver").alias("model"),
                               F.lit("1").alias("version"), F.size("embedding").alias("dimension"))
    shifted = unit.withColumn("vec_id", F.col("vec_id") - 1)
    return op.similarity_join(unit, shifted, ["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


QUESTIONS = ["phone deal", "flight booking to mumbai", "verification code", "headphones festival offer", "github pull request", "upi payment", "usb cable order"]


def question_frame(i: Inputs):
    return i.spark.createDataFrame(list(enumerate(QUESTIONS, 1)), "query_id long, text string")


def _concept_values() -> str:
    return ", ".join(f"('{w}', '{c}', {p})" for c, words in lx.CONCEPTS.items() for p, w in enumerate(words.split()))


shared("concepts", f"SELECT * FROM (VALUES {_concept_values()}) AS t(word, concept, pos)")
shared("questions", "SELECT CAST(row_number() OVER () AS BIGINT) AS query_id, text FROM (SELECT unnest([" + ", ".join(f"'{q}'" for q in QUESTIONS) + "]) AS text)")
shared("q_terms", "SELECT DISTINCT query_id, unnest(string_split(lower(text), ' ')) AS word FROM questions")
_CONCEPT_RANK = """
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, named DESC, concept) AS rank FROM (
    SELECT {key}, concept, sum(s) AS score, max(named) AS named FROM (
      SELECT {key}, concept, CASE WHEN concept = word THEN 2 ELSE 1 END AS s, CASE WHEN concept = word THEN 1 ELSE 0 END AS named FROM {terms} JOIN concepts USING (word)
      UNION ALL SELECT {key}, concept, 2, 1 FROM {terms} JOIN (SELECT DISTINCT concept FROM concepts) ON concept = word) GROUP BY 1, 2)"""
shared("q_concept", "SELECT * FROM (" + _CONCEPT_RANK.format(key="query_id", terms="q_terms") + ") WHERE rank <= 3")
shared("q_expand", """
  SELECT query_id, word, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY cr, pos) AS rank FROM (
    SELECT query_id, c.word, min((k.rank * 1000 + c.pos)) AS cr, 0 AS pos FROM q_concept k JOIN concepts c USING (concept)
    WHERE NOT EXISTS (SELECT 1 FROM q_terms t WHERE t.query_id = k.query_id AND t.word = c.word) GROUP BY 1, 2)) WHERE rank <= 12""")

shared("cap_terms", "SELECT DISTINCT capture_id, word FROM (SELECT capture_id, unnest(string_split_regex(lower(ocr_text), '[^a-z0-9]+')) AS word FROM cap) WHERE word <> ''")


def capture_terms(i: Inputs):
    words = F.filter(F.split(F.lower("ocr_text"), "[^a-z0-9]+", -1), lambda w: w != "")
    return i.cap.select(F.col("capture_id").alias("query_id"), F.explode(words).alias("term"))


@query("sem_concepts", "SELECT capture_id, concept, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM (" + _CONCEPT_RANK.format(key="capture_id", terms="cap_terms") + ") WHERE rank <= 3")
def sem_concepts(i: Inputs):
    """Concepts of every capture text."""
    out = op.query_concepts(capture_terms(i), op.concept_table(i.spark))
    return out.select(F.col("query_id").alias("capture_id"), "concept", "score", "rank")


@query("sem_expand", """
  WITH k AS (SELECT * FROM (""" + _CONCEPT_RANK.format(key="capture_id", terms="cap_terms") + """) WHERE rank <= 3)
  SELECT capture_id, word, CAST(r AS INTEGER) AS rank FROM (SELECT capture_id, word, row_number() OVER (PARTITION BY capture_id ORDER BY o) AS r FROM (
    SELECT capture_id, c.word, min(k.rank * 1000 + c.pos) AS o FROM k JOIN concepts c USING (concept)
    WHERE NOT EXISTS (SELECT 1 FROM cap_terms t WHERE t.capture_id = k.capture_id AND t.word = c.word) GROUP BY 1, 2)) WHERE r <= 12""")
def sem_expand(i: Inputs):
    """Expansion words of every capture text."""
    out = op.expand_terms(capture_terms(i), op.concept_table(i.spark))
    return out.select(F.col("query_id").alias("capture_id"), "word", "rank")


shared("cap_vec", embed_sql("(SELECT capture_id, concat(ocr_text, chr(10), capture_id) AS body FROM cap)", "capture_id", "body"))
shared("q_vec", embed_sql("questions", "query_id", "text"))
shared("sem_hits", """
  SELECT query_id, capture_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, capture_id) AS rank FROM (
    SELECT q.query_id, d.capture_id, sum(q.w * d.w) AS sim FROM q_vec q JOIN cap_vec d USING (dim)
    WHERE EXISTS (SELECT 1 FROM cap_terms t WHERE t.capture_id = d.capture_id AND (
        t.word IN (SELECT word FROM q_terms z WHERE z.query_id = q.query_id) OR t.word IN (SELECT word FROM q_expand z WHERE z.query_id = q.query_id AND z.rank + (SELECT count(*) FROM q_terms y WHERE y.query_id = q.query_id) <= 15)))
    GROUP BY 1, 2) WHERE sim >= 0.25""")


@query("sem_search", "SELECT query_id, capture_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM sem_hits WHERE rank <= 60")
def sem_search(i: Inputs):
    hits = op.search(question_frame(i), i.cap, op.concept_table(i.spark), limit=60, max_terms=15)
    return hits.select("query_id", "capture_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("sem_search_all", """
  SELECT query_id, capture_id, round(sim, 6) AS similarity FROM (
    SELECT q.query_id, d.capture_id, sum(q.w * d.w) AS sim FROM q_vec q JOIN cap_vec d USING (dim)
    WHERE EXISTS (SELECT 1 FROM cap_terms t WHERE t.capture_id = d.capture_id AND t.word IN (
        SELECT z.word FROM q_terms z WHERE z.query_id = q.query_id UNION ALL SELECT c.word FROM concepts c JOIN (
          SELECT z.query_id, y.concept FROM q_terms z JOIN concepts y ON y.word = z.word OR y.concept = z.word) k ON k.concept = c.concept WHERE k.query_id = q.query_id))
    GROUP BY 1, 2) WHERE sim >= 0.25""")
def sem_search_all(i: Inputs):
    hits = op.search(question_frame(i), i.cap, op.concept_table(i.spark))
    return hits.select("query_id", "capture_id", F.round("similarity", 6).alias("similarity"))


@query("sem_similar", """
  WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
    u AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda z: z * z)))) AS e FROM n),
    p AS (SELECT label, max(vec_id) AS probe_id FROM u GROUP BY 1)
  SELECT probe_id, vec_id, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
    SELECT probe_id, vec_id, sim, row_number() OVER (PARTITION BY probe_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM (
      SELECT p.probe_id, a.vec_id, list_dot_product(a.e, b.e) AS sim FROM p JOIN u b ON b.vec_id = p.probe_id JOIN u a ON a.label = p.label AND a.vec_id <> p.probe_id))
  WHERE rank <= 8""")
def sem_similar(i: Inputs):
    """Nearest neighbours of the newest member of every category."""
    unit = i.embeddings.select("vec_id", "label", vec.normalised(F.col("embedding")).alias("vector"))
    probes = unit.groupBy("label").agg(F.max_by(F.struct("vec_id", "vector"), "vec_id").alias("p")).select("label", "p.vec_id", "p.vector")
    return op.nearest_in_group(unit, probes, "label", "vec_id").select("probe_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("sem_classify", "SELECT capture_id, category, round(confidence, 6) AS confidence, CAST(1 AS INTEGER) AS rank FROM cat_f")
def sem_classify(i: Inputs):
    return categories(i).select("capture_id", "category", F.round("confidence", 6).alias("confidence"), "rank")


@query("sem_effective_category", """
  SELECT doc_id, category, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY (source <> 'user'), confidence DESC, category) AS INTEGER) AS rank FROM (
    SELECT doc_id, 'MESSAGES' AS category, 0.2 AS confidence, 'user' AS source FROM labels WHERE toxic = 1
    UNION ALL SELECT doc_id, 'DOCUMENTS', 0.9, 'auto' FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'OTHER', 0.5, 'auto' FROM documents)""")
def sem_effective_category(i: Inputs):
    def rows(df, category, confidence, source):
        return df.select(F.col("doc_id").alias("capture_id"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    all_rows = (rows(i.labels.filter("toxic = 1"), "MESSAGES", 0.2, "user").unionByName(rows(i.labels.filter("quality = 1"), "DOCUMENTS", 0.9, "auto"))
                .unionByName(rows(i.documents, "OTHER", 0.5, "auto")))
    return op.effective_categories(all_rows).select(F.col("capture_id").alias("doc_id"), "category", "rank")


_TOP_WORD = """(SELECT capture_id, word FROM (SELECT capture_id, word, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, word) AS rn FROM (
    SELECT capture_id, word, count(*) AS n FROM (SELECT capture_id, unnest(string_split_regex(lower(ocr_text), '[^a-z0-9]+')) AS word FROM cap)
    WHERE length(word) >= 4 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ('the','and','for','with','from','this','that','have','your','screenshot','screenshots','image','photo','https','http','www','com')
    GROUP BY 1, 2)) WHERE rn <= 8)"""
shared("top_word", "SELECT * FROM " + _TOP_WORD)
shared("group_f", """
  SELECT capture_id, date_added, CASE WHEN category <> 'OTHER' THEN concat('category:', category) WHEN word IS NOT NULL THEN concat('word:', word) END AS group_key
  FROM cap JOIN cat_f USING (capture_id) LEFT JOIN (SELECT capture_id, min(word) AS word FROM top_word GROUP BY 1) USING (capture_id)""")
_LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lx.CATEGORY_LABELS.items()) + "}"


@query("sem_smart_groups", f"""
  WITH g AS (SELECT group_key, count(*) AS size, arg_max(capture_id, (date_added, capture_id)) AS cover_id FROM group_f WHERE group_key IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
    w AS (SELECT group_key, word, count(*) AS n FROM group_f JOIN top_word USING (capture_id) WHERE word NOT IN ('screenshot','image','photo','with','from','this','that') GROUP BY 1, 2),
    t AS (SELECT group_key, arg_max(word, (n, word)) AS word, max(n) AS n FROM w GROUP BY 1),
    z AS (SELECT g.*, CASE WHEN t.n >= 2 THEN concat(upper(left(t.word, 1)), substr(t.word, 2)) END AS word, split_part(g.group_key, ':', 2) AS v, starts_with(g.group_key, 'category:') AS is_cat FROM g LEFT JOIN t USING (group_key))
  SELECT group_key, size, cover_id, CASE WHEN NOT is_cat THEN coalesce(word, v) WHEN word IS NULL OR lower(word) = lower({_LABELS}[v]) THEN {_LABELS}[v]
    ELSE concat(word, ' / ', {_LABELS}[v]) END AS label FROM z ORDER BY size DESC, group_key LIMIT 12""")
def sem_smart_groups(i: Inputs):
    from ..operators.aggregates import top_words
    cats = categories(i).filter("rank = 1").select("capture_id", "category")
    words = top_words(i.cap, "capture_id", "ocr_text", 8)
    first = words.groupBy("capture_id").agg(F.min("word").alias("word"))
    hosts = i.urls.groupBy("capture_id").agg(F.min("host").alias("host"))
    members = (i.cap.select("capture_id", "date_added").join(cats, "capture_id").join(hosts, "capture_id", "left").join(first, "capture_id", "left"))
    return op.smart_groups(members, words.select("capture_id", "word"))


shared("summary_f", """
  SELECT capture_id, array_to_string(list_filter([left(ocr_text, 60), p.money, u.host, d.raw], lambda v: v IS NOT NULL), ' — ') AS summary
  FROM cap LEFT JOIN (SELECT o_orderkey AS capture_id, CASE o_orderkey % 8 WHEN 0 THEN concat('₹', regexp_replace(
      CASE WHEN floor(o_totalprice) >= 100000 THEN concat(left(CAST(floor(o_totalprice)::BIGINT AS VARCHAR), length(CAST(floor(o_totalprice)::BIGINT AS VARCHAR)) - 5), ',', substr(CAST(floor(o_totalprice)::BIGINT AS VARCHAR), -5, 2), ',', right(CAST(floor(o_totalprice)::BIGINT AS VARCHAR), 3))
      WHEN floor(o_totalprice) >= 1000 THEN concat(left(CAST(floor(o_totalprice)::BIGINT AS VARCHAR), length(CAST(floor(o_totalprice)::BIGINT AS VARCHAR)) - 3), ',', right(CAST(floor(o_totalprice)::BIGINT AS VARCHAR), 3))
      ELSE CAST(floor(o_totalprice)::BIGINT AS VARCHAR) END, '^,', '')) WHEN 1 THEN '₹6,500' WHEN 4 THEN '₹299' ELSE '₹1,250' END AS money FROM orders WHERE o_orderkey % 8 IN (0, 1, 4, 5)) p USING (capture_id)
  LEFT JOIN url_f u USING (capture_id) LEFT JOIN date_f d USING (capture_id)""")


def summaries(i: Inputs):
    t = F.col("ocr_text")
    facts = spread(i.cap.select("capture_id", "filename", "ocr_text")).select(
        "capture_id", "filename", "ocr_text", x.prices(t).alias("prices"), F.transform(x.urls(t), lambda u: u["host"]).alias("hosts"),
        F.transform(x.dates(t, _today()), lambda d: d["raw"]).alias("dates"))
    return facts.select("capture_id", op.summary(t, F.col("filename"), F.col("prices"), F.col("hosts"), F.col("dates")).alias("summary"))


def _today():
    from ..sources.captures import TODAY
    return TODAY


@query("sem_summary", "SELECT capture_id, summary FROM summary_f")
def sem_summary(i: Inputs):
    return summaries(i)


@query("sem_detail", """
  SELECT capture_id, summary, category, CASE WHEN capture_id % 8 = 2 THEN 'OTP' WHEN capture_id % 8 = 5 THEN 'PAYMENT' ELSE '' END AS kinds FROM summary_f JOIN cat_f USING (capture_id)""")
def sem_detail(i: Inputs):
    from ..functions.privacy import sensitive_kinds
    kinds = i.cap.select("capture_id", F.array_join(sensitive_kinds(F.col("ocr_text")), "|").alias("kinds"))
    cats = categories(i).filter("rank = 1").select("capture_id", "category")
    return summaries(i).join(cats, "capture_id").join(kinds, "capture_id")
