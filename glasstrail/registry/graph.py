"""Entity graph."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import graph as op
from ..operators.aggregates import top_words
from .core import Inputs, query, shared


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_MONEY = """CASE WHEN amount >= 100000 THEN concat('₹', CAST(amount AS BIGINT) // 100000, ',', lpad(CAST(CAST(amount AS BIGINT) // 1000 % 100 AS VARCHAR), 2, '0'), ',', lpad(CAST(CAST(amount AS BIGINT) % 1000 AS VARCHAR), 3, '0'))
  WHEN amount >= 1000 THEN concat('₹', CAST(amount AS BIGINT) // 1000, ',', lpad(CAST(CAST(amount AS BIGINT) % 1000 AS VARCHAR), 3, '0')) ELSE concat('₹', CAST(amount AS BIGINT)) END"""
_PRODUCT = "trim(regexp_replace(regexp_replace(word, '([a-z])([0-9])', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"
shared("edge_f", f"""
  SELECT capture_id, 'PRODUCT' AS type, {_PRODUCT} AS normalized, word AS display, 'MENTIONS' AS kind, 0.7 AS confidence FROM top_word
    WHERE word NOT IN {_in(lx.CHROME_WORDS)} AND regexp_matches(word, '[a-z]') AND (regexp_matches(word, '[0-9]') OR word IN {_in(lx.PRODUCT_NOUNS)})
  UNION ALL SELECT capture_id, 'WEBSITE', host, host, 'FOUND_ON', 0.9 FROM url_f UNION ALL SELECT capture_id, 'COMPANY', split_part(host, '.', 1), split_part(host, '.', 1), 'SOLD_BY', 0.6 FROM url_f
  UNION ALL SELECT capture_id, 'PRICE', concat(currency, ':', CAST(CAST(amount AS DOUBLE) AS VARCHAR)), {_MONEY}, 'PRICED_AT', 0.9 FROM price_f
  UNION ALL SELECT capture_id, kind, code, code, 'MENTIONS', 0.8 FROM order_f UNION ALL SELECT capture_id, 'DATE', raw, raw, 'OCCURRED_ON', 0.7 FROM date_f
  UNION ALL SELECT capture_id, 'CATEGORY', lower(category), concat(upper(left(category, 1)), lower(substr(category, 2))), 'BELONGS_TO', 0.8 FROM cat_f WHERE category <> 'OTHER'""")


def refs(i: Inputs):
    from .semantic import categories
    phrases = top_words(i.cap, "capture_id", "ocr_text", 8).select("capture_id", F.col("word").alias("phrase"), F.col("rank").alias("pos"))
    label = F.create_map(*[F.lit(v) for kv in lx.CATEGORY_LABELS.items() for v in kv])
    cats = categories(i).select("capture_id", "category", label[F.col("category")].alias("label"), F.col("rank").alias("pos"))
    return op.entity_refs(phrases, i.urls, i.prices, i.dates, i.order_codes, cats)


def edges(i: Inputs):
    return op.build_edges(refs(i))


@query("g_normalize", r"""
  SELECT page_id, regexp_replace(h, '^www\.', '') AS website, CASE WHEN len(p) <= 2 THEN p[1] WHEN p[-2] IN ('co','com','org','net','gov','edu') THEN p[-3] ELSE p[-2] END AS company,
    trim(regexp_replace(regexp_replace(h, '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\1 \2', 'g')) AS product
  FROM (SELECT page_id, h, string_split(regexp_replace(h, '^www\.', ''), '.') AS p FROM (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'www.' WHEN 1 THEN '' ELSE 'shop9.' END, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), CASE WHEN page_id % 2 = 0 THEN '' ELSE '.co.uk' END) AS h FROM pages))""")
def g_normalize(i: Inputs):
    h = F.expr("concat(CASE page_id % 3 WHEN 0 THEN 'www.' WHEN 1 THEN '' ELSE 'Shop9.' END, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), CASE WHEN page_id % 2 = 0 THEN '' ELSE '.co.uk' END)")
    rows = i.pages.select("page_id", h.alias("h"))
    return rows.select("page_id", op.website_name(F.col("h")).alias("website"), op.company_name(F.col("h")).alias("company"), op.product_name(F.col("h")).alias("product"))


@query("g_product_gate", f"""
  SELECT doc_id, word, word NOT IN {_in(lx.CHROME_WORDS)} AND regexp_matches(word, '[a-z]') AND length(word) >= 3 AND (regexp_matches(word, '[0-9]') OR word IN {_in(lx.PRODUCT_NOUNS)}) AS is_product
  FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE length(word) >= 3 AND NOT regexp_matches(word, '[a-z][0-9]')""")
def g_product_gate(i: Inputs):
    words = i.documents.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+", -1)).alias("word")).distinct()
    words = words.filter((F.length("word") >= 3) & ~F.col("word").rlike("[a-z][0-9]"))
    return words.select("doc_id", "word", op.looks_like_product(F.col("word")).alias("is_product"))


@query("g_extract_entities", "SELECT capture_id, type, normalized, display FROM edge_f")
def g_extract_entities(i: Inputs):
    return refs(i).select("capture_id", "type", "normalized", "display")


@query("g_build_edges", "SELECT capture_id, type, normalized, kind, CAST(confidence AS DOUBLE) AS confidence FROM edge_f")
def g_build_edges(i: Inputs):
    return edges(i).select("capture_id", "type", "normalized", "kind", "confidence")


@query("g_find_or_create", "SELECT type, normalized, arg_min(display, (date_added, capture_id)) AS display FROM edge_f JOIN cap USING (capture_id) GROUP BY 1, 2")
def g_find_or_create(i: Inputs):
    return op.find_or_create(edges(i), i.cap).select("type", "normalized", "display")


@query("g_replace_footprint", """
  SELECT type, count(*) AS n, count(DISTINCT normalized) AS entities FROM edge_f WHERE capture_id % 4 <> 0 OR confidence > 0.75 GROUP BY 1""")
def g_replace_footprint(i: Inputs):
    e = edges(i)
    batch = i.cap.filter("capture_id % 4 = 0").select("capture_id")
    fresh = e.join(batch, "capture_id", "left_semi").filter("confidence > 0.75")
    return op.replace_footprint(e, fresh, batch).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("normalized").alias("entities"))


@query("g_from_tables", "SELECT type, count(*) AS edges, count(DISTINCT normalized) AS entities, count(DISTINCT capture_id) AS captures FROM edge_f GROUP BY 1")
def g_from_tables(i: Inputs):
    return edges(i).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("entity_id").alias("entities"), F.countDistinct("capture_id").alias("captures"))


NAMES = ["128GB", "Amazon.in", "github", "Headphones", "nothing here", "amazon"]


@query("g_resolve", """
  SELECT name, arg_min(type, p) AS type, arg_min(normalized, p) AS normalized FROM (SELECT DISTINCT type, normalized FROM edge_f) JOIN (
    VALUES ('128GB', 0, 'PRODUCT', '128gb'), ('Amazon.in', 1, 'WEBSITE', 'amazon.in'), ('github', 2, 'COMPANY', 'github'), ('Headphones', 0, 'PRODUCT', 'headphones'), ('amazon', 2, 'COMPANY', 'amazon')) AS k(name, p, type, normalized) USING (type, normalized) GROUP BY 1""")
def g_resolve(i: Inputs):
    entities = edges(i).select("entity_id", "type", "normalized").distinct()
    names = i.spark.createDataFrame([(n,) for n in NAMES], "name string")
    return op.resolve(entities, names).select("name", "type", "normalized")


@query("g_members", """
  SELECT normalized, capture_id, CAST(rn AS INTEGER) AS rank FROM (SELECT normalized, capture_id, row_number() OVER (PARTITION BY type, normalized ORDER BY date_added DESC, capture_id DESC) AS rn
    FROM (SELECT DISTINCT type, normalized, capture_id FROM edge_f WHERE type = 'WEBSITE') JOIN cap USING (capture_id)) WHERE rn <= 200""")
def g_members(i: Inputs):
    e = edges(i)
    wanted = e.filter("type = 'WEBSITE'").select("entity_id", "normalized").distinct()
    return op.members(e, i.cap, wanted).join(wanted, "entity_id").select("normalized", "capture_id", "rank")


@query("g_relations", "SELECT capture_id, type, display, kind FROM edge_f WHERE capture_id IN (SELECT capture_id FROM cap WHERE status = 'PENDING')")
def g_relations(i: Inputs):
    e = edges(i)
    return e.join(i.cap.filter("status = 'PENDING'").select("capture_id"), "capture_id", "left_semi").select("capture_id", "type", "display", "kind")


@query("g_labels", "SELECT capture_id, string_agg(DISTINCT lower(display), '|' ORDER BY lower(display)) AS labels FROM edge_f GROUP BY 1")
def g_labels(i: Inputs):
    return op.labels(edges(i)).select("capture_id", F.array_join("labels", "|").alias("labels"))


@query("g_entity_page", """
  WITH o AS (SELECT DISTINCT type, normalized, capture_id FROM edge_f WHERE type IN ('PRODUCT', 'WEBSITE', 'COMPANY', 'BOOKING')),
    f AS (SELECT DISTINCT o.type, o.normalized, x.type AS t, x.display AS d FROM o JOIN edge_f x USING (capture_id) WHERE x.type IN ('PRICE', 'WEBSITE', 'CATEGORY'))
  SELECT o.type, o.normalized, count(*) AS n_members, coalesce((SELECT count(*) FROM f WHERE f.type = o.type AND f.normalized = o.normalized AND t = 'PRICE'), 0) AS n_prices,
    coalesce((SELECT string_agg(d, '|' ORDER BY d) FROM f WHERE f.type = o.type AND f.normalized = o.normalized AND t = 'WEBSITE'), '') AS websites,
    coalesce((SELECT string_agg(d, '|' ORDER BY d) FROM f WHERE f.type = o.type AND f.normalized = o.normalized AND t = 'CATEGORY'), '') AS categories FROM o GROUP BY 1, 2""")
def g_entity_page(i: Inputs):
    from ..session import checkpointed
    e = checkpointed(edges(i))
    names = e.select("entity_id", "type", "normalized").distinct()
    pages = op.entity_pages(e, ["PRODUCT", "WEBSITE", "COMPANY", "BOOKING"]).join(names, "entity_id")
    return pages.select("type", "normalized", "n_members", F.coalesce("n_prices", F.lit(0)).alias("n_prices"), F.coalesce(F.array_join("websites", "|"), F.lit("")).alias("websites"),
                        F.coalesce(F.array_join("categories", "|"), F.lit("")).alias("categories"))


@query("g_more_about", "SELECT capture_id, filename, ocr_text FROM cap WHERE capture_id IN (SELECT capture_id FROM edge_f WHERE type = 'COMPANY' AND normalized = 'github')")
def g_more_about(i: Inputs):
    e = edges(i).filter("type = 'COMPANY' AND normalized = 'github'").select("capture_id")
    return i.cap.join(e, "capture_id", "left_semi").select("capture_id", "filename", "ocr_text")
