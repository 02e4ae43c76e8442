"""Visual operators. Hashes come from embedding signs with a few bits flipped per capture, pixels from events."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import extract as x, vectors as vec
from ..operators import visual as op
from ..session import checkpointed
from ..sources.captures import spread
from .core import Inputs, query, shared

_NAMES = [c[0] for c in lx.COLORS]
shared("vis", f"""
  WITH vec_count AS MATERIALIZED (SELECT count(*) AS n FROM embeddings), b AS MATERIALIZED (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << (62 - i)) ELSE 0::BIGINT END))::BIGINT AS h FROM embeddings)
  SELECT o_orderkey AS capture_id, label, xor(xor(h, 1::BIGINT << (o_custkey % 60)::INT), 1::BIGINT << ((o_orderkey // (SELECT n FROM vec_count)) % 53)::INT) AS dhash,
    list_distinct([{_NAMES}[label % 11 + 1], {_NAMES}[o_orderkey % 11 + 1]]) AS colors, label % 3 = 0 AS is_dark, o_orderkey, o_custkey
  FROM orders JOIN b ON b.vec_id = o_orderkey % (SELECT n FROM vec_count)""")


def visuals(i: Inputs):
    e = i.embeddings
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("bigint"), lambda h, k: h.bitwiseOR(
        F.when(F.col("embedding")[k] > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), 62 - k).cast("bigint")))
    base = e.select(F.col("vec_id").alias("base_id"), "label", bits.alias("h"))
    names = F.array(*[F.lit(n) for n in _NAMES])
    size = e.agg(F.count("*").alias("n")).withColumn("scope", F.lit(1))
    o = i.orders.select(F.col("o_orderkey").alias("capture_id"), F.col("o_custkey").alias("owner_id"), F.lit(1).alias("scope"))
    o = o.join(F.broadcast(size), "scope").withColumn("base_id", F.col("capture_id") % F.col("n"))
    j = o.join(base, "base_id")

    def bit(n):
        return F.pow(F.lit(2.0), n).cast("bigint")

    return j.select(
        "capture_id", "label",
        F.col("h").bitwiseXOR(bit(F.col("owner_id") % 60)).bitwiseXOR(bit(F.floor(F.col("capture_id") / F.col("n")) % 53)).alias("dhash"),
        F.array_distinct(F.array(F.get(names, F.col("label") % 11), F.get(names, (F.col("capture_id") % 11).cast("int")))).alias("colors"),
        (F.col("label") % 3 == 0).alias("is_dark"))


# Pixel table: each customer is a small image; its events, in order, are its pixels on a grid.
shared("pixels", """
  SELECT capture_id, CAST(n % 13 AS INTEGER) AS x, CAST(n // 13 AS INTEGER) AS y, CAST((p * 7 + n * 11) % 256 AS INTEGER) AS r, CAST((p * 3) % 256 AS INTEGER) AS g, CAST((q * 5 + p) % 256 AS INTEGER) AS b
  FROM (SELECT capture_id, p, CAST(q AS BIGINT) AS q, row_number() OVER (PARTITION BY capture_id ORDER BY o, l, p, q, e) - 1 AS n
    FROM (SELECT l_suppkey + 0 AS capture_id, l_partkey + 0 AS p, l_quantity + 0 AS q, l_orderkey + 0 AS o, l_linenumber + 0 AS l, l_extendedprice + 0 AS e FROM lineitem))""")


def pixels(i: Inputs):
    from .core import SHARED
    sql = SHARED["pixels"].replace("//", "div").replace("FROM lineitem", "FROM {lineitem}")
    return i.spark.sql(sql, lineitem=i.lineitem)


shared("grid", """
  WITH s AS (SELECT capture_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), t AS (SELECT tx, ty FROM range(9) a(tx), range(8) b(ty))
  SELECT capture_id, tx, ty, CAST(sum((r * 77 + g * 150 + b * 29) >> 8) // count(*) AS BIGINT) AS value FROM pixels JOIN s USING (capture_id), t
  WHERE x >= tx * w // 9 AND x < greatest((tx + 1) * w // 9, tx * w // 9 + 1) AND y >= ty * h // 8 AND y < greatest((ty + 1) * h // 8, ty * h // 8 + 1) GROUP BY 1, 2, 3""")


@query("vis_downscale", "SELECT capture_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, value FROM grid")
def vis_downscale(i: Inputs):
    return op.downscale(pixels(i))


@query("vis_dhash", """
  WITH g AS MATERIALIZED (SELECT capture_id, list(value ORDER BY ty, tx) AS v FROM grid GROUP BY 1)
  SELECT capture_id, CAST(list_sum(list_transform(range(64), lambda k: CASE WHEN v[k // 8 * 9 + k % 8 + 1] > v[k // 8 * 9 + k % 8 + 2]
    THEN CASE WHEN k = 0 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << (63 - k)::INT) END ELSE 0::HUGEINT END)) AS BIGINT) AS dhash FROM g""")
def vis_dhash(i: Inputs):
    return op.dhash(op.downscale(pixels(i)))


_DIST = ", ".join(f"(2*(r-{r})*(r-{r})+4*(g-{g})*(g-{g})+3*(b-{b})*(b-{b}))*100+{n}" for n, (_, r, g, b) in enumerate(lx.COLORS))


@query("vis_palette", f"""
  WITH p AS (SELECT capture_id, least({_DIST}) % 100 AS c, (r * 77 + g * 150 + b * 29) >> 8 AS v FROM pixels),
    k AS (SELECT capture_id, c, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT capture_id, count(*) AS total, sum(v) AS v FROM p GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY n DESC, c) AS rn FROM k JOIN t USING (capture_id) WHERE n / total >= 0.08)
  SELECT t.capture_id, coalesce((SELECT string_agg({_NAMES}[c + 1], '|' ORDER BY rn) FROM r WHERE r.capture_id = t.capture_id AND rn <= 3), '') AS colors,
    round(v / total, 6) AS brightness, v / total < 90 AS is_dark FROM t""")
def vis_palette(i: Inputs):
    return op.palette(pixels(i)).select("capture_id", F.array_join("colors", "|").alias("colors"), F.round("brightness", 6).alias("brightness"), "is_dark")


shared("boxes", """
  SELECT l_orderkey AS capture_id, CAST(l_partkey % 400 AS INTEGER) AS "left", CAST(l_linenumber * 60 AS INTEGER) AS top,
    CAST(l_partkey % 400 + 60 + l_suppkey % 500 AS INTEGER) AS "right", CAST(l_linenumber * 60 + 20 + l_quantity AS INTEGER) AS bottom FROM lineitem""")


def boxes(i: Inputs):
    from .core import SHARED
    return i.spark.sql(SHARED["boxes"].replace('"', "`").replace("FROM lineitem", "FROM {lineitem}"), lineitem=i.lineitem)


@query("vis_text_coverage", 'SELECT capture_id, round(greatest(0.0, least(1.0, sum(("right" - "left") * (bottom - top)) / 1e6)), 6) AS coverage FROM boxes GROUP BY 1')
def vis_text_coverage(i: Inputs):
    return op.text_coverage(boxes(i)).select("capture_id", F.round("coverage", 6).alias("coverage"))


shared("type_f", """
  SELECT capture_id, CASE WHEN capture_id % 5 = 4 THEN 'LONG_SCREENSHOT' WHEN capture_id % 8 = 0 THEN 'PRODUCT_LISTING' WHEN capture_id % 8 = 1 THEN 'TICKET' ELSE 'OTHER' END AS kind,
    CASE WHEN capture_id % 5 = 4 THEN 1.0 WHEN capture_id % 8 = 0 THEN 0.575 WHEN capture_id % 8 = 1 THEN 0.525 ELSE 1.0 END::DOUBLE AS confidence FROM cap""")


def capture_types(i: Inputs):
    t = F.col("ocr_text")
    facts = spread(i.cap.select("capture_id", "ocr_text", "width", "height")).select(
        "capture_id", "ocr_text", "width", "height", F.transform(x.urls(t), lambda u: u["host"]).alias("hosts"),
        (F.size(x.prices(t)) > 0).alias("p"), (F.size(x.codes(t)) > 0).alias("c"))
    kind = F.expr(op.type_sql("ocr_text", "hosts", "p", "c", "width", "height", "0.3D", "'NONE'"))
    return facts.select("capture_id", kind.alias("k")).select("capture_id", "k.kind", "k.confidence")


@query("vis_type", "SELECT capture_id, kind, round(confidence, 6) AS confidence FROM type_f")
def vis_type(i: Inputs):
    return capture_types(i).select("capture_id", "kind", F.round("confidence", 6).alias("confidence"))


shared("screen_boxes", """
  SELECT capture_id, "left" AS l, "right" AS r, "right" - "left" AS w, bottom - top AS h, ("left" + "right") // 2 AS mid,
    top + (bottom - top) / 4.0 AS ct, bottom - (bottom - top) / 4.0 AS cb FROM boxes""")


def _rows_sql(where: str) -> str:
    return f"""
  SELECT capture_id, line, count(*) AS n, min(l) AS l, max(w) AS w, min(mid) AS mid FROM (
    SELECT *, sum(opens) OVER (PARTITION BY capture_id ORDER BY ct, cb, l, r ROWS UNBOUNDED PRECEDING) AS line FROM (
      SELECT *, CASE WHEN ct <= max(cb) OVER (PARTITION BY capture_id ORDER BY ct, cb, l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
      FROM screen_boxes WHERE {where})) GROUP BY 1, 2"""


shared("screen_rows", _rows_sql("true"))
shared("chat_rows", _rows_sql("w BETWEEN 60 AND 620 AND h BETWEEN 8 AND 120"))


@query("vis_layout", """
  WITH b AS (SELECT capture_id, count(*) AS n, count(*) FILTER (w BETWEEN 60 AND 560) AS narrow, count(*) FILTER (mid > 500 OR l BETWEEN 300 AND 700) AS rightish,
      count(*) FILTER (w > 700 AND h BETWEEN 10 AND 60) AS wide FROM screen_boxes GROUP BY 1),
    m AS (SELECT capture_id, list_sort(list(w))[count(*) // 2 + 1] AS w, list_sort(list(l))[count(*) // 2 + 1] AS anchor, count(*) AS n, count(*) FILTER (n >= 3) AS full_rows FROM screen_rows GROUP BY 1),
    a AS (SELECT x.capture_id, x.line, count(*) AS near FROM screen_rows x JOIN screen_rows y ON x.capture_id = y.capture_id AND abs(x.l - y.l) <= 30 GROUP BY 1, 2),
    al AS (SELECT capture_id, count(*) FILTER (near >= 2) AS aligned FROM a GROUP BY 1),
    an AS (SELECT capture_id, count(*) FILTER (abs(l - anchor) <= 60) AS anchored FROM screen_rows JOIN m USING (capture_id) GROUP BY 1),
    c AS (SELECT capture_id, sum(n) AS boxes, count(*) AS lines, count(*) FILTER (n <= 2) AS short, count(*) FILTER (side <> prev) AS turns FROM (
      SELECT *, mid < 500 AS side, lag(mid < 500) OVER (PARTITION BY capture_id ORDER BY line) AS prev FROM chat_rows) GROUP BY 1)
  SELECT b.capture_id, CASE WHEN b.n < 3 THEN 'NONE' WHEN coalesce(c.boxes >= 4 AND c.lines >= 4 AND short >= c.lines * 2 // 3 AND turns >= 3, false) THEN 'CHAT_BUBBLES'
    WHEN m.n >= 2 AND full_rows >= 2 AND aligned >= 2 THEN 'TABLE' WHEN b.n >= 5 AND narrow >= b.n * 2 // 3 AND rightish >= b.n // 2 THEN 'RECEIPT_LIKE'
    WHEN b.n >= 6 AND m.n >= 5 AND m.w <= 620 AND anchored >= m.n * 2 // 3 THEN 'FORM_LIKE' WHEN b.n >= 6 AND wide >= b.n * 2 // 3 THEN 'ARTICLE' ELSE 'NONE' END AS layout
  FROM b JOIN m USING (capture_id) JOIN al USING (capture_id) JOIN an USING (capture_id) LEFT JOIN c USING (capture_id)""")
def vis_layout(i: Inputs):
    return op.layouts(boxes(i))


@query("vis_similar", """
  WITH p AS (SELECT * FROM vis WHERE capture_id = (SELECT max(capture_id) FROM vis))
  SELECT v.capture_id, CAST(bit_count(xor(v.dhash, p.dhash)) AS INTEGER) AS distance FROM vis v, p WHERE v.capture_id <> p.capture_id AND bit_count(xor(v.dhash, p.dhash)) <= 20
  ORDER BY distance, capture_id LIMIT 8""")
def vis_similar(i: Inputs):
    v = visuals(i)
    probe = v.orderBy(F.desc("capture_id")).limit(1)
    return op.similar_to(v, probe)


shared("near_edge", """
  SELECT a.dhash AS a, b.dhash AS b, bit_count(xor(a.dhash, b.dhash)) AS d FROM (SELECT DISTINCT dhash FROM vis) a JOIN (SELECT DISTINCT dhash FROM vis) b
  ON a.dhash < b.dhash AND bit_count(xor(a.dhash, b.dhash)) <= 8""")
_COMPONENTS = """
  WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM near_edge), both_ways AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
  reach(n, m) AS (SELECT a, b FROM both_ways UNION SELECT r.n, w.b FROM reach r JOIN both_ways w ON w.a = r.m),
  comp AS (SELECT n AS dhash, least(n, min(m)) AS g FROM reach GROUP BY n)"""


shared("near_groups", _COMPONENTS + """, members AS (SELECT capture_id, dhash, coalesce(g, dhash) AS g FROM vis LEFT JOIN comp USING (dhash)),
    links AS (SELECT g, max(d) AS max_link_bits FROM e JOIN comp ON comp.dhash = e.a GROUP BY 1)
  SELECT g AS group_hash, count(*) AS size, max(capture_id) AS cover_id, count(DISTINCT dhash) AS n_hashes, CAST(coalesce(any_value(max_link_bits), 0) AS INTEGER) AS max_link_bits
  FROM members LEFT JOIN links USING (g) GROUP BY 1 HAVING count(*) > 1""")


@query("vis_near_duplicates", "SELECT * FROM near_groups")
def vis_near_duplicates(i: Inputs):
    per_hash = op.hashes_of(visuals(i))
    links = checkpointed(op.near_links(per_hash))  # several readers follow
    groups = checkpointed(op.hash_groups(per_hash, links))
    spread_bits = op.link_spread(groups, links)
    return op.summarize_groups(groups).join(spread_bits, "group_hash", "left").withColumn("max_link_bits", F.coalesce("max_link_bits", F.lit(0)))


@query("vis_group_diameter", _COMPONENTS + """, members AS (SELECT capture_id, dhash, coalesce(g, dhash) AS g FROM vis LEFT JOIN comp USING (dhash)),
    h AS (SELECT DISTINCT g, dhash FROM members WHERE g IN (SELECT g FROM members GROUP BY 1 HAVING count(*) > 1))
  SELECT a.g AS group_hash, CAST(max(bit_count(xor(a.dhash, b.dhash))) AS INTEGER) AS max_distance FROM h a JOIN h b USING (g) GROUP BY 1""")
def vis_group_diameter(i: Inputs):
    return op.group_diameters(op.hash_groups(op.hashes_of(visuals(i))))


@query("vis_copy_from_canonical", """
  SELECT c.capture_id, v.dhash, c.duplicate_of IS NOT NULL AS copied FROM dup c JOIN vis v ON v.capture_id = coalesce(c.duplicate_of, c.capture_id)""")
def vis_copy_from_canonical(i: Inputs):
    from .filters import with_duplicates
    return op.copy_from_canonical(with_duplicates(i), visuals(i).select("capture_id", "dhash"))


@query("vis_hash_similarity", """
  WITH m AS MATERIALIZED (SELECT capture_id, dhash FROM vis)
  SELECT a.capture_id, round(greatest(0.0, 1 - bit_count(xor(a.dhash, b.dhash)) / 24.0), 6) AS similarity FROM m a JOIN m b ON b.capture_id = a.capture_id + 500""")
def vis_hash_similarity(i: Inputs):
    v = visuals(i).select("capture_id", "dhash", F.lit("dhash").alias("model"), F.lit("1").alias("version"))
    w = v.select((F.col("capture_id") - 500).alias("capture_id"), F.col("dhash").alias("other"), "model", "version")
    joined = v.join(w, ["capture_id", "model", "version"])
    return joined.select("capture_id", F.round(vec.hash_similarity(F.col("dhash"), F.col("other")), 6).alias("similarity"))
