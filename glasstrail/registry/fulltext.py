"""Full-text search."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.snippets import snippet_sql
from ..lexicon import INNER_STOP
from ..operators import fulltext as op
from ..plans import search as plan
from .core import Inputs, query, shared

QUERIES = [
    plan.make_query(1, "screenshots from 1998", window=(883612800, 915148800), label="1998"),
    plan.make_query(2, "Pixel", ["pixel"]),
    plan.make_query(3, "Pixel 9a", ["pixel", "9a"], ["pixel 9a"]),
    plan.make_query(4, "₹6,500", prices=[plan.exact(6500.0)]),
    plan.make_query(5, "pixel below ₹40,000", ["pixel"], prices=[plan.at_most(40000.0)]),
    plan.make_query(6, "Pixel 9a for ₹39,999", ["pixel", "9a"], ["pixel 9a"], [plan.exact(39999.0)]),
    plan.make_query(7, "screenshots from amazon.in", hosts=["amazon.in"]),
    plan.make_query(8, "headphones github", ["headphones", "github"], ["headphones github"]),
    plan.make_query(9, "delhi flight", ["delhi", "flight"], ["delhi flight"]),
    plan.make_query(10, "code 100010", codes=["100010"]),
    plan.make_query(11, "zzzqqq", ["zzzqqq"]),
    plan.make_query(12, "total with prices", ["total"], types=["PRICES"]),
    plan.make_query(13, "cable at ₹305", ["cable"], prices=[plan.exact(305.0)]),
    plan.make_query(14, "usb total ₹5", ["usb", "total"], ["usb total"], [plan.exact(5.0)]),
    plan.make_query(15, "zzzqqq github.com", ["zzzqqq"], hosts=["github.com"]),
    plan.make_query(16, "long pixel", ["pixel"], long_only=True),
    plan.make_query(17, "₹7", prices=[plan.exact(7.0)]),
    plan.make_query(18, "", sort="NEWEST"),
    plan.make_query(19, "duplicates", types=["DUPLICATES"]),
    plan.make_query(20, "long screenshots", long_only=True),
    plan.make_query(21, "blue screenshots", colors=["blue"]),
    plan.make_query(22, "pixel in blue", ["pixel"], colors=["blue"]),
    plan.make_query(23, "duplicates or codes", types=["DUPLICATES", "OTPS"]),
    plan.make_query(24, "dark long screenshots", colors=["dark"], long_only=True),
    plan.make_query(25, "duplicate pixel below ₹100,000", ["pixel"], prices=[plan.at_most(100000.0)], types=["DUPLICATES"]),
]


def query_frame(i: Inputs):
    return i.spark.createDataFrame(QUERIES, plan.QUERY_DDL)


def documents(i: Inputs):
    """The captures with their duplicates and palettes."""
    from .filters import with_duplicates
    from .visual import visuals
    return plan.documents(with_duplicates(i).join(visuals(i).select("capture_id", "colors", "is_dark"), "capture_id", "left"))


def _lit(v) -> str:
    return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v))


def _list(v) -> str:
    return "[" + ", ".join(_lit(e) for e in v) + "]::VARCHAR[]"


def _row(q) -> str:
    p = q[4][0] if q[4] else (None, None, None, None)
    terms = list(dict.fromkeys([*q[2], *[w for ph in q[3] for w in ph.split(" ")]]))
    return (f"({q[0]}::BIGINT, {_lit(q[1])}, {_list(q[2])}, {_list(q[3])}, {_list(terms)}, {_lit(p[0])}, {_lit(p[2])}::DOUBLE, {_lit(p[3])}::DOUBLE, "
            f"{_lit(q[5])}::BIGINT, {_lit(q[6])}::BIGINT, {_lit(q[8][0] if q[8] else None)}, {_lit(q[10][0] if q[10] else None)}, {_list(q[11])}, {_list(q[12])}, {_lit(q[13])}, {_lit(q[14])})")


shared("qs", "SELECT * FROM (VALUES " + ", ".join(_row(q) for q in QUERIES) + ") AS t(query_id, raw, terms, phrases, fts, kind, pmin, pmax, start_s, end_s, host, code, types, wanted_colors, long_only, sort)")
shared("toks", r"""
  SELECT capture_id, status, date_added, filename, ocr_text, width, height, content_hash,
    list_filter(string_split_regex(lower(filename), '[^a-z0-9₹]+'), lambda t: t <> '') AS ft, list_filter(string_split_regex(lower(ocr_text), '[^a-z0-9₹]+'), lambda t: t <> '') AS tt FROM cap""")
# One row per (query, capture) with the three text flags; brute force over all pairs.
shared("pairs", """
  SELECT q.*, c.capture_id, c.date_added, c.filename, c.ocr_text, c.content_hash,
    len(q.fts) > 0 AND len(list_filter(q.fts, lambda t: len(list_filter(list_concat(c.ft, c.tt), lambda k: starts_with(k, t))) > 0)) = len(q.fts) AS all_terms,
    list_has_any(q.fts, list_concat(c.ft, c.tt)) AS any_term,
    len(list_filter(q.phrases, lambda p: contains(concat(' ', array_to_string(c.tt, ' '), ' '), concat(' ', p, ' ')))) > 0 AS phrase,
    p.amount, u.host AS chost, k.code AS ccode, c.width, c.height, f.types AS ctypes, list_concat(coalesce(v.colors, []), CASE WHEN v.is_dark IS NULL THEN [] WHEN v.is_dark THEN ['dark'] ELSE ['light'] END) AS ccolors
  FROM qs q CROSS JOIN toks c LEFT JOIN price_f p USING (capture_id) LEFT JOIN url_f u USING (capture_id) LEFT JOIN code_f k USING (capture_id)
  LEFT JOIN (SELECT capture_id, list(t) AS types FROM flag GROUP BY 1) f USING (capture_id) LEFT JOIN vis v USING (capture_id) WHERE c.status <> 'FAILED'""")
shared("rungs", """
  SELECT *, CASE WHEN NOT base THEN NULL WHEN txt AND (kind IS NULL OR coalesce(amount BETWEEN pmin AND pmax, false)) THEN 0
    WHEN kind IS NOT NULL AND txt AND coalesce(amount BETWEEN CASE WHEN kind = 'EXACT' THEN pmin * 0.95 ELSE pmin END AND CASE WHEN kind = 'EXACT' THEN pmax * 1.05 ELSE pmax END, false) THEN 1
    WHEN kind IS NOT NULL AND txt THEN 2 WHEN len(terms) > 0 AND any_term THEN 3
    WHEN len(fts) = 0 OR host IS NOT NULL OR code IS NOT NULL OR start_s IS NOT NULL OR len(types) > 0 OR len(wanted_colors) > 0 OR long_only THEN 4 END AS rung
  FROM (SELECT *, (len(fts) = 0 OR all_terms OR phrase) AS txt,
      (start_s IS NULL OR (date_added >= start_s AND date_added < end_s)) AND (host IS NULL OR coalesce(chost = host, false)) AND (code IS NULL OR coalesce(ccode = code, false))
      AND (len(types) = 0 OR coalesce(list_has_any(types, ctypes), false)) AND (len(wanted_colors) = 0 OR list_has_any(wanted_colors, ccolors)) AND (NOT long_only OR height >= 2.8 * width) AS base FROM pairs)""")
shared("answers", """
  SELECT * FROM (SELECT *, min(rung) OVER (PARTITION BY query_id) AS best FROM rungs WHERE rung IS NOT NULL)
  WHERE rung = best""")
shared("needle", "SELECT query_id, unnest(fts) AS term FROM qs")


@query("token_index", """
  SELECT doc_id, token, pos - 1 AS pos FROM (SELECT doc_id, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM (
    SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda t: t <> '') AS t FROM documents))""")
def token_index(i: Inputs):
    docs = i.documents.select(F.col("doc_id").alias("capture_id"), F.lit("").alias("filename"), F.col("text").alias("ocr_text"))
    return op.token_index(docs).select(F.col("capture_id").alias("doc_id"), "token", F.col("pos").cast("bigint").alias("pos"))


@query("fts_terms", """
  SELECT page_id, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT page_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM (
    SELECT page_id, list_filter(list_transform(string_split_regex(trim(url), '[/?&]+'), lambda v: lower(regexp_replace(regexp_replace(v, '^[.,;:!?"''()\\[\\]{}]+', ''), '[.,;:!?"''()\\[\\]{}]+$', ''))), lambda v: trim(v) <> '') AS t FROM pages))""")
def fts_terms(i: Inputs):
    return i.pages.select("page_id", F.array_join(op.clean_terms(F.split(F.trim("url"), "[/?&]+")), "|").alias("terms"))


@query("fts_and_prefix", "SELECT query_id, capture_id FROM pairs WHERE all_terms")
def fts_and_prefix(i: Inputs):
    return op.match_all(op.token_index(i.cap.filter("status <> 'FAILED'")), plan.query_terms(query_frame(i)))


@query("fts_or", "SELECT query_id, capture_id FROM pairs WHERE any_term")
def fts_or(i: Inputs):
    return op.match_any(op.token_index(i.cap.filter("status <> 'FAILED'")), plan.query_terms(query_frame(i)))


def _phrases(i: Inputs):
    return query_frame(i).select("query_id", F.explode("phrases").alias("phrase"))


@query("fts_phrase", "SELECT query_id, capture_id FROM pairs WHERE phrase")
def fts_phrase(i: Inputs):
    return op.match_phrases(op.token_index(i.cap.filter("status <> 'FAILED'")), _phrases(i)).select("query_id", "capture_id").distinct()


@query("fts_union_window", "SELECT query_id, capture_id, CASE WHEN phrase THEN 0 ELSE 1 END AS source FROM pairs WHERE phrase OR all_terms")
def fts_union_window(i: Inputs):
    index = op.token_index(i.cap.filter("status <> 'FAILED'"))
    return op.union_window(op.match_phrases(index, _phrases(i)), op.match_all(index, plan.query_terms(query_frame(i))))


@query("fts_candidate_order", """
  SELECT query_id, capture_id, tier, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, date_added DESC, capture_id DESC) AS rn FROM (
    SELECT query_id, capture_id, date_added, CASE WHEN starts_with(lower(filename), lower(trim(raw))) THEN 0 WHEN contains(lower(filename), lower(trim(raw))) THEN 1 ELSE 2 END AS tier FROM pairs WHERE all_terms))
  WHERE rn <= 400""")
def fts_candidate_order(i: Inputs):
    q = query_frame(i)
    matches = op.match_all(op.token_index(i.cap.filter("status <> 'FAILED'")), plan.query_terms(q))
    return op.candidate_order(matches, i.cap, q)


@query("fts_legacy_score", """
  SELECT capture_id, CASE WHEN lower(filename) = 'screenshot_1.png' THEN 3 WHEN starts_with(lower(filename), 'screenshot_1') THEN 2 WHEN contains(lower(filename), 'screenshot_1') THEN 1 ELSE 0 END AS score
  FROM cap WHERE status <> 'FAILED' ORDER BY score DESC, date_added DESC, capture_id DESC LIMIT 50""")
def fts_legacy_score(i: Inputs):
    full = op.legacy_score(F.col("filename"), F.lit("Screenshot_1.png"))
    part = op.legacy_score(F.col("filename"), F.lit("Screenshot_1"))
    rows = i.cap.filter("status <> 'FAILED'").withColumn("score", F.greatest(full, part))
    return rows.orderBy(F.desc("score"), F.desc("date_added"), F.desc("capture_id")).limit(50).select("capture_id", "score")


def _filtered(i: Inputs):
    from ..operators.filters import date_window, eligible, having
    return having(i.cap.filter(eligible() & date_window(946684800)), i.prices, F.col("amount") <= 1250)


_FILTERED = "SELECT capture_id FROM cap WHERE status <> 'FAILED' AND date_added >= 946684800 AND capture_id IN (SELECT capture_id FROM price_f WHERE amount <= 1250)"


@query("fts_filters_only", _FILTERED)
@query("fts_filters_only_all", _FILTERED)
def fts_filters_only(i: Inputs):
    return _filtered(i).select("capture_id")


def _matched(i: Inputs):
    rows = i.cap.filter("status <> 'FAILED'")
    hits = op.match_any(op.token_index(rows), plan.query_terms(query_frame(i).filter("query_id = 3")))
    return rows.join(hits, "capture_id", "left_semi")


@query("fts_ids", "SELECT capture_id FROM pairs WHERE query_id = 3 AND any_term")
@query("fts_ids_all", "SELECT capture_id FROM pairs WHERE query_id = 3 AND any_term")
def fts_ids(i: Inputs):
    return _matched(i).select("capture_id")


@query("text_search", """
  SELECT query_id, capture_id FROM (SELECT q.query_id, q.t, c.capture_id, list_concat(c.ft, c.tt) AS k FROM toks c CROSS JOIN (
      SELECT query_id, list_filter(string_split_regex(lower(raw), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(['at', 'from', 'for', 'with', 'below', 'screenshots'], w)) AS t FROM qs) q WHERE c.status <> 'FAILED' AND len(q.t) > 0)
  WHERE len(list_filter(t, lambda w: len(list_filter(k, lambda v: starts_with(v, w))) > 0)) = len(t)""".replace("'below', ", ""))
def text_search(i: Inputs):
    terms = query_frame(i).select("query_id", F.explode(op.plain_terms(F.col("raw"), INNER_STOP)).alias("term"))
    return op.match_all(op.token_index(i.cap.filter("status <> 'FAILED'")), terms)


@query("relaxation_ladder", f"SELECT query_id, capture_id, {plan.RUNGS}[best + 1] AS rung FROM answers")
def relaxation_ladder(i: Inputs):
    return plan.ladder(documents(i), query_frame(i)).select("query_id", "capture_id", "rung")


@query("candidate_hydrate", """
  SELECT capture_id, coalesce(CAST(CAST(amount AS BIGINT) AS VARCHAR), '') AS prices, coalesce(host, '') AS hosts, coalesce(normalized, '') AS phones, coalesce(code, '') AS codes
  FROM cap LEFT JOIN price_f USING (capture_id) LEFT JOIN url_f USING (capture_id) LEFT JOIN phone_f USING (capture_id) LEFT JOIN otp_f USING (capture_id) WHERE status <> 'FAILED'""")
def candidate_hydrate(i: Inputs):
    return documents(i).selectExpr("capture_id", "array_join(transform(prices, p -> string(bigint(p.amount))), '|') AS prices", "array_join(hosts, '|') AS hosts",
                                   "array_join(phones, '|') AS phones", "array_join(codes, '|') AS codes")


PREFIXES = ["pi", "gi", "am", "he", "pixel 1", "ma", "x"]
shared("mined", """
  SELECT prefix, capture_id, phrase FROM (SELECT p.prefix, capture_id, trim(concat(regexp_replace(w[k], '[.,;:!?"''()\\[\\]{}]+$', ''), ' ', coalesce(regexp_replace(regexp_replace(w[k + 1], '^[.,;:!?"''()\\[\\]{}]+', ''), '[.,;:!?"''()\\[\\]{}]+$', ''), ''))) AS phrase,
      row_number() OVER (PARTITION BY p.prefix, capture_id ORDER BY k) AS rn
    FROM (SELECT capture_id, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT capture_id, string_split(ocr_text, ' ') AS w FROM cap)) JOIN (SELECT unnest(['pi', 'gi', 'am', 'he', 'pixel 1', 'ma']) AS prefix) p ON starts_with(lower(regexp_replace(w[k], '^[^a-zA-Z0-9_]+', '')), p.prefix))
  WHERE rn <= 3 AND NOT regexp_full_match(phrase, '[0-9]*')""")


def prefix_frame(i: Inputs):
    return i.spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")


@query("top_hosts", "SELECT host, count(*) AS n FROM url_f GROUP BY 1 ORDER BY n DESC, host LIMIT 200")
def top_hosts(i: Inputs):
    return op.top_hosts(i.urls, 200)


@query("mine_phrases", "SELECT prefix, capture_id, phrase FROM mined")
def mine_phrases(i: Inputs):
    return op.mine_phrases(i.cap, prefix_frame(i).filter("length(prefix) > 1")).select("prefix", "capture_id", "phrase")


@query("suggest_prefix", """
  SELECT prefix, text, source, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY source, o, k) AS rn FROM (
    SELECT prefix, k, arg_min(text, (source, o, text)) AS text, min(source) AS source, arg_min(o, (source, o, text)) AS o FROM (
      SELECT p.prefix, lower(t.text) AS k, t.text, t.source, t.o FROM (SELECT unnest(['pi', 'gi', 'am', 'he', 'pixel 1', 'ma']) AS prefix) p
      JOIN (SELECT trim(text) AS text, 0 AS source, -ts AS o FROM qlog_hist WHERE trim(text) <> '' UNION ALL SELECT host, 1, -count(*) FROM url_f GROUP BY 1) t ON starts_with(lower(t.text), p.prefix)
      UNION ALL SELECT prefix, lower(phrase), phrase, 2, -count(*) FROM mined GROUP BY prefix, phrase) GROUP BY 1, 2)) WHERE rn <= 6""")
def suggest_prefix(i: Inputs):
    from .catalog import qlog_hist
    p = prefix_frame(i)
    mined = op.mine_phrases(i.cap, p.filter("length(prefix) > 1"))
    return op.suggest(p, qlog_hist(i).select("text", "ts"), op.top_hosts(i.urls), mined)


def _snippets(i: Inputs):
    docs = i.documents.select("doc_id", "text", F.expr("array('the', 'ent', 'on der')").alias("needles"))
    return docs.select("doc_id", F.expr(snippet_sql("text", "needles")).alias("s"))


_W = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
shared("snip", f"""
  WITH c AS (SELECT doc_id, {_W} AS c FROM documents),
    a AS (SELECT *, list_min(list_filter([instr(lower(c), 'the'), instr(lower(c), 'ent'), instr(lower(c), 'on der')], lambda p: p > 0)) AS a FROM c),
    b AS (SELECT *, greatest(a - 61, 0) AS st, least(greatest(a - 61, 0) + 180, length(c)) AS en FROM a),
    w AS (SELECT *, CASE WHEN st = 0 THEN 0 WHEN instr(substr(c, st + 1), ' ') = 0 THEN length(c) ELSE st + instr(substr(c, st + 1), ' ') - 1 END AS s,
      CASE WHEN en >= length(c) THEN length(c) WHEN instr(reverse(substr(c, 1, en)), ' ') = 0 THEN 0 ELSE en - instr(reverse(substr(c, 1, en)), ' ') + 1 END AS z FROM b)
  SELECT doc_id, c, a, s, z, CASE WHEN z > s THEN substr(c, s + 1, z - s) ELSE '' END AS body FROM w""")


@query("snippet", """
  SELECT doc_id, CASE WHEN c = '' THEN NULL WHEN a IS NULL THEN CASE WHEN length(c) > 180 THEN concat(left(c, 180), '…') ELSE c END
    ELSE concat(CASE WHEN s > 0 THEN '…' ELSE '' END, body, CASE WHEN z < length(c) THEN '…' ELSE '' END) END AS snippet FROM snip""")
def snippet(i: Inputs):
    return _snippets(i).select("doc_id", F.col("s.text").alias("snippet"))


@query("highlights", """
  WITH RECURSIVE hit(doc_id, body, o, needle, ord, f) AS (
    SELECT doc_id, lower(body), CASE WHEN s > 0 THEN 1 ELSE 0 END, n.needle, n.ord, instr(lower(body), n.needle) FROM snip CROSS JOIN (VALUES ('the', 1), ('ent', 2), ('on der', 3)) AS n(needle, ord) WHERE a IS NOT NULL AND instr(lower(body), n.needle) > 0
    UNION ALL SELECT doc_id, body, o, needle, ord, f + length(needle) - 1 + instr(substr(body, f + length(needle)), needle) FROM hit WHERE instr(substr(body, f + length(needle)), needle) > 0)
  SELECT doc_id, coalesce((SELECT string_agg(concat(f - 1 + o, '-', f - 1 + o + length(needle) - 1), '|' ORDER BY ord, f) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, f) AS rn FROM hit) h WHERE h.doc_id = d.doc_id AND rn <= 6), '') AS marks
  FROM documents d""")
def highlights(i: Inputs):
    return _snippets(i).select("doc_id", F.coalesce(F.array_join("s.highlights", "|"), F.lit("")).alias("marks"))


