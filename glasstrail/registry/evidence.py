"""Evidence, grounding and conversations."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import evidence as op
from ..operators.aggregates import price_answer
from ..operators.ordered import carry_forward
from .core import Inputs, query, shared

QUESTIONS = [(2, "128gb", "pixel", "", 883612800, 915148800), (7, "amazon.in", "amazon", "", None, None), (9, None, "delhi", "", 883612800, 915148800), (11, "github", "zzz", "github", None, None)]
shared("quest", "SELECT * FROM (VALUES " + ", ".join(
    f"({q[0]}::BIGINT, {'NULL' if q[1] is None else repr(q[1])}, '{q[2]}', '{q[3]}', {q[4] or 'NULL'}::BIGINT, {q[5] or 'NULL'}::BIGINT)" for q in QUESTIONS) + ") AS t(query_id, entity, keyword, plain, start_s, end_s)")
shared("found_f", """
  SELECT query_id, capture_id, CAST(rn - 1 AS INTEGER) AS engine_rank FROM (SELECT q.query_id, c.capture_id, row_number() OVER (PARTITION BY q.query_id ORDER BY date_added DESC, capture_id DESC) AS rn FROM quest q JOIN cap c
    ON contains(lower(c.ocr_text), CASE WHEN q.plain = '' THEN q.keyword ELSE q.plain END)) WHERE rn <= 60""")
shared("hitflag_f", "SELECT q.query_id, e.capture_id, max(e.normalized = q.entity) AS entity_hit, max(contains(lower(e.display), q.entity)) AS graph_hit FROM quest q JOIN edge_f e ON contains(lower(e.display), q.entity) OR e.normalized = q.entity GROUP BY 1, 2")
shared("cand_f", """
  SELECT f.query_id, f.capture_id, f.engine_rank, coalesce(h.entity_hit, false) AS entity_hit, coalesce(c.date_added >= q.start_s AND c.date_added < q.end_s, false) AS temporal_hit, coalesce(h.graph_hit, false) AS graph_hit
  FROM found_f f JOIN quest q USING (query_id) JOIN cap c USING (capture_id) LEFT JOIN hitflag_f h ON h.query_id = f.query_id AND h.capture_id = f.capture_id
  UNION ALL SELECT query_id, capture_id, NULL, needs, true, false FROM (SELECT q.query_id, c.capture_id, q.entity IS NOT NULL AS needs, row_number() OVER (PARTITION BY q.query_id ORDER BY c.date_added DESC, c.capture_id DESC) AS rn
      FROM quest q JOIN cap c ON c.date_added >= q.start_s AND c.date_added < q.end_s AND contains(lower(c.ocr_text), q.keyword) LEFT JOIN hitflag_f h ON h.query_id = q.query_id AND h.capture_id = c.capture_id
      WHERE q.entity IS NULL OR h.graph_hit) x WHERE rn <= 30 AND NOT EXISTS (SELECT 1 FROM found_f f WHERE f.query_id = x.query_id AND f.capture_id = x.capture_id)""")


def _newest(i: Inputs, column: str):
    q = i.spark.createDataFrame(QUESTIONS, "query_id bigint, entity string, keyword string, plain string, start_s bigint, end_s bigint").filter(f"{column} <> ''")
    w = Window.partitionBy("query_id").orderBy(F.desc("date_added"), F.desc("capture_id"))
    hits = i.cap.select("capture_id", "date_added", "ocr_text").join(F.broadcast(q), F.contains(F.lower("ocr_text"), F.col(column)))
    return hits.withColumn("rn", F.row_number().over(w)).filter("rn <= 60").select("query_id", "capture_id", (F.col("rn") - 1).alias("engine_rank"))


def _candidates(i: Inputs):
    from .graph import edges
    q = i.spark.createDataFrame(QUESTIONS, "query_id bigint, entity string, keyword string, plain string, start_s bigint, end_s bigint")
    return op.candidates(_newest(i, "keyword"), _newest(i, "plain"), i.cap, q, edges(i))


@query("e_candidates", "SELECT query_id, capture_id, engine_rank, entity_hit, temporal_hit, graph_hit FROM cand_f")
def e_candidates(i: Inputs):
    return _candidates(i)


def _searched(i: Inputs):
    """Candidates whose engine rows are the search plan's answers, none cut."""
    from ..plans import search as plan
    from .fulltext import documents
    from .graph import edges
    q = i.spark.createDataFrame(QUESTIONS, "query_id bigint, entity string, keyword string, plain string, start_s bigint, end_s bigint")
    lib = plan.library(documents(i))

    def engine(column: int):
        asked = i.spark.createDataFrame([plan.make_query(x[0], x[column], [x[column]]) for x in QUESTIONS if x[column]], plan.QUERY_DDL)
        return plan.ranked(plan.ladder(lib, asked)).select("query_id", "capture_id", (F.col("rank") - 1).alias("engine_rank"))

    return op.candidates(engine(2), engine(3), i.cap, q, edges(i), window_limit=None)


@query("e_candidates_search")
def e_candidates_search(i: Inputs):
    return _searched(i)


@query("e_rank_search")
def e_rank_search(i: Inputs):
    return op.rank(_searched(i), limit=None).select("query_id", "capture_id", "score", "rank")


@query("e_rank", """
  SELECT query_id, capture_id, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, engine_rank ASC NULLS LAST, capture_id) AS rn FROM (
    SELECT query_id, capture_id, engine_rank, round(CAST(least(1.0, CASE WHEN engine_rank IS NULL THEN 0 ELSE 0.5 * (1 - engine_rank / count(*) OVER (PARTITION BY query_id)) END + CASE WHEN entity_hit THEN 0.25 ELSE 0 END + CASE WHEN temporal_hit THEN 0.15 ELSE 0 END + CASE WHEN graph_hit THEN 0.1 ELSE 0 END) AS DOUBLE), 9) AS score FROM cand_f)) WHERE rn <= 8""")
def e_rank(i: Inputs):
    return op.rank(_candidates(i)).select("query_id", "capture_id", "score", "rank")


shared("evid_f", """
  SELECT c.capture_id, owner_id, date_added, ocr_text AS excerpt, CASE WHEN amount IS NULL THEN '' ELSE concat('INR:', CAST(CAST(amount AS DOUBLE) AS VARCHAR)) END AS price, coalesce(host, '') AS host, CASE WHEN c.capture_id % 8 IN (2, 5) THEN 'SENSITIVE' ELSE 'NORMAL' END AS sensitivity
  FROM cap c LEFT JOIN price_f USING (capture_id) LEFT JOIN url_f USING (capture_id)""")


@query("e_evidence", "SELECT capture_id, excerpt, price AS prices, host AS hosts, sensitivity FROM evid_f")
def e_evidence(i: Inputs):
    rows = op.evidence(i.cap)
    return rows.select("capture_id", "excerpt", F.array_join("prices", "|").alias("prices"), F.array_join("hosts", "|").alias("hosts"), "sensitivity")


@query("e_price_answer", "SELECT owner_id, count(DISTINCT amount) AS n_prices, min(amount) AS lowest, max(amount) AS highest FROM price_f JOIN cap USING (capture_id) GROUP BY 1")
def e_price_answer(i: Inputs):
    rows = i.prices.join(i.cap.select("capture_id", "owner_id"), "capture_id")
    return price_answer(rows, ["owner_id"])


@query("e_timeline_answer", "SELECT owner_id, CAST(to_timestamp(min(date_added)) AS DATE) AS first_day, CAST(to_timestamp(max(date_added)) AS DATE) AS last_day, count(*) AS n FROM cap GROUP BY 1")
def e_timeline_answer(i: Inputs):
    day = lambda c: F.to_date(F.timestamp_seconds(c))
    return i.cap.groupBy("owner_id").agg(F.min("date_added").alias("a"), F.max("date_added").alias("b"), F.count("*").alias("n")).select(
        "owner_id", day(F.col("a")).alias("first_day"), day(F.col("b")).alias("last_day"), "n")


@query("e_compare_answer", """
  SELECT owner_id, count(*) AS n, coalesce(string_agg(DISTINCT nullif(price, ''), '|' ORDER BY nullif(price, '')), '') AS prices, coalesce(string_agg(DISTINCT nullif(host, ''), '|' ORDER BY nullif(host, '')), '') AS hosts FROM evid_f GROUP BY 1""")
def e_compare_answer(i: Inputs):
    rows = op.evidence(i.cap).join(i.cap.select("capture_id", "owner_id"), "capture_id")
    out = op.compare(rows, "owner_id")
    return out.select("owner_id", "n", F.coalesce(F.array_join("prices", "|"), F.lit("")).alias("prices"), F.coalesce(F.array_join("hosts", "|"), F.lit("")).alias("hosts"))


def _answers(i: Inputs, tail: str = ""):
    return i.customer.select(F.col("c_custkey").alias("question_id"), F.expr(
        f"concat('I found ', c_custkey % 15, ' screenshots. The price was ₹6,500! Was it on github.com? Dated 2000 here.', '{tail}')").alias("answer"))


def _owned(i: Inputs):
    return op.evidence(i.cap).join(i.cap.select("capture_id", F.col("owner_id").alias("question_id")), "capture_id")


shared("ground_f", """
  SELECT c_custkey AS question_id, coalesce(n, 0) AS n, c_custkey % 15 <= coalesce(n, 0) AS ok1, coalesce(p, false) AS ok2, coalesce(h, false) AS ok3, coalesce(y, false) AS ok4, coalesce(s, false) AS sensitive
  FROM customer LEFT JOIN (SELECT owner_id, count(*) AS n, bool_or(price = 'INR:6500.0') AS p, bool_or(host = 'github.com') AS h, bool_or(year(to_timestamp(date_added)) = 2000) AS y, bool_or(sensitivity <> 'NORMAL') AS s FROM evid_f GROUP BY 1) ON owner_id = c_custkey""")
_TEXT = """trim(concat_ws(' ', CASE WHEN ok1 THEN concat('I found ', question_id % 15, ' screenshots.') END, CASE WHEN ok2 THEN 'The price was ₹6,500!' END, CASE WHEN ok3 THEN 'Was it on github.com?' END, CASE WHEN ok4 THEN 'Dated 2000 here.' END{more}))"""


@query("e_grounding", f"""
  SELECT question_id, CASE WHEN t = '' THEN '{op.NOTHING_VERIFIED}' ELSE t END AS validated, removed = 0 AS passed, removed FROM (
    SELECT question_id, {_TEXT.format(more='')} AS t, CAST(4 - ok1::INT - ok2::INT - ok3::INT - ok4::INT AS BIGINT) AS removed FROM ground_f)""")
def e_grounding(i: Inputs):
    return op.ground(_answers(i), _owned(i))


@query("e_mask", f"""
  SELECT question_id, CASE WHEN sensitive THEN '{op.MASKED}' ELSE t END AS validated, removed = 0 AND NOT sensitive AS passed FROM (
    SELECT question_id, sensitive, {_TEXT.format(more=", 'Your OTP is here.'")} AS t, 4 - ok1::INT - ok2::INT - ok3::INT - ok4::INT AS removed FROM ground_f)""")
def e_mask(i: Inputs):
    return op.ground(_answers(i, " Your OTP is here."), _owned(i)).select("question_id", "validated", "passed")


@query("e_confidence", "SELECT c_custkey, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_MATCH' WHEN n = 1 THEN 'FOUND_ONE' ELSE 'FOUND_MULTIPLE' END AS confidence FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey")
def e_confidence(i: Inputs):
    counts = i.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = i.customer.select("c_custkey").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", op.confidence(F.coalesce("n", F.lit(0))).alias("confidence"))


# --- conversations -------------------------------------------------------
@query("c_list", """
  SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, arg_max(role, turn) AS last_role, arg_min(left(text, 60), turn) AS title FROM conversations GROUP BY 1""")
def c_list(i: Inputs):
    return i.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"),
                                                  F.min_by(F.left("text", F.lit(60)), "turn").alias("title"))


@query("c_followup_carry", """
  SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN string_split(text, ' ')[1] END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS entity FROM conversations""")
def c_followup_carry(i: Inputs):
    rows = i.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.get(F.split("text", " "), F.lit(0))).alias("own"))
    return carry_forward(rows, ["conv_id"], "turn", "own", "entity").select("conv_id", "turn", "entity")


@query("c_snapshot", "SELECT DISTINCT capture_id, 'deals' AS snapshot FROM (SELECT capture_id FROM price_f UNION ALL SELECT capture_id FROM otp_f UNION ALL SELECT capture_id FROM cap WHERE capture_id % 4 = 1)")
def c_snapshot(i: Inputs):
    found = i.prices.select("capture_id").unionByName(i.codes.select("capture_id")).unionByName(i.cap.filter("capture_id % 4 = 1").select("capture_id"))
    return op.snapshot("deals", found).select("capture_id", "snapshot")
