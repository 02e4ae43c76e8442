"""Actions, comparison and details."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as x
from ..operators import actions as op
from ..sources.captures import TODAY, spread
from .core import Inputs, query, shared


def facts(i: Inputs):
    rows = spread(i.cap.select("capture_id", "filename", "ocr_text"))
    return rows.select("capture_id", "filename", "ocr_text", x.all_facts("ocr_text", TODAY).alias("f")).select("capture_id", "filename", "ocr_text", "f.*")


_MERCHANT = "left(ocr_text, 80)"
shared("action_f", f"""
  SELECT capture_id, 'OPEN_URL' AS type, concat('Open ', host) AS title, url AS payload, 100 AS specificity FROM url_f UNION ALL SELECT capture_id, 'COPY_TEXT', 'Copy URL', url, 60 FROM url_f
  UNION ALL SELECT capture_id, 'CALL_PHONE', concat('Call ', normalized), normalized, 100 FROM phone_f UNION ALL SELECT capture_id, 'COPY_PHONE', 'Copy phone number', normalized, 60 FROM phone_f
  UNION ALL SELECT capture_id, 'CREATE_CALENDAR_EVENT', concat('Add ', raw, ' to Calendar'), CAST(epoch_day * 86400000 AS VARCHAR), 90 FROM date_f UNION ALL SELECT capture_id, 'CREATE_REMINDER', 'Create reminder', raw, 80 FROM date_f
  UNION ALL SELECT capture_id, 'SAVE_EXPENSE', 'Save expense', concat({_MERCHANT}, ' — INR ', CAST(CAST(amount AS DOUBLE) AS VARCHAR)), 90 FROM price_f JOIN cap USING (capture_id)
  UNION ALL SELECT capture_id, 'COPY_TEXT', 'Copy extracted text', ocr_text, 60 FROM cap UNION ALL SELECT capture_id, 'SEARCH_RELATED', 'Ask about this screenshot', CAST(capture_id AS VARCHAR), 50 FROM cap""")


@query("a_candidates", "SELECT capture_id, type, title, payload, specificity FROM action_f")
def a_candidates(i: Inputs):
    return op.candidates(facts(i)).select("capture_id", "type", "title", "payload", "specificity")


@query("a_validate", """
  SELECT reason, count(*) AS n FROM (SELECT CASE WHEN capture_id % 11 = 0 THEN 'Action has no title' WHEN capture_id % 13 = 0 THEN 'Action payload is incomplete'
      WHEN capture_id % 7 = 0 AND capture_id % 2 = 0 THEN 'Permission not granted: CALENDAR' WHEN capture_id % 5 = 0 AND type <> 'CALL_PHONE' THEN 'Highly sensitive action must require confirmation' ELSE 'ok' END AS reason FROM action_f) GROUP BY 1""")
def a_validate(i: Inputs):
    k = F.col("capture_id")
    rows = op.candidates(facts(i)).withColumns({
        "title": F.when(k % 11 == 0, " ").otherwise(F.col("title")), "payload": F.when(k % 13 == 0, "").otherwise(F.col("payload")),
        "permission": F.when(k % 7 == 0, "CALENDAR").otherwise("NONE"), "granted": k % 2 == 1, "sensitivity": F.when(k % 5 == 0, "HIGHLY_SENSITIVE").otherwise("NORMAL")})
    return op.validate(rows).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("a_history", "SELECT event_id, event_type <> 'error' AS success FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def a_history(i: Inputs):
    log = i.events.select(F.col("event_id").alias("log_id"), F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("success"))
    return op.history(log, 50).select(F.col("log_id").alias("event_id"), "success")


@query("a_expenses", f"""
  SELECT capture_id, {_MERCHANT} AS merchant, amount, currency, CASE WHEN contains(lower(ocr_text), 'ola') OR contains(lower(ocr_text), 'uber') THEN 'Transport' END AS category FROM price_f JOIN cap USING (capture_id)""")
def a_expenses(i: Inputs):
    receipts = spread(i.cap.select("capture_id", "ocr_text")).select("capture_id", x.receipt("ocr_text").alias("r"))
    return op.expenses(i.prices, receipts)


shared("terms_f", "SELECT capture_id, list_distinct(list_filter(string_split_regex(lower(ocr_text), '[^a-z0-9₹.,]+'), lambda w: length(w) >= 3)) AS t FROM cap")


@query("d_compare_pairs", """
  SELECT a.capture_id AS first_id, b.capture_id AS second_id, array_to_string(list_sort(list_filter(tb.t, lambda w: NOT list_contains(ta.t, w)))[1:20], '|') AS added, array_to_string(list_sort(list_filter(ta.t, lambda w: NOT list_contains(tb.t, w)))[1:20], '|') AS removed,
    concat_ws('|', CASE WHEN pa.amount <> pb.amount THEN concat('Price ₹', CAST(pa.amount AS BIGINT), ' → ₹', CAST(pb.amount AS BIGINT)) END, CASE WHEN ua.host <> ub.host THEN concat('Website ', ua.host, ' → ', ub.host) END) AS changes,
    CASE WHEN pa.amount IS NOT NULL AND (pb.amount IS NULL OR pa.amount <> pb.amount) THEN concat('INR ', CAST(CAST(pa.amount AS DOUBLE) AS VARCHAR)) ELSE '' END AS only_first
  FROM cap a JOIN cap b ON b.capture_id = a.capture_id + CASE WHEN a.capture_id % 8 = 3 THEN 3 ELSE 4 END JOIN terms_f ta ON ta.capture_id = a.capture_id JOIN terms_f tb ON tb.capture_id = b.capture_id
  LEFT JOIN price_f pa ON pa.capture_id = a.capture_id LEFT JOIN price_f pb ON pb.capture_id = b.capture_id LEFT JOIN url_f ua ON ua.capture_id = a.capture_id LEFT JOIN url_f ub ON ub.capture_id = b.capture_id""")
def d_compare_pairs(i: Inputs):
    side = F.expr("named_struct('ocr_text', ocr_text, 'prices', transform(prices, p -> named_struct('currency', p.currency, 'amount', p.amount)), 'hosts', transform(urls, u -> u.host))")
    rows = spread(i.cap.select("capture_id", "ocr_text")).select("capture_id", "ocr_text", x.prices("ocr_text").alias("prices"), x.urls("ocr_text").alias("urls")).select("capture_id", side.alias("s"))
    k = F.col("first_id")
    a = rows.select(F.col("capture_id").alias("first_id"), F.col("s").alias("a")).withColumn("second_id", k + F.when(k % 8 == 3, 3).otherwise(4))
    b = rows.select(F.col("capture_id").alias("second_id"), F.col("s").alias("b"))
    out = op.compare(a.join(b, "second_id"))
    return out.select("first_id", "second_id", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"), F.array_join("changes", "|").alias("changes"),
                      F.array_join("only_first_prices", "|").alias("only_first"))


@query("d_detail", """
  SELECT capture_id, filename, coalesce(CAST(CAST(amount AS BIGINT) AS VARCHAR), '') AS prices, coalesce(url, '') AS urls, coalesce(normalized, '') AS phones, coalesce(code, '') AS codes, coalesce(d.raw, '') AS dates, amount AS receipt_amount
  FROM cap LEFT JOIN price_f USING (capture_id) LEFT JOIN url_f USING (capture_id) LEFT JOIN phone_f USING (capture_id) LEFT JOIN otp_f USING (capture_id) LEFT JOIN date_f d USING (capture_id)""")
def d_detail(i: Inputs):
    rows = op.detail(spread(i.cap.select("capture_id", "filename", "ocr_text")), x.all_facts("ocr_text", TODAY))
    return rows.selectExpr("capture_id", "filename", "array_join(transform(prices, p -> string(bigint(p.amount))), '|') AS prices", "array_join(transform(urls, u -> u.url), '|') AS urls",
                           "array_join(transform(phones, p -> p.normalized), '|') AS phones", "array_join(codes, '|') AS codes", "array_join(transform(dates, d -> d.raw), '|') AS dates", "receipt.amount AS receipt_amount")
