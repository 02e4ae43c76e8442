"""Window-style operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as op
from .core import Inputs, query, shared


shared("seq_rows", """
  WITH r AS (SELECT capture_id, date_added, date_added // 86400 AS day, list_distinct(list_filter(string_split_regex(lower(ocr_text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS w FROM cap),
    l AS (SELECT *, lag(date_added) OVER o AS pt, lag(w) OVER o AS pw FROM r WINDOW o AS (PARTITION BY day ORDER BY date_added, capture_id)),
    b AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND date_added - pt <= 1800 AND least(len(w), len(pw)) > 0 AND len(list_intersect(w, pw)) >= 0.5 * least(len(w), len(pw)) THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY date_added, capture_id) AS run FROM l)
  SELECT * FROM b""")
shared("seq_groups", """SELECT day, run, count(*) AS size, arg_min(capture_id, (date_added, capture_id)) AS first_id, arg_max(capture_id, (date_added, capture_id)) AS last_id
  FROM seq_rows GROUP BY 1, 2 HAVING count(*) >= 3""")


@query("w_sequences", """
  WITH k AS (SELECT day, run, v, count(*) AS n FROM (SELECT day, run, unnest(w) AS v FROM seq_rows) JOIN seq_groups USING (day, run) GROUP BY 1, 2, 3),
    t AS (SELECT day, run, string_agg(v, ' ' ORDER BY n DESC, v) AS words FROM (SELECT *, row_number() OVER (PARTITION BY day, run ORDER BY n DESC, v) AS rn FROM k) WHERE rn <= 2 GROUP BY 1, 2)
  SELECT day, first_id, last_id, size, concat(words, ' · ', size, ' screenshots') AS label FROM seq_groups JOIN t USING (day, run)""")
def w_sequences(i: Inputs):
    return op.sequences(i.cap)


shared("near_in", """
  SELECT capture_id, date_added, CASE WHEN capture_id % 8 = 1 THEN concat('7QK', owner_id, 'LP') WHEN capture_id % 8 = 0 THEN 'pixel' END AS entity, u.host, CASE WHEN capture_id % 3 = 0 THEN NULL ELSE kind END AS kind
  FROM cap LEFT JOIN url_f u USING (capture_id) JOIN type_f USING (capture_id)""")


def session_input(i: Inputs):
    from .visual import capture_types
    k = F.col("capture_id")
    hosts = i.urls.groupBy("capture_id").agg(F.min("host").alias("host"))
    types = capture_types(i).select("capture_id", F.when(k % 3 != 0, F.col("kind")).alias("kind"))
    entity = F.when(k % 8 == 1, F.concat(F.lit("7QK"), "owner_id", F.lit("LP"))).when(k % 8 == 0, "pixel")
    return i.cap.select("capture_id", "date_added", entity.alias("entity")).join(hosts, "capture_id", "left").join(types, "capture_id")


@query("w_neighbour_session", """
  SELECT a.capture_id, count(*) AS n_shared, least(a.date_added, min(b.date_added)) AS start_s, greatest(a.date_added, max(b.date_added)) AS end_s,
    array_to_string(list_filter([CASE WHEN bool_or(coalesce(a.entity = b.entity, false)) THEN 'shared entities' END, CASE WHEN bool_or(coalesce(a.host = b.host, false)) THEN 'shared websites' END,
      CASE WHEN bool_or(coalesce(a.kind = b.kind, false)) THEN 'shared type' END], lambda v: v IS NOT NULL), '|') AS signals
  FROM near_in a JOIN near_in b ON b.date_added BETWEEN a.date_added - 1800 AND a.date_added + 1800 AND a.capture_id <> b.capture_id AND (a.entity = b.entity OR a.host = b.host OR a.kind = b.kind) GROUP BY a.capture_id, a.date_added""")
def w_neighbour_session(i: Inputs):
    out = op.neighbour_sessions(session_input(i), {"entity": "shared entities", "host": "shared websites", "kind": "shared type"})
    return out.withColumn("signals", F.array_join("signals", "|"))


@query("w_event_groups", """
  SELECT code, count(*) AS size, min(date_added) AS start_s, max(date_added) AS end_s FROM order_f JOIN cap USING (capture_id) GROUP BY 1 HAVING count(*) >= 2 AND max(date_added) - min(date_added) <= 14 * 86400""")
def w_event_groups(i: Inputs):
    return op.event_groups(i.order_codes.join(i.cap.select("capture_id", "date_added"), "capture_id").select("code", "capture_id", "date_added"))


@query("w_price_history", """
  SELECT entity, seen_at, price, lag(price) OVER (PARTITION BY entity ORDER BY seen_at, price) AS before FROM (
    SELECT DISTINCT l_partkey AS entity, CAST(epoch(o_orderdate) AS BIGINT) AS seen_at, l_extendedprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def w_price_history(i: Inputs):
    rows = i.lineitem.join(i.orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "l_partkey AS entity", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS seen_at", "l_extendedprice AS price")
    return op.price_history(rows)


@query("w_user_first", "SELECT user_id, event_id, CAST(rn AS INTEGER) AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'purchase'), value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def w_user_first(i: Inputs):
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("value"), F.col("event_id")]
    return op.top_per_group(i.events, ["user_id"], order, 3).select("user_id", "event_id", "rank")


@query("w_topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 4")
def w_topk_per_group(i: Inputs):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return op.top_per_group(i.lineitem, ["l_suppkey"], order, 4).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("w_canonical", """
  SELECT capture_id, CASE WHEN f <> capture_id THEN f END AS duplicate_of FROM cap LEFT JOIN (SELECT content_hash, arg_min(capture_id, (date_added, capture_id)) AS f FROM cap WHERE status = 'COMPLETED' AND content_hash IS NOT NULL GROUP BY 1) USING (content_hash)""")
def w_canonical(i: Inputs):
    return op.canonical(i.cap).select("capture_id", "duplicate_of")
