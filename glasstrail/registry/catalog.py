"""Sources, sinks and status changes."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import catalog as op
from ..sources import captures as src
from .core import Inputs, query, shared


def _any(col: str, words, fmt="{c} LIKE '%{w}%'") -> str:
    return "(" + " OR ".join(fmt.format(c=col, w=w.replace("_", "\\_")) + (" ESCAPE '\\'" if "_" in w else "") for w in words) + ")"


shared("file_names", """
  SELECT event_id, CASE event_id % 10 WHEN 0 THEN concat('Screenshot_', event_id, '.PNG') WHEN 1 THEN concat('IMG_', event_id, '.jpg')
      WHEN 2 THEN concat('my_screenshot_', event_id, '.jpeg') WHEN 3 THEN concat('scr_', event_id, '.gif') WHEN 4 THEN concat('notes', event_id)
      WHEN 5 THEN concat('a.b.screencap', event_id, '.webp') WHEN 6 THEN concat(event_id, ' screen capture.png')
      WHEN 7 THEN concat('ss_', event_id, '.jpg') WHEN 8 THEN concat('photo', event_id, '.png') ELSE concat(event_id, '_Screenshot', '.png') END AS filename,
    CASE event_id % 7 WHEN 0 THEN 'Pictures/Screenshots/' WHEN 1 THEN 'DCIM/Camera/' WHEN 2 THEN NULL WHEN 3 THEN 'Movies/ScreenRecorder/'
      WHEN 4 THEN 'Pictures/Wallpapers/' WHEN 5 THEN 'Pictures/Screen Captures/' ELSE 'Download/' END AS path
  FROM events""")


def file_names(i: Inputs):
    from .core import SHARED
    return i.spark.sql(SHARED["file_names"].replace("FROM events", "FROM {events}"), events=i.events)


_N = "regexp_replace(lower(filename), '\\.[^.]*$', '')"


@query("capture_predicate", f"""
  SELECT event_id, filename,
    CASE WHEN path IS NOT NULL AND {_any("lower(path)", lx.CAPTURE_EXCLUSIONS)} THEN false
         WHEN regexp_extract(lower(filename), '\\.([^.]*)$', 1) NOT IN ('png','jpg','jpeg','webp') THEN false
         WHEN path IS NOT NULL AND {_any("lower(path)", lx.CAPTURE_FOLDERS)} THEN true
         ELSE {_any(_N, lx.CAPTURE_PREFIXES, "{c} LIKE '{w}%'")} OR {_any(_N, lx.CAPTURE_SUFFIXES, "{c} LIKE '%{w}'")}
           OR contains({_N}, '_screenshot') OR contains({_N}, 'screenshot_') END AS is_capture
  FROM file_names""")
def capture_predicate(i: Inputs):
    f = file_names(i)
    return f.select("event_id", "filename", op.looks_like_capture(F.col("filename"), F.col("path")).alias("is_capture"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(i: Inputs):
    return i.documents.select("doc_id", op.content_hash(F.col("text")).alias("content_hash"))


@query("read_table", "SELECT capture_id, filename, date_added, status, ocr_text FROM cap")
def read_table(i: Inputs):
    orders = src.read_table(i.spark, f"{i.root}/orders.parquet", i.orders.schema)
    return src.derived_captures(orders).select("capture_id", "filename", "date_added", "status", "ocr_text")


_STORED = """stored AS (SELECT capture_id, date_modified, file_size, status FROM cap WHERE capture_id % 10 <> 0),
  found AS (SELECT capture_id, date_modified + CASE WHEN capture_id % 13 = 0 THEN 60 ELSE 0 END AS date_modified, file_size FROM cap WHERE capture_id % 9 <> 0)"""


def _stored_found(i: Inputs):
    k = F.col("capture_id")
    stored = i.cap.filter(k % 10 != 0).select("capture_id", "date_modified", "file_size", "status")
    found = i.cap.filter(k % 9 != 0).select(
        "capture_id", (F.col("date_modified") + F.when(k % 13 == 0, 60).otherwise(0)).alias("date_modified"), "file_size")
    return stored, found


@query("discover_reconcile", f"""
  WITH {_STORED}
  SELECT CASE WHEN s.capture_id IS NULL THEN 'insert' WHEN f.capture_id IS NULL THEN 'stale'
      WHEN s.date_modified <> f.date_modified OR s.file_size <> f.file_size OR s.status <> 'COMPLETED' THEN 'update' ELSE 'keep' END AS change,
    count(*) AS n
  FROM stored s FULL OUTER JOIN found f ON s.capture_id = f.capture_id GROUP BY 1""")
def discover_reconcile(i: Inputs):
    stored, found = _stored_found(i)
    snap = op.reconcile(stored, found, "capture_id", ["date_modified", "file_size"], remove_missing=True)
    return snap.groupBy("change").agg(F.count("*").alias("n"))


@query("replace_children", """
  SELECT capture_id, currency, amount FROM price_f WHERE capture_id % 4 <> 0
  UNION ALL SELECT capture_id, currency, amount + 1 FROM price_f WHERE capture_id % 4 = 0""")
def replace_children(i: Inputs):
    p = i.prices.select("capture_id", "currency", "amount")
    batch = i.cap.filter(F.col("capture_id") % 4 == 0).select("capture_id")
    fresh = p.join(batch, "capture_id", "left_semi").withColumn("amount", F.col("amount") + 1)
    return op.replace_children(p, fresh, batch)


@query("insert_ignore", """
  SELECT capture_id, status FROM cap WHERE capture_id % 3 <> 0
  UNION ALL SELECT capture_id, 'NEW' FROM cap WHERE capture_id % 3 = 0 AND capture_id % 2 = 0""")
def insert_ignore(i: Inputs):
    k = F.col("capture_id")
    old = i.cap.filter(k % 3 != 0).select("capture_id", "status")
    new = i.cap.filter(k % 2 == 0).select("capture_id", F.lit("NEW").alias("status"))
    return op.insert_ignore(old, new, ["capture_id"])


@query("upsert_replace", """
  SELECT user_id, event_type, arg_max(value, (event_id % 2, event_id)) AS value, arg_max(event_id, (event_id % 2, event_id)) AS event_id FROM events GROUP BY 1, 2""")
def upsert_replace(i: Inputs):
    e = i.events.select("user_id", "event_type", "value", "event_id")
    k = F.col("event_id") % 2
    return op.upsert(op.upsert(e.limit(0), e.filter(k == 0), ["user_id", "event_type"], "event_id"), e.filter(k == 1), ["user_id", "event_type"], "event_id")


@query("cascade_delete", "SELECT capture_id, normalized FROM phone_f WHERE capture_id IN (SELECT capture_id FROM cap WHERE status <> 'FAILED')")
def cascade_delete(i: Inputs):
    return op.cascade_delete(i.phones.select("capture_id", "normalized"), i.cap.filter(F.col("status") != "FAILED"))


@query("orphan_sweep", "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p_partkey AND l.l_quantity > 48)")
def orphan_sweep(i: Inputs):
    edges = i.lineitem.filter(F.col("l_quantity") > 48).select(F.col("l_partkey").alias("p_partkey"))
    return op.orphan_sweep(i.part.select("p_partkey", "p_name"), edges, "p_partkey")


shared("qlog_hist", """
  SELECT event_id AS log_id, CAST(event_id AS BIGINT) AS ts,
    CASE event_id % 5 WHEN 0 THEN concat('Pixel ', event_id % 40) WHEN 1 THEN concat(' pixel ', event_id % 40) WHEN 2 THEN '  '
      WHEN 3 THEN concat('OTP ', 1000 + event_id) ELSE concat('order ', event_id) END AS text FROM events""")


def qlog_hist(i: Inputs):
    from .core import SHARED
    return i.spark.sql(SHARED["qlog_hist"].replace("FROM events", "FROM {events}"), events=i.events)


@query("trim_latest", "SELECT log_id, ts, text FROM qlog_hist ORDER BY ts DESC, log_id DESC LIMIT 25")
def trim_latest(i: Inputs):
    return op.keep_latest(qlog_hist(i), [F.desc("ts"), F.desc("log_id")], 25)


@query("history_record", """
  SELECT lower(trim(text)) AS query_key, max(ts) AS last_ts, arg_max(trim(text), ts) AS text FROM qlog_hist WHERE trim(text) <> ''
  GROUP BY 1 ORDER BY last_ts DESC, query_key LIMIT 25""")
def history_record(i: Inputs):
    return op.record_history(qlog_hist(i))


@query("history_sensitive_guard", """
  SELECT log_id, text FROM qlog_hist
  WHERE NOT (length(regexp_replace(text, '[^0-9]', '', 'g')) >= 4 AND contains(lower(text), 'otp') AND regexp_matches(text, '[0-9]{4}'))""")
def history_sensitive_guard(i: Inputs):
    return qlog_hist(i).filter(~op.is_sensitive_query(F.col("text"))).select("log_id", "text")


@query("rebuild_reset", "SELECT capture_id, filename, 'PENDING' AS status, '' AS ocr_text, CAST(NULL AS VARCHAR) AS content_hash FROM cap")
def rebuild_reset(i: Inputs):
    return op.rebuild_reset(i.cap).select("capture_id", "filename", "status", "ocr_text", "content_hash")


@query("delete_all_data", """
  SELECT 'captures' AS tbl, count(*) AS before, CAST(0 AS BIGINT) AS after FROM cap UNION ALL SELECT 'prices', count(*), 0 FROM price_f
  UNION ALL SELECT 'urls', count(*), 0 FROM url_f UNION ALL SELECT 'phones', count(*), 0 FROM phone_f""")
def delete_all_data(i: Inputs):
    """Rows before and after a wipe, per table."""
    return op.wipe({"captures": i.cap, "prices": i.prices, "urls": i.urls, "phones": i.phones})


# --- status changes ------------------------------------------------------
def _status(i: Inputs, df):
    return df.select("capture_id", "status")


@query("reset_stale", "SELECT capture_id, CASE WHEN status = 'PROCESSING' THEN 'PENDING' ELSE status END AS status FROM cap")
def reset_stale(i: Inputs):
    return _status(i, op.set_status(i.cap, "PENDING", F.col("status") == "PROCESSING"))


@query("mark_processing", "SELECT capture_id, CASE WHEN status = 'PENDING' AND capture_id % 2 = 0 THEN 'PROCESSING' ELSE status END AS status FROM cap")
def mark_processing(i: Inputs):
    return _status(i, op.set_status(i.cap, "PROCESSING", (F.col("status") == "PENDING") & (F.col("capture_id") % 2 == 0)))


@query("mark_failed", """
  SELECT capture_id, CASE WHEN capture_id % 17 = 0 THEN 'FAILED' ELSE status END AS status,
    CASE WHEN capture_id % 17 = 0 THEN left(repeat(concat('error ', capture_id, ' '), 60), 500) END AS processing_error FROM cap""")
def mark_failed(i: Inputs):
    errors = i.cap.filter(F.col("capture_id") % 17 == 0).select(
        "capture_id", F.expr("repeat(concat('error ', capture_id, ' '), 60)").alias("error"))
    return op.mark_failed(i.cap.select("capture_id", "status"), errors)


@query("requeue_one", "SELECT capture_id, CASE WHEN capture_id % 100 = 1 AND status <> 'PROCESSING' THEN 'PENDING' ELSE status END AS status FROM cap")
def requeue_one(i: Inputs):
    return _status(i, op.set_status(i.cap, "PENDING", (F.col("capture_id") % 100 == 1) & (F.col("status") != "PROCESSING")))


@query("mark_completed", """
  SELECT capture_id, CASE WHEN status = 'PROCESSING' THEN upper(ocr_text) ELSE ocr_text END AS ocr_text,
    CASE WHEN status = 'PROCESSING' THEN concat('n', capture_id) ELSE content_hash END AS content_hash,
    CASE WHEN status = 'PROCESSING' AND capture_id % 2 = 0 THEN capture_id - 1 END AS duplicate_of,
    CASE WHEN status = 'PROCESSING' THEN 'COMPLETED' ELSE status END AS status FROM cap""")
def mark_completed(i: Inputs):
    k = F.col("capture_id")
    results = i.cap.filter(F.col("status") == "PROCESSING").select(
        k, F.upper("ocr_text").alias("ocr_text"), F.concat(F.lit("n"), k).alias("content_hash"),
        F.when(k % 2 == 0, k - 1).alias("duplicate_of"))
    return op.mark_completed(i.cap.select("capture_id", "status", "ocr_text", "content_hash"), results)


@query("pending_batch", "SELECT capture_id, date_added FROM cap WHERE status = 'PENDING' ORDER BY date_added, capture_id LIMIT 12")
def pending_batch(i: Inputs):
    return op.pending_batch(i.cap).select("capture_id", "date_added")


@query("stale_embeddings", """
  SELECT c.capture_id FROM cap c LEFT JOIN (SELECT capture_id, CASE WHEN capture_id % 5 = 0 THEN '0' ELSE '1' END AS version FROM cap WHERE capture_id % 3 <> 0) v
    ON v.capture_id = c.capture_id
  WHERE c.status = 'COMPLETED' AND trim(c.ocr_text) <> '' AND (v.capture_id IS NULL OR v.version <> '1')""")
def stale_embeddings(i: Inputs):
    k = F.col("capture_id")
    vectors = i.cap.filter(k % 3 != 0).select(k, F.lit("hashed-ngram").alias("model"), F.when(k % 5 == 0, "0").otherwise("1").alias("version"))
    return op.stale_rows(i.cap, vectors, {"model": "hashed-ngram", "version": "1"}, need_text=True)


@query("stale_visuals", """
  SELECT c.capture_id FROM cap c LEFT JOIN (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'visual-v1' ELSE 'visual-v0' END AS mv FROM embeddings) v ON v.vec_id = c.capture_id
  WHERE c.status = 'COMPLETED' AND (v.vec_id IS NULL OR v.mv <> 'visual-v1')""")
def stale_visuals(i: Inputs):
    visuals = i.embeddings.select(F.col("vec_id").alias("capture_id"), F.when(F.col("label") % 2 == 0, "visual-v1").otherwise("visual-v0").alias("model_version"))
    return op.stale_rows(i.cap, visuals, {"model_version": "visual-v1"}, need_text=False)


@query("analysis_backlog", "SELECT capture_id FROM cap WHERE status <> 'FAILED' AND capture_id % 6 <> 0")
def analysis_backlog(i: Inputs):
    return op.analysis_backlog(i.cap, i.cap.filter(F.col("capture_id") % 6 == 0).select("capture_id"))


@query("user_override", """
  SELECT doc_id AS capture_id, CASE WHEN toxic = 1 THEN 'MESSAGES' ELSE 'DOCUMENTS' END AS category, 1.0::DOUBLE AS confidence, 'user' AS source FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'OTHER', 0.5::DOUBLE, 'auto' FROM documents""")
def user_override(i: Inputs):
    lab = i.labels.select(F.col("doc_id").alias("capture_id"), F.when(F.col("toxic") == 1, "MESSAGES").otherwise("DOCUMENTS").alias("category"),
                          F.lit(1.0).alias("confidence"), F.when(F.col("quality") == 1, "user").otherwise("auto").alias("source"))
    fresh = i.documents.select(F.col("doc_id").alias("capture_id"), F.lit("OTHER").alias("category"), F.lit(0.5).alias("confidence"), F.lit("auto").alias("source"))
    return op.reclassify(lab, fresh)


@query("suggestion_state", """
  SELECT capture_id, 'LARGE_FILE' AS kind, capture_id % 7 = 2 AS accepted FROM cap
  WHERE file_size > 15000000 AND capture_id % 7 NOT IN (0, 1)""")
def suggestion_state(i: Inputs):
    k = F.col("capture_id")
    s = i.cap.filter(F.col("file_size") > 15_000_000).select(k, F.lit("LARGE_FILE").alias("kind"))
    d = i.cap.filter(k % 7 < 3).select(k, F.lit("LARGE_FILE").alias("kind"), (k % 7 == 0).alias("dismissed"),
                                       (k % 7 == 1).alias("removed"), (k % 7 == 2).alias("accepted"))
    return op.visible_suggestions(s, d)


@query("archive_state", """
  SELECT c.capture_id, coalesce(a.archived, false) AS archived FROM cap c
  LEFT JOIN (SELECT vec_id, label > 4 AS archived FROM embeddings) a ON a.vec_id = c.capture_id""")
def archive_state(i: Inputs):
    e = i.embeddings.select(F.col("vec_id").alias("capture_id"), (F.col("label") > 4).alias("archived"), F.lit(2).alias("changed_at"))
    earlier = e.select("capture_id", (~F.col("archived")).alias("archived"), F.lit(1).alias("changed_at"))
    return op.archive_flags(i.cap, e.unionByName(earlier))


