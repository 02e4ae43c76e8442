"""Privacy operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import privacy as op
from ..sources.captures import spread
from .core import Inputs, query, shared


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# Texts of every kind: documents, captures and conversations with identifiers mixed in.
shared("texts", """
  SELECT concat('d', doc_id) AS text_id, text FROM documents UNION ALL SELECT concat('c', o_orderkey), ocr_text FROM orders JOIN cap ON capture_id = o_orderkey
  UNION ALL SELECT concat('e', event_id), CASE event_id % 12 WHEN 0 THEN concat('Your OTP is ', 100000 + event_id) WHEN 1 THEN concat('pay user', event_id, '@okaxis now') WHEN 2 THEN concat('card 4111 1111 1111 ', 1000 + event_id % 9000)
    WHEN 3 THEN concat('aadhaar 1234 5678 ', 1000 + event_id % 9000) WHEN 4 THEN 'PAN ABCDE1234F' WHEN 5 THEN concat('chat message from me', event_id, '@mail.com') WHEN 6 THEN concat('password: hunter', event_id)
    WHEN 7 THEN concat('account 123456789', event_id % 1000, ' IFSC HDFC0ABC123') WHEN 8 THEN concat('call +91 98765-4', 1000 + event_id % 9000) WHEN 9 THEN 'voter id and passport, WhatsApp my secret' WHEN 10 THEN concat('txn id TX', event_id, 'ABCDEF') ELSE 'Pixel review with great camera' END FROM events""")


def texts(i: Inputs):
    from .core import SHARED
    sql = SHARED["texts"].split("UNION ALL SELECT concat('e'")[1]
    e = i.spark.sql("SELECT concat('e'" + sql.replace("FROM events", "FROM {events}").replace("END FROM", "END AS text FROM").replace("event_id), CASE", "event_id) AS text_id, CASE"), events=i.events)
    d = i.documents.select(F.concat(F.lit("d"), "doc_id").alias("text_id"), "text")
    c = i.cap.select(F.concat(F.lit("c"), "capture_id").alias("text_id"), F.col("ocr_text").alias("text"))
    return spread(d.unionByName(c).unionByName(e))


_KINDS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN '{k}' END" for k, p in lx.KIND_PATTERNS) + "], lambda v: v IS NOT NULL)"


@query("p_kinds", f"SELECT text_id, array_to_string({_KINDS}, '|') AS kinds FROM texts")
def p_kinds(i: Inputs):
    return texts(i).select("text_id", F.array_join(op.sensitive_kinds(F.col("text")), "|").alias("kinds"))


def _m(p: str) -> str:
    return f"regexp_matches(text, {_q(p)})"


_COMM = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in lx.COMMUNICATION_WORDS) + ")"
shared("levels", f"""
  SELECT text_id, CASE WHEN comm THEN 'PRIVATE_COMMUNICATION' WHEN pan OR nid THEN 'IDENTITY' WHEN bank OR card OR upi THEN 'FINANCIAL' WHEN pw OR otp THEN 'AUTHENTICATION' WHEN txn THEN 'FINANCIAL'
      WHEN mail OR phone THEN 'PERSONAL' ELSE 'PUBLIC' END AS level,
    (otp::INT + pw::INT + upi::INT + card::INT + bank::INT + txn::INT + nid::INT + pan::INT + mail::INT + phone::INT + comm::INT) AS n_reasons,
    CASE WHEN comm THEN 0.7 ELSE greatest(CASE WHEN pan OR nid THEN 0.9 WHEN bank THEN 0.9 WHEN card THEN 0.85 WHEN upi THEN 0.9 WHEN pw THEN 0.85 WHEN otp THEN 0.9 ELSE 0.5 END, CASE WHEN txn OR mail OR phone THEN 0.6 ELSE 0 END) END AS confidence
  FROM (SELECT text_id, ({_m(lx.CODE_LABELLED)} OR {_m(lx.SIX_DIGITS)}) AS otp, {_m(lx.PASSWORD)} AS pw, {_m('(?i)' + lx.UPI)} AS upi, {_m(lx.CARD)} AS card, ({_m(lx.ACCOUNT_NUMBER)} AND {_m(lx.IFSC)}) AS bank,
    {_m(lx.TRANSACTION_ID)} AS txn, {_m(lx.NATIONAL_ID)} AS nid, {_m(lx.PAN)} AS pan, {_m(lx.EMAIL)} AS mail, {_m(lx.PHONE)} AS phone, {_COMM} AS comm FROM texts)""")


def _classified(i: Inputs):
    return texts(i).select("text_id", op.classify(F.col("text")).alias("c"))


@query("p_classify", "SELECT text_id, level, n_reasons, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM levels")
def p_classify(i: Inputs):
    return _classified(i).select("text_id", "c.level", F.size("c.reasons").alias("n_reasons"), F.round("c.confidence", 6).alias("confidence"))


@query("p_high", "SELECT text_id FROM levels WHERE level IN ('AUTHENTICATION', 'FINANCIAL', 'IDENTITY', 'HIGHLY_SENSITIVE')")
def p_high(i: Inputs):
    return _classified(i).filter(op.is_high(F.col("c.level"))).select("text_id")


_DESCRIBE = "CASE level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.DESCRIPTIONS.items()) + " END"


@query("p_describe", f"SELECT {_DESCRIBE} AS description, count(*) AS n FROM levels GROUP BY 1")
def p_describe(i: Inputs):
    return _classified(i).groupBy(op.describe(F.col("c.level")).alias("description")).agg(F.count("*").alias("n"))


_REDACT = "text"
for _p, _mark in op.REDACTIONS:
    _REDACT = f"regexp_replace({_REDACT}, {_q(_p)}, '{_mark}', 'g')"


@query("p_redact", f"SELECT text_id, {_REDACT} AS redacted FROM texts")
def p_redact(i: Inputs):
    return texts(i).select("text_id", op.redact(F.col("text")).alias("redacted"))


_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_m(p)} THEN '{k}' END" for k, p in op.PII) + "], lambda v: v IS NOT NULL)"


@query("p_types", f"SELECT text_id, array_to_string({_TYPES}, '|') AS types, len({_TYPES}) > 0 AS sensitive FROM texts")
def p_types(i: Inputs):
    rows = texts(i).select("text_id", op.pii_types(F.col("text")).alias("t"))
    return rows.select("text_id", F.array_join("t", "|").alias("types"), (F.size("t") > 0).alias("sensitive"))


@query("p_sensitivity_level", f"""
  SELECT text_id, CASE WHEN list_has_any(k, ['BANKING', 'IDENTITY', 'PASSWORD']) THEN 'HIGHLY_SENSITIVE' WHEN len(k) > 0 THEN 'SENSITIVE' ELSE 'NORMAL' END AS level FROM (SELECT text_id, {_KINDS} AS k FROM texts)""")
def p_sensitivity_level(i: Inputs):
    rows = texts(i).select("text_id", op.sensitive_kinds(F.col("text")).alias("k"))
    return rows.select("text_id", op.sensitivity_level(F.col("k")).alias("level"))
