"""Extraction jobs: text columns to fact tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import extract as x
from ..operators.facts import blocks_of, join_lines
from ..sources.captures import TODAY, spread
from .core import Inputs, query, shared

# Links inside running text, wrapped in punctuation that must be trimmed.
shared("page_links", "SELECT page_id, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")


@query("x_urls", """
  SELECT page_id, url, host FROM page_links UNION ALL SELECT page_id, concat('https://www.', host, '/x?y=1'), concat('www.', host) FROM page_links""")
def x_urls(i: Inputs):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    text = F.concat(F.lit("see ("), F.col("url"), F.lit("), or "), F.lit("WWW."), host, F.lit("/x?y=1#top! mail support@example.com v2.1 notes.doc"))
    rows = spread(i.pages.select("page_id", text.alias("text")))
    return rows.select("page_id", F.explode(x.urls("text")).alias("u")).select("page_id", "u.url", "u.host")


@query("x_prices", "SELECT capture_id, raw, currency, amount FROM price_f")
def x_prices(i: Inputs):
    return i.prices.select("capture_id", "raw", "currency", "amount")


@query("x_phones", "SELECT capture_id, raw, normalized, 'IN' AS country FROM phone_f")
def x_phones(i: Inputs):
    return i.phones.select("capture_id", "raw", "normalized", "country")


@query("x_dates", """
  WITH e AS (SELECT event_id, CAST(ts AS DATE) + CAST(event_id % 900 AS INTEGER) AS d, event_id % 6 AS k FROM events)
  SELECT event_id, CASE k WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%-d %B %Y') WHEN 2 THEN strftime(d, '%b %-d, %Y') WHEN 3 THEN strftime(d, '%Y%m%d') WHEN 4 THEN strftime(d, '%d-%m-%y') ELSE strftime(d, '%-d %b') END AS raw,
    CAST(datediff('day', DATE '1970-01-01', CASE WHEN k = 5 THEN make_date(2026, month(d), day(d)) WHEN k = 0 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END) AS BIGINT) AS epoch_day, k NOT IN (4, 5) AS has_year
  FROM e WHERE (k <> 4 OR day(d) > 12) AND (k <> 5 OR (month(d) BETWEEN 7 AND 11 AND NOT (month(d) = 2 AND day(d) = 29)))""")
def x_dates(i: Inputs):
    e = i.events.selectExpr("event_id", "date_add(CAST(ts AS DATE), CAST(event_id % 900 AS INT)) AS d", "event_id % 6 AS k")
    text = F.expr("""concat('seen on ', CASE k WHEN 0 THEN date_format(d, 'dd/MM/yyyy') WHEN 1 THEN date_format(d, 'd MMMM yyyy') WHEN 2 THEN date_format(d, 'MMM d, yyyy')
      WHEN 3 THEN date_format(d, 'yyyyMMdd') WHEN 4 THEN date_format(d, 'dd-MM-yy') ELSE date_format(d, 'd MMM') END, ' at 12:30, item 31/02/2026')""")
    rows = spread(e.select("event_id", text.alias("text")))
    return rows.select("event_id", F.explode(x.dates("text", TODAY)).alias("f")).select("event_id", "f.raw", "f.epoch_day", "f.has_year")


@query("x_codes", "SELECT capture_id, code FROM otp_f")
def x_codes(i: Inputs):
    return i.codes.select("capture_id", "code")


_CATEGORY = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{c}'" for w, c in lx.EXPENSE_CATEGORIES) + " END"


@query("x_receipts", f"""
  SELECT event_id, concat(CASE WHEN event_id % 4 = 0 THEN 'Big Bazaar Fresh' WHEN event_id % 4 = 1 THEN 'Uber trip' WHEN event_id % 4 = 2 THEN 'Acme ltd' ELSE 'Invoice' END) AS merchant,
    round(100 + value, 2) AS amount, CASE WHEN event_id % 3 = 0 THEN 'INR' WHEN event_id % 3 = 1 THEN 'USD' ELSE 'EUR' END AS currency,
    CASE event_id % 4 WHEN 1 THEN 'Transport' WHEN 2 THEN 'Healthcare' END AS category FROM events""")
def x_receipts(i: Inputs):
    text = F.expr("""concat(CASE WHEN event_id % 4 = 0 THEN 'Page 1\\nBig Bazaar Fresh' WHEN event_id % 4 = 1 THEN 'x\\nUber trip' WHEN event_id % 4 = 2 THEN '12\\nAcme ltd\\n\\nApollo' ELSE 'Invoice' END, '\\n\\nTax ',
      CASE WHEN event_id % 3 = 0 THEN '₹' WHEN event_id % 3 = 1 THEN '$' ELSE 'EUR ' END, '3.50\\nSum ', CASE WHEN event_id % 3 = 0 THEN '₹' WHEN event_id % 3 = 1 THEN '$ ' ELSE 'EUR ' END, format_string('%.2f', 100 + value))""")
    rows = spread(i.events.select("event_id", text.alias("text"))).select("event_id", x.receipt("text").alias("r"))
    return rows.filter("r IS NOT NULL").select("event_id", "r.merchant", "r.amount", "r.currency", "r.category")


@query("x_order_codes", "SELECT capture_id, kind, code FROM order_f")
def x_order_codes(i: Inputs):
    return i.order_codes.select("capture_id", "kind", "code")


@query("x_emails", r"""
  SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda z: list_position(m, z[1]) = z[2]), lambda z: z[1]), '|') AS emails FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+\s*@\s*[a-zA-Z0-9.-]+\s*\.\s*[a-zA-Z]{2,}'), lambda v: regexp_replace(v, '\s+', '', 'g')) AS m FROM documents)
  WHERE len(m) > 0""")
def x_emails(i: Inputs):
    rows = i.documents.select("doc_id", x.emails("text").alias("e")).filter("size(e) > 0")
    return rows.select("doc_id", F.array_join("e", "|").alias("emails"))


@query("x_emails_all", r"""
  SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+\s*@\s*[a-zA-Z0-9.-]+\s*\.\s*[a-zA-Z]{2,}')), '\s+', '', 'g') AS email FROM documents""")
def x_emails_all(i: Inputs):
    return i.documents.select("doc_id", F.explode(x.emails("text")).alias("email"))


@query("x_addresses", "SELECT c_custkey, concat(c_custkey % 900 + 1, ' ', c_mktsegment, ' Garden Road') AS address FROM customer")
def x_addresses(i: Inputs):
    rows = i.customer.select("c_custkey", F.expr("concat('ship to ', c_custkey % 900 + 1, ' ', c_mktsegment, ' Garden Road, unit 7, total 12') AS text"))
    return rows.select("c_custkey", F.explode(x.addresses("text")).alias("address"))


@query("x_all_facts", """
  SELECT capture_id, (capture_id % 8 IN (3, 6))::INT AS n_urls, (capture_id % 8 IN (0, 1, 4, 5))::INT AS n_prices, (capture_id % 8 = 5)::INT AS n_phones, (capture_id % 8 = 2 AND (100000 + capture_id % 900000) % 111111 <> 0)::INT AS n_codes,
    (capture_id % 8 = 7)::INT AS n_dates, (capture_id % 8 = 1)::INT AS n_orders, capture_id % 8 IN (0, 1, 4, 5) AS has_receipt, 0 AS n_failures FROM cap""")
def x_all_facts(i: Inputs):
    rows = spread(i.cap.select("capture_id", "ocr_text")).select("capture_id", x.all_facts("ocr_text", TODAY).alias("f"))
    sizes = [F.size(f"f.{n}").alias(f"n_{n}") for n in ("urls", "prices", "phones", "codes", "dates", "orders", "failures")]
    return rows.select("capture_id", *sizes, F.col("f.receipt").isNotNull().alias("has_receipt"))


@query("x_join_lines", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda v: trim(v) <> ''), chr(10)) AS body FROM documents WHERE trim(text) <> ''")
def x_join_lines(i: Inputs):
    return join_lines(blocks_of(i.documents, "doc_id", "text"), "doc_id").select("doc_id", F.col("text").alias("body"))
