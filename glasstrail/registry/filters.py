"""Structured search predicates."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as x
from ..operators import filters as op
from .core import Inputs, query, shared

shared("dup", "SELECT capture_id, CASE WHEN min_id <> capture_id THEN min_id END AS duplicate_of FROM (SELECT capture_id, content_hash, CASE WHEN content_hash IS NOT NULL THEN min(capture_id) OVER (PARTITION BY content_hash) END AS min_id FROM cap)")
shared("flag", """
  SELECT capture_id, 'URLS' AS t FROM url_f UNION SELECT capture_id, 'PRICES' FROM price_f UNION SELECT capture_id, 'DATES' FROM date_f
  UNION SELECT capture_id, 'PHONES' FROM phone_f UNION SELECT capture_id, 'OTPS' FROM code_f
  UNION SELECT capture_id, 'DUPLICATES' FROM dup WHERE duplicate_of IS NOT NULL""")

shared("flag_otp", "SELECT capture_id, t FROM flag WHERE t <> 'OTPS' UNION ALL SELECT capture_id, 'OTPS' FROM otp_f")


def with_duplicates(i: Inputs):
    """Captures with the smallest id of their content hash, when that is another capture."""
    first = i.cap.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("capture_id").alias("first_id"))
    return (i.cap.join(first, "content_hash", "left")
            .withColumn("duplicate_of", F.when(F.col("first_id") != F.col("capture_id"), F.col("first_id"))).drop("first_id"))


def children(i: Inputs):
    return {"URLS": i.urls, "PRICES": i.prices, "DATES": i.dates, "PHONES": i.phones, "OTPS": i.codes}


@query("f_eligible", "SELECT capture_id, status FROM cap WHERE status <> 'FAILED'")
def f_eligible(i: Inputs):
    return i.cap.filter(op.eligible()).select("capture_id", "status")


@query("f_ids", """
  SELECT c.capture_id, c.filename, CAST(b.item_id AS BIGINT) AS pos FROM cap c JOIN benchmark b ON c.capture_id = b.item_id * 7 + 3""")
def f_ids(i: Inputs):
    wanted = i.benchmark.select((F.col("item_id") * 7 + 3).alias("capture_id"), F.col("item_id").alias("pos"))
    return op.ids_in_order(i.cap.select("capture_id", "filename"), wanted)


@query("f_date_window", "SELECT capture_id, date_added FROM cap WHERE date_added >= 883612800 AND date_added < 915148800")
def f_date_window(i: Inputs):
    return i.cap.filter(op.date_window(883612800, 915148800)).select("capture_id", "date_added")


@query("f_price_band", "SELECT capture_id, filename FROM cap WHERE capture_id IN (SELECT capture_id FROM price_f WHERE currency = 'INR' AND amount BETWEEN 1000 AND 40000)")
def f_price_band(i: Inputs):
    band = op.price_band(F.col("amount"), F.col("currency"), 1000.0, 40000.0, "INR")
    return op.having(i.cap, i.prices, band).select("capture_id", "filename")


@query("f_phone", "SELECT capture_id FROM phone_f WHERE normalized = (SELECT min(normalized) FROM phone_f)")
def f_phone(i: Inputs):
    target = i.phones.agg(F.min("normalized").alias("normalized"))
    return op.having(i.cap.select("capture_id"), i.phones.join(F.broadcast(target), "normalized", "left_semi"), F.lit(True))


@query("f_domain", """
  WITH d AS (SELECT unnest(['example.com', 'example.org', 'blog.example.com', 'ample.com']) AS domain),
    h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)
  SELECT domain, page_id FROM h JOIN d ON host = domain OR ends_with(host, concat('.', domain))""")
def f_domain(i: Inputs):
    hosts = i.pages.select("page_id", F.explode(x.urls(F.col("url"))).alias("u")).select("page_id", F.col("u.host").alias("host"))
    domains = i.spark.createDataFrame([(d,) for d in ("example.com", "example.org", "blog.example.com", "ample.com")], "domain string")
    keyed = hosts.select("page_id", F.explode(op.host_suffixes(F.col("host"))).alias("domain"))
    return keyed.join(domains, "domain").select("domain", "page_id")


@query("f_code", "SELECT capture_id, code FROM code_f WHERE right(code, 2) = '26'")
def f_code(i: Inputs):
    return op.having(i.codes.select("capture_id", "code"), i.codes, F.col("code").endswith("26"))


@query("f_content_types", "SELECT DISTINCT capture_id FROM flag_otp WHERE t IN ('URLS', 'OTPS', 'DUPLICATES')")
def f_content_types(i: Inputs):
    flags = op.presence_flags(with_duplicates(i), children(i))
    return flags.filter(op.of_types(F.col("flags"), ["URLS", "OTPS", "DUPLICATES"])).select("capture_id")


@query("f_filter_chip", "SELECT t, count(*) AS n FROM flag_otp GROUP BY t")
def f_filter_chip(i: Inputs):
    flags = op.presence_flags(with_duplicates(i), children(i))
    return flags.select(F.explode("flags").alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query("f_color", """
  SELECT capture_id, 'blue' AS wanted FROM vis WHERE list_contains(colors, 'blue') UNION ALL SELECT capture_id, 'dark' FROM vis WHERE is_dark
  UNION ALL SELECT capture_id, 'light' FROM vis WHERE NOT is_dark""")
def f_color(i: Inputs):
    from .visual import visuals
    v = visuals(i)
    parts = [v.filter(op.has_color(F.col("colors"), F.col("is_dark"), c)).select("capture_id", F.lit(c).alias("wanted")) for c in ("blue", "dark", "light")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f_long_aspect", "SELECT capture_id, width, height FROM cap WHERE width > 0 AND height >= 2.8 * width")
def f_long_aspect(i: Inputs):
    return i.cap.filter(op.is_long()).select("capture_id", "width", "height")


@query("f_optional", "SELECT capture_id FROM cap WHERE status <> 'FAILED' AND date_added >= 915148800")
def f_optional(i: Inputs):
    return i.cap.filter(op.all_of(op.eligible(), op.date_window(915148800, None), None)).select("capture_id")


@query("f_manual_merge", """
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 100 ELSE event_id END AS start_ms,
    CASE event_id % 4 WHEN 0 THEN 'URLS' WHEN 1 THEN 'DUPLICATES|URLS' WHEN 2 THEN 'OTPS|URLS' ELSE 'DUPLICATES|OTPS|URLS' END AS types FROM events""")
def f_manual_merge(i: Inputs):
    k = F.col("event_id")
    manual = F.when(k % 3 == 0, F.lit(100).cast("bigint"))
    types = F.array_union(F.array(F.lit("URLS")), F.array_compact(F.array(
        F.when(k % 2 == 1, "DUPLICATES"), F.when(k % 4 >= 2, "OTPS"))))
    return i.events.select(k, op.merge_manual(k, manual).alias("start_ms"), F.array_join(F.array_sort(types), "|").alias("types"))


@query("f_keyset_page", """
  SELECT capture_id, date_added FROM cap WHERE status <> 'FAILED' AND (date_added < 915148800 OR (date_added = 915148800 AND capture_id < 5000))
  ORDER BY date_added DESC, capture_id DESC LIMIT 50""")
def f_keyset_page(i: Inputs):
    return op.keyset_page(i.cap, (915148800, 5000), 50).select("capture_id", "date_added")


@query("f_like_escape", r"SELECT page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') AS escaped, contains(lower(url), 'page=2') AS hit FROM pages")
def f_like_escape(i: Inputs):
    return i.pages.select("page_id", op.escape_like(F.col("url")).alias("escaped"), F.lower("url").contains("page=2").alias("hit"))
