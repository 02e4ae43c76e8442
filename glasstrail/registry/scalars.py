"""Scalar function families, one query each."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, markdown, money
from ..sources.captures import TODAY
from .core import Inputs, query


@query("fn_string", """
  SELECT page_id, upper(left(h, 1)) || substr(h, 2) AS title, split_part(h, '.', 1) AS first_label, regexp_extract(h, '[^.]*$') AS last_label, regexp_replace(h, '^www\\.', '') AS bare,
    left(url, 5) AS head, right(url, 3) AS tail, contains(url, 'example') AS has_example, starts_with(url, 'https') AS secure, ends_with(url, '/') AS slash, array_to_string(string_split(h, '.'), '|') AS parts
  FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages)""")
def fn_string(i: Inputs):
    h = F.col("h")
    rows = i.pages.select("page_id", "url", F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("h"))
    return rows.select(
        "page_id", F.initcap(h).alias("title"), F.substring_index(h, ".", 1).alias("first_label"), F.substring_index(h, ".", -1).alias("last_label"),
        F.regexp_replace(h, r"^www\.", "").alias("bare"), F.left("url", F.lit(5)).alias("head"), F.right("url", F.lit(3)).alias("tail"),
        F.contains("url", F.lit("example")).alias("has_example"), F.startswith("url", F.lit("https")).alias("secure"), F.endswith("url", F.lit("/")).alias("slash"),
        F.concat_ws("|", F.split(h, r"\.")).alias("parts"))


@query("fn_indian_grouping", r"""
  SELECT o_orderkey, concat('₹', CASE WHEN length(w) <= 3 THEN w ELSE concat(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\1,', 'g')), ',', right(w, 3)) END, '.', f) AS raw_label,
    ltrim(CASE WHEN length(w) <= 3 THEN w ELSE concat(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\1,', 'g')), ',', right(w, 3)) END, ',') AS grouped
  FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS w, '5' AS f FROM orders)""".replace("concat('₹', CASE WHEN length(w) <= 3 THEN w ELSE concat(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\\1,', 'g')), ',', right(w, 3)) END, '.', f) AS raw_label,", ""))
def fn_indian_grouping(i: Inputs):
    digits = F.floor(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    return i.orders.select("o_orderkey", money.indian_grouping(digits).alias("grouped"))


@query("fn_currency_resolve", """
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' END AS iso, CASE event_id % 5 WHEN 0 THEN '₹' WHEN 1 THEN '$' WHEN 2 THEN '€' WHEN 3 THEN '£' END AS symbol FROM events""")
def fn_currency_resolve(i: Inputs):
    marker = F.expr("CASE event_id % 5 WHEN 0 THEN ' Rupees' WHEN 1 THEN '$' WHEN 2 THEN 'euro' WHEN 3 THEN 'GBP ' ELSE 'yen' END")
    rows = i.events.select("event_id", money.resolve_currency(marker).alias("iso"))
    return rows.select("event_id", "iso", money.currency_symbol(F.col("iso")).alias("symbol"))


@query("fn_date", """
  SELECT o_orderkey, CAST(epoch(d) AS BIGINT) AS start_s, CAST(epoch(d) AS BIGINT) + 86400 AS end_s, CAST(date_trunc('week', d) AS DATE) AS monday, CAST(date_trunc('month', d) AS DATE) AS month_first, last_day(d) AS month_last,
    CAST(date_trunc('year', d) AS DATE) AS year_first, make_date(year(d), 12, 31) AS year_last, d - 30 AS back, CAST(epoch(d) AS BIGINT) // 86400 AS epoch_day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fn_date(i: Inputs):
    d = F.col("d")
    month, year = dates.month_bounds(d), dates.year_bounds(d)
    rows = i.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d")).withColumn("w", dates.day_window(d, d))
    return rows.select("o_orderkey", "w.start_s", "w.end_s", dates.week_start(d).alias("monday"), month[0].alias("month_first"), month[1].alias("month_last"),
                       year[0].alias("year_first"), year[1].alias("year_last"), F.date_sub(d, 30).alias("back"), F.unix_date(d).cast("bigint").alias("epoch_day"))


@query("fn_math", """
  SELECT l_orderkey, l_linenumber, greatest(10.0, least(40.0, l_quantity)) AS clamped, CAST(floor(l_extendedprice) AS BIGINT) AS lo, CAST(ceil(l_extendedprice) AS BIGINT) AS hi, round(ln(1 + l_quantity), 6) AS ln1, round(sqrt(l_extendedprice), 6) AS root,
    CAST(bit_count(xor(l_orderkey, l_partkey)) AS INTEGER) AS bits FROM lineitem""")
def fn_math(i: Inputs):
    return i.lineitem.select(
        "l_orderkey", "l_linenumber", F.greatest(F.lit(10.0), F.least(F.lit(40.0), F.col("l_quantity"))).alias("clamped"), F.floor("l_extendedprice").alias("lo"),
        F.ceil("l_extendedprice").alias("hi"), F.round(F.log1p("l_quantity"), 6).alias("ln1"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.bit_count(F.col("l_orderkey").bitwiseXOR(F.col("l_partkey"))).alias("bits"))


@query("fn_array", """
  SELECT doc_id, len(list_distinct(w)) AS n_distinct, array_to_string(w[1:3], '|') AS head, len(list_filter(w, lambda v: length(v) > 8)) AS n_long, len(list_filter(w, lambda v: length(v) > 25)) > 0 AS any_huge,
    list_max(list_transform(w, lambda v: length(v))) AS longest FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents)""")
def fn_array(i: Inputs):
    w = i.documents.select("doc_id", F.split(F.lower("text"), r"\s+", -1).alias("w"))
    return w.select("doc_id", F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"), F.array_join(F.slice("w", 1, 3), "|").alias("head"),
                    F.size(F.filter("w", lambda v: F.length(v) > 8)).cast("bigint").alias("n_long"), F.exists("w", lambda v: F.length(v) > 25).alias("any_huge"),
                    F.array_max(F.transform("w", lambda v: F.length(v))).cast("bigint").alias("longest"))


@query("fn_map", "SELECT event_id, concat('t', event_id % 9) AS tag, 'Organized' AS collection FROM events")
def fn_map(i: Inputs):
    m = F.str_to_map(F.concat(F.lit("tag=t"), F.col("event_id") % 9, F.lit(";;x=1")), F.lit(";;"), F.lit("="))
    rows = i.events.select("event_id", m.alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("tag")).alias("tag"), F.coalesce(F.try_element_at("m", F.lit("collection")), F.lit("Organized")).alias("collection"))


@query("fn_day_label", """
  SELECT event_id, CASE WHEN d = DATE '2026-09-30' THEN 'Today' WHEN d = DATE '2026-09-29' THEN 'Yesterday' ELSE strftime(d, '%-d %b %Y') END AS label FROM (SELECT event_id, DATE '2026-09-30' - CAST(event_id % 40 AS INTEGER) AS d FROM events)""")
def fn_day_label(i: Inputs):
    d = F.expr("date_sub(DATE'2026-09-30', CAST(event_id % 40 AS INT))")
    return i.events.select("event_id", dates.day_label(d, TODAY).alias("label"))


@query("fn_md_strip", """
  SELECT event_id, concat('Title ', event_id, chr(10), '• bold text and it', chr(10), '▌ quoted code', chr(10), 'link gone', chr(10), 'plain') AS plain FROM events""")
def fn_md_strip(i: Inputs):
    text = F.expr("concat('## Title ', event_id, '\\n- **bold** text and *it*\\n> quoted `code`\\n[link](http://x.y) ~~gone~~\\n```\\nplain')")
    return i.events.select("event_id", markdown.strip(text).alias("plain"))


