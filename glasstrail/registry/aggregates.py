"""Aggregations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as op
from .core import Inputs, query
from .filters import with_duplicates


@query("agg_status_counts", "SELECT status, count(*) AS n FROM cap GROUP BY status")
def agg_status_counts(i: Inputs):
    return op.status_counts(i.cap)


@query("agg_index_stats", """
  SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'PENDING') AS pending,
    count(*) FILTER (status = 'PROCESSING') AS processing, count(*) FILTER (status = 'FAILED') AS failed,
    (SELECT count(*) FROM dup WHERE duplicate_of IS NOT NULL) AS duplicate_items,
    (SELECT count(*) FROM (SELECT content_hash FROM cap WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups FROM cap""")
def agg_index_stats(i: Inputs):
    return op.index_stats(with_duplicates(i))


@query("agg_total_count", "SELECT count(*) AS n, count(*) FILTER (status = 'PENDING') AS pending FROM cap")
def agg_total_count(i: Inputs):
    return i.cap.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PENDING").alias("pending"))


@query("agg_dup_items", "SELECT count(*) AS n FROM dup WHERE duplicate_of IS NOT NULL")
def agg_dup_items(i: Inputs):
    return with_duplicates(i).agg(F.count_if(F.col("duplicate_of").isNotNull()).alias("n"))


@query("agg_dup_groups", "SELECT count(*) AS n FROM (SELECT content_hash FROM cap WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def agg_dup_groups(i: Inputs):
    return op.duplicate_hashes(i.cap).agg(F.count("*").alias("n"))


@query("agg_dup_members", """
  SELECT content_hash, capture_id, date_added FROM cap WHERE content_hash IN
    (SELECT content_hash FROM cap WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""")
def agg_dup_members(i: Inputs):
    return op.duplicate_members(i.cap).select("content_hash", "capture_id", "date_added")


@query("agg_indexed_bytes", "SELECT coalesce(sum(file_size), 0)::BIGINT AS bytes FROM cap")
def agg_indexed_bytes(i: Inputs):
    return i.cap.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


@query("agg_category_counts", "SELECT category, count(DISTINCT capture_id) AS n FROM cat_f GROUP BY category")
def agg_category_counts(i: Inputs):
    from .semantic import categories
    return op.category_counts(categories(i))


@query("agg_category_members", """
  SELECT capture_id, max(row_id) AS last_row FROM (SELECT l_suppkey AS capture_id, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem WHERE l_returnflag = 'A')
  GROUP BY capture_id ORDER BY last_row DESC, capture_id LIMIT 50""")
def agg_category_members(i: Inputs):
    rows = i.lineitem.filter(F.col("l_returnflag") == "A").select(
        F.col("l_suppkey").alias("capture_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return op.latest_members(rows, 50)


@query("agg_top_entities", """
  SELECT p_name AS display_name, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey
  GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2 ORDER BY n DESC, display_name LIMIT 60""")
def agg_top_entities(i: Inputs):
    edges = (i.lineitem.select(F.col("l_orderkey").alias("capture_id"), F.col("l_partkey").alias("p_partkey"))
             .join(i.part.select("p_partkey", F.col("p_name").alias("display_name")), "p_partkey"))
    return op.top_entities(edges, ["display_name"], min_count=2, limit=60)


@query("agg_expense_total", "SELECT currency, round(sum(amount), 6) AS total FROM price_f GROUP BY currency")
def agg_expense_total(i: Inputs):
    return op.totals(i.prices, "currency")


@query("agg_expense_category", """
  SELECT currency, coalesce(category, 'ALL') AS category, round(sum(amount), 6) AS total FROM
    (SELECT currency, CASE WHEN capture_id % 8 = 0 THEN 'Shopping' WHEN capture_id % 8 = 1 THEN 'Travel' ELSE 'Other' END AS category, amount FROM price_f)
  GROUP BY GROUPING SETS ((currency, category), (currency))""")
def agg_expense_category(i: Inputs):
    k = F.col("capture_id") % 8
    rows = i.prices.withColumn("category", F.when(k == 0, "Shopping").when(k == 1, "Travel"))
    return op.expenses_by_category(rows)


@query("agg_collections", """
  SELECT o_custkey AS collection_id, count(*) AS members, arg_max(o_orderkey, (epoch(o_orderdate), o_orderkey)) AS cover_id FROM orders GROUP BY 1""")
def agg_collections(i: Inputs):
    members = i.cap.select(F.col("owner_id").alias("collection_id"), "capture_id", "date_added")
    return op.collection_summary(members)


@query("agg_timeline", """
  WITH c AS (SELECT date_added // 86400 AS epoch_day, capture_id FROM cap),
    k AS (SELECT epoch_day, category, count(*) AS n FROM c JOIN cat_f USING (capture_id) WHERE category <> 'OTHER' GROUP BY 1, 2),
    t AS (SELECT epoch_day, string_agg(category, '|' ORDER BY n DESC, category) AS top FROM
      (SELECT *, row_number() OVER (PARTITION BY epoch_day ORDER BY n DESC, category) AS rn FROM k) WHERE rn <= 2 GROUP BY 1)
  SELECT epoch_day, count(*) AS captures, coalesce(any_value(top), '') AS categories FROM c LEFT JOIN t USING (epoch_day) GROUP BY 1""")
def agg_timeline(i: Inputs):
    from .semantic import categories
    return op.timeline(i.cap, categories(i))


_WORDS = r"""
  SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents)
  WHERE length(w) >= 4 AND NOT regexp_full_match(w, '[0-9]+')
    AND w NOT IN ('the','and','for','with','from','this','that','have','your','screenshot','screenshots','image','photo','https','http','www','com') GROUP BY 1, 2"""


@query("agg_top_words", f"SELECT doc_id, w AS word, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rn FROM ({_WORDS})) WHERE rn <= 8")
def agg_top_words(i: Inputs):
    return op.top_words(i.documents, "doc_id", "text", 8)


@query("agg_price_answer", """
  SELECT owner_id, count(DISTINCT amount) AS n_prices, min(amount) AS lowest, max(amount) AS highest FROM price_f JOIN cap USING (capture_id) GROUP BY 1""")
def agg_price_answer(i: Inputs):
    rows = i.prices.join(i.cap.select("capture_id", "owner_id"), "capture_id")
    return op.price_answer(rows, ["owner_id"])


@query("agg_signal_summary", "SELECT t AS signal, count(*) AS n FROM flag_otp GROUP BY 1")
def agg_signal_summary(i: Inputs):
    from ..operators.filters import presence_flags
    from .filters import children
    return op.signal_summary(presence_flags(with_duplicates(i), children(i)).withColumnRenamed("flags", "signals"))


@query("agg_counts_misc", """
  SELECT 'conversations' AS what, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'messages', count(*) FROM conversations
  UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'relations', count(*) FROM lineitem UNION ALL SELECT 'embeddings', count(*) FROM embeddings""")
def agg_counts_misc(i: Inputs):
    return op.table_counts({"messages": i.conversations, "entities": i.part, "relations": i.lineitem, "embeddings": i.embeddings,
                            "conversations": i.conversations.select("conv_id").distinct()})


