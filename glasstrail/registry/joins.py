"""Joins, sorts and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ordered, visual
from .core import Inputs, query
from .filters import with_duplicates


@query("j_inner_equi", "SELECT l_orderkey, l_linenumber, p_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey")
def j_inner_equi(i: Inputs):
    return i.lineitem.join(i.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name", "l_quantity")


@query("j_left_outer", "SELECT c.capture_id, e.label FROM cap c LEFT JOIN embeddings e ON e.vec_id = c.capture_id")
def j_left_outer(i: Inputs):
    e = i.embeddings.select(F.col("vec_id").alias("capture_id"), "label")
    return i.cap.select("capture_id").join(e, "capture_id", "left")


@query("j_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j_left_anti(i: Inputs):
    big = i.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return i.customer.select("c_custkey").join(big, "c_custkey", "left_anti")


@query("j_semi_exists", """
  SELECT capture_id FROM cap WHERE capture_id IN (SELECT capture_id FROM price_f WHERE amount > 100000) OR capture_id IN (SELECT capture_id FROM otp_f) OR capture_id IN (SELECT capture_id FROM dup WHERE duplicate_of IS NOT NULL)""")
def j_semi_exists(i: Inputs):
    flags = filters.presence_flags(with_duplicates(i), {"BIG": i.prices.filter("amount > 100000"), "OTPS": i.codes})
    return flags.filter(filters.of_types(F.col("flags"), ["BIG", "OTPS", "DUPLICATES"])).select("capture_id")


@query("j_in_subquery", """
  SELECT DISTINCT p_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2')""")
def j_in_subquery(i: Inputs):
    edges = i.lineitem.select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    first = edges.join(i.part.filter("p_brand = 'Brand#2'").select("p_partkey"), "p_partkey", "left_semi").select("l_orderkey")
    return edges.join(first, "l_orderkey", "left_semi").join(i.part, "p_partkey").select("p_name").distinct()


@query("j_not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def j_not_in_subquery(i: Inputs):
    used = i.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return i.part.select("p_partkey").join(used, "p_partkey", "left_anti")


@query("j_derived_group", "SELECT o_orderkey, o_custkey, n FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) USING (o_custkey)")
def j_derived_group(i: Inputs):
    counted = i.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 12")
    return i.orders.select("o_orderkey", "o_custkey").join(counted, "o_custkey")


@query("j_theta_range", """
  SELECT band, count(*) AS n FROM price_f JOIN (VALUES ('low', 0.0, 500.0), ('mid', 500.0, 50000.0), ('high', 50000.0, 1e12)) AS b(band, lo, hi) ON amount >= lo AND amount < hi GROUP BY 1""")
def j_theta_range(i: Inputs):
    bands = i.spark.createDataFrame([("low", 0.0, 500.0), ("mid", 500.0, 50000.0), ("high", 50000.0, 1e12)], "band string, lo double, hi double")
    hit = i.prices.join(F.broadcast(bands), (F.col("amount") >= F.col("lo")) & (F.col("amount") < F.col("hi")))
    return hit.groupBy("band").agg(F.count("*").alias("n"))


@query("j_hash_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def j_hash_lookup(i: Inputs):
    """Nations and regions are fixed-size tables, so they are broadcast."""
    places = i.nation.join(F.broadcast(i.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return i.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j_hamming_threshold", "SELECT dhash, count(*) AS near, CAST(min(d) AS INTEGER) AS nearest FROM (SELECT a AS dhash, d FROM near_edge UNION ALL SELECT b, d FROM near_edge) GROUP BY 1")
def j_hamming_threshold(i: Inputs):
    """Per hash: other hashes within the threshold and the distance of the nearest one."""
    from .visual import visuals
    return visual.near_counts(visual.near_links(visuals(i).select("dhash")))


@query("j_time_proximity", """
  WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)
  SELECT event_id, n, first_near, last_near FROM e JOIN (SELECT a.event_id, count(*) AS n, min(b.t) AS first_near, max(b.t) AS last_near FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 1800 GROUP BY 1) USING (event_id)""")
def j_time_proximity(i: Inputs):
    """Neighbours of each event by the same user within 30 minutes, counted without emitting pairs."""
    e = i.events.selectExpr("event_id", "user_id", "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS t")
    near = ordered.near_in_time(e, ["user_id"], "t", 1800)
    return e.join(near, ["user_id", "t"]).select("event_id", F.col("n_near").alias("n"), "first_near", "last_near")


# --- sorts and sets ------------------------------------------------------
@query("s_multi_key", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 200")
def s_multi_key(i: Inputs):
    return i.orders.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("s_case_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey DESC LIMIT 100")
def s_case_order(i: Inputs):
    tier = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return i.orders.orderBy(tier, F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select("o_orderkey")


@query("s_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def s_limit_offset(i: Inputs):
    return i.customer.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey")


@query("s_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def s_topk(i: Inputs):
    return i.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("set_union_distinct", "SELECT capture_id, min(p) AS source FROM (SELECT capture_id, 0 AS p FROM price_f UNION ALL SELECT capture_id, 1 FROM cap WHERE status = 'PENDING') GROUP BY 1")
def set_union_distinct(i: Inputs):
    both = i.prices.select("capture_id", F.lit(0).alias("p")).unionByName(i.cap.filter("status = 'PENDING'").select("capture_id", F.lit(1).alias("p")))
    return both.groupBy("capture_id").agg(F.min("p").alias("source"))


@query("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_intersect(i: Inputs):
    return i.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(i.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_except(i: Inputs):
    return i.customer.select(F.col("c_custkey").alias("k")).subtract(i.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")))


@query("set_distinct_by", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def set_distinct_by(i: Inputs):
    return i.lineitem.dropDuplicates(["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey")
