"""Rule evaluation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import lexicon as lx
from ..functions import extract as x
from ..operators import rules as op
from ..operators.aggregates import top_words_in_row
from ..operators.graph import labels_in_row, refs_in_row
from ..operators.semantic import category_sql
from ..operators.visual import type_sql
from ..sources.captures import TODAY
from .core import Inputs, query, shared

RULES = [
    (1, "shop", True, "PRICE_DETECTED", "entities|contains|128GB", "ADD_TAG", "tag=Deals"),
    (2, "sites", True, "URL_DETECTED", "merchant|==|github.com", "ADD_TO_COLLECTION", "collection=Code"),
    (3, "tickets", True, "TICKET_DETECTED", "", "CREATE_REMINDER", ""),
    (4, "off", False, "NEW_SCREENSHOT", "", "ARCHIVE", ""),
    (5, "calendar", True, "NEW_SCREENSHOT", "", "CREATE_CALENDAR_EVENT", "title=x"),
    (6, "unknown", True, "NEW_SCREENSHOT", "nofield|==|1", "ARCHIVE", ""),
    (7, "bad operator", True, "NEW_SCREENSHOT", "merchant|~|a", "ARCHIVE", ""),
    (8, "cheap", True, "PRICE_DETECTED", "has_url|!=|true;;broken;;has_price|==|true", "SAVE_EXPENSE", "amount=10;;currency=INR;;=x"),
    (9, "nightly", True, "TIME_BASED", "has_price|==|true", "ADD_TAG", ""),
]
shared("rule_f", "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}::BIGINT, {str(r[2]).lower()}, '{r[3]}', '{r[5]}')" for r in RULES) + ") AS t(rule_id, enabled, trigger, action)")
shared("ctx_f", """
  SELECT c.capture_id, c.date_added, kind AS visual_type, coalesce(labels, '') AS entities, coalesce(host, '') AS merchant, amount IS NOT NULL AS has_price, host IS NOT NULL AS has_url, labels IS NOT NULL AS has_label
  FROM cap c JOIN type_f USING (capture_id) LEFT JOIN url_f USING (capture_id) LEFT JOIN price_f USING (capture_id)
  LEFT JOIN (SELECT capture_id, string_agg(DISTINCT lower(display), ' ' ORDER BY lower(display)) AS labels FROM edge_f GROUP BY 1) USING (capture_id)""")
shared("hit_f", """
  SELECT 1 AS rule_id, capture_id FROM ctx_f WHERE has_price AND contains(entities, '128gb') UNION ALL SELECT 2, capture_id FROM ctx_f WHERE merchant = 'github.com'
  UNION ALL SELECT 3, capture_id FROM ctx_f WHERE visual_type = 'TICKET' UNION ALL SELECT 8, capture_id FROM ctx_f WHERE has_price AND NOT has_url""")


def rule_frame(i: Inputs):
    return i.spark.createDataFrame(RULES, op.RULE_DDL)


def entities_in_row(captures: DataFrame):
    """Captures with their facts, categories and ``refs``, what ``graph.entity_refs`` gives, read off each capture's own text, so nothing is joined.

    Captures are dealt out once, as texts, because reading facts off them costs far more than moving them and a file may be one split.
    """
    t = F.col("ocr_text")
    none = lambda c, ddl: F.coalesce(c, F.array().cast(f"array<{ddl}>"))
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or small texts would be put together in few tasks
    facts = captures.select("capture_id", "date_added", "ocr_text", "width", "height").repartition(parts, "capture_id").select(
        "*", none(x.urls(t), x.URL_DDL).alias("urls"), none(x.prices(t), x.PRICE_DDL).alias("prices"), none(x.codes(t), "string").alias("codes"),
        x.dates(t, TODAY).alias("dates"), x.order_codes(t).alias("orders"), top_words_in_row(t, 8).alias("phrases"))
    flagged = facts.withColumns({"all_hosts": F.transform("urls", lambda u: u["host"]), "has_price": F.size("prices") > 0, "has_code": F.size("codes") > 0})
    ranked = flagged.withColumn("ranked", F.expr(category_sql("ocr_text", "all_hosts", "has_price", "has_code")))
    label = F.create_map(*[F.lit(v) for kv in lx.CATEGORY_LABELS.items() for v in kv])
    shown = F.transform("ranked", lambda c: F.when(c["category"] != "OTHER", label[c["category"]]))
    return ranked.withColumn("refs", refs_in_row(F.col("phrases"), F.col("urls"), F.col("prices"), F.col("dates"), F.col("orders"), shown))


def labels_of(captures: DataFrame):
    """``(capture_id, labels)``: the names of each capture's entities, sorted and distinct; none is an empty array."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform("refs", lambda r: r["display"]))))
    return entities_in_row(captures).select("capture_id", names.alias("labels"))


def contexts(i: Inputs, captures: DataFrame | None = None):
    """Contexts from each capture's own row. ``captures`` may be a stream."""
    typed = entities_in_row(i.cap if captures is None else captures).withColumn(
        "visual_type", F.expr(type_sql("ocr_text", "all_hosts", "has_price", "has_code", "width", "height", "0.3D", "'NONE'"))["kind"])
    rows = typed.select("capture_id", "date_added", "visual_type", labels_in_row(F.col("refs")).alias("labels"), F.array_sort(F.array_distinct("all_hosts")).alias("hosts"), F.size("prices").alias("n_prices"))
    return op.context(rows)


@query("r_context", "SELECT capture_id, visual_type, entities, merchant, CAST(has_price AS VARCHAR) AS has_price, CAST(has_url AS VARCHAR) AS has_url, CAST(1 + has_price::INT + has_url::INT + 2 * has_label::INT + (visual_type = 'TICKET')::INT AS INTEGER) AS n_triggers FROM ctx_f")
def r_context(i: Inputs):
    keys = ("visual_type", "entities", "merchant", "has_price", "has_url")
    return contexts(i).select("capture_id", *[F.col("ctx")[k].alias(k) for k in keys], F.size("triggers").alias("n_triggers"))


@query("r_parse", """
  SELECT event_id, 2 AS n_conditions, concat('f', event_id % 5, '|==|v', event_id) AS first_condition, concat('t', event_id % 3) AS tag FROM events""")
def r_parse(i: Inputs):
    text = F.expr("concat('f', event_id % 5, '|==|v', event_id, ';;broken|x;;g|contains|', event_id)")
    rows = i.events.select("event_id", op.parse_conditions(text).alias("c"), op.parse_params(F.expr("concat('tag=t', event_id % 3, ';;=bad;;nope')")).alias("p"))
    first = F.col("c")[0]
    return rows.select("event_id", F.size("c").alias("n_conditions"), F.concat_ws("|", first["field"], first["op"], first["value"]).alias("first_condition"), F.col("p")["tag"].alias("tag"))


@query("r_match", "SELECT CAST(rule_id AS BIGINT) AS rule_id, capture_id FROM hit_f")
def r_match(i: Inputs):
    return op.match(contexts(i), rule_frame(i)).select("rule_id", "capture_id")


@query("r_once_only", "SELECT CAST(rule_id AS BIGINT) AS rule_id, capture_id FROM hit_f WHERE capture_id % 2 = 1 OR rule_id = 8")
def r_once_only(i: Inputs):
    rules = i.spark.createDataFrame([(r[0],) for r in RULES if r[0] != 8], "rule_id bigint").withColumn("scope", F.lit(1))
    done = i.cap.filter("capture_id % 2 = 0").select("capture_id").withColumn("scope", F.lit(1)).join(F.broadcast(rules), "scope").select("rule_id", "capture_id")
    return op.match(contexts(i), rule_frame(i), done).select("rule_id", "capture_id")


@query("r_safety", "SELECT action, count(*) AS n FROM rule_f JOIN events ON event_id % 9 + 1 = rule_id WHERE action NOT IN ('CREATE_CALENDAR_EVENT', 'SHOW_NOTIFICATION') GROUP BY 1")
def r_safety(i: Inputs):
    """Proposed actions of a stream of rule firings, unsafe ones dropped."""
    firings = i.events.select((F.col("event_id") % 9 + 1).alias("rule_id")).join(rule_frame(i), "rule_id")
    return op.safe(firings).groupBy("action").agg(F.count("*").alias("n"))


@query("r_effects", """
  SELECT 'tag' AS effect, 'deals' AS name, count(*) AS n FROM hit_f WHERE rule_id = 1 UNION ALL SELECT 'member', 'code', count(*) FROM hit_f WHERE rule_id = 2
  UNION ALL SELECT 'result', CASE rule_id WHEN 1 THEN 'Tagged Deals' WHEN 2 THEN 'Added to Code' WHEN 3 THEN 'Reminder saved on this device' ELSE 'Expense saved on this device' END, count(*) FROM hit_f GROUP BY rule_id""")
def r_effects(i: Inputs):
    from ..session import checkpointed
    hits = checkpointed(op.match(contexts(i), rule_frame(i)))
    out = op.effects(hits, i.spark.createDataFrame([(7, "CODE")], "collection_id bigint, name string"))
    parts = [("tag", out["tags"], "label"), ("member", out["members"], "name"), ("result", out["log"], "result")]
    return reduce(DataFrame.unionByName, [df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).withColumn("effect", F.lit(k)) for k, df, c in parts])


@query("r_time_based", "SELECT CAST(9 AS BIGINT) AS rule_id, capture_id FROM ctx_f WHERE has_price")
@query("r_time_based_all", "SELECT CAST(9 AS BIGINT) AS rule_id, capture_id FROM ctx_f WHERE has_price")
def r_time_based(i: Inputs):
    return op.time_based(contexts(i), rule_frame(i)).select("rule_id", "capture_id")
