"""Rule evaluation: rules join captures on their trigger, at most once per (rule, capture)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fulltext import few, meet

UNSAFE = ["CREATE_CALENDAR_EVENT", "SHOW_NOTIFICATION"]
RULE_DDL = "rule_id bigint, name string, enabled boolean, trigger string, condition_text string, action string, param_text string"


def parse_conditions(encoded: Column) -> Column:
    """``f|op|v;;f|op|v`` to ``array<struct<field, op, value>>``; malformed parts are dropped."""
    parts = F.filter(F.transform(F.split(encoded, ";;", -1), lambda p: F.split(p, r"\|", -1)), lambda s: F.size(s) == 3)
    return F.transform(parts, lambda s: F.struct(s[0].alias("field"), s[1].alias("op"), s[2].alias("value")))


def parse_params(encoded: Column) -> Column:
    parts = F.filter(F.split(encoded, ";;", -1), lambda p: F.instr(p, "=") > 1)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    return F.map_from_entries(pairs)


def parsed(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"conditions": parse_conditions(F.col("condition_text")), "params": parse_params(F.col("param_text"))})


def context(captures: DataFrame) -> DataFrame:
    """Context map and fired triggers. Needs capture_id, visual_type, labels, hosts, n_prices (arrays and counts)."""
    has_price, has_url, has_label = F.col("n_prices") > 0, F.size("hosts") > 0, F.size("labels") > 0
    ctx = F.create_map(F.lit("visual_type"), F.coalesce("visual_type", F.lit("")), F.lit("entities"), F.array_join("labels", " "),
                       F.lit("merchant"), F.coalesce(F.get("hosts", F.lit(0)), F.lit("")), F.lit("has_price"), has_price.cast("string"), F.lit("has_url"), has_url.cast("string"))
    triggers = F.array_compact(F.array(
        F.lit("NEW_SCREENSHOT"), F.when(has_price, "PRICE_DETECTED"), F.when(has_url, "URL_DETECTED"), F.when(has_label, "ENTITY_DETECTED"), F.when(has_label, "TOPIC_DETECTED"),
        F.when(F.col("visual_type") == "RECEIPT", "RECEIPT_DETECTED"), F.when(F.col("visual_type") == "TICKET", "TICKET_DETECTED")))
    return captures.select("capture_id", "date_added", ctx.alias("ctx"), triggers.alias("triggers"))


def conditions_hold(conditions: Column, ctx: Column) -> Column:
    """All conditions hold; an unknown field or operator never does."""
    def one(c: Column) -> Column:
        actual = F.try_element_at(ctx, c["field"])
        hit = (F.when(c["op"] == "==", actual == c["value"]).when(c["op"] == "!=", actual != c["value"])
               .when(c["op"] == "contains", F.contains(F.lower(actual), F.lower(c["value"]))).otherwise(F.lit(False)))
        return F.coalesce(hit, F.lit(False))

    return F.forall(conditions, one)


def safe(rules: DataFrame) -> DataFrame:
    return rules.filter(~F.col("action").isin(UNSAFE))


def match(contexts: DataFrame, rules: DataFrame, executed: DataFrame | None = None) -> DataFrame:
    """``(rule_id, capture_id, action, params)`` of rules that fire now, each pair once.

    Few rules are broadcast, so captures and their contexts aren't shuffled for the match; of the firings only ids are, and action and
    parameters come back from the rules.
    """
    # For a plain explode Spark would filter by the triggers first, that is compute every context once more.
    fired = contexts.select("capture_id", "ctx", F.explode_outer("triggers").alias("trigger"))
    version = F.xxhash64("trigger", "condition_text", "action", "param_text")
    active = safe(parsed(rules.filter("enabled"))).select("rule_id", version.alias("version"), "trigger", "conditions", "action", "params")
    small = few(active)
    hits = meet(fired, active.select("rule_id", "version", "trigger", "conditions"), "trigger", small).filter(conditions_hold(F.col("conditions"), F.col("ctx")))
    pairs = hits.groupBy("rule_id", "capture_id").agg(F.min("version").alias("version"))
    told = active.dropDuplicates(["rule_id", "version"]).select("rule_id", "version", "action", "params")
    once = meet(pairs, told, ["rule_id", "version"], small).select("rule_id", "capture_id", "action", "params")
    return once if executed is None else once.join(executed.select("rule_id", "capture_id"), ["rule_id", "capture_id"], "left_anti")


def time_based(contexts: DataFrame, rules: DataFrame, executed: DataFrame | None = None, newest: int | None = None) -> DataFrame:
    """TIME_BASED rules over all captures, or the newest."""
    recent = contexts if newest is None else contexts.orderBy(F.desc("date_added"), F.desc("capture_id")).limit(newest)
    recent = recent.withColumn("triggers", F.array(F.lit("TIME_BASED")))
    return match(recent, rules, executed)


def effects(hits: DataFrame, collections: DataFrame) -> dict[str, DataFrame]:
    """Tags, collection memberships and result texts of the fired rules. ``collections``: collection_id, name."""
    tag = F.coalesce(F.try_element_at("params", F.lit("tag")), F.lit("organized"))
    target = F.coalesce(F.try_element_at("params", F.lit("collection")), F.lit("Organized"))
    tags = hits.filter("action = 'ADD_TAG'").select("capture_id", F.lower(tag).alias("label"), F.lit("automation").alias("source"))
    known = collections.groupBy(F.lower("name").alias("k")).agg(F.min("collection_id").alias("collection_id"))
    added = hits.filter("action = 'ADD_TO_COLLECTION'").select("capture_id", F.lower(target).alias("k")).distinct().join(F.broadcast(known), "k", "left")
    # A missing collection is created by name; its id follows from the name.
    members = added.select(F.coalesce("collection_id", F.xxhash64("k")).alias("collection_id"), F.col("k").alias("name"), "capture_id")
    amount, currency = F.try_element_at("params", F.lit("amount")).try_cast("double"), F.try_element_at("params", F.lit("currency"))
    result = (F.when(F.col("action") == "ADD_TAG", F.concat(F.lit("Tagged "), tag)).when(F.col("action") == "ADD_TO_COLLECTION", F.concat(F.lit("Added to "), target))
              .when(F.col("action") == "ARCHIVE", "Archived").when(F.col("action") == "CREATE_REMINDER", "Reminder saved on this device")
              .when(F.col("action") == "SAVE_EXPENSE", F.when(amount.isNull() | currency.isNull(), "Missing amount — needs review").otherwise("Expense saved on this device")))
    log = hits.select("rule_id", "capture_id", "action", result.alias("result"))
    return {"tags": tags, "members": members, "log": log}
