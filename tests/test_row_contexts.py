"""Contexts come from a capture's own row, and rules reach captures without a shuffle of contexts."""
from pyspark.sql import functions as F

from glasstrail.operators import aggregates, graph, rules
from glasstrail.registry import rules as registered
from glasstrail.registry.core import Inputs

ROOT = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contexts_are_one_projection(spark):
    plan = plan_of(registered.contexts(Inputs(spark, ROOT)))
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_labels_and_top_words_equal_the_joined_ones(spark):
    from glasstrail.registry.graph import edges
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    i = Inputs(spark, ROOT)
    joined = {r[0]: " ".join(r[1]) for r in graph.labels(edges(i)).collect()}
    rows = registered.contexts(i).select("capture_id", F.col("ctx")["entities"].alias("e")).collect()
    assert len(rows) == i.cap.count() and {r[0]: r[1] for r in rows if r[1]} == joined
    texts = spark.createDataFrame([(1, "beta alpha beta gamma 12345 the alpha delta zeta9 zeta9 zeta9"), (2, ""), (3, None), (4, " ".join(f"word{n}" * (1 + n % 2) for n in range(40)) + " word3")], "k int, t string")
    want = {r[0]: r[1] for r in aggregates.top_words(texts, "k", "t").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda v: v["word"]).alias("w")).collect()}
    got = {r[0]: r[1] or [] for r in texts.select("k", aggregates.top_words_in_row(F.col("t")).alias("w")).collect()}
    assert got == {k: want.get(k, []) for k in got}


def test_rules_are_broadcast_and_pairs_stay_single(spark):
    ctx = spark.createDataFrame([(1, 0, {"has_price": "true"}, ["NEW_SCREENSHOT", "PRICE_DETECTED"]), (1, 0, {"has_price": "true"}, ["NEW_SCREENSHOT"]), (2, 0, {"has_price": "false"}, ["NEW_SCREENSHOT"])],
                                "capture_id long, date_added long, ctx map<string,string>, triggers array<string>")
    table = spark.createDataFrame([(1, "a", True, "NEW_SCREENSHOT", "", "ADD_TAG", "tag=x"), (1, "a", True, "NEW_SCREENSHOT", "", "ADD_TAG", "tag=x"), (2, "b", True, "PRICE_DETECTED", "has_price|==|true", "ARCHIVE", ""),
                                   (1, "c", True, "PRICE_DETECTED", "", "ADD_TAG", "tag=y")], rules.RULE_DDL)
    out = rules.match(ctx, table)
    plan = plan_of(out)
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan.split("BroadcastExchange")[0]
    rows = sorted((r["rule_id"], r["capture_id"], r["action"]) for r in out.collect())
    assert rows == [(1, 1, "ADD_TAG"), (1, 2, "ADD_TAG"), (2, 1, "ARCHIVE")]
    assert {tuple(r["params"].items()) for r in out.filter("rule_id = 1 AND capture_id = 2").collect()} == {(("tag", "x"),)}
