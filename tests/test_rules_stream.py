"""The stream of rule firings runs every rule over every capture."""
from glasstrail import registry
from glasstrail.registry.rules import RULES

ROOT = "/root/testdata/sf0.001"


def test_the_stream_fires_every_rule_that_a_batch_fires(spark):
    actions = {r[0]: r[5] for r in RULES}
    batch = sorted((r["rule_id"], r["capture_id"], actions[r["rule_id"]]) for r in registry.QUERIES["r_match"](spark, ROOT).collect())
    stream = sorted((r["rule_id"], r["capture_id"], r["action"]) for r in registry.QUERIES["st_rules_once"](spark, ROOT).collect())
    assert stream == batch and {r[0] for r in stream} == {1, 2, 3, 8}
