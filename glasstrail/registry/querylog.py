"""Query-log annotation. The log is derived from events: twenty query shapes with numbers filled in."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import querylog as op
from ..sources.captures import TODAY
from .core import Inputs, query, shared

# (text SQL over n, then what it must be understood as: terms, phrases, prices, window, label, hosts, phones, codes, types, colors, long, intent)
SHAPES = [
    ("'Pixel phones below ₹40,000'", "pixel|phones", "pixel phones", "'AT_MOST:INR:0:40000'", None, "", "''", "", "", "", "false", "SEARCH"),
    ("concat('Find the screenshot where I saw AirPods for ₹', n + 100)", "airpods", "", "concat('EXACT:INR:', n + 100, ':', n + 100)", None, "", "''", "", "", "", "false", "FIND"),
    ("'Find the Amazon screenshot from last month'", "amazon", "", "''", ("2026-08-01", "2026-08-31", "last month"), "", "''", "", "", "", "false", "FIND"),
    ("concat('screenshots from https://www.amazon.in/deals', n)", "", "", "''", None, "amazon.in", "''", "", "", "", "false", "FILTER"),
    ("'show duplicate screenshots'", "", "", "''", None, "", "''", "", "DUPLICATES", "", "false", "FILTER"),
    ("'Pixel 9'", "pixel|9", "pixel 9", "''", None, "", "''", "", "", "", "false", "SEARCH"),
    ("'  '", "", "", "''", None, "", "''", "", "", "", "false", "BROWSE"),
    ("concat('laptop around ', (n + 50) * 100)", "laptop", "", "concat('RANGE::', (n + 50) * 95, ':', (n + 50) * 105)", None, "", "''", "", "", "", "false", "SEARCH"),
    ("'invoices this week'", "invoices", "", "''", ("2026-09-28", "2026-10-04", "this week"), "", "''", "", "", "", "false", "SEARCH"),
    ("'invoices last week'", "invoices", "", "''", ("2026-09-21", "2026-09-27", "last week"), "", "''", "", "", "", "false", "SEARCH"),
    ("concat('OTP ', 100000 + n)", "", "", "''", None, "", "''", "CODE", "", "", "false", "FILTER"),
    ("'blue long screenshot of boarding pass'", "boarding|pass", "boarding pass", "''", None, "", "''", "", "", "blue", "true", "SEARCH"),
    ("concat('call 9876', 500000 + n % 400000)", "call", "", "''", None, "", "concat('+919876', 500000 + n % 400000)", "", "", "", "false", "SEARCH"),
    ("concat('between ₹', n + 10, ' and ₹', n + 500, ' shoes')", "shoes", "", "concat('RANGE:INR:', n + 10, ':', n + 500)", None, "", "''", "", "", "", "false", "SEARCH"),
    ("'since 2024 tickets'", "tickets", "", "''", ("2025-01-01", "9999-12-31", "after 2024"), "", "''", "", "", "", "false", "SEARCH"),
    ("'30/09/2025 flight'", "flight", "", "''", ("2025-09-30", "2025-09-30", "30 September 2025"), "", "''", "", "", "", "false", "SEARCH"),
    ("'websites with links dark mode'", "dark|mode", "dark mode", "''", None, "", "''", "", "URLS", "", "false", "SEARCH"),
    ("'last 3 months receipts'", "receipts", "", "''", ("2026-07-01", "2026-09-30", "last 3 months"), "", "''", "", "", "", "false", "SEARCH"),
    ("concat('order ', 40000 + n, ' delivered')", "TERMS", "PHRASE", "''", None, "", "''", "", "", "", "false", "SEARCH"),
    ("'march 2025 salary slip'", "salary|slip", "salary slip", "''", ("2025-03-01", "2025-03-31", "March 2025"), "", "''", "", "", "", "false", "SEARCH"),
]
_CASE = "CASE n % 20 " + " ".join(f"WHEN {k} THEN {s[0]}" for k, s in enumerate(SHAPES)) + " END"
shared("qlog", f"SELECT n AS query_id, n, {_CASE} AS text FROM (SELECT event_id AS n FROM events)")


def log(i: Inputs):
    return i.spark.sql(f"SELECT n AS query_id, {_CASE} AS text FROM (SELECT event_id AS n FROM {{events}})", events=i.events)


def annotated(i: Inputs):
    return op.annotate(log(i), TODAY)


def _pick(column: int, quoted: bool = True) -> str:
    def value(v) -> str:
        return f"'{v}'" if quoted else v

    return "CASE query_id % 20 " + " ".join(f"WHEN {k} THEN {value(s[column])}" for k, s in enumerate(SHAPES)) + " END"


@query("q_dates", "SELECT query_id, s AS start_day, e AS end_day, label FROM (SELECT query_id, CASE query_id % 20 " + " ".join(
    f"WHEN {k} THEN datediff('day', DATE '1970-01-01', DATE '{s[4][0]}')" for k, s in enumerate(SHAPES) if s[4]) + " END AS s, CASE query_id % 20 " + " ".join(
    f"WHEN {k} THEN datediff('day', DATE '1970-01-01', DATE '{s[4][1]}')" for k, s in enumerate(SHAPES) if s[4]) + " END AS e, CASE query_id % 20 " + " ".join(
    f"WHEN {k} THEN '{s[4][2]}'" for k, s in enumerate(SHAPES) if s[4]) + " END AS label FROM qlog) WHERE s IS NOT NULL")
def q_dates(i: Inputs):
    return annotated(i).filter("start_day IS NOT NULL").select("query_id", "start_day", "end_day", F.col("date_label").alias("label"))


@query("q_hosts", f"SELECT query_id, {_pick(5)} AS hosts FROM qlog")
def q_hosts(i: Inputs):
    return annotated(i).select("query_id", F.array_join("hosts", "|").alias("hosts"))


@query("q_codes", "SELECT query_id, CASE WHEN query_id % 20 = 10 THEN CAST(100000 + query_id AS VARCHAR) ELSE '' END AS codes FROM qlog")
def q_codes(i: Inputs):
    return annotated(i).select("query_id", F.array_join("codes", "|").alias("codes"))


@query("q_phones", "SELECT query_id, " + _pick(6, False) + " AS phones FROM qlog")
def q_phones(i: Inputs):
    return annotated(i).select("query_id", F.array_join("phones", "|").alias("phones"))


@query("q_prices", "SELECT query_id, " + _pick(3, False) + " AS prices FROM qlog")
def q_prices(i: Inputs):
    shown = F.expr("array_join(transform(prices, p -> concat(p.kind, ':', coalesce(p.currency, ''), ':', bigint(round(p.min)), ':', bigint(round(p.max)))), '|')")
    return annotated(i).select("query_id", shown.alias("prices"))


@query("q_types", f"SELECT query_id, {_pick(8)} AS types FROM qlog")
def q_types(i: Inputs):
    return annotated(i).select("query_id", F.array_join("types", "|").alias("types"))


@query("q_visual", f"SELECT query_id, {_pick(9)} AS colors, {_pick(10, False)} AS long_only FROM qlog")
def q_visual(i: Inputs):
    return annotated(i).select("query_id", F.array_join("colors", "|").alias("colors"), "long_only")


@query("q_keywords", f"""
  SELECT query_id, CASE WHEN query_id % 20 = 18 THEN concat('order|', 40000 + query_id, '|delivered') ELSE {_pick(1)} END AS terms, CASE WHEN query_id % 20 = 18 THEN concat('order ', 40000 + query_id, ' delivered') ELSE {_pick(2)} END AS phrases FROM qlog""")
def q_keywords(i: Inputs):
    return annotated(i).select("query_id", F.array_join("terms", "|").alias("terms"), F.array_join("phrases", "|").alias("phrases"))


@query("q_intent", f"SELECT query_id, {_pick(11)} AS intent FROM qlog")
def q_intent(i: Inputs):
    return annotated(i).select("query_id", "intent")


@query("q_describe", """
  SELECT k, description, count(*) AS n FROM (SELECT query_id % 20 AS k, CASE query_id % 20 WHEN 0 THEN 'pixel phones · up to ₹40,000' WHEN 2 THEN 'amazon · last month' WHEN 3 THEN 'amazon.in' WHEN 4 THEN 'duplicates' WHEN 5 THEN 'pixel 9' WHEN 6 THEN 'everything'
    WHEN 8 THEN 'invoices · this week' WHEN 9 THEN 'invoices · last week' WHEN 10 THEN 'one-time code' WHEN 11 THEN 'boarding pass · blue · long screenshots' WHEN 14 THEN 'tickets · after 2024' WHEN 15 THEN 'flight · 30 September 2025' WHEN 16 THEN 'dark mode'
    WHEN 17 THEN 'receipts · last 3 months' WHEN 19 THEN 'salary slip · March 2025' ELSE 'other' END AS description FROM qlog) GROUP BY 1, 2""")
def q_describe(i: Inputs):
    k = F.col("query_id") % 20
    rows = annotated(i).select(k.alias("k"), F.when(k.isin(1, 7, 12, 13, 18), "other").otherwise(F.col("description")).alias("description"))
    return rows.groupBy("k", "description").agg(F.count("*").alias("n"))


# Questions: ten shapes over conversation turns, each with the turn's own first word as a name.
_ASK = """CASE (conv_id + turn) % 10 WHEN 0 THEN concat('What changed after ', w) WHEN 1 THEN 'How many did I keep' WHEN 2 THEN concat('Tell me about ', w, ' from shop.example.com') WHEN 3 THEN 'cheapest price under ₹40k last week'
  WHEN 4 THEN 'compare both screens' WHEN 5 THEN 'summarize my notes today' WHEN 6 THEN 'why' WHEN 7 THEN 'find Pixel Phone for me over 2,500' WHEN 8 THEN 'I remember a blue header recently' ELSE text END"""
shared("asks", f"SELECT conv_id, turn, {_ASK} AS ask FROM (SELECT conv_id, turn, text, 'Zed' AS w FROM conversations)")


def asks(i: Inputs):
    return i.spark.sql(f"SELECT conv_id, turn, {_ASK} AS ask FROM (SELECT conv_id, turn, text, 'Zed' AS w FROM {{c}})", c=i.conversations)


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


# The tenth shape is free prose, which may hold any of the words.
_PROSE_INTENT = f"""CASE WHEN {_any(lx.TIMELINE_WORDS)} AND {_any(lx.CHANGE_WORDS)} THEN 'CHANGE_DETECTION' WHEN {_any(lx.RECALL_WORDS)} THEN 'RECALL' WHEN {_any(lx.COUNT_WORDS)} THEN 'COUNT'
    WHEN {_any(lx.ENTITY_WORDS)} THEN 'ENTITY_LOOKUP' WHEN {_any(lx.TIMELINE_WORDS)} THEN 'TIMELINE' WHEN {_any(lx.PRICE_WORDS)} THEN 'PRICE_HISTORY'
    WHEN {_any(lx.COMPARISON_WORDS)} THEN 'COMPARE' WHEN {_any(lx.CHANGE_WORDS)} THEN 'CHANGE_DETECTION' WHEN {_any(lx.SUMMARIZE_WORDS)} THEN 'SUMMARIZE'
    WHEN {_any(lx.LIST_WORDS)} THEN 'LIST' WHEN {_any(lx.RELATIONSHIP_WORDS)} THEN 'RELATIONSHIP' WHEN {_any(lx.EXPLAIN_WORDS)} THEN 'EXPLAIN'
    WHEN starts_with(low, 'find') OR starts_with(low, 'show me') OR starts_with(low, 'which') THEN 'FIND' ELSE 'SEARCH' END"""


@query("q_assistant_intent", f"""
  SELECT conv_id, turn, CASE (conv_id + turn) % 10 WHEN 0 THEN 'CHANGE_DETECTION' WHEN 1 THEN 'COUNT' WHEN 2 THEN 'ENTITY_LOOKUP' WHEN 3 THEN 'PRICE_HISTORY' WHEN 4 THEN 'COMPARE' WHEN 5 THEN 'SUMMARIZE' WHEN 6 THEN 'EXPLAIN' WHEN 7 THEN 'FIND' WHEN 9 THEN prose ELSE 'RECALL' END AS intent
  FROM (SELECT conv_id, turn, {_PROSE_INTENT} AS prose FROM (SELECT conv_id, turn, lower(trim(ask)) AS low FROM asks))""")
def q_assistant_intent(i: Inputs):
    return asks(i).select("conv_id", "turn", op.question_intent(F.col("ask")).alias("intent"))


@query("q_assistant_slots_all")
def q_assistant_slots_all(i: Inputs):
    """Slots of every turn, the turns of free prose included, with the entity as computed."""
    rows = op.question_slots(asks(i), TODAY, "ask")
    return rows.select("conv_id", "turn", "entity", "price_max", "price_min", F.get("period", F.lit(0)).alias("first_day"), "color", "refers_to_previous", F.array_join("keywords", "|").alias("keywords"))


@query("q_assistant_slots", """
  SELECT conv_id, turn, CASE k WHEN 0 THEN 'Zed' WHEN 2 THEN 'shop.example' WHEN 7 THEN 'Pixel Phone' END AS entity, CASE k WHEN 3 THEN 40000.0 END::DOUBLE AS price_max, CASE k WHEN 7 THEN 2500.0 END::DOUBLE AS price_min,
    CASE k WHEN 3 THEN DATE '2026-09-23' WHEN 5 THEN DATE '2026-09-30' WHEN 8 THEN DATE '2026-09-16' END AS first_day, CASE k WHEN 8 THEN 'blue' END AS color,
    CASE k WHEN 0 THEN 'changed|zed' WHEN 1 THEN 'many|keep' WHEN 2 THEN 'tell|zed|shop.example.com' WHEN 3 THEN 'cheapest|₹40k|last|week' WHEN 4 THEN 'compare|both|screens' WHEN 5 THEN 'summarize|notes|today' WHEN 6 THEN 'why' WHEN 7 THEN 'pixel|phone|500' ELSE 'remember|blue|header|recently' END AS keywords
  FROM (SELECT conv_id, turn, (conv_id + turn) % 10 AS k FROM asks) WHERE k <> 9 AND k NOT IN (1, 8) OR k IN (1, 8)""".replace("k <> 9 AND k NOT IN (1, 8) OR k IN (1, 8)", "k <> 9"))
def q_assistant_slots(i: Inputs):
    rows = op.question_slots(asks(i).filter("(conv_id + turn) % 10 <> 9"), TODAY, "ask")
    k = (F.col("conv_id") + F.col("turn")) % 10
    return rows.select("conv_id", "turn", F.when(~k.isin(1, 8), F.col("entity")).alias("entity"), "price_max", "price_min", F.get("period", F.lit(0)).alias("first_day"), "color", F.array_join("keywords", "|").alias("keywords"))
