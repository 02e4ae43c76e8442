"""Slots of free prose against a plain version."""
import re
import unicodedata
from datetime import timedelta

from glasstrail import lexicon as lx
from glasstrail.registry import querylog
from glasstrail.registry.core import Inputs
from glasstrail.sources.captures import TODAY

STOP = set(lx.QUESTION_STOP)
NUMBER = r"\s*₹?\s*([\d,]+(?:\.\d+)?)\s*(k?)"
MAX, MIN = (f"(?:{w}){NUMBER}" for w in ("under|below|less than|up to|cheaper than|at most", "above|over|more than|greater than|from|at least"))
EXTRA = ["Meet Zoë Müller at Café Rouge, over ₹2,500 yesterday", "under ₹3k and over 5 in red", "nothing here", "see Docs.Example.org this week", "", "from , to", "  Anna   and Bob? "]


def amount(pattern, low):
    m = re.search(pattern, low, re.A)
    try:
        return float(m[1].replace(",", "")) * (1000 if m[2] else 1) if m else None
    except ValueError:
        return None


def plain(text):
    trim = lambda w: re.sub(r"^[,.?!]+|[,.?!]+$", "", w)
    low = text.strip(" ").lower()
    words = re.split(r"\s+", text.strip(" "), flags=re.A)
    entity = None
    for n, w in enumerate(words):
        if w and unicodedata.category(w[0]) == "Lu" and trim(w).lower() not in STOP:
            run = []
            for k, v in enumerate(words[n:]):
                if trim(v) == "" or (k and trim(v).lower() in STOP):
                    break
                run.append(trim(v))
            joined = " ".join(run)
            entity = joined if len(joined) >= 2 and any(c.isalpha() for c in joined) else None
            break
    domain = re.search(r"[a-z0-9-]+[.][a-z]{2,}", low)
    days = [("today", 0), ("yesterday", 1), ("this week", 7), ("last week", 7), ("this month", 30), ("last month", None), ("recently", 14), ("a few days ago", 14), ("a few weeks ago", 30)]
    first = next((TODAY.replace(month=TODAY.month - 1) if d is None else TODAY - timedelta(d) for w, d in days if w in low), None)
    keys = [w for w in re.split(r"\s+", re.sub(r"[^a-z0-9₹$€£\s.-]", " ", low, flags=re.A), flags=re.A) if len(w) > 2 and w not in STOP]
    return (domain[0] if domain else entity, amount(MAX, low), None if re.search(MAX, low, re.A) else amount(MIN, low), first,
            next((c for c in lx.QUESTION_COLORS if c in low), None), "|".join(dict.fromkeys(keys)))


def test_slots_of_every_turn(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    asked = {(r["conv_id"], r["turn"]): r["ask"] for r in querylog.asks(i).collect()}
    rows = {(r["conv_id"], r["turn"]): r for r in querylog.q_assistant_slots_all(i).collect()}
    assert rows.keys() == asked.keys() and any(sum(k) % 10 == 9 for k in rows)
    for k, r in rows.items():
        assert (r["entity"], r["price_max"], r["price_min"], r["first_day"], r["color"], r["keywords"]) == plain(asked[k]), asked[k]
    assert any(r["entity"] for k, r in rows.items() if sum(k) % 10 in (1, 8, 9))


def test_slots_of_odd_prose(spark):
    from pyspark.sql import functions as F

    from glasstrail.operators.querylog import question_slots
    log = spark.createDataFrame([(n, t) for n, t in enumerate(EXTRA)], "n int, text string")
    for r in question_slots(log, TODAY).withColumn("first", F.get("period", F.lit(0))).collect():
        assert (r["entity"], r["price_max"], r["price_min"], r["first"], r["color"], "|".join(r["keywords"])) == plain(EXTRA[r["n"]]), EXTRA[r["n"]]
