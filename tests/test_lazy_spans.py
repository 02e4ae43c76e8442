"""Spans split a text only where it matches, and the guards before the patterns lose nothing."""
from datetime import date

from pyspark.sql import functions as F

from glasstrail.functions import base, extract as x

TEXTS = ["otp1234", "1234otp x", "x" * 60 + "verification code" + " " * 10 + "445566", "b" * 30 + "zotp" + "-" * 38 + "7788 z", "confirmed 9911", "o.t.p 4455", "USE4455",
         "12/03/2024", "due 20240312", "5 Sept 2023", "MAY 3, 2024", "may3", "pay 12-9", "3.4", "1 . 2 / x", "98765-43210 a", "+91 98765 43210", "0 9876543210", "id 9876543210", "₹5 ₹6 total", "", None]


def test_split_waits_for_a_match(spark):
    sql = base.find_spans("t", "[0-9]+", before=4, after=4)
    assert sql.index("size(_m.hits) = 0") < sql.index("split(")
    rows = spark.createDataFrame([("a12b3",), ("none",), ("",), (None,)], "t string").select(F.expr(sql).alias("s")).collect()
    assert [[tuple(v) for v in r["s"]] if r["s"] is not None else None for r in rows] == [[("12", "a", "b3"), ("3", "a12b"[-4:], "")], [], [], None]


def test_guards_lose_nothing(spark):
    """The guarded extractors against the same ones with the guard made always true."""
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(TEXTS)], "n int, t string")
    built = {"codes": (x.codes, ()), "dates": (x.dates, (date(2026, 9, 30),)), "phones": (x.phones, ())}
    for name, (build, more) in built.items():
        guarded = rows.select("n", build("t", *more).alias("v")).orderBy("n").collect()
        # Every cue, month, separator and phone core stands behind the text, out of any pattern's reach.
        tail = " " * 80 + "| code jan ! / 6" + "|" * 3
        open_rows = rows.select("n", F.when(F.col("t").isNotNull(), F.concat("t", F.lit(tail))).alias("t")).select("n", build("t", *more).alias("v")).orderBy("n").collect()
        assert [r["v"] or [] for r in guarded] == [r["v"] or [] for r in open_rows], name
