from datetime import date

import pytest
from pyspark.sql import functions as F

from glasstrail.functions import extract as x

TODAY = date(2026, 9, 30)


def run(spark, build, text):
    return spark.createDataFrame([(text,)], "t string").select(build("t").alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [
    ("Pixel 9a - ₹39,999", [("INR", 39999.0)]), ("Total Rs. 39,999", [("INR", 39999.0)]), ("Total Rs 1200", [("INR", 1200.0)]), ("INR 39999", [("INR", 39999.0)]),
    ("Only $299", [("USD", 299.0)]), ("USD 299", [("USD", 299.0)]), ("order ₹500", []), ("39,,999 ₹", []), ("", []),
])
def test_prices(spark, text, want):
    assert [(r["currency"], r["amount"]) for r in run(spark, x.prices, text)] == want


@pytest.mark.parametrize("text,want", [
    ("Your OTP is 483921", ["483921"]), ("Use 928341 to verify", ["928341"]), ("OTP: 1234", ["1234"]), ("OTP: 48392011", ["48392011"]),
    ("OTP: 483921 and backup code 928341", ["483921", "928341"]), ("Order ID: 482913 confirmed", []), ("Enter 2026 to continue", []), ("OTP: 111111", []),
    ("OTP: 20260930", []), ("OTP: 4829130", []),
])
def test_codes(spark, text, want):
    assert run(spark, x.codes, text) == want


@pytest.mark.parametrize("text,want", [
    ("30/09/2026", 1), ("30-09-2026", 1), ("30 Sep 2026", 1), ("September 30, 2026", 1), ("2026-09-30", 1), ("20260930", 1), ("Meeting 25/09 at noon", 1),
    ("From 30/09/2026 to 15/10/2026", 2), ("Due 03/04 soon", 0), ("Meeting 25 Dec with the team", 0), ("31/02/2026", 0), ("Order 182739 shipped", 0),
])
def test_dates(spark, text, want):
    assert len(run(spark, lambda t: x.dates(t, TODAY), text)) == want


@pytest.mark.parametrize("text,hit", [
    ("+91 98765 43210", True), ("+91-98765-43210", True), ("9876543210", True), ("09876543210", True), ("91 98765 43210", True),
    ("Order ID: 9876543210", False), ("1987654321098", False), ("1234567890", False),
])
def test_phones(spark, text, hit):
    assert [r["normalized"] for r in run(spark, x.phones, text)] == (["+919876543210"] if hit else [])


@pytest.mark.parametrize("text,want", [
    ("example.com/page", ["https://example.com/page"]), ("Open amazon.in, then flipkart.com.", ["https://amazon.in", "https://flipkart.com"]),
    ("amazon.in amazon.in", ["https://amazon.in"]), ("support@example.com", []), ("Version 2.1", []), ("see notes.doc", []),
])
def test_urls(spark, text, want):
    assert [r["url"] for r in run(spark, x.urls, text)] == want


def test_receipt_takes_the_largest_amount(spark):
    r = run(spark, x.receipt, "Big Bazaar store\nTax ₹3.50\nTotal ₹1,250.50")
    assert (r["merchant"], r["amount"], r["currency"]) == ("Big Bazaar store", 1250.5, "INR")


def test_null_text_is_a_note_not_a_failure(spark):
    df = spark.createDataFrame([(None,)], "t string").select(x.all_facts("t", TODAY).alias("f"))
    row = df.select("f.failures", F.size("f.prices").alias("n")).first()
    assert row["failures"] == ["text"] and row["n"] == 0


def test_many_matches_in_one_text_all_count(spark):
    text = "; ".join(f"₹{k}" for k in range(1, 1501))
    assert len(run(spark, x.prices, text)) == 1500
