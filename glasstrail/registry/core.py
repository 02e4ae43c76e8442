"""Registration of queries and the shared inputs of both engines."""
from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources import captures as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Lazily built frames over one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    @cached_property
    def cap(self) -> DataFrame:
        return src.derived_captures(self.table("orders"))

    @cached_property
    def prices(self) -> DataFrame:
        return src.prices_of(self.cap)

    @cached_property
    def urls(self) -> DataFrame:
        return src.urls_of(self.cap)

    @cached_property
    def phones(self) -> DataFrame:
        return src.phones_of(self.cap)

    @cached_property
    def codes(self) -> DataFrame:
        return src.codes_of(self.cap)

    @cached_property
    def dates(self) -> DataFrame:
        return src.dates_of(self.cap)

    @cached_property
    def order_codes(self) -> DataFrame:
        return src.order_codes_of(self.cap)


#: Shared pieces of the SQL counterparts. The facts of the derived captures follow from their
#: text shapes, so they are stated directly rather than by repeating the extraction patterns.
SHARED: dict[str, str] = {
    "cap": src.CAPTURE_SQL.replace("{S}", "VARCHAR").replace("{EPOCH}", "epoch(o_orderdate)").replace("{ORDERS}", "orders"),
    "price_f": """
      SELECT o_orderkey AS capture_id, 'INR' AS currency,
        CASE o_orderkey % 8 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN 6500.0 WHEN 4 THEN 299.0 ELSE 1250.0 END AS amount,
        CASE o_orderkey % 8 WHEN 0 THEN concat('₹', CAST(floor(o_totalprice) AS BIGINT)) WHEN 1 THEN '₹6,500' WHEN 4 THEN '₹299' ELSE '₹1,250' END AS raw
      FROM orders WHERE o_orderkey % 8 IN (0, 1, 4, 5)""",
    "url_f": """
      SELECT o_orderkey AS capture_id, CASE o_orderkey % 8 WHEN 3 THEN 'amazon.in' ELSE 'github.com' END AS host,
        CASE o_orderkey % 8 WHEN 3 THEN 'https://amazon.in' ELSE 'https://github.com' END AS url
      FROM orders WHERE o_orderkey % 8 IN (3, 6)""",
    "phone_f": """
      SELECT o_orderkey AS capture_id, concat('98', 10000000 + o_custkey) AS raw, concat('+9198', 10000000 + o_custkey) AS normalized
      FROM orders WHERE o_orderkey % 8 = 5""",
    "code_f": """
      SELECT o_orderkey AS capture_id, CAST(100000 + o_orderkey % 900000 AS VARCHAR) AS code FROM orders WHERE o_orderkey % 8 = 2""",
    # Extraction takes no code of one repeated digit: of six digits these are the multiples of 111111.
    "otp_f": """
      SELECT capture_id, code FROM code_f WHERE CAST(code AS BIGINT) % 111111 <> 0""",
    "date_f": """
      SELECT o_orderkey AS capture_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS raw,
        CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS epoch_day, CAST(o_orderdate AS DATE) AS day
      FROM orders WHERE o_orderkey % 8 = 7""",
    "order_f": """
      SELECT o_orderkey AS capture_id, 'BOOKING' AS kind, concat('7QK', o_custkey, 'LP') AS code FROM orders WHERE o_orderkey % 8 = 1""",
}


def shared(name: str, sql: str) -> None:
    SHARED[name] = sql


def with_shared(body: str) -> str:
    """Prefix the shared pieces ``body`` uses, in dependency order."""
    order: list[str] = []
    open_names: set[str] = set()

    def visit(sql: str) -> None:
        for name in SHARED:
            if name not in order and name not in open_names and re.search(rf"(?i)\b(?:from|join)\s+{name}\b", sql):
                open_names.add(name)
                visit(SHARED[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    head = ", ".join(f"{n} AS ({SHARED[n]})" for n in order)
    stripped = body.strip()
    if re.match(r"(?i)with\s+recursive\s", stripped):
        return f"WITH RECURSIVE {head}, {stripped[len('with recursive'):]}"
    if re.match(r"(?i)with\s", stripped):
        return f"WITH {head}, {stripped[4:]}"
    return f"WITH {head} {stripped}"


def query(key: str, sql: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``key`` with its SQL counterpart."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Inputs(spark, root))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    """Every SQL counterpart with its shared pieces in front."""
    return {key: with_shared(sql) for key, sql in ORACLES.items()}
