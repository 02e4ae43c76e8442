"""The capture table and its fact tables.

``derived_captures`` makes a capture library out of an order table, so that every operator has
realistic input at any scale: one capture per order, eight text shapes, facts of every kind.
"""
from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import extract as x

TODAY = date(2026, 9, 30)
NOW = int(datetime(2026, 9, 30, 12, tzinfo=timezone.utc).timestamp())

#: One definition for both engines; {S} is the string type and {EPOCH} the epoch second of the order.
CAPTURE_SQL = """
SELECT o_orderkey AS capture_id, o_custkey AS owner_id,
  concat('Screenshot_', CAST(o_orderkey AS {S}), '.png') AS filename,
  CASE o_orderkey % 6 WHEN 0 THEN 'Pictures/Screenshots/' WHEN 1 THEN 'DCIM/Camera/' WHEN 2 THEN NULL
    WHEN 3 THEN 'Movies/ScreenRecordings/' WHEN 4 THEN 'Pictures/Wallpapers/' ELSE 'Download/' END AS relative_path,
  CAST({EPOCH} AS BIGINT) AS date_added,
  CAST({EPOCH} + 60 * (o_orderkey % 3) AS BIGINT) AS date_modified,
  CAST(floor(o_totalprice * 40) AS BIGINT) AS file_size,
  CAST(1080 AS BIGINT) AS width, CAST(1080 + (o_orderkey % 5) * 600 AS BIGINT) AS height,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL
    ELSE concat('h', CAST(o_custkey AS {S}), '_', CAST(o_orderkey % 8 AS {S})) END AS content_hash,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED'
    WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'PROCESSING' ELSE 'PENDING' END
    ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'COMPLETED' END END AS status,
  CASE o_orderkey % 8
   WHEN 0 THEN concat('Store Home Offers Google Pixel 9a 5G 128GB ₹', CAST(CAST(floor(o_totalprice) AS BIGINT) AS {S}), ' Add to cart ', CAST(o_orderkey AS {S}))
   WHEN 1 THEN concat('Flight ticket Delhi to Mumbai PNR 7QK', CAST(o_custkey AS {S}), 'LP fare ₹6,500 ', CAST(o_orderkey AS {S}))
   WHEN 2 THEN concat('Your verification code is ', CAST(100000 + o_orderkey % 900000 AS {S}), ' valid for 10 minutes')
   WHEN 3 THEN concat('Great Festival up to 70% off on headphones at amazon.in ', CAST(o_orderkey AS {S}))
   WHEN 4 THEN concat('Order confirmed. Item: USB-C cable. Total ₹299 ', CAST(o_orderkey AS {S}))
   WHEN 5 THEN concat('UPI payment of ₹1,250 to 98', CAST(10000000 + o_custkey AS {S}), ' successful ', CAST(o_orderkey AS {S}))
   WHEN 6 THEN concat('github.com pull request #', CAST(o_orderkey AS {S}), ' merged into main')
   ELSE concat('Maps directions to home, 12 min drive, arrive ', CAST(CAST(o_orderdate AS DATE) AS {S})) END AS ocr_text
FROM {ORDERS}
"""
SPARK_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)"


def derived_captures(orders: DataFrame) -> DataFrame:
    sql = CAPTURE_SQL.replace("{S}", "STRING").replace("{EPOCH}", SPARK_EPOCH).replace("{ORDERS}", "{orders}")
    return orders.sparkSession.sql(sql, orders=orders)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Column-pruned scan; a known schema skips inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew before CPU-heavy work, if the session asks for it by ``spark.glasstrail.partitions``.

    Unset, as on a cluster, the splits of the scan stay. The local session sets it, because its tables are single small files.
    """
    partitions = df.sparkSession.conf.get("spark.glasstrail.partitions", None)
    return df.repartition(int(partitions)) if partitions else df


def facts_of(captures: DataFrame, facts: Column, *fields: str) -> DataFrame:
    """Child table of one fact list: ``capture_id`` plus the struct fields."""
    items = spread(captures.select("capture_id", "ocr_text")).select("capture_id", F.posexplode(facts).alias("pos", "f"))
    return items.select("capture_id", *[F.col(f"f.{n}").alias(n) for n in fields], "pos")


def prices_of(captures: DataFrame) -> DataFrame:
    return facts_of(captures, x.prices(F.col("ocr_text")), "raw", "currency", "amount")


def urls_of(captures: DataFrame) -> DataFrame:
    return facts_of(captures, x.urls(F.col("ocr_text")), "url", "host")


def phones_of(captures: DataFrame) -> DataFrame:
    return facts_of(captures, x.phones(F.col("ocr_text")), "raw", "normalized", "country")


def codes_of(captures: DataFrame) -> DataFrame:
    return spread(captures.select("capture_id", "ocr_text")).select("capture_id", F.posexplode(x.codes(F.col("ocr_text"))).alias("pos", "code"))


def dates_of(captures: DataFrame, today: date = TODAY) -> DataFrame:
    return facts_of(captures, x.dates(F.col("ocr_text"), today), "raw", "epoch_day", "has_year")


def order_codes_of(captures: DataFrame) -> DataFrame:
    return facts_of(captures, x.order_codes(F.col("ocr_text")), "kind", "code")
