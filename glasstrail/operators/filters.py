"""Structured predicates. Absent constraints fold away; stored columns are never wrapped."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

LONG_ASPECT = 2.8
CONTENT_TYPES = ["URLS", "PRICES", "DATES", "PHONES", "OTPS", "DUPLICATES"]


def eligible(status: str = "status") -> Column:
    return F.col(status) != "FAILED"


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the constraints that are present."""
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def date_window(start: int | None = None, end: int | None = None, column: str = "date_added") -> Column | None:
    lower = F.col(column) >= start if start is not None else None
    upper = F.col(column) < end if end is not None else None
    return None if start is None and end is None else all_of(lower, upper)


def ids_in_order(rows: DataFrame, wanted: DataFrame, key: str = "capture_id") -> DataFrame:
    """Rows with the wanted ids in the wanted order; ``wanted`` holds (key, pos)."""
    return rows.join(wanted, key, "inner").orderBy("pos")


def price_band(amount: Column, currency: Column, low: float | None, high: float | None, iso: str | None = None) -> Column:
    return all_of(currency == iso if iso else None,
                  amount >= low if low is not None else None,
                  amount <= high if high is not None else None)


def having(rows: DataFrame, child: DataFrame, condition: Column, key: str = "capture_id") -> DataFrame:
    """Rows with at least one child that satisfies ``condition``."""
    return rows.join(child.filter(condition).select(key), key, "left_semi")


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``: a domain filter becomes an equality on these."""
    parts = F.split(F.lower(host), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_matches(host: Column, domain: Column) -> Column:
    h = F.lower(host)
    return (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def presence_flags(captures: DataFrame, children: dict[str, DataFrame], key: str = "capture_id") -> DataFrame:
    """``(key, flags)``: the fact types each capture has. Partial aggregation keeps the shuffle small."""
    tagged = [c.select(key).withColumn("t", F.lit(t)) for t, c in children.items()]
    if "duplicate_of" in captures.columns:
        tagged.append(captures.filter(F.col("duplicate_of").isNotNull()).select(key).withColumn("t", F.lit("DUPLICATES")))
    flags = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("flags"))
    return captures.select(key).join(flags, key, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def of_types(flags: Column, types: list[str]) -> Column:
    return F.lit(True) if not types else F.arrays_overlap(flags, F.array(*[F.lit(t) for t in types]))


def has_color(colors: Column, is_dark: Column, color: str) -> Column:
    if color in ("dark", "light"):
        return is_dark == (color == "dark")
    return F.array_contains(colors, color)


def is_long(width: str = "width", height: str = "height") -> Column:
    return (F.col(width) > 0) & (F.col(height) >= F.col(width) * LONG_ASPECT)


def merge_manual(parsed: Column, manual: Column) -> Column:
    return F.coalesce(manual, parsed)


def keyset_page(rows: DataFrame, cursor: tuple[int, int] | None, size: int) -> DataFrame:
    """The page after ``cursor`` (date descending, id descending), without OFFSET."""
    page = rows.filter(eligible())
    if cursor is not None:
        d, k = F.col("date_added"), F.col("capture_id")
        page = page.filter((d < cursor[0]) | ((d == cursor[0]) & (k < cursor[1])))
    return page.orderBy(F.desc("date_added"), F.desc("capture_id")).limit(size)


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")
