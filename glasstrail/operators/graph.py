"""Entity graph as two tables: entities and edges."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import lexicon as lx
from ..functions import money
from ..functions.base import let, text_array

CONFIDENCE = {"PRODUCT": 0.7, "WEBSITE": 0.9, "COMPANY": 0.6, "PRICE": 0.9, "ORDER": 0.8, "BOOKING": 0.8, "CATEGORY": 0.8, "DATE": 0.7}
KIND = {"PRODUCT": "MENTIONS", "WEBSITE": "FOUND_ON", "COMPANY": "SOLD_BY", "PRICE": "PRICED_AT", "ORDER": "MENTIONS", "BOOKING": "MENTIONS",
        "CATEGORY": "BELONGS_TO", "DATE": "OCCURRED_ON"}


def product_name(raw: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "(?<=[a-z])(?=[0-9])", " "), r"\s+", " "))


def website_name(host: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit("."))


def company_name(host: Column) -> Column:
    parts = F.split(website_name(host), r"\.", -1)
    n = F.size(parts)
    second = F.get(parts, n - 2).isin(lx.SECOND_LEVEL)
    return F.when(n <= 2, F.get(parts, F.lit(0))).when(second, F.get(parts, n - 3)).otherwise(F.get(parts, n - 2))


def price_name(currency: Column, amount: Column) -> Column:
    return F.concat(currency, F.lit(":"), amount.cast("string"))


def looks_like_product(phrase: Column) -> Column:
    return named_like_product(product_name(phrase))


def named_like_product(name: Column) -> Column:
    words = F.split(name, " ")
    return ((F.length(name) >= 3) & (F.size(words) <= 4) & ~F.arrays_overlap(words, text_array(lx.CHROME_WORDS)) & name.rlike("[a-z]")
            & (name.rlike("[0-9]") | F.arrays_overlap(words, text_array(lx.PRODUCT_NOUNS))))


def entity_refs(phrases: DataFrame, urls: DataFrame, prices: DataFrame, dates: DataFrame, codes: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Typed references ``(capture_id, type, display, normalized, pos)`` from the fact tables."""
    def rows(df: DataFrame, kind: str | Column, display: Column, normalized: Column) -> DataFrame:
        k = F.lit(kind) if isinstance(kind, str) else kind
        pos = F.col("pos") if "pos" in df.columns else F.lit(0)
        return df.select("capture_id", k.alias("type"), display.alias("display"), normalized.alias("normalized"), pos.cast("int").alias("pos"))

    host = website_name(F.col("host"))
    sites = urls.filter(F.contains(host, F.lit(".")))
    parts = [
        rows(phrases.filter(looks_like_product(F.col("phrase"))), "PRODUCT", F.trim("phrase"), product_name(F.col("phrase"))),
        rows(sites, "WEBSITE", host, host), rows(sites, "COMPANY", company_name(F.col("host")), company_name(F.col("host"))),
        rows(prices, "PRICE", money.format_money(F.col("currency"), F.col("amount")), price_name(F.col("currency"), F.col("amount"))),
        rows(codes, F.col("kind"), F.col("code"), F.upper(F.trim("code"))),
        rows(dates, "DATE", F.col("raw"), F.lower(F.trim("raw"))),
    ]
    if categories is not None:
        parts.append(rows(categories.filter("category <> 'OTHER'"), "CATEGORY", F.col("label"), F.lower(F.trim("label"))))
    union = reduce(DataFrame.unionByName, parts)
    first = union.groupBy("capture_id", "type", "normalized").agg(F.min(F.struct("pos", "display")).alias("f"))
    return first.select("capture_id", "type", "normalized", F.col("f.display").alias("display"), F.col("f.pos").alias("pos"))


REF_DDL = "struct<type:string,normalized:string,pos:int,display:string>"


def refs_in_row(phrases: Column, urls: Column, prices: Column, dates: Column, codes: Column, categories: Column) -> Column:
    """What ``entity_refs`` gives for one capture, as an array of ``REF_DDL``, from the facts in its own row: nothing is joined or shuffled.

    ``phrases`` and ``categories`` (labels, null for OTHER) are texts in rank order, the others the arrays of the extractors.
    """
    def ref(kind: Column, display: Column, normalized: Column, pos: Column) -> Column:
        return F.struct(kind.alias("type"), normalized.alias("normalized"), pos.cast("int").alias("pos"), display.alias("display"))

    host = lambda u: website_name(u["host"])
    sites = F.filter(urls, lambda u: F.contains(host(u), F.lit(".")))
    shown = lambda p: let(lambda b: money.shown_amount(p["currency"], b["g"]), g=let(lambda b: money.indian_grouping(b["a"]), a=money.plain_amount(p["amount"])))
    named = F.filter(F.transform(phrases, lambda p, k: F.struct(p.alias("p"), (k + 1).alias("k"), product_name(p).alias("name"))), lambda v: named_like_product(v["name"]))
    parts = [
        F.transform(named, lambda v: ref(F.lit("PRODUCT"), F.trim(v["p"]), v["name"], v["k"])),
        F.transform(sites, lambda u, k: ref(F.lit("WEBSITE"), host(u), host(u), k)),
        F.transform(sites, lambda u, k: ref(F.lit("COMPANY"), company_name(u["host"]), company_name(u["host"]), k)),
        F.transform(prices, lambda p, k: ref(F.lit("PRICE"), shown(p), price_name(p["currency"], p["amount"]), k)),
        F.transform(codes, lambda c, k: ref(c["kind"], c["code"], F.upper(F.trim(c["code"])), k)),
        F.transform(dates, lambda d, k: ref(F.lit("DATE"), d["raw"], F.lower(F.trim(d["raw"])), k)),
        F.filter(F.transform(categories, lambda c, k: ref(F.lit("CATEGORY"), c, F.lower(F.trim(c)), k + 1)), lambda r: r["display"].isNotNull()),
    ]
    none = F.array().cast(f"array<{REF_DDL}>")
    whole = F.array_sort(F.concat(*[F.coalesce(p.cast(f"array<{REF_DDL}>"), none) for p in parts]))
    same = lambda a, b: a["type"].eqNullSafe(b["type"]) & a["normalized"].eqNullSafe(b["normalized"])
    # Sorted by type, name and place: the first of each type and name counts.
    return let(lambda b: F.filter(b["refs"], lambda r, k: (k == 0) | ~same(r, F.get(b["refs"], k - 1))), refs=whole)


def labels_in_row(refs: Column) -> Column:
    """What ``labels`` gives for one capture."""
    shown = F.transform(refs, lambda r: F.lower(r["display"]))
    return F.array_sort(F.array_distinct(F.filter(shown, lambda v: v.isNotNull())))


def build_edges(refs: DataFrame) -> DataFrame:
    """``(capture_id, entity_id, type, normalized, display, kind, confidence)``."""
    kind = F.create_map(*[F.lit(v) for kv in KIND.items() for v in kv])
    sure = F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])
    return refs.select("capture_id", entity_id().alias("entity_id"), "type", "normalized", "display", kind[F.col("type")].alias("kind"), sure[F.col("type")].alias("confidence"))


def entity_id() -> Column:
    """Stable id from the key, so no counter is needed."""
    return F.xxhash64("type", "normalized")


def find_or_create(edges: DataFrame, captures: DataFrame) -> DataFrame:
    """One entity per (type, name), with the display name first seen."""
    dated = edges.join(captures.select("capture_id", "date_added"), "capture_id")
    return dated.groupBy("entity_id", "type", "normalized").agg(F.min_by("display", F.struct("date_added", "capture_id")).alias("display"))


def replace_footprint(edges: DataFrame, fresh: DataFrame, batch: DataFrame) -> DataFrame:
    return edges.join(batch.select("capture_id").distinct(), "capture_id", "left_anti").unionByName(fresh)


def resolve(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entity of a free name: as product, else website, else company."""
    keys = names.select("name", F.explode(F.array(
        F.struct(F.lit(0).alias("p"), F.lit("PRODUCT").alias("type"), product_name(F.col("name")).alias("normalized")),
        F.struct(F.lit(1).alias("p"), F.lit("WEBSITE").alias("type"), website_name(F.col("name")).alias("normalized")),
        F.struct(F.lit(2).alias("p"), F.lit("COMPANY").alias("type"), website_name(F.col("name")).alias("normalized")))).alias("k")).select("name", "k.*")
    hit = entities.join(keys, ["type", "normalized"])
    return hit.groupBy("name").agg(F.min_by(F.struct("entity_id", "type", "normalized"), "p").alias("e")).select("name", "e.*")


def members(edges: DataFrame, captures: DataFrame, wanted: DataFrame, limit: int | None = 200) -> DataFrame:
    """Captures of the wanted entities, newest first."""
    rows = (edges.join(wanted.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "capture_id").distinct()
            .join(captures.select("capture_id", "date_added"), "capture_id"))
    if limit is None:
        return rows
    w = Window.partitionBy("entity_id").orderBy(F.desc("date_added"), F.desc("capture_id"))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def labels(edges: DataFrame) -> DataFrame:
    return edges.groupBy("capture_id").agg(F.array_sort(F.collect_set(F.lower("display"))).alias("labels"))


def first_label(edges: DataFrame) -> DataFrame:
    """Most certain label per capture, then alphabetical."""
    return edges.groupBy("capture_id").agg(F.min_by("display", F.struct((-F.col("confidence")).alias("o"), "display")).alias("entity"))


def entity_pages(edges: DataFrame, types: list[str]) -> DataFrame:
    """Per entity: members, price points, websites and categories of its captures.

    The second hop joins on the capture, whose edges are few, so a popular entity costs rows, not pairs.
    """
    own = edges.filter(F.col("type").isin(types)).select("entity_id", "capture_id").distinct()
    other = edges.filter(F.col("type").isin("PRICE", "WEBSITE", "CATEGORY")).select("capture_id", F.col("type").alias("t"), F.col("display").alias("d"))
    facts = own.join(other, "capture_id").groupBy("entity_id", "t", "d").agg(F.lit(1).alias("one"))
    lists = facts.groupBy("entity_id").agg(
        F.count_if(F.col("t") == "PRICE").alias("n_prices"), F.array_sort(F.collect_list(F.when(F.col("t") == "WEBSITE", F.col("d")))).alias("websites"),
        F.array_sort(F.collect_list(F.when(F.col("t") == "CATEGORY", F.col("d")))).alias("categories"))
    counts = own.groupBy("entity_id").agg(F.count("*").alias("n_members"))
    return counts.join(lists, "entity_id", "left")
