"""Text search for many queries at once: index, term and phrase matching, suggestions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import collapse_space, index_tokens
from ..session import checkpointed

TRIM = r".,;:!?\"'()\[\]{}"

#: Largest relation, in rows, that a search sends to every executor.
FEW = 20_000


def few(rows: DataFrame) -> bool:
    """Whether a relation is small, by looking at ``FEW`` rows of it."""
    return rows.limit(FEW + 1).count() <= FEW


def meet(large: DataFrame, rows: DataFrame, on: str | list[str], small: bool | None = None) -> DataFrame:
    """``large`` joined with rows that are broadcast if they are few; ``large`` itself is never broadcast.

    Exploded tokens are far larger than the planner takes them for and queries made on the driver far smaller, so its
    own choice would send the whole index through the driver.
    """
    return large.join(F.broadcast(rows), on) if (few(rows) if small is None else small) else large.hint("merge").join(rows, on)


def token_index(captures: DataFrame) -> DataFrame:
    """``(token, capture_id, field, pos)`` over file name and text. One-time codes tables are not indexed."""
    fields = [("filename", 0), ("ocr_text", 1)]
    arrays = F.array(*[F.struct(F.lit(n).alias("field"), index_tokens(F.col(c)).alias("t")) for c, n in fields])
    per = captures.select("capture_id", F.explode(arrays).alias("f"))
    return per.select("capture_id", F.col("f.field").alias("field"), F.posexplode("f.t").alias("pos", "token"))


def save_index(index: DataFrame, table: str, buckets: int = 64) -> None:
    """Keep the index bucketed and sorted by token, so term lookups read few files and joins need no shuffle."""
    index.write.mode("overwrite").bucketBy(buckets, "token").sortBy("token", "capture_id").saveAsTable(table)


def clean_terms(terms: Column) -> Column:
    trimmed = F.transform(terms, lambda t: F.lower(F.regexp_replace(t, f"^[{TRIM}]+|[{TRIM}]+$", "")))
    return F.array_distinct(F.filter(trimmed, lambda t: F.trim(t) != ""))


def raw_terms(text: Column) -> Column:
    return clean_terms(F.split(F.trim(text), r"\s+"))


def expand_prefixes(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, term, token)``: the tokens each term is a prefix of.

    The vocabulary is far smaller than the index. Each token lists its own prefixes and meets the terms by equality.
    """
    vocabulary = index.select("token").distinct()
    wanted = terms.select(F.length("term").alias("n")).distinct().agg(F.collect_set("n").alias("lengths"))
    prefixes = (vocabulary.withColumn("_one", F.lit(1)).join(F.broadcast(wanted.withColumn("_one", F.lit(1))), "_one")
                .select("token", F.explode(F.filter("lengths", lambda n: n <= F.length("token"))).alias("n")))
    keyed = prefixes.select("token", F.expr("left(token, n)").alias("term"))
    return meet(keyed, terms.select("query_id", "term").distinct(), "term").select("query_id", "term", "token")


def term_hits(index: DataFrame, needles: DataFrame) -> DataFrame:
    """``(query_id, capture_id, n)``: how many distinct terms of a query occur in a capture."""
    found = meet(index.select("token", "capture_id"), needles, "token").groupBy("query_id", "capture_id", "term").agg(F.lit(1).alias("one"))
    return found.groupBy("query_id", "capture_id").agg(F.count("*").alias("n"))


def match_all(index: DataFrame, terms: DataFrame, prefix: bool = True) -> DataFrame:
    """Captures that hold every term of a query, each as a token prefix (or exactly)."""
    needles = checkpointed(expand_prefixes(index, terms)) if prefix else terms.select("query_id", "term", F.col("term").alias("token"))
    need = terms.select("query_id", "term").distinct().groupBy("query_id").agg(F.count("*").alias("need"))
    return meet(term_hits(index, needles), need, "query_id").filter("n = need").select("query_id", "capture_id")


def match_any(index: DataFrame, terms: DataFrame) -> DataFrame:
    needles = terms.select("query_id", "term", F.col("term").alias("token"))
    return term_hits(index, needles).select("query_id", "capture_id")


def match_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Captures with the words of a phrase side by side.

    Every word votes for the position its phrase would start at; a phrase is there when all its words
    vote for one start. That is one join with the index and one aggregation.
    """
    words = phrases.select("query_id", "phrase", F.posexplode(index_tokens(F.col("phrase"))).alias("offset", "token"))
    need = words.groupBy("query_id", "phrase").agg(F.count("*").alias("need")).filter("need > 1")
    small = few(words)
    votes = (meet(index, words, "token", small).groupBy("query_id", "phrase", "capture_id", "field", (F.col("pos") - F.col("offset")).alias("start"))
             .agg(F.count("*").alias("n")))
    return meet(votes, need, ["query_id", "phrase"], small).filter("n = need").select("query_id", "capture_id", "phrase").distinct()


def union_window(phrase_hits: DataFrame, term_matches: DataFrame) -> DataFrame:
    """Phrase hits first, then term hits; one row per (query, capture)."""
    both = phrase_hits.select("query_id", "capture_id").distinct().withColumn("source", F.lit(0)).unionByName(
        term_matches.select("query_id", "capture_id").withColumn("source", F.lit(1)))
    return both.groupBy("query_id", "capture_id").agg(F.min("source").alias("source"))


def candidate_order(matches: DataFrame, captures: DataFrame, queries: DataFrame, limit: int | None = 400) -> DataFrame:
    """File name prefix, then file name contains, then the rest; newest first."""
    found = captures.select("capture_id", "filename", "date_added").hint("merge").join(matches, "capture_id")
    rows = meet(found, queries.select("query_id", F.lower(F.trim("raw")).alias("needle")), "query_id")
    name = F.lower("filename")
    tier = F.when(name.startswith(F.col("needle")), 0).when(F.contains(name, F.col("needle")), 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy("tier", F.desc("date_added"), F.desc("capture_id"))
    ranked = rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(w))
    return (ranked if limit is None else ranked.filter(F.col("rank") <= limit)).select("query_id", "capture_id", "tier", "rank")


def legacy_score(filename: Column, needle: Column) -> Column:
    low, n = F.lower(filename), F.lower(needle)
    return F.when(low == n, 3).when(low.startswith(n), 2).when(F.contains(low, n), 1).otherwise(0)


def plain_terms(text: Column, stop: list[str]) -> Column:
    """Terms of the plain search: split on everything but letters and digits, stop words dropped."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != ""))
    return F.array_except(words, F.array(*[F.lit(s) for s in stop]))


def top_hosts(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """Hosts with their numbers: all of them, or the ``limit`` most frequent."""
    hosts = urls.groupBy("host").agg(F.count("*").alias("n"))
    return hosts if limit is None else hosts.orderBy(F.desc("n"), "host").limit(limit)


def mine_phrases(captures: DataFrame, prefixes: DataFrame, per_document: int = 3) -> DataFrame:
    """``(prefix, capture_id, phrase)``: words that start with a prefix, with the word that follows."""
    words = captures.select("capture_id", F.split(collapse_space(F.col("ocr_text")), " ").alias("w"))
    pairs = words.select("capture_id", F.posexplode("w").alias("pos", "word"), "w").select(
        "capture_id", "pos", "word", F.coalesce(F.get("w", F.col("pos") + 1), F.lit("")).alias("next"))
    clean = lambda c: F.regexp_replace(c, f"^[{TRIM}]+|[{TRIM}]+$", "")
    longest = prefixes.select(F.lower("prefix").alias("prefix"), F.length("prefix").alias("n")).distinct()
    keyed = pairs.withColumn("bare", F.lower(F.regexp_replace("word", r"^[^\p{L}\p{N}_]+", "")))
    lens = longest.agg(F.collect_set("n").alias("lengths")).withColumn("_one", F.lit(1))
    hit = (keyed.withColumn("_one", F.lit(1)).join(F.broadcast(lens), "_one")
           .select("capture_id", "pos", "word", "next", "bare", F.explode(F.filter("lengths", lambda n: n <= F.length("bare"))).alias("n"))
           .withColumn("prefix", F.expr("left(bare, n)")).join(longest, ["prefix", "n"]))
    phrase = F.trim(F.concat_ws(" ", clean(F.col("word")), clean(F.col("next"))))
    w = Window.partitionBy("prefix", "capture_id").orderBy("pos")
    return (hit.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_document)
            .select("prefix", "capture_id", phrase.alias("phrase"), "pos").filter(~F.col("phrase").rlike("^[0-9]*$")))


def suggest(prefixes: DataFrame, history: DataFrame, hosts: DataFrame, mined: DataFrame, limit: int = 6, min_chars: int = 2) -> DataFrame:
    """Completions per prefix: recent queries, then hosts, then phrases from the texts.

    ``history``: text, ts; ``hosts``: host, n; ``mined``: prefix, phrase.
    """
    p = prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).filter(F.length("prefix") >= min_chars).distinct()

    def starting(df: DataFrame, text: str, order: Column, source: int) -> DataFrame:
        items = df.select(collapse_space(F.col(text)).alias("text"), order.alias("o"))
        grown = items.select("text", "o", F.explode(F.transform(F.sequence(F.lit(min_chars), F.greatest(F.length("text"), F.lit(min_chars))),
                                                                lambda n: F.lower(F.substring(F.col("text"), F.lit(1), n)))).alias("prefix"))
        return grown.join(p, "prefix").select("prefix", "text", F.lit(source).alias("source"), "o").distinct()

    phrases = mined.groupBy("prefix", "phrase").agg(F.count("*").alias("n")).join(p, "prefix").select(
        "prefix", F.col("phrase").alias("text"), F.lit(2).alias("source"), (-F.col("n")).alias("o"))
    all_rows = starting(history, "text", -F.col("ts"), 0).unionByName(starting(hosts, "host", -F.col("n"), 1)).unionByName(phrases)
    best = all_rows.filter("text <> ''").groupBy("prefix", F.lower("text").alias("k")).agg(F.min(F.struct("source", "o", "text")).alias("s"))
    w = Window.partitionBy("prefix").orderBy("s.source", "s.o", "k")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("prefix", F.col("s.text").alias("text"), F.col("s.source").alias("source"), "rank")
