"""Quality rules with a verdict on whole hosts.

One Arrow pass counts, per text, what the rules need. Failures are summed per host (here: the source of a
document), each host's failure rate of a rule is shrunk towards the population by a beta prior fitted to all hosts
(method of moments), and hosts whose shrunk rate passes ``host_limit`` are rejected; verdicts join back to documents.

Null texts have no words; a null host is a host of its own. Repeated rows are judged each. Empty input gives no rows.
"""
from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_texts, checkpointed, free_name, per_row, small_side

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
ADDED = pa.schema([(c, pa.int64()) for c in COUNTS])
DDL = ", ".join(f"{c} bigint" for c in COUNTS)
_NOT_SYMBOLS = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that stand twice or more in the text, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, covered = 0, 0  # covered: words before this position are counted already
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def counts_of(text: bytes) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one UTF-8 text; words are runs without ASCII white space."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (len(words), len(b"".join(words).translate(None, _CONTINUATION)), len(text.translate(None, _NOT_SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def with_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def derive(column: pa.Array) -> list[list]:
        rows = [counts_of(t) for t in byte_texts(column)]
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in COUNTS]

    return per_row(df, text, ADDED, DDL, derive, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rules whose failures are summed by host. Shortness alone says nothing about a host, so it isn't one."""
    return {
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 30 * F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "long_words": F.col("word_chars") > 40 * F.col("n_words"),
    }


def host_verdicts(counted: DataFrame, host: str, host_limit: float = 0.5) -> DataFrame:
    """``(host, n_docs, worst_rate, host_rejected)``: one row per host.

    The prior of a rule has the mean m and the variance v of the hosts' raw rates; its strength is m(1-m)/v - 1, kept
    between 1 and 1,000 so that equal hosts (v = 0) and opposite ones still give a proper prior.
    """
    named = rules()
    sums = counted.groupBy(F.col(f"`{host}`").alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.when(rule, 1).otherwise(0)).alias(name) for name, rule in named.items()])
    sums = checkpointed(sums)
    rate = {name: F.col(name) / F.col("n_docs") for name in named}
    moments = sums.agg(*[F.avg(r).alias(f"m_{n}") for n, r in rate.items()], *[F.var_pop(r).alias(f"v_{n}") for n, r in rate.items()])
    shrunk = []
    for name in named:
        m, v = F.col(f"m_{name}"), F.col(f"v_{name}")
        strength = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(m * (1 - m) / F.nullif(v, F.lit(0.0)) - 1, F.lit(1000.0))))
        shrunk.append((F.col(name) + m * strength) / (F.col("n_docs") + strength))
    judged = sums.crossJoin(F.broadcast(moments))  # one row of moments
    return judged.select("host", "n_docs", F.greatest(*shrunk).alias("worst_rate")).withColumn("host_rejected", F.col("worst_rate") >= host_limit)


def judge(counted: DataFrame, host: str, host_limit: float = 0.5) -> DataFrame:
    """Counted rows with ``base_failed``, ``failed_rules``, ``host_rate``, ``host_rejected`` and ``kept``.

    A document is kept unless a base rule fails, more than 3 symbols stand per 10 words, or its host is rejected.
    Columns named like the added ones are replaced; any other name may occur.
    """
    counted = counted.drop(*{"host_rate", "host_rejected", "base_failed", "failed_rules", "kept"} - {host})
    of = free_name(counted, "host")
    verdicts = host_verdicts(counted, host, host_limit).select(F.col("host").alias(of), F.col("worst_rate").alias("host_rate"), "host_rejected")
    rejected = F.coalesce("host_rejected", F.lit(False))
    named = rules()
    failed = F.concat_ws(",", *[F.when(rule, F.lit(name)) for name, rule in named.items()])
    return (counted.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col(of)), "left").drop(of)
            .withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn("host_rejected", rejected)
            .withColumn("kept", ~F.col("base_failed") & ~named["symbols"] & ~F.col("host_rejected")))


def kept_documents(docs: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns. The counts are taken twice, for the hosts and for the
    rows, which is cheaper than moving whole texts between executors: only hosts' verdicts move.
    """
    verdicts = checkpointed(host_verdicts(with_counts(docs, keep=[host]), host, host_limit).filter("host_rejected").select("host"))
    own = docs.columns
    counted = with_counts(docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)]), f"own_{own.index('text')}")
    good = counted.filter(~base_failed() & ~rules()["symbols"])
    left = good.join(small_side(verdicts), F.col(f"own_{own.index(host)}").eqNullSafe(F.col("host")), "left_anti")
    return left.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)])
