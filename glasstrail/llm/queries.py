"""The registered queries of this package: each applies its operator to the whole of its table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, convtrie, licenses, mixing, quality, rulefit, secrets, simhash, sitetree, toxicity, urls, vectors
from .common import checkpointed, documents, held_out, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_licenses(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scanned(documents(spark, root, "doc_id", "text"), keep=["doc_id"])


@query
def op2_bpe(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


@query
def op3_quality_model(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "text")
    model = rulefit.trained(docs, table(spark, root, "labels", "doc_id", "quality"))
    return rulefit.scored(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op4_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return urls.judged(table(spark, root, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op4_url_filter"] = urls.oracle_sql()


@query
def op5_vector_dedup(spark: SparkSession, root: str) -> DataFrame:
    return vectors.deduplicated(table(spark, root, "embeddings", "vec_id", "embedding"))


@query
def op6_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scanned(documents(spark, root, "doc_id", "text"), keep=["doc_id"])


@query
def op7_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "source", "text")
    counted = checkpointed(quality.with_counts(docs, keep=["doc_id", "source"]))
    return quality.judge(counted, "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules", "host_rejected")


@query
def op8_mix(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "source", "text").withColumn("pick_hash", mixing.pick_hash("doc_id", "text"))
    sized = checkpointed(mixing.with_sizes(docs, keep=["doc_id", "source", "pick_hash"]))
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op9_simhash(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "text")
    prints = checkpointed(simhash.with_fingerprints(docs, keep=["doc_id"]))
    return simhash.with_components(prints).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "lang", "text")
    net, thresholds = toxicity.trained(docs, table(spark, root, "labels", "doc_id", "toxic"))
    return toxicity.scored(docs, net, thresholds, keep=["doc_id", "lang"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")


@query
def op11_conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    return convtrie.trie(table(spark, root, "conversations", "conv_id", "turn", "role", "text"))


ORACLES["op11_conversation_trie"] = convtrie.oracle_sql()


@query
def op12_html_text(spark: SparkSession, root: str) -> DataFrame:
    return sitetree.main_text(table(spark, root, "pages", "page_id", "url", "html"), keep=["page_id", "url"])


ORACLES["op12_html_text"] = sitetree.oracle_sql()


@query
def op13_token_alignment(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root, "doc_id", "text")
    return alignment.scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), 32_000, keep=["doc_id"])
