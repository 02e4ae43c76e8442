"""Hashed n-gram features and vector arithmetic as Columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .base import let

DIMENSION = 512
MODEL, VERSION = "hashed-ngram", "1"


def embeddable_text(text: Column, filename: Column) -> Column:
    base = F.when(filename.contains("."), F.regexp_replace(filename, r"\.[^.]*$", "")).otherwise(filename)
    name = F.trim(F.regexp_replace(F.regexp_replace(base, r"[_\-]+", " "), "(?i)screenshot", " "))
    return F.when(name == "", text).otherwise(F.concat(text, F.lit("\n"), name))


def cleaned(text: Column) -> Column:
    """Lower-cased letters and digits of the whole text, and its white space: the words of ``features`` in one pass."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}\s]+", "")


def features(text: Column) -> Column:
    """Words, word pairs and padded character trigrams of the whole text."""
    words = F.filter(
        F.transform(F.split(F.lower(text), r"\s+", -1), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]", "")),
        lambda w: F.length(w) >= 2)

    def build(st: Column) -> Column:
        w = st["w"]
        pairs = F.transform(F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda b, i: F.concat(F.get(w, i), F.lit(" "), b))
        grams = F.flatten(F.transform(w, lambda x: F.transform(
            F.sequence(F.lit(0), F.length(x) - 1),
            lambda k: F.substring(F.concat(F.lit("^"), x, F.lit("$")), k + 1, F.lit(3)))))
        return F.concat(w, pairs, grams)

    return let(build, w=words)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units (equal to code points inside the BMP), in a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"),
                       lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors, clamped."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def normalised(a: Column) -> Column:
    def build(st: Column) -> Column:
        return F.transform(st["v"], lambda x: F.when(st["n"] > 0, x / st["n"]).otherwise(F.lit(0.0)))

    doubles = F.transform(a, lambda x: x.cast("double"))
    return let(lambda s: let(build, v=s["v"], n=F.sqrt(dot(s["v"], s["v"]))), v=doubles)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - hamming(a, b) / F.lit(24.0))
