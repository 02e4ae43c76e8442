"""Small Column helpers shared by every operator."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of the text index: every ASCII character that is no letter and no digit.
INDEX_SPLIT = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def text_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def empty(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """Bind ``values`` once and evaluate ``fn`` over the bound struct.

    Expressions referenced inside a lambda would otherwise be evaluated per element.
    """
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.transform(bound, fn)[0]


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """One pass over the text for the whole list."""
    return text.rlike("|".join(re.escape(w) for w in words))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def index_tokens(text: Column) -> Column:
    """Tokens of the text index, in order; non-ASCII characters stay inside tokens."""
    return F.filter(F.split(ascii_lower(text), INDEX_SPLIT, -1), lambda t: t != "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_of(text: Column | str) -> str:
    """SQL text of a plain column or of a SQL expression."""
    return text if isinstance(text, str) else text._jc.toString()


def bind(body: str, **values: str) -> str:
    """SQL that evaluates ``values`` once and ``body`` over them as ``_b.name``.

    Inside a lambda an outer expression is evaluated for every element; binding avoids that.
    """
    fields = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return f"transform(array(struct({fields})), _b -> {body})[0]"


def find_spans(text: str, pattern: str, before: int = 0, after: int = 0) -> str:
    """SQL for all matches with their neighbourhood: ``array<struct<raw, before, after>>``.

    Splitting on the same pattern gives the text between matches, so the context of match i is
    the tail of what precedes it. At most ``before`` pieces can contribute, so the cost stays
    linear in the number of matches.
    """
    left = right = "''"
    if before:
        lo = f"greatest(i - {before}, 0)"
        head = (f"array_join(transform(slice(_s.pieces, {lo} + 1, i - {lo}), (p, k) -> "
                f"concat(right(p, {before}), get(_s.hits, {lo} + k))), '')")
        left = f"right(concat({head}, right(get(_s.pieces, i), {before})), {before})"
    if after:
        tail = (f"array_join(transform(slice(_s.pieces, i + 2, {after}), (p, k) -> "
                f"concat(left(p, {after}), coalesce(get(_s.hits, i + k + 1), ''))), '')")
        right = f"left({tail}, {after})"
    q = quote(pattern)
    spans = (f"transform(array(struct(_m.hits AS hits, split({text}, {q}, -1) AS pieces)), _s -> "
             f"transform(_s.hits, (raw, i) -> named_struct('raw', raw, 'before', {left}, 'after', {right})))[0]")
    none = "CAST(array() AS array<struct<raw:string,before:string,after:string>>)"
    # Most texts hold no match; splitting, which compiles the pattern anew, is left to those that do.
    return f"transform(array(struct(regexp_extract_all({text}, {q}, 0) AS hits)), _m -> CASE WHEN size(_m.hits) = 0 THEN {none} ELSE {spans} END)[0]"


def first_of_each(items: str, key: str) -> str:
    """SQL that keeps the first element ``e`` of each ``key`` (SQL over ``e``), in order."""
    return (f"transform(array(struct({items} AS items)), _d -> transform(array(struct(_d.items AS items, transform(_d.items, e -> {key}) AS keys)), "
            f"_k -> filter(_k.items, (e, n) -> array_position(_k.keys, {key}) = n + 1))[0])[0]")
