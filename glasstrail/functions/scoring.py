"""Relevance arithmetic as SQL text over a query struct ``q`` and a document struct ``d``.

``q``: terms, phrases, prices, hosts, phones, codes, types, start_s, end_s, date_label, colors
``d``: ocr_text, filename, date_added, prices, hosts, phones, codes, duplicate_of
"""
from __future__ import annotations

from ..weights import HybridWeights, RelevanceWeights
from .base import quote

_SPACE = quote(r"\s+")


def closeness_sql(f: str, p: str) -> str:
    """How well price ``p`` meets filter ``f``: 0 to 1."""
    span = f"greatest({f}.max - {f}.min, 1D)"
    away = f"CASE WHEN {p}.amount < {f}.min THEN {f}.min - {p}.amount ELSE {p}.amount - {f}.max END"
    return (f"CASE WHEN {f}.currency IS NOT NULL AND {f}.currency <> {p}.currency THEN 0D "
            f"WHEN {p}.amount BETWEEN {f}.min AND {f}.max THEN 1D "
            f"WHEN {f}.kind = 'RANGE' THEN greatest(0D, least(1D, 1D - ({away}) / (2 * {span}))) ELSE 0D END")


def money_sql(currency: str, amount: str) -> str:
    """Formatted amount with Indian digit grouping."""
    digits = f"CASE WHEN {amount} % 1 = 0 THEN CAST(CAST({amount} AS BIGINT) AS STRING) ELSE format_string('%.2f', {amount}) END"
    grouped = (r"CASE WHEN length(substring_index(_m.x, '.', 1)) <= 3 THEN _m.x ELSE concat(reverse(regexp_replace(reverse(left(substring_index(_m.x, '.', 1), "
               r"length(substring_index(_m.x, '.', 1)) - 3)), '(\\d{2})(?=\\d)', '$1,')), ',', right(substring_index(_m.x, '.', 1), 3), "
               r"CASE WHEN contains(_m.x, '.') THEN concat('.', substring_index(_m.x, '.', -1)) ELSE '' END) END")
    shown = (f"CASE WHEN {currency} IS NULL THEN _g.x WHEN {currency} = 'INR' THEN concat('₹', _g.x) WHEN {currency} = 'USD' THEN concat('$', _g.x) "
             f"WHEN {currency} = 'EUR' THEN concat('€', _g.x) WHEN {currency} = 'GBP' THEN concat('£', _g.x) ELSE concat(_g.x, ' ', {currency}) END")
    return f"transform(array(struct({digits} AS x)), _m -> transform(array(struct({grouped} AS x)), _g -> {shown})[0])[0]"


def recency_sql(date_added: str, now: int, top: int) -> str:
    age = f"greatest(floor(({now} - {date_added}) / 86400), 0)"
    return f"CAST({top} * (1D - least({age} / 365D, 1D)) AS INT)"


def lexical_sql(now: int, w: RelevanceWeights = RelevanceWeights(), q: str = "q", d: str = "d", with_reasons: bool = True) -> str:
    """``struct<score, reasons>``, or the score alone; a reason is ``label␟KIND``. The value of a one-time code is never shown."""
    best = (f"array_max(transform(filter({d}.prices, p -> {closeness_sql('f', 'p')} > 0), (p, i) -> "
            f"named_struct('c', {closeness_sql('f', 'p')}, 'i', -i, 'cur', p.currency, 'amt', p.amount)))")
    host_hit = f"exists({d}.hosts, x -> lower(x) = h OR endswith(lower(x), concat('.', h)))"
    bound = {
        "ocr": f"lower(trim(regexp_replace({d}.ocr_text, {_SPACE}, ' ')))", "name": f"lower({d}.filename)",
        "terms": f"transform({q}.terms, t -> lower(t))", "phrases": f"transform({q}.phrases, t -> lower(t))",
        "prices": f"filter(transform({q}.prices, f -> {best}), x -> x IS NOT NULL)",
        "hosts": f"filter({q}.hosts, h -> {host_hit})",
        "phones": f"array_intersect({q}.phones, {d}.phones)",
        "code": f"arrays_overlap({q}.codes, {d}.codes)",
        "dated": f"coalesce({q}.start_s IS NOT NULL AND {d}.date_added >= {q}.start_s AND {d}.date_added < {q}.end_s, false)",
    }
    more = {
        "hits": "filter(_a.terms, t -> contains(_a.ocr, t) OR contains(_a.name, t))",
        "named": "get(filter(_a.terms, t -> contains(_a.name, t)), 0)",
        "found": "filter(_a.phrases, p -> contains(_a.ocr, p) OR contains(replace(_a.ocr, ' ', ''), replace(p, ' ', '')))",
    }
    score = " + ".join([
        f"CASE WHEN size(_a.terms) = 0 THEN 0 WHEN size(_h.hits) = size(_a.terms) THEN {w.all_terms} WHEN size(_h.hits) >= ceil(size(_a.terms) * {w.most_terms_ratio}D) THEN {w.most_terms} ELSE 0 END",
        f"CASE WHEN size(_h.hits) > 0 THEN {w.text_match} ELSE 0 END",
        f"{w.exact_phrase} * size(_h.found)", f"CASE WHEN _h.named IS NOT NULL THEN {w.filename_match} ELSE 0 END",
        f"aggregate(_a.prices, 0, (s, p) -> s + CASE WHEN p.c >= 1 THEN {w.price_exact} ELSE CAST({w.price_approximate} * p.c AS INT) END)",
        f"{w.url_match} * size(_a.hosts)", f"{w.phone_match} * size(_a.phones)", f"CASE WHEN _a.code THEN {w.code_match} ELSE 0 END",
        f"CASE WHEN _a.dated THEN {w.date_match} ELSE 0 END", recency_sql(f"{d}.date_added", now, w.recency_max),
    ])
    reasons = ("array_distinct(array_compact(concat("
               "array(CASE WHEN size(_h.hits) > 0 THEN concat(_h.hits[0], '␟TERM') END), transform(_h.found, p -> concat(p, '␟PHRASE')), "
               "array(concat(_h.named, '␟FILENAME')), "
               f"transform(_a.prices, p -> concat({money_sql('p.cur', 'p.amt')}, '␟PRICE')), transform(_a.hosts, h -> concat(h, '␟URL')), "
               "transform(_a.phones, p -> concat(p, '␟PHONE')), "
               f"array(CASE WHEN _a.code THEN 'One-time code␟OTP' END, CASE WHEN _a.dated THEN concat({q}.date_label, '␟DATE') END, "
               f"CASE WHEN array_contains({q}.types, 'DUPLICATES') AND {d}.duplicate_of IS NOT NULL THEN 'Duplicate␟DUPLICATE' END))))")
    first = ", ".join(f"{v} AS {k}" for k, v in bound.items())
    second = ", ".join(f"{v} AS {k}" for k, v in more.items())
    return (f"transform(array(struct({first})), _a -> transform(array(struct({second})), _h -> "
            f"named_struct('score', {score}{f", 'reasons', {reasons}" if with_reasons else ''}))[0])[0]")


def metadata_share_sql(reasons: str, q: str = "q") -> str:
    """Satisfied constraints over asked constraints."""
    asked = {"PRICE": f"size({q}.prices) > 0", "URL": f"size({q}.hosts) > 0", "PHONE": f"size({q}.phones) > 0", "OTP": f"size({q}.codes) > 0", "DATE": f"{q}.start_s IS NOT NULL"}
    total = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in asked.values())
    met = " + ".join(f"CASE WHEN {c} AND exists({reasons}, r -> endswith(r, '␟{k}')) THEN 1 ELSE 0 END" for k, c in asked.items())
    return f"coalesce(try_divide({met}, {total}), 0D)"


def hybrid_sql(lexical: str, semantic: str, metadata: str, visual: str, entity: str, w: HybridWeights = HybridWeights()) -> str:
    """Weighted sum of the five clamped signals; ``lexical`` is 0-100, the others 0-1."""
    def unit(x: str) -> str:
        return f"greatest(0D, least(1D, {x}))"

    return (f"(greatest(0D, least(100D, {lexical})) * {w.lexical}D + {unit(semantic)} * 100 * {w.semantic}D + {unit(metadata)} * 100 * {w.metadata}D "
            f"+ {unit(visual)} * 100 * {w.visual}D + {unit(entity)} * 100 * {w.entity}D) / {w.total}D")


def normal_lexical_sql(score: str, w: HybridWeights = HybridWeights()) -> str:
    return f"greatest(0D, least(1D, {score} / {w.lexical_ceiling}D)) * 100"


def palette_overlap_sql(wanted: str, colors: str) -> str:
    return f"coalesce(try_divide(size(filter({wanted}, c -> array_contains({colors}, lower(c)))), size({wanted})), 0D)"


def visual_score_sql(wanted: str, colors: str, query_hash: str, dhash: str) -> str:
    near = f"CASE WHEN {query_hash} IS NULL OR {dhash} IS NULL THEN 0D ELSE greatest(0D, 1D - bit_count({query_hash} ^ {dhash}) / 24D) END"
    return f"greatest({palette_overlap_sql(wanted, colors)}, {near})"


def entity_score_sql(wanted: str, labels: str) -> str:
    hit = f"filter({wanted}, w -> exists({labels}, l -> contains(lower(l), w) OR contains(w, lower(l))))"
    return f"CASE WHEN size({labels}) = 0 THEN 0D ELSE coalesce(try_divide(size({hit}), size({wanted})), 0D) END"
