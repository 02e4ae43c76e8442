"""Annotation of free-text queries, step by step.

Every step reads what the steps before it left. What a step consumes is replaced by the mark ``MARK``, which later counts
as a dropped token. All builders are SQL text, so a whole query log is annotated in one projection per step.
"""
from __future__ import annotations

import re
from datetime import date, timedelta

from .. import lexicon as lx
from .base import bind, find_spans, quote
from .extract import INDIAN, date_sql

MARK = "\x01"
_M = "' \\u0001 '"
MIN_DAY, MAX_DAY = 0, 2932896
DATE_DDL = "struct<start_day:bigint,end_day:bigint,label:string,raw:string>"


def _words(words) -> str:
    return "|".join(re.escape(w) for w in sorted(set(words), key=len, reverse=True))


def mask(text: str, raws: str) -> str:
    """``text`` with every string of ``raws`` replaced by the mark."""
    return f"aggregate({raws}, {text}, (t, r) -> replace(t, r, {_M}))"


# --- dates ---------------------------------------------------------------
def _epoch(d: date) -> int:
    return (d - date(1970, 1, 1)).days


def _relative(today: date) -> list[tuple[str, int, int, str]]:
    monday = today - timedelta(days=today.weekday())
    month = today.replace(day=1)
    before = (month - timedelta(days=1)).replace(day=1)
    following = (month + timedelta(days=32)).replace(day=1)
    year = today.year
    return [
        (lx.QUERY_TODAY, _epoch(today), _epoch(today), "today"),
        (lx.QUERY_YESTERDAY, _epoch(today) - 1, _epoch(today) - 1, "yesterday"),
        (lx.QUERY_THIS_WEEK, _epoch(monday), _epoch(monday) + 6, "this week"),
        (lx.QUERY_LAST_WEEK, _epoch(monday) - 7, _epoch(monday) - 1, "last week"),
        (lx.QUERY_THIS_MONTH, _epoch(month), _epoch(following) - 1, "this month"),
        (lx.QUERY_LAST_MONTH, _epoch(before), _epoch(month) - 1, "last month"),
        (lx.QUERY_THIS_YEAR, _epoch(date(year, 1, 1)), _epoch(date(year, 12, 31)), "this year"),
        (lx.QUERY_LAST_YEAR, _epoch(date(year - 1, 1, 1)), _epoch(date(year - 1, 12, 31)), "last year"),
    ]


def _month_number(name: str) -> str:
    return "int(array_position(array(" + ", ".join(f"'{m[:3]}'" for m in lx.MONTH_NAMES) + f"), left(lower({name}), 3)))"


def date_steps(today: date) -> list[tuple[str, str]]:
    """``(pattern, SQL over the match r)`` in order of precedence."""
    t = f"DATE'{today.isoformat()}'"

    def row(start: str, end: str, label: str) -> str:
        return f"named_struct('start_day', bigint({start}), 'end_day', bigint({end}), 'label', {label}, 'raw', r)"

    def day(d: str) -> str:
        return bind(f"CASE WHEN _b.d IS NOT NULL THEN {row('unix_date(_b.d)', 'unix_date(_b.d)', chr(100) + 'ate_format(_b.d, ' + repr('d MMMM yyyy') + ')')} END", d=d)

    steps = [(p, row(str(a), str(b), f"'{label}'")) for p, a, b, label in _relative(today)]

    window = lx.QUERY_LAST_N
    n, unit = f"int(regexp_extract(r, {quote(window)}, 1))", f"lower(regexp_extract(r, {quote(window)}, 2))"
    start = (f"CASE _b.u WHEN 'day' THEN date_sub({t}, _b.n - 1) WHEN 'week' THEN date_add(date_sub({t}, 7 * _b.n), 1) WHEN 'month' THEN date_add(add_months({t}, -_b.n), 1) "
             f"ELSE date_add(add_months({t}, -12 * _b.n), 1) END")
    steps.append((window, bind(f"CASE WHEN _b.n BETWEEN 1 AND 3650 THEN {row(f'unix_date({start})', f'unix_date({t})', 'concat(' + repr('last ') + ', _b.n, ' + repr(' ') + ', _b.u, ' + repr('s') + ')')} END", n=n, u=unit)))

    iso = lx.QUERY_ISO
    g = lambda p, k: f"regexp_extract(r, {quote(p)}, {k})"
    steps.append((iso, day(date_sql(g(iso, 1), g(iso, 2), g(iso, 3)))))
    slash = lx.QUERY_SLASH
    year = f"CASE WHEN int({g(slash, 3)}) < 100 THEN 2000 + int({g(slash, 3)}) ELSE int({g(slash, 3)}) END"
    a, b = f"int({g(slash, 1)})", f"int({g(slash, 2)})"
    steps.append((slash, day(date_sql(f"({year})", f"(CASE WHEN {a} > 12 THEN {b} ELSE {a} END)", f"(CASE WHEN {a} > 12 THEN {a} ELSE {b} END)"))))

    def first_of(p: str, month_group: int, year_group: int, day_number: str = "1") -> str:
        """First day of a named month; a missing year is the latest that is not in the future."""
        m = _month_number(g(p, month_group))
        inferred = f"CASE WHEN {date_sql(str(today.year), m, f'least(greatest({day_number}, 1), 28)')} > {t} THEN {today.year - 1} ELSE {today.year} END"
        return date_sql(f"(CASE WHEN {g(p, year_group)} <> '' THEN int({g(p, year_group)}) ELSE {inferred} END)", m, day_number)

    month_label = "date_format(_b.d, 'MMMM yyyy')"
    bm, am = lx.QUERY_BEFORE + lx.QUERY_MONTH_YEAR, lx.QUERY_AFTER + lx.QUERY_MONTH_YEAR
    steps.append((bm, bind(row(str(MIN_DAY), "unix_date(_b.d) - 1", f"concat('before ', {month_label})"), d=first_of(bm, 1, 2))))
    by, ay = lx.QUERY_BEFORE + lx.QUERY_YEAR, lx.QUERY_AFTER + lx.QUERY_YEAR
    steps.append((by, bind(row(str(MIN_DAY), "unix_date(make_date(_b.y, 1, 1)) - 1", "concat('before ', _b.y)"), y=f"int({g(by, 1)})")))
    steps.append((am, bind(row("unix_date(last_day(_b.d)) + 1", str(MAX_DAY), f"concat('after ', {month_label})"), d=first_of(am, 1, 2))))
    steps.append((ay, bind(row("unix_date(make_date(_b.y, 12, 31)) + 1", str(MAX_DAY), "concat('after ', _b.y)"), y=f"int({g(ay, 1)})")))

    dm = lx.QUERY_DAY_NAME
    steps.append((dm, day(first_of(dm, 2, 3, f"int({g(dm, 1)})"))))
    md = lx.QUERY_NAME_DAY
    steps.append((md, day(first_of(md, 1, 3, f"int({g(md, 2)})"))))
    named = lx.QUERY_IN_MONTH
    plain_may = f"lower({g(named, 1)}) = 'may' AND {g(named, 2)} = ''"
    steps.append((named, bind(f"CASE WHEN NOT ({plain_may}) THEN {row('unix_date(_b.d)', 'unix_date(last_day(_b.d))', month_label)} END", d=first_of(named, 1, 2))))
    iny = lx.QUERY_IN_YEAR
    steps.append((iny, bind(row("unix_date(make_date(_b.y, 1, 1))", "unix_date(make_date(_b.y, 12, 31))", "string(_b.y)"), y=f"int({g(iny, 1)})")))
    return steps


def find_sql(text: str, pattern: str, build: str, ddl: str) -> str:
    """Matches of one step, built rows that are not null."""
    return f"CASE WHEN {text} RLIKE {quote(pattern)} THEN filter(transform(regexp_extract_all({text}, {quote(pattern)}, 0), r -> {build}), x -> x IS NOT NULL) ELSE CAST(array() AS array<{ddl}>) END"


# --- hosts, codes, phones ------------------------------------------------


def host_sql(raw: str) -> str:
    """Host of a link: no scheme, port, path or leading ``www.``; null when it is none."""
    bare = f"regexp_replace(regexp_replace(lower(trim({raw})), '^[a-z]+://', ''), '[/?#].*$', '')"
    host = f"regexp_replace(regexp_replace(substring_index(substring_index({bare}, '@', -1), ':', 1), '^www[.]', ''), '[.]+$', '')"
    return bind("CASE WHEN _b.h RLIKE '^[^.]+(?:[.][^.]+)*[.][a-z]{2,}$' THEN _b.h END", h=host)


def phones_sql(text: str) -> str:
    """``array<struct<raw, value>>``; a number beside a currency mark is no phone."""
    near = "(?:₹|[$]|€|£|rs|inr|usd|eur|gbp)"
    groups = []
    for p in lx.PHONE_PATTERNS:
        ok = f"NOT trim(lower(right(s.before, 6))) RLIKE {quote(near + '$')} AND NOT trim(lower(left(s.after, 6))) RLIKE {quote('^' + near)}"
        value = bind(INDIAN, d="regexp_replace(s.raw, '[^0-9]', '')")
        groups.append(f"transform(filter({find_spans(text, p, before=6, after=6)}, s -> {ok}), s -> named_struct('raw', trim(s.raw), 'value', {value}))")
    return f"CASE WHEN {text} RLIKE '[0-9]{{5}}' THEN filter(concat({', '.join(groups)}), p -> p.value IS NOT NULL) ELSE CAST(array() AS array<struct<raw:string,value:string>>) END"


# --- prices --------------------------------------------------------------
PRICE_DDL = "struct<kind:string,currency:string,min:double,max:double,raw:string>"


def currency_sql(marker: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.CURRENCY_WORDS.items())
    return f"CASE lower(trim({marker})) {arms} END"


def between_sql(text: str) -> str:
    g = lambda k: f"regexp_extract(r, {quote(lx.QUERY_BETWEEN)}, {k})"
    num = lambda k: f"try_cast(replace({g(k)}, ',', '') AS double)"
    build = bind("CASE WHEN _b.lo > 0 AND _b.hi >= _b.lo THEN named_struct('kind', 'RANGE', 'currency', _b.c, 'min', _b.lo, 'max', _b.hi, 'raw', r) END",
                 lo=num(2), hi=num(4), c=f"coalesce({currency_sql(g(1))}, {currency_sql(g(3))})")
    return find_sql(text, lx.QUERY_BETWEEN, build, PRICE_DDL)


def amounts_sql(text: str) -> str:
    """Single amounts with their operator and currency; identifiers and bare numbers are no prices."""
    def trailing(words) -> str:
        return f"_p.probe RLIKE {quote(r'(?<![\p{L}\p{N}])(?:' + _words(words) + ')$')}"

    pre = quote(rf"(?:([{lx.QUERY_SYMBOLS}])|(?<!\p{{L}})(\p{{L}}{{1,8}}))[ -]{{0,2}}$")
    suffix = quote(rf"^[ -]{{0,2}}([{lx.QUERY_SYMBOLS}]|\p{{L}}+)")
    probe0 = f"regexp_replace(lower(s.before), {quote(r'[ ₹$€£.,:;#\-–=]+$')}, '')"
    first = (f"named_struct('s', s, 'sym', regexp_extract(s.before, {pre}, 1), 'word', regexp_extract(s.before, {pre}, 2), 'next', regexp_extract(s.after, {suffix}, 1), "
             f"'probe0', {probe0}, 'v', try_cast(regexp_replace(s.raw, '[, ]', '') AS double))")
    prefix_code = f"coalesce({currency_sql('_f.sym')}, {currency_sql('_f.word')})"
    second = (f"named_struct('s', _f.s, 'v', _f.v, 'cur', coalesce({prefix_code}, {currency_sql('_f.next')}), 'probe', "
              f"CASE WHEN {currency_sql('_f.word')} IS NOT NULL THEN rtrim(left(_f.probe0, length(_f.probe0) - length(_f.word))) ELSE _f.probe0 END)")
    tol = lx.PRICE_TOLERANCE
    words = "(?:" + _words([*lx.AT_MOST_WORDS, *lx.AT_LEAST_WORDS, *lx.APPROXIMATE_WORDS, *lx.PRICE_TRIGGER_WORDS]) + ")"
    cur = "(?:" + "|".join(re.escape(k) for k in sorted(lx.CURRENCY_WORDS, key=len, reverse=True)) + ")"
    left_part = quote(rf"(?i)((?:(?<![\p{{L}}\p{{N}}]){words}[\s:.=-]*){{0,3}}(?:(?<!\p{{L}}){cur}\.?)?[ -]{{0,2}})$")
    right_part = quote(rf"(?i)^([ -]{{0,2}}(?:[{lx.QUERY_SYMBOLS}]|(?:rs|inr|usd|eur|gbp|rupees?|dollars?|euros?|pounds?)\b))")
    raw = f"concat(regexp_extract(_p.s.before, {left_part}, 1), _p.s.raw, regexp_extract(_p.s.after, {right_part}, 1))"
    row = lambda kind, lo, hi: f"named_struct('kind', '{kind}', 'currency', _p.cur, 'min', double({lo}), 'max', double({hi}), 'raw', {raw})"
    decide = (f"CASE WHEN _p.v IS NULL OR _p.v <= 0 OR _p.v >= 1e12 OR {trailing(lx.PRICE_IDENTIFIER_WORDS)} THEN NULL "
              f"WHEN {trailing(lx.AT_MOST_WORDS)} THEN {row('AT_MOST', '0', '_p.v')} WHEN {trailing(lx.AT_LEAST_WORDS)} THEN {row('AT_LEAST', '_p.v', '1.7976931348623157E308D')} "
              f"WHEN {trailing(lx.APPROXIMATE_WORDS)} THEN {row('RANGE', f'_p.v * {1 - tol}D', f'_p.v * {1 + tol}D')} "
              f"WHEN _p.cur IS NOT NULL OR {trailing(lx.PRICE_TRIGGER_WORDS)} THEN {row('EXACT', '_p.v', '_p.v')} END")
    chain = f"transform(transform(transform({find_spans(text, lx.QUERY_AMOUNT, before=64, after=12)}, s -> {first}), _f -> {second}), _p -> {decide})"
    return f"CASE WHEN {text} RLIKE '[0-9]' THEN filter({chain}, x -> x IS NOT NULL) ELSE CAST(array() AS array<{PRICE_DDL}>) END"


# --- content types, colours, keywords ------------------------------------
COLOR = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(lx.COLOR_WORDS) + r")(?![\p{L}\p{N}])(?!(?<=dark|light)\s*mode(?!\p{L}))"
TOKEN = "\x01" + r"|\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d*\p{L}[\p{L}\p{N}]*|[\p{L}\p{N}]+"


def tokens_sql(text: str) -> str:
    return f"transform(regexp_extract_all({text}, {quote(TOKEN)}, 0), t -> lower(t))"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


def keywords_sql(text: str, max_terms: int | None = None, max_phrases: int | None = None) -> str:
    """``struct<terms, phrases>`` of what is left: fillers trimmed at both ends, stop words and consumed text break phrases."""
    filler = f"IN {_in(lx.TRAILING_FILLER)}"
    cut = ("slice(_t.k, coalesce(array_min(filter(transform(_t.k, (t, i) -> CASE WHEN t " + filler + " THEN NULL ELSE i + 1 END), i -> i IS NOT NULL)), 1), "
           "coalesce(array_max(filter(transform(_t.k, (t, i) -> CASE WHEN t " + filler + " THEN NULL ELSE i + 1 END), i -> i IS NOT NULL)), 0) "
           "- coalesce(array_min(filter(transform(_t.k, (t, i) -> CASE WHEN t " + filler + " THEN NULL ELSE i + 1 END), i -> i IS NOT NULL)), 1) + 1)")
    kept = f"transform(_c.c, t -> CASE WHEN t IN {_in(lx.INNER_STOP)} OR t = '\\u0001' THEN '\\u0001' ELSE t END)"
    runs = "filter(transform(split(array_join(_k.k, ' '), '\\u0001', -1), r -> trim(r)), r -> contains(r, ' '))"
    first = lambda items, limit: items if limit is None else f"slice({items}, 1, {limit})"
    terms = first("array_distinct(filter(_k.k, t -> t <> '\\u0001' AND (length(t) >= 2 OR exists(_r.r, p -> array_contains(split(p, ' '), t)))))", max_terms)
    return (f"transform(array(struct({tokens_sql(text)} AS k)), _t -> transform(array(struct(CASE WHEN size(_t.k) = 0 THEN _t.k ELSE {cut} END AS c)), _c -> "
            f"transform(array(struct({kept} AS k)), _k -> transform(array(struct({runs} AS r)), _r -> "
            f"named_struct('terms', {terms}, 'phrases', {first('array_distinct(_r.r)', max_phrases)}))[0])[0])[0])[0]")
