"""Fact extraction as Column builders: ``text -> array<struct>``.

Each builder is one SQL expression over the whole text, evaluated inside a projection. Context
guards read the neighbourhood that :func:`find_spans` captures, so nothing needs a Python worker.
``text`` is a column or a SQL expression.
"""
from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .base import bind, find_spans, first_of_each, quote, sql_of



def _guarded(condition: str, found: str, ddl: str) -> str:
    return f"CASE WHEN {condition} THEN {found} ELSE CAST(array() AS array<{ddl}>) END"


# --- links ---------------------------------------------------------------
URL_DDL = "struct<url:string,host:string>"
_HOST = r"^(?:[^.\-](?:[^.]{0,62})\.)(?:[^.]{1,63}\.)*\p{L}{2,63}$"


def urls(text: Column | str) -> Column:
    """Links with their lower-cased host, in order, each address once."""
    t = sql_of(text)
    # Closing parentheses without an opening one are punctuation around the link.
    surplus = "greatest(0, length(regexp_replace(_b.v, '[^)]', '')) - length(regexp_replace(_b.v, '[^(]', '')))"
    run = "length(_b.v) - length(rtrim(')', _b.v))"
    trimmed = bind(f"left(_b.v, length(_b.v) - least({surplus}, {run}))", v=f"regexp_replace(r, {quote('[.,;:!?' + chr(39) + chr(34) + '’”]+$')}, '')")
    raws = f"filter(transform(regexp_extract_all({t}, {quote(lx.URL)}, 0), r -> {trimmed}), r -> r <> '')"
    host_port = f"regexp_extract(_b.rest, {quote('^([^/?]*)')}, 1)"
    path = f"regexp_replace(regexp_replace(_b.rest, {quote('^[^/?]*')}, ''), '#.*$', '')"
    built = bind(f"named_struct('url', concat(_b.scheme, '://', lower({host_port}), {path}), 'host', lower(substring_index({host_port}, ':', 1)))",
                 scheme="CASE WHEN lower(r) LIKE 'http://%' THEN 'http' ELSE 'https' END",
                 rest=f"regexp_replace(r, {quote('^(?i:https?)://')}, '')")
    valid = f"filter(transform({raws}, r -> {built}), u -> length(u.host) <= 253 AND u.host RLIKE {quote(_HOST)})"
    return F.expr(_guarded(f"contains({t}, '.')", first_of_each(valid, "e.url"), URL_DDL))


# --- prices --------------------------------------------------------------
PRICE_DDL = "struct<raw:string,currency:string,amount:double>"
_PRICE_REJECT = rf"(?i)\b(?:{lx.PRICE_REJECT_WORDS})[\s:.\-#]*$"


def prices(text: Column | str) -> Column:
    """Priced amounts: raw text, ISO currency and value. Amounts are never converted."""
    t = sql_of(text)
    groups = []
    for marker, iso, symbol in lx.PRICE_MARKERS:
        m = re.escape(marker)
        if symbol:
            patterns = [rf"{m}\s?{lx.PRICE_NUMBER}", rf"{lx.PRICE_NUMBER}\s?{m}"]
        else:
            edge = r"(?<![A-Za-z])" if marker == "Rs" else r"\b"
            patterns = [rf"{edge}{m}\.?\s?{lx.PRICE_NUMBER}", rf"{lx.PRICE_NUMBER}\s?{edge}{m}\b"]
        both = ", ".join(
            f"transform(filter({find_spans(t, p, before=28)}, s -> NOT s.before RLIKE {quote(_PRICE_REJECT)}), s -> "
            f"named_struct('raw', trim(s.raw), 'currency', '{iso}', 'amount', CASE WHEN contains(s.raw, ',,') THEN NULL ELSE "
            f"try_cast(replace(regexp_extract(s.raw, {quote(lx.PRICE_NUMBER)}, 0), ',', '') AS double) END))" for p in patterns)
        groups.append(_guarded(f"contains({t}, {quote(marker)})", f"concat({both})", PRICE_DDL))
    found = f"filter(concat({', '.join(groups)}), p -> p.amount > 0 AND p.amount < 1e12)"
    some = "|".join(re.escape(m) for m, _, _ in lx.PRICE_MARKERS)
    return F.expr(_guarded(f"{t} RLIKE {quote(some)}", first_of_each(found, "concat(e.raw, '\t', e.currency)"), PRICE_DDL))


# --- phones --------------------------------------------------------------
PHONE_DDL = "struct<raw:string,normalized:string,country:string>"
_PHONE_REJECT = rf"(?i)\b(?:{lx.PHONE_REJECT_WORDS})\b[\s:.\-#]*$"
#: Canonical form of Indian digits ``_b.d``, null when they are no such number.
INDIAN = ("CASE WHEN length(_b.d) = 12 AND startswith(_b.d, '91') THEN concat('+', _b.d) "
          "WHEN length(_b.d) = 11 AND _b.d RLIKE '^0[6-9]' THEN concat('+91', right(_b.d, 10)) "
          "WHEN length(_b.d) = 10 AND _b.d RLIKE '^[6-9]' THEN concat('+91', _b.d) END")
#: One entry per country: (country, patterns, SQL that normalises the digits ``_b.d``).
PHONE_STRATEGIES = [("IN", lx.PHONE_PATTERNS, INDIAN)]


def phones(text: Column | str, guard: bool = True, strategies=None) -> Column:
    """Phone numbers in canonical form; ``guard`` rejects numbers that follow an identifier word."""
    t = sql_of(text)
    groups = []
    for country, patterns, normalise in strategies or PHONE_STRATEGIES:
        for p in patterns:
            spans = find_spans(t, p, before=24 if guard else 0)
            if guard:
                spans = f"filter({spans}, s -> NOT s.before RLIKE {quote(_PHONE_REJECT)})"
            canonical = bind(normalise, d="regexp_replace(s.raw, '[^0-9]', '')")
            found = f"transform({spans}, s -> named_struct('raw', trim(s.raw), 'normalized', {canonical}, 'country', '{country}'))"
            groups.append(_guarded(f"{t} RLIKE {quote(lx.PHONE_CORE)}", found, PHONE_DDL) if p in lx.PHONE_PATTERNS else found)
    found = first_of_each(f"filter(concat({', '.join(groups)}), p -> p.normalized IS NOT NULL)", "e.normalized")
    return F.expr(_guarded(f"{t} RLIKE '[0-9]{{5}}'", found, PHONE_DDL))


# --- one-time codes ------------------------------------------------------
_CODE_REJECT = rf"(?i)\b(?:{lx.CODE_REJECT_WORDS})\b[\s:.\-#]*$"


def codes(text: Column | str) -> Column:
    """One-time codes of 4, 5, 6 or 8 digits near a cue word.

    The reach of a cue is measured between cue and number.
    """
    t = sql_of(text)
    near_before = "(?i)(?:" + "|".join(rf"{cue}[\s\S]{{0,{reach}}}$" for cue, reach in lx.CODE_CUES) + ")"
    near_after = "(?i)(?:" + "|".join(cue for cue, _ in lx.CODE_CUES) + ")"
    keep = (f"length(s.raw) IN (4, 5, 6, 8) AND NOT right(s.before, 28) RLIKE {quote(_CODE_REJECT)} "
            f"AND NOT s.raw RLIKE {quote(r'^(?:(.)' + chr(92) + r'1+|(?:19|20)' + chr(92) + 'd{2})$')} "
            "AND NOT (length(s.raw) = 8 AND try_cast(concat_ws('-', substr(s.raw, 1, 4), substr(s.raw, 5, 2), substr(s.raw, 7, 2)) AS date) IS NOT NULL) "
            f"AND (s.before RLIKE {quote(near_before)} OR s.after RLIKE {quote(near_after)})")
    spans = find_spans(t, r"(?<![\d.,])\d{4,8}(?![\d.,%])", before=44, after=24)
    # A cue stands whole in the text; its word edges may be edges of the neighbourhood only, so they are left out here.
    cued = "(?i)" + "|".join(cue.replace(r"\b", "") for cue, _ in lx.CODE_CUES)
    return F.expr(_guarded(f"{t} RLIKE '[0-9]{{4}}' AND {t} RLIKE {quote(cued)}", f"array_distinct(transform(filter({spans}, s -> {keep}), s -> s.raw))", "string"))


# --- dates ---------------------------------------------------------------
DATE_DDL = "struct<raw:string,epoch_day:bigint,has_year:boolean>"


def month_sql(name: str) -> str:
    months = ", ".join(f"'{m[:3]}'" for m in lx.MONTH_NAMES)
    return f"int(array_position(array({months}), left(lower(trim({name})), 3)))"


def date_sql(year: str, month: str, day: str) -> str:
    """Date from parts, null when no such day exists."""
    return f"try_cast(concat_ws('-', lpad({year}, 4, '0'), lpad({month}, 2, '0'), lpad({day}, 2, '0')) AS date)"


def dates(text: Column | str, today: date) -> Column:
    """Dates in numeric and named forms; a year-less date counts only near ``today``."""
    t = sql_of(text)
    ymd = lx.DATE_YMD
    compact8 = lx.DATE_COMPACT
    dmy = lx.DATE_DMY
    day_name = lx.DATE_DAY_NAME
    name_day = lx.DATE_NAME_DAY
    short_num = lx.DATE_SHORT_NUMBER
    short_day = lx.DATE_SHORT_DAY
    short_name = lx.DATE_SHORT_NAME
    close = ", ".join(str(m) for m in range(1, 13) if min(abs(m - today.month), 12 - abs(m - today.month)) <= 2)

    def part(pattern: str, group: int) -> str:
        return f"regexp_extract(r, {quote(pattern)}, {group})"

    def number(pattern: str, group: int) -> str:
        return f"try_cast({part(pattern, group)} AS int)"

    def entry(year: str, month: str, day: str, has_year: str) -> str:
        ok = "_b.y BETWEEN 1990 AND 2100 AND _b.m BETWEEN 1 AND 12 AND _b.d BETWEEN 1 AND 31"
        return bind(f"named_struct('raw', trim(r), 'epoch_day', CASE WHEN {ok} THEN bigint(unix_date({date_sql('_b.y', '_b.m', '_b.d')})) END, 'has_year', {has_year})",
                    y=year, m=month, d=day)

    def window_year(pattern: str, group: int) -> str:
        return bind("CASE WHEN _b.n BETWEEN 1990 AND 2099 THEN _b.n WHEN _b.n BETWEEN 90 AND 99 THEN _b.n + 1900 WHEN _b.n BETWEEN 0 AND 49 THEN _b.n + 2000 END",
                    n=number(pattern, group))

    def day_first(a: str, b: str) -> tuple[str, str]:
        return f"CASE WHEN {a} > 12 THEN {b} ELSE {a} END", f"CASE WHEN {a} > 12 THEN {a} ELSE {b} END"

    def run(src: str, pattern: str, build: str, guard: str | None = None) -> str:
        found = f"filter(transform(regexp_extract_all({src}, {quote(pattern)}, 0), r -> {build}), d -> d.epoch_day IS NOT NULL)"
        return _guarded(f"{src} RLIKE {quote(guard)}", found, DATE_DDL) if guard else found

    def four(pattern: str, group: int) -> str:
        return f"length({part(pattern, group)}) = 4"

    m, d = day_first(number(dmy, 1), number(dmy, 3))
    certain = f"CASE WHEN {four(dmy, 4)} OR {number(dmy, 1)} > 12 OR {number(dmy, 3)} > 12 THEN {window_year(dmy, 4)} END"
    dated = [
        run(t, ymd, entry(number(ymd, 1), number(ymd, 3), number(ymd, 4), "true"), r"\d{4}\s*[/.\-]"),
        run(t, compact8, entry(number(compact8, 1), number(compact8, 2), number(compact8, 3), "true"), r"\d{8}"),
        run(t, dmy, entry(certain, m, d, four(dmy, 4)), r"\d\s*[/.\-]"),
        run(t, day_name, entry(window_year(day_name, 3), month_sql(part(day_name, 2)), number(day_name, 1), four(day_name, 3))),
        run(t, name_day, entry(window_year(name_day, 3), month_sql(part(name_day, 1)), number(name_day, 2), four(name_day, 3))),
    ]

    def near(month: str) -> str:
        return bind(f"CASE WHEN _b.q IN ({close}) THEN _b.q END", q=month)

    m, d = day_first(number(short_num, 1), number(short_num, 3))
    sure = f"CASE WHEN {number(short_num, 1)} > 12 OR {number(short_num, 3)} > 12 THEN {m} END"
    year = str(today.year)
    steps = [
        (short_num, entry(year, near(sure), d, "false")),
        (short_day, entry(year, near(month_sql(part(short_day, 2))), number(short_day, 1), "false")),
        (short_name, entry(year, near(month_sql(part(short_name, 1))), number(short_name, 2), "false")),
    ]

    def masked(src: str, found: str) -> str:
        return f"aggregate({found}, {src}, (t, d) -> replace(t, d.raw, '\\u0001'))"

    # Text already read as a date is masked before the year-less forms look at it.
    state = f"transform(array(struct(concat({', '.join(dated)}) AS found)), s0 -> struct(s0.found AS found, {masked(t, 's0.found')} AS rest))[0]"
    for n, (pattern, build) in enumerate(steps, 1):
        more = f"transform(array({state}), a{n} -> struct(a{n}.found AS found, a{n}.rest AS rest, {run(f'a{n}.rest', pattern, build)} AS more))"
        state = f"transform({more}, s{n} -> struct(concat(s{n}.found, s{n}.more) AS found, {masked(f's{n}.rest', f's{n}.more')} AS rest))[0]"
    # Every form holds a month's name, a digit before a separator or eight digits.
    some = rf"(?i)\d\s*[/.\-]|\d{{8}}|{'|'.join(sorted({m[:3] for m in lx.MONTH_NAMES}))}"
    return F.expr(_guarded(f"{t} RLIKE '[0-9]' AND {t} RLIKE {quote(some)}", first_of_each(f"{state}.found", "e.raw"), DATE_DDL))


# --- receipts ------------------------------------------------------------
RECEIPT_DDL = "struct<merchant:string,amount:double,currency:string,category:string,raw_text:string>"


def lines_sql(text: str) -> str:
    return f"filter(transform(split({text}, {quote(chr(13) + chr(10) + '|' + chr(10) + '|' + chr(13))}, -1), v -> trim(v)), v -> v <> '')"


def _words_sql(text: str, words) -> str:
    return f"{text} RLIKE {quote('|'.join(re.escape(w) for w in words))}"


def receipt(text: Column | str) -> Column:
    """Largest marked amount, merchant line and expense category; null without an amount."""
    t = sql_of(text)
    amounts = []
    for k, (marker, iso, _) in enumerate(lx.PRICE_MARKERS):
        m = re.escape(marker)
        both = ", ".join(
            f"transform(regexp_extract_all({t}, {quote(p)}, 1), v -> named_struct('amount', try_cast(replace(v, ',', '') AS double), 'pos', {-(2 * k + j)}, 'currency', '{iso}'))"
            for j, p in enumerate((rf"{m}\s*({lx.RECEIPT_NUMBER})", rf"({lx.RECEIPT_NUMBER})\s*{m}")))
        amounts.append(_guarded(f"contains({t}, {quote(marker)})", f"concat({both})", "struct<amount:double,pos:int,currency:string>"))
    best = f"array_max(filter(concat({', '.join(amounts)}), a -> a.amount * 10 >= 1))"
    arms = " ".join(f"WHEN contains({{0}}, '{w}') THEN '{c}'" for w, c in lx.EXPENSE_CATEGORIES)
    category = "CASE " + arms + " END"
    merchant = (f"coalesce(left(get(filter(_r.l, v -> {_words_sql('lower(v)', lx.MERCHANT_WORDS)}), 0), 80), "
                f"left(get(filter(_r.l, v -> length(v) >= 4 AND v RLIKE {quote(chr(92) + 'p{L}')}), 0), 80), get(_r.l, 0))")
    named = bind(f"coalesce({category.format('_b.m')}, {category.format('_b.f')})", m="lower(_m.m)", f=f"lower({t})")
    body = (f"transform(array(struct({merchant} AS m)), _m -> named_struct('merchant', _m.m, 'amount', _r.best.amount, 'currency', _r.best.currency, "
            f"'category', {named}, 'raw_text', left({t}, 500)))[0]")
    whole = f"transform(array(struct({lines_sql(t)} AS l, {best} AS best)), _r -> CASE WHEN size(_r.l) > 0 AND _r.best IS NOT NULL THEN {body} END)[0]"
    some = "|".join(re.escape(m) for m, _, _ in lx.PRICE_MARKERS)
    return F.expr(f"CASE WHEN {t} RLIKE {quote(some)} THEN {whole} END")


# --- identifiers, e-mails, addresses --------------------------------------
ORDER_DDL = "struct<kind:string,code:string>"


def order_codes(text: Column | str) -> Column:
    """Order and booking codes: 6-20 capitals or digits after a cue word, with at least one digit."""
    t, q = sql_of(text), quote(lx.ORDER_CODE)
    items = (f"transform(regexp_extract_all({t}, {q}, 0), r -> named_struct('kind', CASE WHEN contains(lower(r), 'book') OR contains(lower(r), 'pnr') "
             f"THEN 'BOOKING' ELSE 'ORDER' END, 'code', regexp_extract(r, {q}, 1)))")
    return F.expr(f"array_distinct(filter({items}, x -> x.code RLIKE '[0-9]'))")


def _first(items: str, limit: int | None) -> str:
    return items if limit is None else f"slice({items}, 1, {limit})"


def emails(text: Column | str, limit: int | None = None) -> Column:
    t = sql_of(text)
    found = f"transform(regexp_extract_all({t}, {quote(lx.EMAIL_LOOSE)}, 0), m -> regexp_replace(m, {quote(chr(92) + 's+')}, ''))"
    return F.expr(_guarded(f"contains({t}, '@')", _first(f"array_distinct({found})", limit), "string"))


def addresses(text: Column | str, limit: int | None = None) -> Column:
    t = sql_of(text)
    return F.expr(_first(f"array_distinct(transform(regexp_extract_all({t}, {quote(lx.STREET)}, 0), m -> trim(m)))", limit))


def all_facts(text: Column | str, today: date) -> Column:
    """Every extractor in one struct. A null text gives empty lists, never a failed row."""
    t = sql_of(text)
    safe = f"coalesce({t}, '')"
    missing = F.expr(f"CASE WHEN {t} IS NULL THEN array('text') ELSE CAST(array() AS array<string>) END")
    return F.struct(
        urls(safe).alias("urls"), prices(safe).alias("prices"), phones(safe).alias("phones"),
        codes(safe).alias("codes"), dates(safe, today).alias("dates"), order_codes(safe).alias("orders"),
        emails(safe).alias("emails"), addresses(safe).alias("addresses"), receipt(safe).alias("receipt"),
        missing.alias("failures"),
    )
