"""Query understanding over a table of query texts."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as lx
from ..functions import querylog as q
from ..functions.base import bind, contains_any, quote
from ..functions.scoring import money_sql


class _Chain:
    """Projections that pass one struct column ``_a`` from step to step.

    Every step names the column before it exactly once, so a filter pushed down through the steps adds one copy of the
    work, not one copy per reference and step.
    """

    def __init__(self, **fields: str):
        self.fields = list(fields)
        self.steps = ["struct(" + ", ".join(f"{v} AS {k}" for k, v in fields.items()) + ")"]

    def step(self, found, raw: str | None, mask_pattern: str | None = None, **updates) -> None:
        """Evaluate ``found(rest)`` as x, mask what it consumed and set fields from ``update(state)``."""
        a, b = "a1", "b1"
        kept = ", ".join(f"{a}.{f} AS {f}" for f in self.fields)
        out = {f: f"{b}.{f}" for f in self.fields}
        if raw is not None:
            out["rest"] = q.mask(f"{b}.rest", f"transform({b}.x, x -> {raw})")
        if mask_pattern is not None:
            out["rest"] = f"regexp_replace({b}.rest, {quote(mask_pattern)}, ' \\u0001 ')"
        out.update({name: make(b) for name, make in updates.items()})
        shown = ", ".join(f"{v} AS {k}" for k, v in out.items())
        self.steps.append(f"transform(transform(array(_a), {a} -> struct({kept}, {found(a + '.rest')} AS x)), {b} -> struct({shown}))[0]")
        self.fields = list(out)


def annotation_steps(today: date, text: str = "text") -> list[str]:
    """The annotation of one query text: SQL for the column ``_a``, step by step."""
    pair = "struct<raw:string,value:string>"
    chain = _Chain(rest=f"trim({text})", dates=f"CAST(array() AS array<{q.DATE_DDL}>)", types="CAST(array() AS array<string>)")
    for pattern, build in q.date_steps(today):
        chain.step(lambda rest, p=pattern, b=build: q.find_sql(rest, p, b, q.DATE_DDL), "x.raw", dates=lambda s: f"concat({s}.dates, {s}.x)")
    host = f"named_struct('raw', r, 'value', {q.host_sql('r')})"
    chain.step(lambda rest: f"filter({q.find_sql(rest, lx.QUERY_HOST, host, pair)}, x -> x.value IS NOT NULL)", "x.raw", hosts=lambda s: f"array_distinct(transform({s}.x, x -> x.value))")
    code = f"named_struct('raw', r, 'value', regexp_extract(r, {quote(lx.QUERY_CODE)}, 1))"
    chain.step(lambda rest: q.find_sql(rest, lx.QUERY_CODE, code, pair), "x.raw", codes=lambda s: f"transform({s}.x, x -> x.value)")
    chain.step(q.phones_sql, "x.raw", phones=lambda s: f"array_distinct(transform({s}.x, x -> x.value))")
    chain.step(q.between_sql, "x.raw", between=lambda s: f"{s}.x")
    chain.step(q.amounts_sql, "x.raw", prices=lambda s: f"concat({s}.between, {s}.x)")
    for name, pattern in lx.QUERY_TYPE_PATTERNS:
        chain.step(lambda rest, p=pattern: f"{rest} RLIKE {quote(p)}", None, pattern, types=lambda s, n=name: f"CASE WHEN {s}.x THEN array_append({s}.types, '{n}') ELSE {s}.types END")
    chain.step(lambda rest: f"{rest} RLIKE {quote(lx.QUERY_LONG)}", None, lx.QUERY_LONG, long_only=lambda s: f"{s}.x")
    names = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in lx.COLOR_WORDS.items()) + ")"
    chain.step(lambda rest: f"regexp_extract_all({rest}, {quote(q.COLOR)}, 0)", None, q.COLOR, colors=lambda s: f"array_distinct(transform({s}.x, c -> {names}[lower(c)]))")
    # The first date in the text sets the window.
    chain.step(q.keywords_sql, None, terms=lambda s: f"{s}.x.terms", phrases=lambda s: f"{s}.x.phrases",
               date=lambda s: f"array_min(transform({s}.dates, d -> struct(instr({text}, d.raw) AS at, d AS d))).d")
    kept = "z.terms AS terms, z.phrases AS phrases, z.prices AS prices, z.hosts AS hosts, z.phones AS phones, z.codes AS codes, z.types AS types, z.colors AS colors, z.long_only AS long_only"
    flat = f"transform(array(_a), z -> struct({kept}, z.date.start_day AS start_day, z.date.end_day AS end_day, z.date.label AS date_label))"
    names = "terms phrases prices hosts phones codes types colors long_only start_day end_day date_label".split()
    last = f"transform({flat}, y -> struct({', '.join(f'y.{n} AS {n}' for n in names)}, {intent_sql(text, 'y.')} AS intent, {describe_sql('y.')} AS description))[0]"
    return [*chain.steps, last]


def annotate(log: DataFrame, today: date, text: str = "text") -> DataFrame:
    """Structured columns of each query text, ready for the search plan.

    Order: dates, hosts, codes, phones, prices, content types, looks, keywords. Narrow projections only, no shuffle.
    """
    df = log
    for sql in annotation_steps(today, text):
        df = df.select(*log.columns, F.expr(sql).alias("_a"))
    return df.select(*log.columns, "_a.*")


def intent_sql(text: str, p: str = "") -> str:
    nothing = (f"size({p}prices) + size({p}hosts) + size({p}phones) + size({p}codes) + size({p}types) + size({p}colors) = 0 AND {p}start_day IS NULL AND NOT {p}long_only")
    verbs = ", ".join(f"'{v}'" for v in lx.REQUEST_VERBS)
    return (f"CASE WHEN size({p}terms) + size({p}phrases) = 0 THEN CASE WHEN {nothing} THEN 'BROWSE' ELSE 'FILTER' END "
            f"WHEN exists(slice({q.tokens_sql(f'trim({text})')}, 1, 4), t -> t IN ({verbs})) THEN 'FIND' ELSE 'SEARCH' END")


def price_texts_sql(prices: str) -> str:
    """How the price filters of a query read."""
    low, high = money_sql("f.currency", "f.min"), money_sql("f.currency", "f.max")
    return (f"transform({prices}, f -> CASE f.kind WHEN 'EXACT' THEN {low} WHEN 'AT_MOST' THEN concat('up to ', {high}) WHEN 'AT_LEAST' THEN concat('from ', {low}) ELSE concat({low}, ' – ', {high}) END)")


def describe_sql(p: str = "") -> str:
    """What was understood, joined with middle dots."""
    price = price_texts_sql(f"{p}prices")
    rest = f"filter({p}terms, t -> NOT exists({p}phrases, w -> array_contains(split(w, ' '), t)))"
    flags = (f"array_compact(array(CASE WHEN {p}long_only THEN 'long screenshots' END, CASE WHEN size({p}codes) > 0 THEN 'one-time code' END, CASE WHEN array_contains({p}types, 'DUPLICATES') THEN 'duplicates' END))")
    joined = f"array_join(array_distinct(concat({p}phrases, {rest}, {price}, array_compact(array({p}date_label)), {p}hosts, {p}phones, {p}colors, {flags})), ' · ')"
    return bind("CASE WHEN _b.j = '' THEN 'everything' ELSE _b.j END", j=joined)


def to_search(annotated: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """Annotated queries in the shape of the search plan."""
    return annotated.selectExpr(
        f"{key} AS query_id", f"{text} AS raw", "terms", "phrases", "transform(prices, p -> named_struct('kind', p.kind, 'currency', p.currency, 'min', p.min, 'max', p.max)) AS prices",
        "start_day * 86400 AS start_s", "(end_day + 1) * 86400 AS end_s", "date_label", "hosts", "phones", "codes", "types", "colors", "long_only", "'RELEVANCE' AS sort")


# --- questions -----------------------------------------------------------
def question_intent(text: Column) -> Column:
    """Intent of a question by ordered word lists."""
    low = F.lower(F.trim(text))
    any_of = lambda words: contains_any(low, words)
    return (F.when(any_of(lx.TIMELINE_WORDS) & any_of(lx.CHANGE_WORDS), "CHANGE_DETECTION").when(any_of(lx.RECALL_WORDS), "RECALL").when(any_of(lx.COUNT_WORDS), "COUNT")
            .when(any_of(lx.ENTITY_WORDS), "ENTITY_LOOKUP").when(any_of(lx.TIMELINE_WORDS), "TIMELINE").when(any_of(lx.PRICE_WORDS), "PRICE_HISTORY")
            .when(any_of(lx.COMPARISON_WORDS), "COMPARE").when(any_of(lx.CHANGE_WORDS), "CHANGE_DETECTION").when(any_of(lx.SUMMARIZE_WORDS), "SUMMARIZE")
            .when(any_of(lx.LIST_WORDS), "LIST").when(any_of(lx.RELATIONSHIP_WORDS), "RELATIONSHIP").when(any_of(lx.EXPLAIN_WORDS), "EXPLAIN")
            .when(low.rlike("^(?:find|show me|which)"), "FIND").otherwise("SEARCH"))


def question_slots(log: DataFrame, today: date, text: str = "text") -> DataFrame:
    """Entity, price bound, period, colour, reference to the previous turn and keywords of a question."""
    low = f"lower(trim({text}))"
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(lx.QUESTION_STOP))
    trim = lambda w: f"regexp_replace({w}, '^[,.?!]+|[,.?!]+$', '')"
    tokens = f"split(trim({text}), {quote(chr(92) + 's+')}, -1)"
    # A capitalised word opens a run that the next stop word ends.
    start = f"array_min(filter(transform(_t.k, (w, i) -> CASE WHEN w RLIKE {quote('^' + chr(92) + 'p{Lu}')} AND NOT lower({trim('w')}) IN ({stop}) THEN i END), i -> i IS NOT NULL))"
    tail = "slice(_s.k, _s.a + 1, size(_s.k))"
    end = f"coalesce(array_min(filter(transform({tail}, (w, i) -> CASE WHEN {trim('w')} = '' OR (i > 0 AND lower({trim('w')}) IN ({stop})) THEN i END), i -> i IS NOT NULL)), size(_s.k))"
    run = f"array_join(transform(slice({tail}, 1, {end}), w -> {trim('w')}), ' ')"
    phrase = (f"transform(array(struct({tokens} AS k)), _t -> transform(array(struct(_t.k AS k, {start} AS a)), _s -> CASE WHEN _s.a IS NOT NULL THEN "
              f"transform(array(struct({run} AS v)), _v -> CASE WHEN length(_v.v) >= 2 AND _v.v RLIKE {quote(chr(92) + 'p{L}')} THEN _v.v END)[0] END)[0])[0]")
    domain = f"nullif(regexp_extract({low}, {quote(lx.QUESTION_DOMAIN)}, 0), '')"
    bounds = {"max": lx.QUESTION_AT_MOST, "min": lx.QUESTION_AT_LEAST}
    value = lambda p: (f"CASE WHEN {low} RLIKE {quote(p)} THEN try_cast(replace(regexp_extract({low}, {quote(p)}, 1), ',', '') AS double) * CASE WHEN regexp_extract({low}, {quote(p)}, 2) = 'k' THEN 1000 ELSE 1 END END")
    t = f"DATE'{today.isoformat()}'"
    since = lambda days, months: f"add_months({t}, -{months})" if months else f"date_sub({t}, {days})"
    period = "CASE " + " ".join(f"WHEN contains({low}, '{p}') THEN array({since(a, m)}, date_sub({t}, {b}))" for p, a, b, m in lx.QUESTION_PERIODS) + " END"
    color = "CASE " + " ".join(f"WHEN contains({low}, '{c}') THEN '{c}'" for c in lx.QUESTION_COLORS) + " END"
    refers = f"{low} RLIKE {quote('|'.join(lx.PREVIOUS_WORDS))}"
    words = f"array_distinct(filter(split(regexp_replace({low}, '[^a-z0-9₹$€£\\\\s.-]', ' '), {quote(chr(92) + 's+')}, -1), w -> length(w) > 2 AND NOT w IN ({stop})))"
    return log.withColumns({
        "entity": F.expr(f"coalesce({domain}, {phrase})"), "price_max": F.expr(value(bounds["max"])),
        "price_min": F.expr(f"CASE WHEN NOT {low} RLIKE {quote(bounds['max'])} THEN {value(bounds['min'])} END"),
        "period": F.expr(period), "color": F.expr(color), "refers_to_previous": F.expr(refers), "keywords": F.expr(words)})
