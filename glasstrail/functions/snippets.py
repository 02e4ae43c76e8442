"""Result snippets and their highlights, as SQL text over a document and its needles."""
from __future__ import annotations

from .base import quote

LENGTH, MAX_HIGHLIGHTS = 180, 6
_SPACE = quote(r"\s+")


def snippet_sql(text: str, needles: str, length: int = LENGTH) -> str:
    """``struct<text, highlights>``; ``needles`` are lower-case. Highlights are 0-based ``start-end`` ranges.

    The window starts a third of its length before the earliest needle and is moved to word edges.
    """
    collapsed = f"trim(regexp_replace({text}, {_SPACE}, ' '))"
    anchor = "array_min(filter(transform(_a.n, w -> instr(lower(_a.c), w)), p -> p > 0))"
    head = f"CASE WHEN length(_p.c) > {length} THEN concat(left(_p.c, {length}), '…') ELSE _p.c END"
    # 0-based window bounds, then moved forward or back to a space.
    start = f"greatest(_p.a - 1 - {length // 3}, 0)"
    first = f"CASE WHEN {start} = 0 THEN 0 ELSE {start} + coalesce(nullif(instr(substr(_p.c, {start} + 1), ' '), 0), length(_p.c) - {start} + 1) - 1 END"
    end = f"least({start} + {length}, length(_p.c))"
    last = f"CASE WHEN {end} >= length(_p.c) THEN length(_p.c) ELSE {end} - coalesce(nullif(instr(reverse(left(_p.c, {end})), ' '), 0), {end} + 1) + 1 END"
    body = "CASE WHEN _w.z > _w.s THEN substr(_p.c, _w.s + 1, _w.z - _w.s) ELSE '' END"
    found = ("flatten(transform(_p.n, w -> CASE WHEN instr(lower(_t.body), w) = 0 THEN CAST(array() AS array<struct<f:int,t:int>>) ELSE "
             "transform(aggregate(slice(split(lower(_t.body), concat('\\\\Q', w, '\\\\E'), -1), 1, size(split(lower(_t.body), concat('\\\\Q', w, '\\\\E'), -1)) - 1), "
             "CAST(array() AS array<int>), (acc, piece) -> array_append(acc, CASE WHEN size(acc) = 0 THEN length(piece) ELSE acc[size(acc) - 1] + length(w) + length(piece) END)), "
             "f -> named_struct('f', f, 't', f + length(w) - 1)) END))")
    marks = f"transform(slice({found}, 1, {MAX_HIGHLIGHTS}), h -> concat(h.f + _t.o, '-', h.t + _t.o))"
    shown = (f"transform(array(struct(concat(CASE WHEN _w.s > 0 THEN '…' ELSE '' END, {body}, CASE WHEN _w.z < length(_p.c) THEN '…' ELSE '' END) AS text, "
             f"{body} AS body, CASE WHEN _w.s > 0 THEN 1 ELSE 0 END AS o)), _t -> named_struct('text', _t.text, 'highlights', {marks}))[0]")
    windowed = f"transform(array(struct({first} AS s, {last} AS z)), _w -> {shown})[0]"
    chosen = (f"CASE WHEN _p.c = '' THEN NULL WHEN _p.a IS NULL THEN named_struct('text', {head}, 'highlights', CAST(array() AS array<string>)) ELSE {windowed} END")
    return (f"transform(array(struct({collapsed} AS c, filter({needles}, w -> w <> '') AS n)), _a -> "
            f"transform(array(struct(_a.c AS c, _a.n AS n, {anchor} AS a)), _p -> {chosen})[0])[0]")


