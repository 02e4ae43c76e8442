"""License scans: an Aho-Corasick automaton over each text's words finds notice phrases and identifier tags; licence
expressions behind tags are parsed by a shunting-yard parser and evaluated.

Words are runs without ASCII characters other than letters and digits, lower-cased A-Z. Joined by single spaces they
form the string the automaton reads, so a phrase matches whole words only and a position is a count of spaces.

An expression combines identifiers by WITH, AND and OR (binding in this order) and parentheses. Each identifier has an
openness from 0 to 1; AND takes the least, OR the greatest, WITH adds the exception's relief up to 1. Malformed
expressions give no labels. The score of a text is the least openness of all it states, 0.5 if it states nothing.

Null texts are empty. Texts are scanned whole, repeated rows each.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, per_row

#: Phrases whose places are counted, with their labels. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases. Fixed values.
NOTICES = {
    "mit license": "mit", "apache license": "apache", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "the unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "all rights reserved": "all-rights-reserved",
}
#: Tags behind which an expression stands, as words and as they are written. Fixed values.
TAGS = ("spdx license identifier", "license expression")
TAG = re.compile(r"(?:spdx-license-identifier|license-expression)\x20*:\x20*([^\r\n*]*)", re.IGNORECASE | re.ASCII)
#: Openness of licence families by the start of their identifiers; the longest start counts, 0.5 for none. Fixed values.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "0bsd": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nd": 0.3,
    "cc-by-nc": 0.2, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "all-rights-reserved": 0.0,
}
RELIEF = 0.2
_WORD_MAP = bytes(b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+_-]+)")


def openness(identifier: str) -> float:
    starts = [s for s in OPENNESS if identifier == s or identifier.startswith((s + "-", s + "+"))]
    return OPENNESS[max(starts, key=len)] if starts else 0.5


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens in postfix order (operators in lower case), or None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand, at = True, 0  # operand: an identifier or an opening parenthesis has to come next
    text = expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break  # what follows is no part of the expression
        token, at = m[1].lower(), m.end()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token in _BINDS:
            if operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                break  # prose behind the expression
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Identifiers of the expression and its openness, or None if it is malformed."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], float]] = []
    for token in order:
        if token not in _BINDS:
            stack.append(({token}, openness(token)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], min(1.0, left[1] + RELIEF)))
        else:
            stack.append((left[0] | right[0], (min if token == "and" else max)(left[1], right[1])))
    return stack[0]


def automaton():
    """The Aho-Corasick automaton of all phrases and tags; each phrase stands between spaces."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, **dict.fromkeys(TAGS)}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(raw: bytes, find) -> tuple:
    """The numbers and labels of one text; ``find`` is the automaton's ``iter``."""
    words = raw.translate(_WORD_MAP).split()
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    places, base, labels, states, tagged = [], set(), set(), [], False
    at = word = 0
    for end, phrase in find(joined):
        if phrase in TAGS:
            tagged = True
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        states.append(openness(label))
        if phrase in BASE:
            start = end - len(phrase) - 1  # the space before the phrase
            if start < at:
                at = word = 0
            word += joined.count(" ", at, start)
            at = start
            places.append(word)
            base.add(label)
    if tagged:
        for m in TAG.finditer(raw.decode("utf-8", "replace")):
            found = evaluate(m[1])
            if found:
                labels |= found[0]
                states.append(found[1])
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            min(states, default=0.5))


ADDED = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                   ("labels", pa.string()), ("score", pa.float64())])
DDL = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scanned(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def derive(column: pa.Array) -> list[list]:
        find = automaton().iter
        rows = [scan(t, find) for t in byte_texts(column)]
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in ADDED.names]

    return per_row(df, text, ADDED, DDL, derive, keep)
