"""Secret scans: fixed patterns and sliding-window entropy over candidate strings.

A candidate is a run of ``[A-Za-z0-9+/_=-]``. Its class is the narrowest alphabet that holds it: hex, base32, lower case with digits, upper
case with digits, letters of both cases, base62 or base64. A window slides over it; the counts of its characters change by one in
and one out, and with them the sum of c log c, from which the entropy follows at once, and the number of switches between
lower case, upper case, digits and signs. Both must reach the least value of the class, which follows from its alphabet and the
window: the mean of random strings less ``TAIL`` standard deviations. The stretch that such windows cover is reported, unless the
allow-list (UUIDs, ordered alphabets, paths, words with one number, camel case) suppresses the candidate. Where the candidate as
a whole shows nothing, its pieces between signs are tried alone, so a key behind ``name=`` or ``prefix_`` is seen.

Strings under ``WINDOW`` characters, of one case without digits, or of digits alone are no candidates.
Spans count code points, end exclusive. Null texts are empty. Texts are scanned whole.
"""
from __future__ import annotations

import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, per_row, sha256_hex

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters in a window, and the least length of a candidate.
WINDOW = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
PIECE = re.compile(rf"[A-Za-z0-9]{{{WINDOW},}}")
#: How many standard deviations below the mean of random strings a window may lie.
TAIL = 2.6
#: Lower-case letters, upper-case letters, digits and signs of each alphabet, and the pattern of its strings; the first that holds a candidate is its class.
CLASSES = {
    "hex": ((6, 0, 10, 0), re.compile(r"(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)")),
    "base32": ((0, 26, 6, 0), re.compile(r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*")),
    "lower": ((26, 0, 10, 0), re.compile(r"(?=.*[0-9])(?=.*[a-z])[a-z0-9]+")),
    "upper": ((0, 26, 10, 0), re.compile(r"(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+")),
    "letters": ((26, 26, 0, 0), re.compile(r"(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+")),
    "base62": ((26, 26, 10, 0), re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+")),
    "base64": ((26, 26, 10, 2), re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).+")),
}
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[A-Za-z]+[-_=/+]*[0-9]+|[0-9]+[-_=/+]*[A-Za-z]+|(?:[A-Za-z]*[0-9]{0,4}[-_/+=])+[A-Za-z]*[0-9]{0,4}")
ORDERED = ("0123456789abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_CANDIDATE_MAP = bytes(120 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
_KIND_MAP = "".join("0" if 97 <= b <= 122 else "1" if 65 <= b <= 90 else "2" if 48 <= b <= 57 else "3" for b in range(128))


@cache
def terms(window: int) -> list[float]:
    """c log c for every count that a window can hold, and one more while it moves."""
    return [0.0] + [c * math.log2(c) for c in range(1, window + 2)]


@cache
def limits(sizes: tuple[int, ...], window: int = WINDOW, tail: float = TAIL) -> tuple[float, int]:
    """Least entropy in bits and least number of switches of a window over an alphabet with ``sizes`` characters of each kind.

    Both are the mean less ``tail`` standard deviations over random windows. The counts of two characters are
    multinomial, so mean and variance of the sum of c log c are sums over one and two counts. Switches between neighbours
    depend on the switch before and after only.
    """
    n, term = sum(sizes), terms(window)

    def chance(a: int, b: int = 0) -> float:
        """Chance that one given character is there a times, and (with b) another b times."""
        ways = math.comb(window, a) * math.comb(window - a, b)
        return ways * (1 / n) ** (a + b)

    one = [chance(a) * (1 - 1 / n) ** (window - a) for a in range(window + 1)]
    mean = sum(p * t for p, t in zip(one, term))
    square = sum(p * t * t for p, t in zip(one, term))
    both = sum(chance(a, b) * (1 - 2 / n) ** (window - a - b) * term[a] * term[b] for a in range(2, window + 1) for b in range(2, window - a + 1))
    variance = n * (square - mean * mean) + n * (n - 1) * (both - mean * mean)
    entropy = math.log2(window) - (n * mean + tail * math.sqrt(max(variance, 0.0))) / window
    shares = [k / n for k in sizes]
    switch = 1 - sum(p * p for p in shares)
    twice = sum(p * (1 - p) ** 2 for p in shares)  # the middle one of three differs from both
    spread = (window - 1) * switch * (1 - switch) + 2 * (window - 2) * (twice - switch * switch)
    return entropy, max(1, math.floor((window - 1) * switch - tail * math.sqrt(max(spread, 0.0))))


def hot_stretch(s: str, limit: float, window: int = 20, switches: int = 0) -> tuple[int, int] | None:
    """From the first to the end of the last window of ``s`` whose entropy reaches ``limit`` with at least ``switches`` switches of kind."""
    term = terms(window)
    counts: dict[str, int] = {}
    total, first, last, turned = 0.0, -1, -1, 0  # total: the sum of c log c
    kinds = [_KIND_MAP[ord(ch)] for ch in s]
    for i, ch in enumerate(s):
        turned += i > 0 and kinds[i] != kinds[i - 1]
        if i >= window:
            turned -= kinds[i - window] != kinds[i - window + 1]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and turned >= switches and math.log2(window) - total / window >= limit - 1e-9:
            first = i - window + 1 if first < 0 else first
            last = i + 1
    return None if first < 0 else (first, last)


def allowed(s: str) -> bool:
    low = s.lower()
    camel = s.isalpha() and 4 * sum(map(str.islower, s)) >= 3 * len(s)
    return camel or bool(ALLOWED.fullmatch(s)) or any(low in o + o for o in ORDERED)


def class_of(s: str) -> str | None:
    """The narrowest class whose alphabet holds the candidate; None if it is of no class."""
    return next((name for name, (_, pattern) in CLASSES.items() if pattern.fullmatch(s)), None)


def random_stretch(s: str) -> tuple[int, int] | None:
    """Where a candidate looks random by the limits of its class."""
    name = class_of(s)
    if name is None or allowed(s):
        return None
    entropy, switches = limits(CLASSES[name][0])
    return hot_stretch(s, entropy, WINDOW, switches)


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates that look random; a candidate that doesn't is tried piece by piece, unless it is allowed as it is."""
    out = []
    for m in CANDIDATE.finditer(text):
        found = random_stretch(m[0])
        if found:
            out.append((m.start() + found[0], m.start() + found[1]))
        elif not m[0].isalnum() and not allowed(m[0]):
            for piece in PIECE.finditer(m[0]):
                found = random_stretch(piece[0])
                if found:
                    at = m.start() + piece.start()
                    out.append((at + found[0], at + found[1]))
    return out


def spans_of(raw: bytes) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` by start, then kind. Cheap byte searches skip texts that can hold none."""
    low = raw.lower()
    wanted = any(k in low for k in _KEYWORDS)
    access = b"AKIA" in raw
    lengthy = b"x" * WINDOW in raw.translate(_CANDIDATE_MAP)
    hexes = b"x" * 24 in raw.translate(_HEX_MAP)
    if not (wanted or access or lengthy or hexes):
        return []
    text = raw.decode("utf-8", "replace")
    out = []
    if wanted:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if lengthy:
        out += [(a, b, 3) for a, b in entropy_spans(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


ADDED = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
DDL = "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string"


def scanned(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def row(raw: bytes) -> tuple:
        spans = spans_of(raw)
        kinds = [k for _, _, k in spans]
        return (*map(kinds.count, KINDS), sha256_hex(as_text([s for s in spans if s[2] != "entropy"]).encode()), as_text(spans))

    def derive(column: pa.Array) -> list[list]:
        rows = [row(t) for t in byte_texts(column)]
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in ADDED.names]

    return per_row(df, text, ADDED, DDL, derive, keep)


def redact(raw: bytes, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by ``mark``, overlapping ones as one; None if it holds none."""
    merged: list[list[int]] = []
    for a, b, _ in spans_of(raw):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return None
    text = raw.decode("utf-8", "replace")
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with their secrets replaced by ``mark``; ``n_chars``, where there is one, follows the text."""
    def derive(column: pa.Array) -> list[list]:
        return [[redact(t, mark) for t in byte_texts(column)]]

    own = docs.columns
    at = own.index(text)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], F.col(f"`{text}`").alias("own_text"))
    done = per_row(plain, "own_text", pa.schema([("clean", pa.string())]), "clean string", derive, [f"own_{i}" for i in range(len(own))])
    out = []
    for i, c in enumerate(own):
        value = F.col(f"own_{i}")
        if i == at:
            value = F.coalesce("clean", f"own_{i}")
        elif c == "n_chars":
            value = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return done.select(*out)
