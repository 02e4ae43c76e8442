"""Byte-level BPE: encoding and decoding by DuckDB recursive queries inside each Spark partition.

Spark deals the documents out; a task splits its texts into words and hands only words it has not met to DuckDB.
There every word is a set of token-position rows. A recursive query joins neighbouring positions with the merge
table, contracts each word's leftmost pair of least rank, and repeats until no word has a pair left. An ordered
aggregation joins the token bytes of a word again (decoding).

Null texts are empty: no token, the hash of nothing. Any length works. A word of more than ``LONG_BYTES`` bytes contracts, in one
round, all places of its pair of least rank that don't overlap, so its rounds grow with its distinct pairs rather than
with its bytes. That equals one place after the other wherever no pair with the new token ranks below it; for other
ranks only the leftmost place is contracted. A task keeps a bounded memory of words (``memory`` entries), which never changes a result.
"""
from __future__ import annotations

import base64
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import char_texts, per_row

ENCODE = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE state(k, tok, done) AS (
  SELECT k, tok, false FROM start
  UNION ALL
  (WITH best AS (
     SELECT a.k >> 32 AS w, min((m.r::BIGINT << 32) + (a.k & 4294967295)) AS g
     FROM state a JOIN state b ON b.k = a.k + 1 JOIN merges m ON m.ab = a.tok::BIGINT * 4294967296 + b.tok
     WHERE NOT a.done GROUP BY 1)
   SELECT CASE WHEN k & 4294967295 > g & 4294967295 THEN k - 1 ELSE k END,
          CASE WHEN k & 4294967295 = g & 4294967295 THEN (g >> 32)::INTEGER ELSE tok END, g IS NULL
   FROM state LEFT JOIN best ON state.k >> 32 = w
   WHERE NOT done AND (g IS NULL OR k & 4294967295 <> (g & 4294967295) + 1)))
SELECT k, tok FROM state WHERE done
"""
#: A word of more bytes than this contracts many places a round.
LONG_BYTES = 1_000
#: Merges, and whether a token, once made, can be part of a pair of lower rank; then one place at a time is contracted.
LONG_MERGES = """
CREATE TABLE long_merges AS
SELECT m.ab, m.r, coalesce(low < m.r, false) AS alone
FROM merges m LEFT JOIN (SELECT tok, min(r) AS low FROM (SELECT ab >> 32 AS tok, r FROM merges UNION ALL SELECT ab & 4294967295, r FROM merges) GROUP BY tok) ON tok = m.r
"""
#: ``k`` is where a token starts and ``e`` where the next one does. Places that overlap form chains; every second one of a chain is contracted, from the left.
ENCODE_LONG = """
INSERT INTO coded
WITH RECURSIVE state(k, e, tok, done) AS (
  SELECT k, k + 1, tok, false FROM long_start
  UNION ALL
  (WITH pair AS (
     SELECT a.k, a.e, b.e AS e2, a.k >> 32 AS w, m.r, m.alone
     FROM state a JOIN state b ON b.k = a.e JOIN long_merges m ON m.ab = a.tok::BIGINT * 4294967296 + b.tok WHERE NOT a.done),
   least AS (SELECT w, min(r) AS r FROM pair GROUP BY w),
   place AS (SELECT pair.*, coalesce(lag(e) OVER (PARTITION BY w ORDER BY k) = k, false) AS linked FROM pair JOIN least USING (w, r)),
   chain AS (SELECT *, sum((NOT linked)::INTEGER) OVER (PARTITION BY w ORDER BY k) AS c, row_number() OVER (PARTITION BY w ORDER BY k) AS i FROM place),
   chosen AS (SELECT k, e, e2, r FROM chain WHERE i = 1 OR NOT alone QUALIFY row_number() OVER (PARTITION BY w, c ORDER BY k) % 2 = 1)
   SELECT s.k, coalesce(c.e2, s.e), coalesce(c.r, s.tok), l.w IS NULL
   FROM state s LEFT JOIN chosen c ON c.k = s.k LEFT JOIN least l ON l.w = s.k >> 32 LEFT JOIN chosen gone ON gone.e = s.k
   WHERE NOT s.done AND gone.e IS NULL))
SELECT k, tok FROM state WHERE done
"""
DECODE = "SELECT unhex(string_agg(h, '' ORDER BY k)) FROM coded JOIN vocab USING (tok)"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks. A small fixed file beside the library."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One task's encoder: a DuckDB connection with merge table and vocabulary, and a bounded memory of words."""

    def __init__(self, path: str, pattern: str, memory: int = 300_000):
        import duckdb
        import numpy as np
        import regex

        self.split, self.memory = regex.compile(pattern).findall, memory
        self.ranks = read_ranks(path)
        pairs = [(self.ranks[t[:i]] * 4294967296 + self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.con = duckdb.connect()
        self.con.execute("SET threads = 1")
        self.con.register("merge_rows", pa.table({"ab": pa.array([p[0] for p in pairs], pa.int64()), "r": pa.array([p[1] for p in pairs], pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.con.execute(LONG_MERGES)
        self.con.register("token_rows", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "h": [t.hex() for t in self.ranks], "n": [len(t) for t in self.ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM token_rows")
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.word_ids: dict[str, bytes] = {}
        self.word_decoded: dict[str, bytes] = {}
        self.piece_ids: dict[str, bytes] = {}
        self.piece_decoded: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded bytes of each word."""
        import numpy as np

        raw = [w.encode() for w in words]
        size = np.array([len(w) for w in raw], dtype=np.int64)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(raw), dtype=np.int64), size)
        position = np.arange(size.sum(), dtype=np.int64) - np.repeat(first, size)
        tokens = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        key = (word << 32) + position
        whole = np.array([self.ranks.get(w, -1) for w in raw], dtype=np.int32)  # a word that is a token itself is that token
        single = whole[word] >= 0
        tokens = np.where(single, whole[word], tokens)
        keep = ~single | (position == 0)
        long = keep & ~single & (size[word] > LONG_BYTES)
        self.con.register("start", pa.table({"k": key[keep & ~long], "tok": tokens[keep & ~long]}))
        self.con.execute(ENCODE)
        self.con.unregister("start")
        if long.any():
            self.con.register("long_start", pa.table({"k": key[long], "tok": tokens[long]}))
            self.con.execute(ENCODE_LONG)
            self.con.unregister("long_start")
        rows = self.con.execute("SELECT k >> 32 AS w, tok, n FROM coded JOIN vocab USING (tok) ORDER BY k").fetchnumpy()
        (text,), = self.con.execute(DECODE).fetchall()
        flat, ids_end = rows["tok"].astype("<u4").tobytes(), np.cumsum(np.bincount(rows["w"], minlength=len(raw))) * 4
        text_end = np.cumsum(np.bincount(rows["w"], weights=rows["n"], minlength=len(raw)).astype(np.int64))

        def cut(data: bytes, ends: list[int]) -> list[bytes]:
            return [data[a:b] for a, b in zip([0, *ends], ends)]

        return cut(flat, ids_end.tolist()), cut(text, text_end.tolist())

    def _trim(self) -> None:
        """Keep the memory bounded; the words met first are the most frequent ones and stay."""
        for first, second in ((self.word_ids, self.word_decoded), (self.piece_ids, self.piece_decoded)):
            if len(first) > self.memory:
                for k in list(first)[self.memory // 3:]:
                    del first[k], second[k]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text.

        A space after something that is no white space always starts a new word, so texts fall into pieces at
        single spaces, and only unknown pieces are split by the pattern. Texts with other white space beside a
        space are split as wholes.
        """
        self._trim()
        cut = [[] if "\0" in text or text[:1] == " " else text.replace(" ", "\0 ").split("\0") for text in texts]
        distinct: set[str] = set()
        for parts in cut:
            distinct.update(parts)
        distinct.difference_update(self.piece_ids)
        loose = {p for p in distinct if p == " " or p[-1:].isspace() or p[1:2].isspace() or p[:1].isspace() and p[0] != " "}
        plans: list[tuple[list[str], bool]] = []
        words: set[str] = set()
        for text, parts in zip(texts, cut):
            whole = not parts or bool(loose) and not loose.isdisjoint(parts)
            plans.append((self.split(text) if whole else parts, whole))
            if whole:
                words.update(plans[-1][0])
                distinct.difference_update(loose)
        fresh = {p: self.split(p) for p in distinct.difference(loose)}
        for parts in fresh.values():
            words.update(parts)
        new = [w for w in words if w not in self.word_ids]
        if new:
            ids, decoded = self.encode_words(new)
            self.word_ids.update(zip(new, ids))
            self.word_decoded.update(zip(new, decoded))
        for piece, parts in fresh.items():
            self.piece_ids[piece] = b"".join(map(self.word_ids.__getitem__, parts))
            self.piece_decoded[piece] = b"".join(map(self.word_decoded.__getitem__, parts))
        tables = {True: (self.word_ids, self.word_decoded), False: (self.piece_ids, self.piece_decoded)}
        return [tuple(b"".join(map(known.__getitem__, parts)) for known in tables[whole]) for parts, whole in plans]


_CODERS: dict[tuple, Coder] = {}


def _coder(path: str, pattern: str, memory: int) -> Coder:
    """The worker process's coder; workers serve many tasks, so the tables are made once."""
    key = (path, pattern, memory)
    if key not in _CODERS:
        _CODERS[key] = Coder(path, pattern, memory)
    return _CODERS[key]


ADDED = pa.schema([("ids", pa.large_binary()), ("decoded", pa.large_binary())])


def in_groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters each; a longer text is a run of its own."""
    group: list[str] = []
    held = 0
    for text in texts:
        if group and held + len(text) > chars:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", memory: int = 300_000, group_chars: int = 3_000_000,
                  keep: list[str] | None = None) -> DataFrame:
    """Every row with ``ids`` (binary, unsigned 32-bit little-endian) and ``decoded`` (binary)."""

    def derive(column: pa.Array) -> list[list]:
        coder = _coder(path, pattern, memory)
        gc.disable()  # many small objects without cycles
        pairs = [p for group in in_groups(char_texts(column), group_chars) for p in coder.encode(group)]
        return [[p[0] for p in pairs], [p[1] for p in pairs]]

    return per_row(df, text, ADDED, "ids binary, decoded binary", derive, keep)


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, memory: int = 300_000,
            group_chars: int = 3_000_000, ids: str | None = None) -> DataFrame:
    """Token count and hashes of what :func:`encode_decode` gives; with ``ids`` the ids themselves are a column of that name.

    A kept column named like one of these is replaced; any other name may be used.
    """
    own = [c for c in (df.columns if keep is None else keep) if c not in (*DIGESTS, ids)]
    plain = df.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)], F.col(f"`{text}`").alias("own_text"))
    coded = encode_decode(plain, path, pattern, "own_text", memory, group_chars, [f"own_{i}" for i in range(len(own))])
    return coded.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *([F.col("ids").alias(ids)] if ids else []))
