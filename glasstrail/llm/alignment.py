"""Alignment of two tokenizers' tokens over the same texts, with corpus-wide counts of the linked id pairs.

Both id lists of a text cover the same bytes. The ends of the tokens are dictionaries from end to index; the intersection
of their keys, sorted, cuts both lists into groups, and links are expanded inside each group: all pairs whose byte ranges
overlap.

Neither tokenizer joins a space or line end with something before it that is no white space: the byte pattern never does,
and the vocabulary of pieces is looked through for it when it is loaded. Such places are ends of both, so texts are aligned
piece by piece and a task remembers what it found for a piece (at most ``MEMORY`` short pieces; results don't depend on
it). A vocabulary that does join there makes whole texts the pieces.

Corpus-wide: per text only its different id pairs and their numbers are stored, in a written table. Counts are summed with
a partial sum before the shuffle. Pairs that occur often go to the texts by a broadcast of at most ``BROADCAST_PAIRS``
rows, whatever the corpus; the rest, by their rarity without hot keys, by a shuffled join.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
``groups_sha256``. Ids may be null or repeat and any other column may be kept: rows are told apart by a number of their own.
"""
from __future__ import annotations

import gc
import hashlib
import re
import uuid
from array import array
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir
from .bpe import in_groups
from .common import char_texts, per_row

MEMORY = 400_000
SHORT = 64
BROADCAST_PAIRS = 1_000_000
PIECE = re.compile(r"[ \n](?:[^ \n]+|(?<=\s)[ \n])*")
ALIGNED = pa.schema([*[(f"_{c}", pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("_groups", pa.string()), ("_pairs", pa.list_(pa.int64())), ("_times", pa.list_(pa.int64()))])
ALIGNED_DDL = "_n_a bigint, _n_b bigint, _n_groups bigint, _n_links bigint, _groups string, _pairs array<bigint>, _times array<bigint>"
NOTHING = (0, 0, 0, 0, "", [], [])


def groups_of(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[list[int], list[int]]]:
    """Groups of two id lists over the same bytes."""
    end_a = {end: i for i, end in enumerate(accumulate(map(size_a.__getitem__, a)), 1)}
    end_b = {end: i for i, end in enumerate(accumulate(map(size_b.__getitem__, b)), 1)}
    common = end_a.keys() & end_b.keys()
    if len(common) == 1:
        return [(a, b)]
    found, i, j = [], 0, 0
    for end in sorted(common):
        m, n = end_a[end], end_b[end]
        found.append((a[i:m], b[j:n]))
        i, j = m, n
    return found


def links_of(left: list[int], right: list[int], size_a: list[int], size_b: list[int]) -> list[tuple[int, int]]:
    """Linked pairs of one group of several tokens on both sides; inside it no ends meet before the last one."""
    links, m, n, to_a, to_b = [], 0, 0, size_a[left[0]], size_b[right[0]]
    while True:
        links.append((left[m], right[n]))
        if to_a == to_b:
            return links
        if to_a < to_b:
            m += 1
            to_a += size_a[left[m]]
        else:
            n += 1
            to_b += size_b[right[n]]


def byte_level() -> dict[str, int]:
    """Characters of a byte-level vocabulary to bytes: printable Latin-1 stands for itself, the others are numbered from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """One task's tokenizers and its memory of pieces."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        vocab, decode = self.a.get_vocab(with_added_tokens=True), byte_level()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes_a[i] = bytes(decode[c] for c in entry) if all(c in decode for c in entry) else entry.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank, self.line = self.b.encode("x ")[len(self.b.encode("x")):], self.b.encode("\nx")[:1]
        self.joins = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or self.line != [self.b.piece_to_id("▁")]
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.name_a, self.name_b = list(map(str, range(len(self.bytes_a)))), list(map(str, range(len(self.bytes_b))))
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _learn(self, pieces: list[str]) -> dict[str, tuple | None]:
        ids_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        ids_b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        found: dict[str, tuple | None] = {}
        bytes_a, bytes_b, size_a, size_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__, self.size_a, self.size_b
        name_a, name_b, width = self.name_a, self.name_b, len(self.bytes_b)
        for piece, a, b in zip(pieces, ids_a, ids_b):
            if piece == " ":  # an empty text gets no space of its own
                b = self.blank
            elif piece[0] == "\n":  # nor has a line end one before it
                b = b[1:]
            whole = piece.encode()
            if b"".join(map(bytes_a, a)) != whole or b"".join(map(bytes_b, b)) != whole:
                found[piece] = None
                continue
            codes, texts = [], []
            groups = groups_of(a, b, size_a, size_b)
            for left, right in groups:
                if len(left) == 1:
                    x = left[0]
                    if len(right) == 1:
                        codes.append(x * width + right[0])
                        texts.append(f"{x}|{right[0]}")
                        continue
                    codes += [x * width + y for y in right]
                elif len(right) == 1:
                    codes += [x * width + right[0] for x in left]
                else:
                    codes += [x * width + y for x, y in links_of(left, right, size_a, size_b)]
                texts.append(f"{','.join([name_a[x] for x in left])}|{','.join([name_b[y] for y in right])}")
            found[piece] = (len(a), len(b), len(groups), ";".join(texts), array("q", codes).tobytes())
        return found

    def align(self, texts: list[str]) -> list[tuple]:
        import numpy as np

        cut = [[] if not t else [" " + t] if self.joins else PIECE.findall(" " + t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        again = fresh.intersection(self.older)
        found = self._learn(list(fresh.difference(again)))
        for p in again:
            found[p] = self.older[p]
        lookup = self.known | found
        out = []
        for pieces in cut:
            parts = list(map(lookup.__getitem__, pieces))
            if not parts or None in parts:
                out.append(NOTHING)
                continue
            n_a, n_b, n_groups, groups, codes = zip(*parts)
            links = np.frombuffer(b"".join(codes), np.int64)
            pairs, times = np.unique(links, return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times))
        self.known.update((p, e) for p, e in found.items() if len(p) <= SHORT)
        if len(self.known) > MEMORY // 2:  # two generations: what was met lately stays
            self.known, self.older = {}, self.known
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def aligned(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, group_chars: int = 2_000_000) -> DataFrame:
    """Rows with numbers of tokens, groups and links, the hash of the groups, and the different linked pairs with their
    numbers. A pair is coded as id of A * size of B's vocabulary + id of B."""

    def derive(column: pa.Array) -> list[list]:
        gc.disable()  # many small objects without cycles
        key = (path_a, path_b)
        if key not in _ALIGNERS:
            _ALIGNERS[key] = Aligner(*key)
        rows = [row for group in in_groups(char_texts(column), group_chars) for row in _ALIGNERS[key].align(group)]
        return [list(x) for x in zip(*rows)] if rows else [[] for _ in ALIGNED]

    return per_row(df, text, ALIGNED, ALIGNED_DDL, derive, keep)


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """``(_pair, _count, _best)`` of all linked pairs; ``_best`` if no other pair with the same id of B occurs more often."""
    counts = pairs.groupBy("_pair").agg(F.sum("_n").alias("_count"))
    highest = counts.groupBy((F.col("_pair") % size_b).alias("_b")).agg(F.max("_count").alias("_highest"))
    return counts.join(highest, F.col("_pair") % size_b == F.col("_b")).select("_pair", "_count", (F.col("_count") == F.col("_highest")).cast("int").alias("_best"))


def stored(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def scored(df: DataFrame, path_a: str, path_b: str, size_b: int, text: str = "text", keep: list[str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The kept columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. ``size_b`` is at least the
    size of B's vocabulary. Kept columns of these names are replaced."""
    added = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    plain = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)])
    own = [f"own_{i}" for i in range(len(kept))]
    rows = stored(aligned(plain, path_a, path_b, "_text", own).withColumn("_row", F.monotonically_increasing_id()))
    pairs = rows.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("z")).select("_row", F.col("z._pairs").alias("_pair"), F.col("z._times").alias("_n"))
    counts = stored(pair_counts(pairs, size_b))
    level = F.floor(F.log2("_count"))
    sizes = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # one row per power of two
    least, held = 0, 0
    for n, size in sizes:
        held += size
        if held > broadcast_pairs:
            least = n + 1
            break
    often = counts.filter(level >= least)
    met = pairs.join(F.broadcast(often), "_pair", "left")
    value = lambda frame: frame.groupBy("_row").agg(F.sum(F.col("_n") * F.col("_best")).alias("n_best"), F.sum(F.col("_n") * F.col("_count")).alias("count_sum"))
    if least:
        rare = met.filter("_count is null").select("_row", "_pair", "_n").join(counts.filter(level < least), "_pair")
        met = met.filter("_count is not null").select("_row", "_n", "_best", "_count").unionByName(rare.select("_row", "_n", "_best", "_count"))
    whole = rows.drop("_pairs", "_times").join(value(met), "_row", "left")
    return whole.select(*[F.col(o).alias(c) for o, c in zip(own, kept)], *[F.col(f"_{c}").alias(c) for c in added[:4]],
                        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_best", "count_sum")], F.col("_groups").alias("groups_sha256"))
