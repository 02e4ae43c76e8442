"""Hashed n-gram vectors of many texts at once, as numpy arrays."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken together up to so many weights and bytes; a longer text goes alone. This bounds memory, not results.
CELLS, BYTES = 1 << 19, 1 << 20
#: So few words left are hashed one by one.
FEW = 64
OFFSET, PRIME = 2166136261, 16777619
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def blocks(offsets: np.ndarray, dimension: int):
    """Ranges of rows that are embedded together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(int(np.searchsorted(offsets, offsets[a] + BYTES, "right")) - 1, a + CELLS // dimension, n)
        yield a, max(b, a + 1)
        a = max(b, a + 1)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of UTF-8 texts that lie one behind another, in order, and the row of each."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    begins = np.append(np.flatnonzero(first[solid]), np.count_nonzero(solid))
    words = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data[solid]))
    return words.dictionary_encode(), np.searchsorted(offsets[1:], np.flatnonzero(first), "right")


def fnv1a(h: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a carried on from ``h`` over words ``codes[start:start + length]``, the longest first."""
    h, k = h.astype(np.uint32), 0
    while (n := int(np.searchsorted(-lengths, -k, "left"))) > FEW:
        h[:n] = (h[:n] ^ codes[starts[:n] + k]) * np.uint32(PRIME)
        k += 1
    for i in range(n):
        v = int(h[i])
        for c in codes[starts[i] + k:starts[i] + lengths[i]].tolist():
            v = (v ^ c) * PRIME & 4294967295
        h[i] = v
    return h


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    at = runs(keys)
    return keys[at], np.diff(at, append=len(keys))


def weights(data: np.ndarray, offsets: np.ndarray, dimension: int) -> np.ndarray:
    """Per row and dimension the sum of 1 + ln(count) over the row's different features; 0 where there is none.

    Features are told apart by what they are, not by hash: words by number, pairs by two, trigrams by three code points. A word
    of three letters is a trigram too. Numbers follow length and hash, so sums don't depend on the texts taken together.
    """
    rows = len(offsets) - 1
    sums = np.zeros(rows * dimension)

    def add(row, hashes, n):
        sums[:] += np.bincount(row * dimension + hashes % dimension, 1.0 + np.log(n), rows * dimension)

    encoded, row = split_words(data, offsets)
    lengths = pc.utf8_length(encoded.dictionary).to_numpy()
    letters = encoded.dictionary.buffers()[2]
    codes = np.frombuffer(str(letters or b"", "utf-8").encode("utf-32-le"), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= 2]
    starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    hashes = fnv1a(np.full(len(order), OFFSET), codes, starts, lengths)
    again = np.lexsort((hashes, -lengths))
    starts, lengths, hashes = starts[again], lengths[again], hashes[again]
    number = np.full(len(encoded.dictionary), -1)
    number[order[again]] = np.arange(len(order))
    word = number[encoded.indices.to_numpy()]
    word, row = word[word >= 0], row[word >= 0]
    if not len(word):
        return sums.reshape(rows, dimension)
    row_bits, word_bits = (rows - 1).bit_length(), (len(order) - 1).bit_length()
    row_mask = (1 << row_bits) - 1

    near = np.flatnonzero(row[1:] == row[:-1])
    keys, n = counted((word[near + 1] << word_bits | word[near]) << row_bits | row[near])
    pairs = keys >> row_bits
    at = runs(pairs)
    a, b = pairs[at] & (1 << word_bits) - 1, pairs[at] >> word_bits
    found = fnv1a((hashes[a] ^ np.uint32(32)) * np.uint32(PRIME), codes, starts[b], lengths[b])
    add(keys & row_mask, np.repeat(found, np.diff(at, append=len(pairs))), n)

    keys, n = counted(word << row_bits | row)
    word, row = keys >> row_bits, keys & row_mask
    three = lengths[word] == 3
    add(row[~three], hashes[word[~three]], n[~three])

    ends = np.cumsum(lengths)
    place = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
    middle = codes[place].astype(np.int64)
    left, right = np.empty_like(middle), np.empty_like(middle)
    left[1:], right[:-1] = middle[:-1], middle[1:]
    left[ends - lengths], right[ends - 1] = ord("^"), ord("$")
    whole = np.flatnonzero(lengths == 3)
    own = (ends - lengths)[whole]
    grams = np.concatenate((left << 42 | middle << 21 | right, middle[own] << 42 | middle[own + 1] << 21 | middle[own + 2]))
    grams, gram = np.unique(grams, return_inverse=True)
    own_gram = np.zeros(len(lengths), np.int64)
    own_gram[whole] = gram[ends[-1]:]
    found = np.full(len(grams), OFFSET, np.uint32)
    for shift in (42, 21, 0):
        found = (found ^ (grams >> shift & 0x1FFFFF).astype(np.uint32)) * np.uint32(PRIME)
    # Counts ride in the low bits, so that one plain sort brings those of a gram and row together.
    count_bits, size = int(n.max()).bit_length(), lengths[word]
    tail = row << count_bits | n
    upto = np.cumsum(size)
    each = np.repeat((ends - lengths)[word] - (upto - size), size) + np.arange(upto[-1])
    keys = np.concatenate((gram[each] << row_bits + count_bits | np.repeat(tail, size), own_gram[word[three]] << row_bits + count_bits | tail[three]))
    keys.sort()
    both = keys >> count_bits
    at = runs(both)
    both = both[at]
    add(both & row_mask, found[both >> row_bits], np.add.reduceat(keys & (1 << count_bits) - 1, at))
    return sums.reshape(rows, dimension)


def sparse_vectors(texts: pa.Array, dimension: int):
    """``(rows, dimensions, weights)`` of the unit vectors of cleaned texts, block by block; texts without features have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    for a, b in blocks(offsets, dimension):
        w = weights(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], dimension)
        row, dim = np.nonzero(w)
        yield row + a, dim, w[row, dim] / np.sqrt((w * w).sum(1))[row]
