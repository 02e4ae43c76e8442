"""Alignment of two tokenizers against whole texts and all pairs of byte ranges."""
import collections
import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers

from glasstrail.llm import alignment, queries

ROOT = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n\n", "a\n b\t c \x0b d", "x　 y\xa0 z", "<|endoftext|> </s> <unk> <0x41>", "▁ odd ▁▁x", "I'll don't 'S 12 3.4 ²½ 你好 😀👍🏽",
       "\x00 a\x00b", "\x1c \x1d  x", "word " * 3000, "z" * 4000, "İſK é ﻿", "tab\tand space \r\n end ", "same same", "same same", "%%% ### *** $$$ &&&"]


def brute(texts):
    """Per text by whole-text tokenization; overlaps by comparing all ranges of a group."""
    a_coder = tokenizers.Tokenizer.from_file(PATHS[0])
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names, decode = {i: t for t, i in a_coder.get_vocab().items()}, alignment.byte_level()
    rows, counts = [], collections.Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        raw_a = [bytes(decode[c] for c in names[i]) for i in a]
        raw_b = [bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            rows.append(None)
            continue

        def ranges(raw):
            at, out = 0, []
            for r in raw:
                out.append((at, at + len(r)))
                at += len(r)
            return out

        in_a, in_b = ranges(raw_a), ranges(raw_b)
        groups, links, i, j = [], [], 0, 0
        for end in sorted({e for _, e in in_a} & {e for _, e in in_b}):
            m = next(k for k in range(i, len(a)) if in_a[k][1] == end) + 1
            n = next(k for k in range(j, len(b)) if in_b[k][1] == end) + 1
            groups.append(",".join(map(str, a[i:m])) + ";" + ",".join(map(str, b[j:n])))
            links += [(a[x], b[y]) for x in range(i, m) for y in range(j, n) if in_a[x][0] < in_b[y][1] and in_b[y][0] < in_a[x][1]]
            i, j = m, n
        counts.update(links)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256("|".join(groups).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (*r[:3], len(r[3]), sum(counts[k] == best[k[1]] for k in r[3]), sum(counts[k] for k in r[3]), r[4]) for r in rows]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 40, 0])
def test_odd_texts(spark, broadcast):
    frame = spark.createDataFrame([(None if i % 5 == 0 else i // 2, t, 7, "mine", 1) for i, t in enumerate(ODD)], "doc_id bigint, text string, n_a int, _row string, level int").repartition(3)
    got = alignment.scored(frame, *PATHS, 32_000, broadcast_pairs=broadcast).collect()
    assert collections.Counter((r["text"], r["_row"], *[r[c] for c in COLUMNS]) for r in got) == collections.Counter((t, "mine", *b) for t, b in zip(ODD, brute(ODD)))


def test_empty_table(spark):
    assert alignment.scored(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS, 32_000).count() == 0


def test_query_over_given_documents(spark):
    t = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op13_token_alignment"](spark, ROOT).collect()}
    assert got == dict(zip(t["doc_id"], brute(t["text"])))
