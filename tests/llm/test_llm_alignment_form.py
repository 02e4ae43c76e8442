"""The hashed form of the groups, as the contract writes it: `a1,a2|b1;a3|b2,b3`."""
import hashlib
import random

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
import tokenizers

from glasstrail.llm import alignment, queries

ROOT = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "the ", " odd", "naïve", "\n", "\t", " ", "  ", "\r\n", ";", "|", "12", "你好", "👍🏽", " ", "\x85", "　", "'s", "é", "\x1f", "%%", "ſ", "᠎", "<s>", "▁"]


def form(text):
    """The contract's string of a text's groups, from whole-text tokenization and byte offsets; empty without tokens."""
    a_coder = tokenizers.Tokenizer.from_file(PATHS[0])
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    names, decode = {i: t for t, i in a_coder.get_vocab().items()}, alignment.byte_level()

    def of(text):
        whole = (" " + text).encode()
        a = [(i, bytes(decode[c] for c in names[i])) for i in a_coder.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(b_coder.id_to_piece(i)[3:5], 16)]) if b_coder.is_byte(i) else b_coder.id_to_piece(i).replace("▁", " ").encode()) for i in b_coder.encode(text)]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return ""
        groups, left, right, to_a, to_b = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if to_a <= to_b:
                i, x = a.pop()
                left.append(str(i))
                to_a += len(x)
            else:
                i, x = b.pop()
                right.append(str(i))
                to_b += len(x)
            if to_a == to_b:
                groups.append(f"{','.join(left)}|{','.join(right)}")
                left, right = [], []
        return ";".join(groups)

    return of(text) if isinstance(text, str) else [of(t or "") for t in text]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest() if s else ""


def test_form_of_a_known_text():
    assert form("a") == "257|264"
    assert form("naïve words").count("|") == form("naïve words").count(";") + 1


def test_random_texts(spark):
    rng = random.Random(13)
    texts = [None, "", *["".join(rng.choices(SIGNS, k=rng.randrange(1, 30))) for _ in range(400)]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["groups_sha256"] for r in alignment.scored(frame, *PATHS, 32_000).collect()}
    assert got == dict(enumerate(map(digest, form(texts))))


def test_query_over_given_documents(spark):
    t = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = {r["doc_id"]: r["groups_sha256"] for r in queries.QUERIES["op13_token_alignment"](spark, ROOT).collect()}
    assert got == dict(zip(t["doc_id"], map(digest, form(t["text"]))))
