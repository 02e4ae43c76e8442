"""The trie of rebuilt conversations against a dictionary of all prefixes."""
import collections
import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from glasstrail.llm import convtrie, queries

ROOT = "/root/testdata/sf0.001"
DDL = "conv_id bigint, turn bigint, role string, text string, depth int, cid string, path string"


def brute(rows):
    """Node rows from (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    members, ending = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns if c == family else own.get(family, [])[:h] + turns[h:])
        ending[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return collections.Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                                hashlib.sha256(",".join(map(str, sorted(ending[k]))).encode()).hexdigest()) for k, m in members.items())


def many():
    """Shared heads, copies, nulls, ties, repeated rows, ids without turns of their own, a long conversation and its near copy."""
    rows = [(c, t, "user" if t % 2 == 0 else None, None if (c + t) % 7 == 0 else f"text {t if c % 3 else c % 11}") for c in range(60) for t in range(c % 12)]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(4)]
    rows += [(c, t, "r", f"é{min(t, c - 100)}") for c in range(300, 316, 2) for t in range(12)]
    rows += [(400, t, "a", f"{t % 5}") for t in range(17)] + [(410, t, "a", f"{t % 5}" if t < 16 else "end") for t in range(17)]
    rows += [(-7, 0, "user", "same"), (-3, 1, "x", ""), (-3, 0, "x", ""), (None, 0, "user", "lost"), (500, None, "late", None), (500, 0, "b", "x"), (500, 0, "a", "y"), (500, 0, "a", "y"),
             (601, 0, "only", "one"), (9_000_000_000_000_000_004, 3, "", "end"), (700, 0, "a", "b c"), (705, 0, "a b", "c")]
    return rows


@pytest.mark.parametrize("segment, burst", [(4096, 2048), (6, 3), (17, 1)])
def test_trie_against_all_prefixes(spark, segment, burst):
    frame = spark.createDataFrame([(*r, 1, "mine", "p") for r in many()], DDL).repartition(5)
    got = collections.Counter(map(tuple, convtrie.trie(frame, segment, burst).collect()))
    got = collections.Counter({(r[0], r[1], r[2], *r[3:]): n for r, n in got.items()})
    assert got == brute(many())


def test_empty_table(spark):
    assert convtrie.trie(spark.createDataFrame([], DDL)).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 0, "a", "b", 0, "", "")], DDL)).count() == 0


def test_query_over_given_conversations(spark):
    t = pq.read_table(f"{ROOT}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    rows = queries.QUERIES["op11_conversation_trie"](spark, ROOT)
    assert collections.Counter(map(tuple, rows.collect())) == brute([tuple(r.values()) for r in t])
