"""Prefix trie of rebuilt conversations, built as a burst trie.

Shards hold containers of suffixes under trie heads. A container with more than ``burst`` different suffixes bursts: its
head becomes an inner node and its suffixes move into one container per next turn id, round by round. The containers that
are left are sorted and swept into nodes: one pass over a shard keeps only the nodes on the current path and the closed
children of those, so at most ``burst`` rows and one suffix.

* A turn id is the 128-bit digest of (role, text), taken before any shuffle: no text moves. Ids of one family (a
  conversation whose turns head others, and those others) are sorted together and streamed, never held as a group.
* A conversation of ``SEGMENT`` turns or more is cut into segments; a segment's container head is the digest of all
  turns before it, so segments of different conversations meet exactly where their prefixes are equal. Segments are
  built last to first, and a head's own results are handed to the segment before it. No row holds more than ``SEGMENT``
  turns. The first segment of common conversations is the whole conversation.
* Equal suffixes of one container are one row with a count, so a group of copies, however large, is a single suffix.
  The hash of a node's own conversation ids needs their order: they are sorted by Spark (spilling) and streamed through
  the hash. A hash of an ordered list can't be merged, so one task streams the ids (24 bytes each) of one node.

Null roles and texts are empty. Turns sort by turn number (null first), then by turn id: equal turn numbers and repeated
rows are all kept, in that order. Rows without a conversation id belong to no conversation and are left out. An empty
table has no node. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, small_side

SEGMENT = 4096
BURST = 2048
#: A family is ``FAMILY`` conversations in a row; the head taken over from its first one has fewer than ``HEADS`` turns.
FAMILY, HEADS = 5, 9
ROOT = hashlib.md5(b"").digest()

SEGMENTS_DDL = "conv_id bigint, part int, head binary, code binary, whole boolean, ids array<binary>, sizes array<bigint>"
SEGMENTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("head", pa.binary()), ("code", pa.binary()), ("whole", pa.bool_()),
                      ("ids", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])
GROUPS_DDL = "code binary, least bigint, n bigint, ends_sha256 string"
GROUPS = pa.schema([("code", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
NODE = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES_DDL = ("depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
             "ends_sha256 string, top binary, path array<binary>")
NODES = pa.schema([(c, pa.int64()) for c in NODE[:-1]] + [("ends_sha256", pa.string()), ("top", pa.binary()), ("path", pa.list_(pa.binary()))])
NOTHING = hashlib.sha256(b"").hexdigest()
FLUSH = 5_000


def turn_id(role: Column, text: Column) -> Column:
    """128-bit digest of a turn; the length of the role keeps (role, text) apart."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, FLUSH):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, FLUSH).columns))


def _flushed(rows: Iterator[tuple], schema: pa.Schema, weight=lambda row: 1) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= FLUSH:
            yield _written(held, schema)
            held, size = [], 0
    if held:
        yield _written(held, schema)


def head_length(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _rebuilt(rows: Iterator[tuple], segment: int) -> Iterator[tuple]:
    """Segments of the rebuilt conversations, from (family, conv_id, id, size) sorted by family, its first conversation first."""
    family: object = None
    shared: list[tuple[bytes, int]] = []  # the first turns of the family's first conversation
    conv: object = None
    ids: list[bytes] = []
    sizes: list[int] = []
    part, head, skip = 0, ROOT, 0

    def cut(more: bool) -> tuple:
        nonlocal part, head, ids, sizes
        code = hashlib.md5(head + b"".join(ids) + (b"+" if more else b".")).digest()
        row = (conv, part, head, code, not more, ids, sizes)
        part, head, ids, sizes = part + 1, code, [], []
        return row

    for fam, c, turn, size in rows:
        if c != conv or fam != family:
            if conv is not None:
                yield cut(False)
            if fam != family:
                family, shared = fam, []
            conv, part, head = c, 0, ROOT
            skip = 0 if c == fam else head_length(c)
            ids, sizes = [], []
            for i, s in shared[:skip]:
                ids.append(i)
                sizes.append(s)
                if len(ids) == segment:
                    yield cut(True)
        if c == fam and len(shared) < HEADS - 1:
            shared.append((turn, size))
        if skip:
            skip -= 1
            continue
        ids.append(turn)
        sizes.append(size)
        if len(ids) == segment:
            yield cut(True)
    if conv is not None:
        yield cut(False)


def rebuilt(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rebuilt conversations as rows (conv_id, part, head, code, whole, ids, sizes): the turns of one segment, the digests
    of all turns before it and up to its end, and whether the conversation ends here."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    conv_id = F.col("conv_id").cast("bigint")
    slim = turns.filter("conv_id is not null").select(
        (conv_id - conv_id % FAMILY).alias("family"), conv_id.alias("conv_id"), "turn", turn_id(role, text).alias("id"), F.octet_length(text).cast("bigint").alias("size"))
    dealt = slim.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "id")
    return dealt.select("family", "conv_id", "id", "size").mapInArrow(
        lambda batches: _flushed(_rebuilt(_rows(batches), segment), SEGMENTS, lambda row: 1 + len(row[5])), SEGMENTS_DDL)


def _grouped(rows: Iterator[tuple]) -> Iterator[tuple]:
    code, least, n, whole, digest, text = None, None, 0, False, hashlib.sha256(), ""
    for c, conv_id, ends in rows:
        if c != code:
            if code is not None:
                yield code, least, n, digest.hexdigest() if whole else NOTHING
            code, least, n, whole, digest, text = c, conv_id, 0, ends, hashlib.sha256(), ""
        n += 1
        digest.update(f"{text}{conv_id}".encode())
        text = ","
    if code is not None:
        yield code, least, n, digest.hexdigest() if whole else NOTHING


def distinct_suffixes(segments: DataFrame) -> DataFrame:
    """One row per different segment with its count ``n``, its least conversation and the hash of the ids that end in it."""
    keys = segments.select("code", "conv_id", "whole").repartition("code").sortWithinPartitions("code", "conv_id")
    groups = keys.mapInArrow(lambda batches: _flushed(_grouped(_rows(batches)), GROUPS), GROUPS_DDL)
    one = segments.join(groups.withColumnRenamed("least", "conv_id"), ["code", "conv_id"])
    return one.select("part", "head", "code", "ids", "sizes", F.col("conv_id").alias("least"), "n", "ends_sha256")


class _Node:
    __slots__ = ("depth", "least", "n", "kids", "leaves", "saved", "size", "ends", "closed")

    def __init__(self, depth: int, size: int):
        self.depth, self.size, self.least, self.n, self.kids, self.leaves, self.saved, self.ends = depth, size, None, 0, 0, 0, 0, NOTHING
        self.closed: list[_Node] = []


def _swept(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes of all containers of a shard, from suffixes sorted by (container, ids): a stack holds the current path."""
    stack: list[_Node] = []
    before: tuple = (None,)
    path_ids: list[bytes] = []

    def close(keep: int) -> Iterator[tuple]:
        """Closes the nodes deeper than the first ``keep`` of the stack. A node's row goes out when its parent is closed."""
        while len(stack) > keep:
            node = stack.pop()
            node.saved += (node.n - 1) * node.size
            if not node.kids:
                node.leaves = 1
            for kid in node.closed:
                yield kid.depth, kid.least, node.least, kid.n, kid.kids, kid.leaves, kid.saved, kid.ends, None, None
            node.closed = []
            if stack:
                up = stack[-1]
                up.kids, up.leaves, up.saved, up.n = up.kids + 1, up.leaves + node.leaves, up.saved + node.saved, up.n + node.n
                up.least = node.least if up.least is None else min(up.least, node.least)
                up.closed.append(node)
            else:
                cid, parent_least, path = before
                yield node.depth, node.least, parent_least, node.n, node.kids, node.leaves, node.saved, node.ends, cid, path

    for cid, start, level, parent_least, path, ids, sizes, least, n, ends, kids, leaves, saved in rows:
        if cid != before[0]:
            yield from close(0)
            before = (cid, parent_least, path)
            stack.append(_Node(start + level, sizes[level - 1] if level else 0))
            path_ids = ids
            common = level
        else:
            common = level
            while common < len(path_ids) and common < len(ids) and path_ids[common] == ids[common]:
                common += 1
            yield from close(common - level + 1)
            path_ids = ids
        for k in range(common, len(ids)):
            stack.append(_Node(start + k + 1, sizes[k]))
        end = stack[-1]
        end.n, end.ends = end.n + n, ends
        end.least = least if end.least is None else min(end.least, least)
        end.kids, end.leaves, end.saved = end.kids + kids, end.leaves + leaves, end.saved + saved
    yield from close(0)


def _burst(rows: DataFrame, burst: int) -> tuple[DataFrame, DataFrame | None]:
    """Settled containers' suffixes, and the heads of those that burst."""
    members = checkpointed(rows.withColumns({"cid": F.col("head"), "level": F.lit(0), "parent_least": F.lit(None).cast("bigint"), "path": F.array().cast("array<binary>")}))
    settled, heads = [], []
    while True:
        big = checkpointed(members.groupBy("cid").agg(F.count(F.lit(1)).alias("held"), F.min("least").alias("head_least")).filter(F.col("held") > burst).drop("held"))
        if big.isEmpty():
            settled.append(members)
            break
        marked = members.join(small_side(big), "cid", "left")
        settled.append(marked.filter("head_least is null").drop("head_least"))
        inner = marked.filter("head_least is not null")
        here = F.size("ids") == F.col("level")
        own = lambda c: F.coalesce(F.max(F.when(here, F.col(c))), F.lit(0)).cast("bigint").alias(c)
        heads.append(inner.groupBy("cid").agg(
            F.min("level").alias("level"), F.min("least").alias("conv_id"), F.min("parent_least").alias("parent_conv_id"), F.min("path").alias("path"), F.sum("n").alias("n_convs"),
            F.min("start").alias("start"), F.min(F.when(F.col("level") > 0, F.expr("sizes[level - 1]")).otherwise(0)).alias("size"),
            F.coalesce(F.max(F.when(here, F.col("ends_sha256"))), F.lit(NOTHING)).alias("ends_sha256"), own("kids"), own("leaves"), own("saved")))
        following = F.unhex(F.md5(F.concat("cid", F.expr("ids[level]"))))
        members = checkpointed(inner.filter(~here).withColumns({
            "path": F.concat("path", F.array("cid")), "cid": following, "level": F.col("level") + 1, "parent_least": F.col("head_least")}).drop("head_least"))
    return _united(settled), _united(heads) if heads else None


def _united(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _nodes(rows: DataFrame, burst: int) -> DataFrame:
    """All nodes below and at the heads of one part's segments, with ``top``: the container of a container's own node."""
    settled, heads = _burst(rows, burst)
    shards = (settled.select("cid", "start", "level", "parent_least", "path", "ids", "sizes", "least", "n", "ends_sha256", "kids", "leaves", "saved")
              .repartition("cid").sortWithinPartitions("cid", "ids"))
    swept = checkpointed(shards.mapInArrow(lambda batches: _flushed(_swept(_rows(batches)), NODES), NODES_DDL))
    if heads is None:
        return swept
    heads = checkpointed(heads)
    tops = swept.filter("top is not null")
    own = heads.select(F.concat("path", F.array("cid")).alias("path"), F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    below = (tops.select("path", "n_leaves", "saved_tokens").unionByName(own).select(F.explode("path").alias("cid"), "n_leaves", "saved_tokens")
             .groupBy("cid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    kids = (tops.select("path").unionByName(heads.select("path")).filter(F.size("path") > 0).groupBy(F.element_at("path", -1).alias("cid"))
            .agg(F.count(F.lit(1)).alias("found")))
    inner = heads.drop("size", "leaves", "saved").join(below, "cid").join(kids, "cid").select(
        (F.col("start") + F.col("level")).alias("depth"), "conv_id", "parent_conv_id", "n_convs", (F.col("kids") + F.col("found")).alias("n_children"), "n_leaves", "saved_tokens",
        "ends_sha256", F.col("cid").alias("top"), "path")
    return swept.unionByName(inner)


def trie(turns: DataFrame, segment: int = SEGMENT, burst: int = BURST) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, from turns (conv_id, turn, role, text)."""
    segments = checkpointed(rebuilt(turns, segment))
    suffixes = checkpointed(distinct_suffixes(segments))
    last = suffixes.agg(F.max("part")).first()[0]
    found, handed = [], None
    for part in range(last or 0, -1, -1):
        rows = suffixes.filter(F.col("part") == part).withColumn("start", F.lit(part * segment).cast("bigint")).drop("part")
        if handed is None:
            rows = rows.withColumns({c: F.lit(0).cast("bigint") for c in ("kids", "leaves", "saved")})
        else:
            rows = (rows.join(handed, "code", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("kids", "leaves", "saved")})
                    .withColumn("ends_sha256", F.coalesce("handed_sha256", "ends_sha256")).drop("handed_sha256"))
        nodes = checkpointed(_nodes(rows.drop("code"), burst))
        head = F.col("top").isNotNull() & (F.size("path") == 0)
        if part:
            handed = nodes.filter(head).select(F.col("top").alias("code"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"),
                                               F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("handed_sha256"))
            nodes = nodes.filter(~head)
        found.append(nodes.select(*NODE))
    return _united(found).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def oracle_sql() -> str:
    """DuckDB SQL for the trie of ``conversations``: every prefix of every rebuilt conversation as a key, CRC-32 bit by bit."""
    return f"""
WITH own AS (
  SELECT conv_id, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {FAMILY} AS family,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [256 + ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b - 256) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS taken, k, id, size FROM convs c JOIN own o ON o.conv_id = c.family AND o.k <= c.h WHERE c.conv_id <> c.family
  UNION ALL
  SELECT c.conv_id, 1, k, id, size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND (o.k > c.h OR c.conv_id = c.family)),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(id, '') OVER w) AS key, size FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY taken, k ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT conv_id, 0 AS depth, '' AS key, CAST(NULL AS VARCHAR) AS parent, 0 AS size FROM convs
  UNION ALL
  SELECT conv_id, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), ''), size FROM placed),
lengths AS (SELECT conv_id, max(depth) AS d FROM steps GROUP BY conv_id),
nodes AS (SELECT key, depth, parent, min(conv_id) AS conv_id, count(*) AS n, min(size) AS size FROM steps GROUP BY key, depth, parent),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
ends AS (SELECT key, sha256(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id)) AS ends_sha256
  FROM steps s JOIN lengths l ON l.conv_id = s.conv_id AND l.d = s.depth GROUP BY key),
below AS (SELECT up.key, sum((nodes.n - 1) * nodes.size) AS saved, count(*) FILTER (WHERE kids.key IS NULL) AS leaves
  FROM nodes JOIN steps up ON up.conv_id = nodes.conv_id AND up.depth <= nodes.depth LEFT JOIN kids ON kids.key = nodes.key GROUP BY up.key)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(n_children, 0) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes above ON above.key = nodes.parent
"""
