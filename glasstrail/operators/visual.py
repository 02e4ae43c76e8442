"""Perceptual hashes, palettes, layout and visual similarity."""
from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import lexicon as lx
from ..functions.base import bind, quote
from ..functions.vectors import hamming
from ..session import checkpointed
from .components import connected_components

NEAR_DUPLICATE_BITS, SIMILAR_BITS, VISUAL_ONLY_BITS = 8, 20, 24
GRID_W, GRID_H = 9, 8


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def downscale(pixels: DataFrame, width: int = GRID_W, height: int = GRID_H) -> DataFrame:
    """Box average ``(capture_id, tx, ty, value)`` of a pixel table onto a small grid.

    A pixel column x falls in the boxes whose floor bounds contain it. Narrow images give boxes of at
    least one pixel, so a column may serve several boxes: the box list of a pixel is generated, not joined.
    """
    size = pixels.groupBy("capture_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    gray = pixels.select("capture_id", "x", "y", luminance(F.col("r"), F.col("g"), F.col("b")).alias("v")).join(size, "capture_id")

    def boxes(pos: str, extent: str, n: int) -> Column:
        def inside(t: Column) -> Column:
            lo = F.floor(t * F.col(extent) / n)
            hi = F.greatest(F.floor((t + 1) * F.col(extent) / n), lo + 1)
            return (F.col(pos) >= lo) & (F.col(pos) < hi)

        return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), inside)

    cells = (gray.withColumn("tx", F.explode(boxes("x", "w", width))).withColumn("ty", F.explode(boxes("y", "h", height))))
    return cells.groupBy("capture_id", "tx", "ty").agg(F.expr("sum(v) div count(*)").alias("value"))


def dhash(grid: DataFrame) -> DataFrame:
    """64-bit difference hash from the 9x8 grid: bit set where a cell is brighter than its right neighbour."""
    packed = grid.groupBy("capture_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("ty") * GRID_W + F.col("tx")).alias("k"), "value"))).alias("m"))
    bits = F.lit(0).cast("bigint")
    for y in range(GRID_H):
        for x in range(GRID_W - 1):
            k = y * GRID_W + x
            bits = bits.bitwiseOR(F.when(F.col("m")[k] > F.col("m")[k + 1], F.shiftleft(F.lit(1).cast("bigint"), 63 - (y * 8 + x))).otherwise(F.lit(0).cast("bigint")))
    return packed.select("capture_id", bits.alias("dhash"))


def nearest_color(r: Column, g: Column, b: Column) -> Column:
    """Name of the nearest of the fixed colours; the first wins a tie."""
    options = F.array(*[F.struct(
        ((r - cr) * (r - cr) * 2 + (g - cg) * (g - cg) * 4 + (b - cb) * (b - cb) * 3).alias("d"), F.lit(n).alias("n"), F.lit(name).alias("name"))
        for n, (name, cr, cg, cb) in enumerate(lx.COLORS)])
    return F.array_min(options)["name"]


def palette(pixels: DataFrame, min_share: float = 0.08, top: int = 3, dark_below: float = 90.0) -> DataFrame:
    """Leading colours, mean brightness and darkness per capture."""
    counts = (pixels.select("capture_id", nearest_color(F.col("r"), F.col("g"), F.col("b")).alias("color"),
                            luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"))
              .groupBy("capture_id", "color").agg(F.count("*").alias("n"), F.sum("v").alias("v")))
    order = F.array(*[F.lit(c[0]) for c in lx.COLORS])
    per = counts.groupBy("capture_id").agg(F.sum("n").alias("total"), F.sum("v").alias("v"), F.max("n").alias("most"), F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("o"), F.array_position(order, F.col("color")).alias("p"), "color"))).alias("c"))
    kept = F.slice(F.filter("c", lambda x: -x["o"] / F.col("total") >= min_share), 1, top)
    return per.select("capture_id", F.transform(kept, lambda x: x["color"]).alias("colors"), (F.col("most") / F.col("total")).alias("top_share"),
                      (F.col("v") / F.col("total")).alias("brightness"), (F.col("v") / F.col("total") < dark_below).alias("is_dark"))


def text_coverage(blocks: DataFrame) -> DataFrame:
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    return blocks.groupBy("capture_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(area) / F.lit(1e6))).alias("coverage"))


def type_sql(text: str, hosts: str, has_price: str, has_code: str, width: str, height: str, coverage: str, layout: str) -> str:
    """SQL for the capture type and its confidence, from the fixed keyword families."""
    options = []
    for n, (kind, words, rule_hosts, host_w, price_w, code_w, layout_w) in enumerate(lx.TYPE_RULES):
        parts = [f"CASE WHEN contains(_c.t, '{w}') THEN {v}D ELSE 0D END" for w, v in words.items()]
        if rule_hosts:
            parts.append(f"CASE WHEN exists(_c.h, h -> h RLIKE {quote('|'.join(re.escape(h) for h in rule_hosts))}) THEN {host_w}D ELSE 0D END")
        parts += [f"CASE WHEN _c.p THEN {price_w}D ELSE 0D END"] if price_w else []
        parts += [f"CASE WHEN _c.k THEN {code_w}D ELSE 0D END"] if code_w else []
        parts += [f"CASE WHEN _c.l = '{name}' THEN {v}D ELSE 0D END" for name, v in layout_w.items()]
        options.append(f"named_struct('s', round({' + '.join(parts)}, 9), 'n', {-n}, 'kind', '{kind}')")
    marks = " + ".join(f"CASE WHEN contains(_c.t, '{m}') THEN 1 ELSE 0 END" for m in lx.UI_MARKERS)
    ui, photo = "named_struct('kind', 'APP_UI', 'confidence', 0.5D)", "named_struct('kind', 'PHOTO', 'confidence', 0.4D)"
    decide = bind(
        "CASE WHEN _c.w > 0 AND _c.hh >= _c.w * 2.8D THEN named_struct('kind', 'LONG_SCREENSHOT', 'confidence', 1D) "
        f"WHEN _b.b.s < 2D AND _b.u >= 2 THEN {ui} WHEN _c.cov < 0.02D AND _b.b.s = 0 THEN {photo} "
        "WHEN _b.b.s < 1.5D THEN named_struct('kind', 'OTHER', 'confidence', 1D) "
        "ELSE named_struct('kind', _b.b.kind, 'confidence', greatest(0.3D, least(1D, _b.b.s / 4D))) END",
        b=f"array_max(array({', '.join(options)}))", u=marks)
    return (f"transform(array(struct(concat(' ', lower({text}), ' ') AS t, transform({hosts}, h -> lower(h)) AS h, {has_price} AS p, {has_code} AS k, "
            f"{width} AS w, {height} AS hh, {coverage} AS cov, {layout} AS l)), _c -> {decide})[0]")


# --- layout --------------------------------------------------------------
def _box_rows(boxes: DataFrame) -> DataFrame:
    """Rows of text as islands: a box opens a row if its middle half begins below the middle halves before it.

    Two boxes whose heights overlap by half or more have overlapping middle halves, so they share a row.
    """
    core = boxes.withColumns({"core_top": F.col("top") + (F.col("bottom") - F.col("top")) / 4.0, "core_bottom": F.col("bottom") - (F.col("bottom") - F.col("top")) / 4.0})
    order = Window.partitionBy("capture_id").orderBy("core_top", "core_bottom", "left", "right")
    before = F.max("core_bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = core.withColumn("opens", F.when(F.col("core_top") <= before, 0).otherwise(1))
    numbered = opened.withColumn("row", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("capture_id", "row").agg(
        F.count("*").alias("n"), F.min("left").alias("left"), F.max(F.col("right") - F.col("left")).alias("widest"), F.min("mid").alias("mid"))


def layouts(blocks: DataFrame) -> DataFrame:
    """``(capture_id, layout)`` from text boxes: rows as islands, then counts per screen and one decision.

    Everything is a window or an aggregation by screen; a screen's boxes are the largest group.
    """
    t = lx.LAYOUT
    boxes = blocks.select("capture_id", "left", "top", "right", "bottom", (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"),
                          F.floor((F.col("left") + F.col("right")) / 2).cast("int").alias("mid"))
    share = lambda c: F.count_if(c)
    screen = boxes.groupBy("capture_id").agg(
        F.count("*").alias("boxes"), share(F.col("w").between(*t["receipt_width"])).alias("narrow"),
        share((F.col("mid") > t["middle"]) | F.col("left").between(*t["receipt_left"])).alias("rightish"),
        share((F.col("w") > t["article_width"]) & F.col("h").between(*t["article_height"])).alias("wide"))
    one = Window.partitionBy("capture_id")
    rows = _box_rows(boxes).withColumns({
        "edges": F.count("*").over(one.orderBy("left").rangeBetween(-t["table_edge"], t["table_edge"])), "rows": F.count("*").over(one),
        "by_width": F.row_number().over(one.orderBy("widest", "row")) - 1, "by_left": F.row_number().over(one.orderBy("left", "row")) - 1})
    middle = F.expr("rows div 2")
    rows = rows.withColumn("anchor", F.max(F.when(F.col("by_left") == middle, F.col("left"))).over(one))
    lines = rows.groupBy("capture_id").agg(
        F.count("*").alias("rows"), share(F.col("n") >= t["table_per_row"]).alias("full"), share(F.col("edges") >= 2).alias("aligned"),
        F.max(F.when(F.col("by_width") == middle, F.col("widest"))).alias("widest"), share(F.abs(F.col("left") - F.col("anchor")) <= t["form_edge"]).alias("anchored"))
    talk = _box_rows(boxes.filter(F.col("w").between(*t["chat_width"]) & F.col("h").between(*t["chat_height"])))
    side = (F.col("mid") < t["middle"]).cast("int")
    turns = talk.withColumn("turn", F.coalesce((side != F.lag(side).over(one.orderBy("row"))).cast("int"), F.lit(0)))
    chat = turns.groupBy("capture_id").agg(F.sum("n").alias("talk_boxes"), F.count("*").alias("talk_rows"), share(F.col("n") <= t["chat_per_row"]).alias("short"), F.sum("turn").alias("turns"))
    c = screen.join(lines, "capture_id").join(chat, "capture_id", "left").fillna(0, ["talk_boxes", "talk_rows", "short", "turns"])
    is_chat = (F.col("talk_boxes") >= t["chat_boxes"]) & (F.col("talk_rows") >= t["chat_rows"]) & (F.col("short") >= F.expr("talk_rows * 2 div 3")) & (F.col("turns") >= t["chat_turns"])
    is_table = (F.col("rows") >= t["table_rows"]) & (F.col("full") >= t["table_rows"]) & (F.col("aligned") >= 2)
    is_receipt = (F.col("boxes") >= t["receipt_boxes"]) & (F.col("narrow") >= F.expr("boxes * 2 div 3")) & (F.col("rightish") >= F.expr("boxes div 2"))
    is_form = (F.col("boxes") >= t["form_boxes"]) & (F.col("rows") >= t["form_rows"]) & (F.col("widest") <= t["form_width"]) & (F.col("anchored") >= F.expr("rows * 2 div 3"))
    is_article = (F.col("boxes") >= t["article_boxes"]) & (F.col("wide") >= F.expr("boxes * 2 div 3"))
    return c.select("capture_id", F.when(F.col("boxes") < t["least_boxes"], "NONE").when(is_chat, "CHAT_BUBBLES").when(is_table, "TABLE").when(is_receipt, "RECEIPT_LIKE")
                    .when(is_form, "FORM_LIKE").when(is_article, "ARTICLE").otherwise("NONE").alias("layout"))


# --- similarity ----------------------------------------------------------
def similar_to(visuals: DataFrame, probe: DataFrame, bits: int = SIMILAR_BITS, limit: int = 8) -> DataFrame:
    """Captures within ``bits`` of one probe hash (a one-row frame), nearest first, the probe excluded."""
    one = probe.select(F.col("capture_id").alias("probe_id"), F.col("dhash").alias("ph")).limit(1)
    sql = """SELECT v.capture_id, bit_count(v.dhash ^ (SELECT ph FROM {p})) AS distance FROM {v} v
             WHERE v.capture_id <> (SELECT probe_id FROM {p}) AND bit_count(v.dhash ^ (SELECT ph FROM {p})) <= {bits}"""
    near = visuals.sparkSession.sql(sql, p=one, v=visuals.select("capture_id", "dhash"), bits=bits)
    return near.orderBy("distance", "capture_id").limit(limit)


def _flipped(band: int, part: Column):
    return lambda mask: F.struct(F.lit(band).alias("band"), part.bitwiseXOR(mask).alias("value"))


def _band_keys(dhash: Column, bands: int, radius: int) -> Column:
    """Keys ``(band, value)`` with every value within ``radius`` bit flips of the band's bits."""
    keys = []
    edges = [64 * b // bands for b in range(bands + 1)]
    for b in range(bands):
        width = edges[b + 1] - edges[b]
        part = F.shiftrightunsigned(dhash, edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        masks = [sum(1 << p for p in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]
        keys.append(F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), _flipped(b, part)))
    return F.concat(*keys)


def hamming_pairs(hashes: DataFrame, bits: int = NEAR_DUPLICATE_BITS, bands: int = 5) -> DataFrame:
    """All pairs ``(a, b, distance)``, a < b, of distinct hashes within ``bits``. Nothing is missed.

    With ``bands`` bands two such hashes differ by at most ``bits // bands`` bits in some band. One side
    lists its exact bands, the other also the values that many flips away, so equal keys find every pair.
    More bands mean fewer probe keys but weaker keys; 3 bands suit billions of distinct hashes.
    """
    radius = bits // bands
    distinct = hashes.select("dhash").distinct()
    stored = distinct.select(F.col("dhash").alias("a"), F.explode(_band_keys(F.col("dhash"), bands, 0)).alias("k"))
    probes = distinct.select(F.col("dhash").alias("b"), F.explode(_band_keys(F.col("dhash"), bands, radius)).alias("k"))
    near = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= bits)
    joined = stored.select("a", "k.band", "k.value").join(probes.select("b", "k.band", "k.value"), ["band", "value"]).filter(near)
    return checkpointed(joined.select("a", "b").distinct().withColumn("distance", hamming(F.col("a"), F.col("b"))))  # several readers follow


#: Most hashes with one equal band that one task compares; a larger group is cut by its further equal bands.
GROUP = 1_000_000
#: Most hashes of such a block that one task compares at once; a larger block is cut into stripes of this size that meet in pairs.
STRIPE = 20_000
#: Blocks up to this size are compared many at a time.
FEW = 200
#: Most crowded groups or blocks that are broadcast (40 bytes each); more are joined by shuffle.
CROWDED = 100_000
#: Rows that a task gets, and pairs that it compares at a time.
TASK_ROWS, CELLS = 1_000_000, 1 << 17


def near_links(hashes: DataFrame, bits: int = NEAR_DUPLICATE_BITS, equal: int = 2, stripe: int = STRIPE, group: int | None = None) -> DataFrame:
    """``(dhash, near, nearest, widest, met)`` per distinct hash that has another within ``bits``. No pair is missed, none is stored.

    Of ``bits + equal`` bands, two such hashes agree in at least ``equal``; their first equal band is one of the first ``bits + 1``.
    So a hash is sent to one group per such band and its value, as band and hash alone (9 rows of 9 bytes). Inside a group numpy
    cuts blocks by the further equal bands, and a pair counts only in the block of its first ``equal`` equal bands. A group
    returns one row per linked hash: the number of its links, its nearest and widest one, and the least hash that it reaches inside
    the group. ``met`` holds those, so edges to them have the same components as all links. A group of more than ``group`` hashes
    is dealt out by blocks instead, one row per hash and block. The result isn't stored.
    """
    group = GROUP if group is None else group
    edges = [64 * b // (bits + equal) for b in range(bits + equal + 1)]
    masks = [(1 << edges[b + 1]) - (1 << edges[b]) for b in range(bits + equal)]
    chosen = list(combinations(range(bits + equal), equal))
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    cut = lambda mask: F.col("dhash").bitwiseAND(F.lit(signed(mask)).cast("bigint"))
    distinct = checkpointed(hashes.select("dhash").filter("dhash IS NOT NULL").distinct())
    n, least_tasks = distinct.count(), int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = F.array(*[F.lit(b).cast("byte") for b in range(bits + 1)])
    value = F.get(F.array(*[cut(masks[b]) for b in range(bits + 1)]), F.col("band").cast("int"))
    rows = distinct.select("dhash", F.explode(bands).alias("band"))
    ddl = "dhash long, near long, nearest int, widest int, least long"

    def in_groups(batches):
        held = [(batch.column("band").to_numpy(zero_copy_only=False), batch.column("dhash").to_numpy(zero_copy_only=False)) for batch in batches]
        if held:
            band, codes = (np.concatenate(part) for part in zip(*held))
            held.clear()
            for b in np.unique(band).tolist():
                yield from _grouped(np.sort(codes[band == b]), [c for c in chosen if c[0] == b], masks, bits)

    full = rows.groupBy("band", value.alias("value")).agg(F.count("*").alias("n")).filter(F.col("n") > group).select("band", "value") if n > group else None
    if full is not None:
        full = checkpointed(full)
        n_full = full.count()
        full = F.broadcast(full) if n_full <= CROWDED else full
    if full is None or not n_full:
        whole, found = rows, None
    else:
        valued = rows.withColumn("value", value)
        whole = valued.join(full, ["band", "value"], "left_anti").select("dhash", "band")
        found = _by_blocks(valued.join(full, ["band", "value"], "left_semi").select("dhash", "band"), chosen, masks, bits, cut, stripe, least_tasks, ddl)
    tasks = max(least_tasks, -(-n * (bits + 1) // TASK_ROWS))
    grouped = whole.repartition(tasks, "band", value).mapInArrow(in_groups, ddl)
    found = grouped if found is None else grouped.unionByName(found)
    return found.groupBy("dhash").agg(F.sum("near").alias("near"), F.min("nearest").alias("nearest"), F.max("widest").alias("widest"), F.collect_set("least").alias("met"))


def _by_blocks(rows: DataFrame, chosen: list, masks: list[int], bits: int, cut, stripe: int, least_tasks: int, ddl: str) -> DataFrame:
    """Links of the hashes ``(dhash, band)`` of crowded groups, block by block; crowded blocks are cut into stripes."""
    keys = [F.struct(F.lit(n).alias("choice"), F.lit(c[0]).alias("band_"), cut(sum(masks[b] for b in c)).alias("value")) for n, c in enumerate(chosen)]
    rows = rows.select("dhash", F.inline(F.filter(F.array(*keys), lambda k: k["band_"] == F.col("band")))).drop("band_")
    sizes = checkpointed(rows.groupBy("choice", "value").agg(F.count("*").alias("n")).filter("n > 1"))
    crowded = checkpointed(sizes.filter(F.col("n") > stripe).select("choice", "value", F.ceil(F.col("n") / stripe).cast("int").alias("stripes")))
    # A hash of stripe s goes to the tiles (s, t) and (t, s), t >= s first; an uncut block is the tile (0, 0).
    own = F.pmod(F.xxhash64("dhash"), F.col("stripes")).cast("int")
    dealt = rows.join(F.broadcast(crowded) if crowded.count() <= CROWDED else crowded, ["choice", "value"], "left").withColumn("stripes", F.coalesce("stripes", F.lit(1))).withColumn("own", own)
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).select(
        "choice", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"), "dhash")
    block = ["choice", "value", "low", "high"]
    tasks = max(least_tasks, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // (4 * TASK_ROWS)))
    sent = tiles.repartition(tasks, *block).sortWithinPartitions(*block, "dhash")

    def in_blocks(batches):
        held = None
        for batch in batches:
            table = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*block, "first", "dhash")}
            held = table if held is None else {c: np.concatenate([held[c], table[c]]) for c in table}
            starts = np.flatnonzero(np.any([held[c][1:] != held[c][:-1] for c in block], axis=0)) + 1
            if len(starts):
                yield from _tiled({c: v[:starts[-1]] for c, v in held.items()}, np.concatenate([[0], starts]), chosen, masks, bits)
                held = {c: v[starts[-1]:] for c, v in held.items()}
        if held is not None and len(held["dhash"]):
            yield from _tiled(held, np.array([0, len(held["dhash"])]), chosen, masks, bits)

    return sent.mapInArrow(in_blocks, ddl)


class _Found:
    """Per hash: number of links, nearest and widest one, and the place of the least hash that it reaches by them."""

    def __init__(self, n: int):
        self.near, self.nearest, self.widest, self.least = np.zeros(n, np.int64), np.full(n, 64, np.int32), np.zeros(n, np.int32), np.arange(n)

    def pairs(self, a, b, gap) -> None:
        for end in (a, b):
            np.add.at(self.near, end, 1)
            np.minimum.at(self.nearest, end, gap)
            np.maximum.at(self.widest, end, gap)
        self.join(a, b)

    def join(self, a, b) -> None:
        least = self.least
        while True:
            ra, rb = least[a], least[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(least, np.maximum(ra, rb), np.minimum(ra, rb))
            while (least[least] != least).any():
                least[:] = least[least]

    def add(self, place, part: "_Found") -> None:
        """What a block found, whose hashes lie at ``place``; its joins are left to the caller."""
        self.near[place] += part.near
        self.nearest[place] = np.minimum(self.nearest[place], part.nearest)
        self.widest[place] = np.maximum(self.widest[place], part.widest)

    def batches(self, hashes):
        linked = self.near > 0
        if linked.any():
            columns = [hashes[linked], self.near[linked], self.nearest[linked], self.widest[linked], hashes[self.least[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dhash", "near", "nearest", "widest", "least"])


def _earlier(choice: tuple, masks: list[int]):
    """The bands in which a pair of this choice's blocks differs, or it belongs to another block."""
    return np.array([masks[b] for b in range(choice[-1]) if b not in choice], dtype=np.uint64)


def _grouped(hashes, choices: list, masks: list[int], bits: int):
    """Arrow batches of the linked hashes of the groups of one band; ``hashes`` are sorted and distinct."""
    codes, found = hashes.view(np.uint64), _Found(len(hashes))
    for choice in choices:
        value = codes & np.uint64(sum(masks[b] for b in choice))
        order = np.argsort(value, kind="stable")
        value = value[order]
        starts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
        _compare(codes, order, starts, _earlier(choice, masks), bits, found)
    yield from found.batches(hashes)


def _tiled(rows: dict, starts, chosen: list, masks: list[int], bits: int):
    """Arrow batches of the linked hashes of tiles, sorted by tile and hash; ``starts`` holds where tiles begin, and the end."""
    for n in np.unique(rows["choice"]).tolist():
        at = np.flatnonzero(rows["choice"] == n)
        here, hashes = starts[(starts >= at[0]) & (starts <= at[-1] + 1)] - at[0], rows["dhash"][at]
        codes, found, first = hashes.view(np.uint64), _Found(len(hashes)), rows["first"][at].astype(bool)
        _compare(codes, np.arange(len(codes)), here, _earlier(chosen[n], masks), bits, found, (rows["low"][at] != rows["high"][at], first))
        yield from found.batches(hashes)


def _compare(codes, order, starts, earlier, bits: int, found: _Found, sides=None) -> None:
    """Adds the close pairs inside blocks of ``order``; with ``sides`` (crossed, first) a crossed block's two sides meet."""
    sizes = np.diff(starts)
    crossed = np.zeros(len(sizes), bool) if sides is None else sides[0][starts[:-1]]
    few = (sizes > 1) & (sizes <= FEW) & ~crossed
    if few.any():
        at = np.flatnonzero(np.repeat(few, sizes))
        for a, b, gap in _shifted(codes[order], at, np.repeat(starts[1:], sizes)[at], earlier, bits):
            found.pairs(order[a], order[b], gap)
    joins = []
    large = np.flatnonzero((sizes > 1) & ~few)
    for s, e, x in zip(starts[:-1][large].tolist(), starts[1:][large].tolist(), crossed[large].tolist()):
        place = order[s:e]
        part = _block(codes[place], sides[1][s:e] if x else None, earlier, bits)
        found.add(place, part)
        moved = part.least != np.arange(e - s)
        joins.append((place[moved], place[part.least[moved]]))
    if joins:
        found.join(*(np.concatenate(ends) for ends in zip(*joins)))


def _shifted(codes, at, end, earlier, bits: int):
    """Close pairs inside blocks: every row with the row one, two, ... places later, up to the end of its block."""
    step = 0
    while len(at):
        step += 1
        inside = at + step < end
        at, end = at[inside], end[inside]
        x = codes[at] ^ codes[at + step]
        gap = np.bitwise_count(x)
        close = gap <= bits
        for mask in earlier:
            close &= (x & mask) != 0
        close = np.flatnonzero(close)
        if len(close):
            yield at[close], at[close] + step, gap[close].astype(np.int32)


def _block(codes, first, earlier, bits: int) -> _Found:
    """Close pairs of one block, or of its ``first`` side with the other.

    A pair counts if it differs in all ``earlier`` bands. Where it does, one of the two differs from any third code, here the commonest
    bits; so only hashes meet that differ from it in as many of these bands together. In a flood of near copies few do.
    """
    found, most = _Found(len(codes)), len(earlier)
    bit = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) * 2 > len(codes)
    x = codes ^ np.packbits(bit).view(np.uint64)[0]
    off = np.zeros(len(codes), np.int64)
    for mask in earlier:
        off += (x & mask) != 0
    classes = [np.flatnonzero(off == k) for k in range(most + 1)]
    for i in range(most + 1):
        for j in range(most - i, most + 1) if first is not None else range(max(i, most - i), most + 1):
            left, right = classes[i], classes[j]
            if first is not None:
                left, right = left[first[left]], right[~first[right]]
            if len(left) and len(right):
                _tile(codes, left, right, first is None and i == j, earlier, bits, found)
    return found


def _tile(codes, left, right, same: bool, earlier, bits: int, found: _Found) -> None:
    """Close pairs of two lists of places, strip by strip; each pair once where both are the same list."""
    step = max(32, CELLS // len(right))
    for s in range(0, len(left), step):
        a, b = left[s:s + step], right[s:] if same else right
        x = codes[a][:, None] ^ codes[b][None, :]
        gap = np.bitwise_count(x)
        close = gap <= bits
        if same:
            close[:, :len(a)] &= ~np.tri(len(a), dtype=bool)
        hits = np.count_nonzero(close)
        if hits and hits * 4 >= close.size:  # most cells are links: whole rows and columns
            for mask in earlier:
                close &= (x & mask) != 0
            ones = close.view(np.uint8)
            wide, by = gap * ones, (64 - gap) * ones
            for ends, axis in ((a, 1), (b, 0)):
                found.near[ends] += ones.sum(axis, dtype=np.uint32)
                found.widest[ends] = np.maximum(found.widest[ends], wide.max(axis))
                found.nearest[ends] = np.minimum(found.nearest[ends], 64 - by.max(axis).astype(np.int32))
            rows, columns = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
            found.join(np.concatenate([a[rows], b[columns]]), np.concatenate([b[ones.argmax(1)[rows]], a[ones.argmax(0)[columns]]]))
            close &= found.least[a][:, None] != found.least[b][None, :]
            at, to = np.nonzero(close)
            found.join(a[at], b[to])
        elif hits:
            at = np.flatnonzero(close)
            own = x.ravel()[at]
            for mask in earlier:
                kept = (own & mask) != 0
                at, own = at[kept], own[kept]
            if len(at):
                i, j = np.divmod(at, len(b))
                found.pairs(a[i], b[j], gap.ravel()[at].astype(np.int32))


def near_counts(links: DataFrame) -> DataFrame:
    """``(dhash, near, nearest)``: one row per hash, whatever the size of its neighbourhood."""
    return links.select("dhash", "near", "nearest")


def hashes_of(visuals: DataFrame) -> DataFrame:
    """``(dhash, n, cover_id)``: equal hashes collapse into one row, so a flood of exact copies costs one; stored, several readers follow."""
    return checkpointed(visuals.groupBy("dhash").agg(F.count("*").alias("n"), F.max("capture_id").alias("cover_id")))


def hash_groups(per_hash: DataFrame, links: DataFrame | None = None, bits: int = NEAR_DUPLICATE_BITS) -> DataFrame:
    """Rows of ``hashes_of`` with ``group_hash``, for every hash that has a near duplicate or a copy.

    Components run over the least hashes of blocks alone: a hash joins those that it reached by edges to its own least one, and
    takes that one's component.
    """
    links = checkpointed(near_links(per_hash, bits)) if links is None else links
    edges = links.filter(F.size("met") > 1).select(F.explode("met").alias("b"), F.array_min("met").alias("a")).filter("a <> b").distinct()
    comp = connected_components(edges).select(F.col("node").alias("least"), "component")
    placed = (links.select("dhash", F.array_min("met").alias("least")).join(comp, "least", "left")
              .select("dhash", F.coalesce("component", "least").alias("group_hash")))
    return per_hash.join(placed, "dhash", "left").withColumn("group_hash", F.coalesce("group_hash", F.when(F.col("n") > 1, F.col("dhash")))).filter("group_hash IS NOT NULL")


def near_duplicate_groups(visuals: DataFrame, links: DataFrame | None = None, bits: int = NEAR_DUPLICATE_BITS) -> DataFrame:
    """``(capture_id, dhash, group_hash)`` for every capture with a near duplicate."""
    return visuals.select("capture_id", "dhash").join(hash_groups(hashes_of(visuals), links, bits).select("dhash", "group_hash"), "dhash")


def summarize_groups(groups: DataFrame) -> DataFrame:
    """One row per group of ``hash_groups``: size, cover and number of distinct hashes."""
    return groups.groupBy("group_hash").agg(F.sum("n").alias("size"), F.max("cover_id").alias("cover_id"), F.count("*").alias("n_hashes"))


def link_spread(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Widest link inside each group, in bits."""
    return groups.select("dhash", "group_hash").join(links.select("dhash", "widest"), "dhash").groupBy("group_hash").agg(F.max("widest").alias("max_link_bits"))


def group_diameters(members: DataFrame) -> DataFrame:
    """``(group_hash, max_distance)``: the largest distance between two hashes of a group, exact.

    Four pivots per group: its least hash, the hash farthest from it, the hash farthest from that, and the most central
    one. The pivots' own largest distances are a lower bound; by the triangle inequality two hashes can only beat it if
    their distances from every pivot add up to more. Hashes too near to a pivot to find such a partner are dropped, and
    the rest meet by (group, distance from the central pivot): a hash asks only for the distances that would do. On
    clusters that leaves the outermost shells; a group whose hashes all lie equally far out is compared in full.
    """
    points = checkpointed(members.select("group_hash", "dhash").distinct())
    away = lambda pivot: F.bit_count(F.col("dhash").bitwiseXOR(F.col(pivot)))
    picks = [F.min("dhash"), F.max_by("dhash", F.struct("r0", "dhash")), F.max_by("dhash", F.struct("r1", "dhash")), F.min_by("dhash", F.struct(F.greatest("r1", "r2"), "dhash"))]
    for k, pick in enumerate(picks):
        pivots = points.groupBy("group_hash").agg(pick.alias("pivot"))
        points = checkpointed(points.join(pivots, "group_hash").withColumn(f"r{k}", away("pivot")).drop("pivot"))
    radii = [f"r{k}" for k in range(len(picks))]
    bounds = checkpointed(points.groupBy("group_hash").agg(*[F.max(r).alias(f"most_{r}") for r in radii])
                          .withColumn("lower", F.greatest(*[f"most_{r}" for r in radii])))
    able = points.join(bounds, "group_hash").filter(" AND ".join(f"{r} + most_{r} > lower" for r in radii))
    able = checkpointed(able.select("group_hash", "dhash", *radii, "lower", "most_r3"))
    left = able.withColumn("level", F.explode(
        F.filter(F.sequence(F.lit(0), "most_r3"), lambda j: (j + F.col("r3") > F.col("lower")) & (j >= F.col("r3"))))).drop("most_r3")
    right = able.select(F.col("group_hash").alias("g"), F.col("dhash").alias("other"), *[F.col(r).alias(f"o_{r}") for r in radii])
    gap = F.bit_count(F.col("dhash").bitwiseXOR(F.col("other")))
    far = left.join(right, [F.col("group_hash") == F.col("g"), F.col("level") == F.col("o_r3"), *[F.col(r) + F.col(f"o_{r}") > F.col("lower") for r in radii], gap > F.col("lower")])
    wider = far.groupBy("group_hash").agg(F.max(gap).alias("found"))
    return bounds.join(wider, "group_hash", "left").select("group_hash", F.coalesce("found", "lower").alias("max_distance"))


def copy_from_canonical(captures: DataFrame, visuals: DataFrame) -> DataFrame:
    """Duplicates take over the visuals of their canonical row."""
    cols = [c for c in visuals.columns if c != "capture_id"]
    own = captures.select("capture_id", "duplicate_of").join(visuals, "capture_id", "left")
    source = visuals.select(F.col("capture_id").alias("duplicate_of"), F.struct(*cols).alias("s"), F.lit(True).alias("from_canonical"))
    copies = own.filter(F.col("duplicate_of").isNotNull()).join(source, "duplicate_of", "left")
    rest = own.filter(F.col("duplicate_of").isNull())  # most rows: they need no source and stay where they are
    joined = copies.unionByName(rest.withColumn("s", F.lit(None).cast(source.schema["s"].dataType)).withColumn("from_canonical", F.lit(None).cast("boolean")))
    return joined.select("capture_id", *[F.coalesce(F.col(f"s.{c}"), F.col(c)).alias(c) for c in cols], F.coalesce("from_canonical", F.lit(False)).alias("copied")).filter(F.col(cols[0]).isNotNull())


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixel table of an image folder: Spark's image source decodes, one row per pixel."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    cells = images.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p"))

    def byte(offset: int) -> Column:
        start = F.col("p") * F.col("nChannels") + F.least(F.lit(offset), F.col("nChannels") - 1)
        return F.conv(F.hex(F.substring("data", start + 1, F.lit(1))), 16, 10).cast("int")

    return cells.select(F.xxhash64("origin").alias("capture_id"), (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"),
                        byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def distance_label(bits: Column) -> Column:
    return F.when(bits == 0, "Identical pixels").when(bits <= NEAR_DUPLICATE_BITS, "Near duplicate").when(bits <= 16, "Very similar").otherwise("Similar")

