"""Main text of HTML pages by a site style tree.

The DOMs of a host's pages are merged into one tree: elements with equal paths of (tag, classes) are one node. For every
node, over the ``m`` different pages that have it:

* presentation: its style in a page is the set of its children's orders; the entropy of the styles, to the base m, times
  ``1 - 0.9 ** styles``;
* content: 1 less the mean entropy of its texts over the pages. A text found on every page counts nothing, one found on
  one page counts fully.

A branch is as important as its most important node, and a branch below ``limit`` is removed from each page. Pages with the
same texts are one page here, so that copies of a page don't make its text look like a part of the site. Nodes on fewer than
``least_pages`` pages are not judged, nor are elements without a class of their own inside an article.

Entropy alone rates menus and adverts as content where every page has other ones, so fixed words of tags, classes, ids and
roles decide first: branches named as menus, headers, footers, sidebars, notices, adverts, forms or comments go. If
anything is left in an ``article``, the text is that; else that of ``main``; else what the tree leaves, and if the tree
leaves nothing, what it removed.

The merged trees are aggregated as rows (node, text or style); no host's pages meet in a task. A page is parsed twice, in
its own row. Elements deeper than ``DEPTH`` belong to their ancestor's node; texts of any depth and length are read.

A null html is empty and has the empty text. A null url, or one without ``://``, belongs to the empty host. Repeated and
null page ids are rows of their own. Any other column is carried.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, small_side
from .urls import with_parts

LIMIT, LEAST_PAGES, DEPTH, DAMPING = 0.2, 8, 12, 0.9

# What HTML's elements mean, and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(("a abbr acronym b bdi bdo big br button cite code data del dfn em embed font i img input ins kbd label link mark meta meter nobr output progress q "
                    "rp rt ruby s samp script select small span strike strong style sub sup svg textarea time tt u var wbr").split())
ENDS_P = frozenset(("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
                    "li main menu nav ol p pre search section summary table td th tr tbody thead tfoot ul dd dt").split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "p": ({"p"}, {"table", "td", "th", "button", "caption"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
P_SCOPE = frozenset("table td th button caption".split())
TABLE_SCOPE, ENDS_TABLE = frozenset("td th table".split()), frozenset("table tr tbody thead tfoot td th body html article main".split())
NOISE_TAGS = frozenset(("head nav aside footer form script style noscript template iframe object svg canvas button select datalist textarea input dialog menu audio video map title "
                        "xmp noembed noframes").split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NOISE_WORDS = frozenset(("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promos promotion banner banners sidebar sidebars aside nav navbar "
                         "navigation menu menus breadcrumb breadcrumbs masthead footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup "
                         "newsletter subscribe signup login search searchbox share sharing social related recommended recommendations pagination pager copyright disclaimer form").split())
HEADER_WORDS = frozenset("header headers topbar".split())
ARTICLE_NOISE = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser".split())
LAYOUT_WORDS = frozenset("has with no without".split())

OPEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>)""", re.S)
PLAIN_OPEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _traits(tag: str, attributes: str) -> tuple[str, bool, bool, frozenset]:
    """Label of an element, whether it is named as noise, whether it has a class of its own, and its words."""
    label, role, words, hidden = tag, "", (), False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name == "role":
            role = value.strip().lower()
        elif name == "hidden":
            hidden = True
        else:
            words += tuple(w.lower() for w in WORD.findall(value))
    if words:
        label = f"{tag}.{'.'.join(sorted(set(words)))}"
    found = frozenset(words)
    noise = hidden or tag in NOISE_TAGS or role in NOISE_ROLES
    if not noise and found and tag not in ("html", "body", "main") and not found & LAYOUT_WORDS:
        noise = bool(found & (ARTICLE_NOISE if tag == "article" else NOISE_WORDS))
    return label, noise, bool(words), found | {f"role={role}"} if role else found


class _Open:
    __slots__ = ("tag", "key", "label", "noise", "form", "scope", "judged", "removed", "kids", "up")

    def __init__(self, tag: str, key: int, label: str, noise: bool, form: bool, scope: int, judged: bool, removed: bool, up: tuple):
        self.tag, self.key, self.label, self.noise, self.form, self.scope, self.judged, self.removed, self.up = tag, key, label, noise, form, scope, judged, removed, up
        self.kids: list[str] = []


def walk(page: str, host: int, removed: frozenset = frozenset(), nodes: dict | None = None) -> list[tuple[int, bool, str]]:
    """Blocks of a page outside named noise, in page order: (scope, whether the tree removes it, text). Scope is 2 inside an
    article, 1 inside main, 0 elsewhere. ``nodes`` collects, per merged node, ancestors, child orders and texts."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    blocks: list[tuple[int, bool, str]] = []
    run: list[str] = []
    run_scope, run_removed = 0, False
    stack = [_Open("", host, "", False, False, 0, False, False, ())]
    traits: dict[tuple[str, str], tuple] = {}
    opened: dict[str, int] = {}  # open elements by tag: no search for what isn't open
    at, end, opener = 0, len(page), OPEN

    def flush() -> None:
        nonlocal run
        if run:
            text = " ".join("".join(run).split())
            if text:
                blocks.append((run_scope, run_removed, text))
            run = []

    def close(keep: int) -> None:
        while len(stack) > keep:
            e = stack.pop()
            opened[e.tag] -= 1
            if e.tag not in INLINE:
                flush()
            if nodes is not None and not e.noise and len(stack) <= DEPTH:
                nodes.setdefault(e.key, (e.up, e.judged, set(), set()))[2].add(" ".join(e.kids))

    def text(raw: str) -> None:
        nonlocal run_scope, run_removed
        top = stack[-1]
        if top.noise or not raw:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        if top.scope != run_scope or top.removed != run_removed:
            flush()
            run_scope, run_removed = top.scope, top.removed
        run.append(raw)
        if nodes is not None and not raw.isspace():
            if not top.kids or top.kids[-1] != "#":
                top.kids.append("#")
            nodes.setdefault(top.key, (top.up, top.judged, set(), set()))[3].add(" ".join(raw.split()))

    while at < end:
        cut = page.find("<", at)
        if cut < 0:
            text(page[at:])
            break
        m = opener.match(page, cut)
        if m is None:
            following = page[cut + 1:cut + 2]
            if opener is OPEN and (following.isalpha() or following == "/"):
                m = PLAIN_OPEN.match(page, cut)  # a quote or a tag that never ends: quotes count nothing from here on
                opener = PLAIN_OPEN
            if m is None:  # a mere character
                text(page[at:cut + 1])
                at = cut + 1
                continue
        if cut > at:
            text(page[at:cut])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] and tag != "br":  # an end tag of br is a br
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1 if opened.get(tag) else 0, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag not in INLINE if tag in INLINE else stack[i].tag in TABLE_SCOPE and tag not in ENDS_TABLE:
                    break
            continue
        if opened.get("p") and tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in P_SCOPE:
                    break
        if tag in CLOSES:
            ended, scope = CLOSES[tag]
            last = None
            for i in range(len(stack) - 1 if any(map(opened.get, ended)) else 0, 0, -1):
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ended:
                    last = i
            if last is not None:
                close(last)
        if tag == "body" and opened.get("head"):  # an open head ends here
            for i in range(1, len(stack)):
                if stack[i].tag == "head":
                    close(i)
                    break
        if tag not in INLINE:
            flush()
        top = stack[-1]
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            continue
        known = (tag, m[3])
        if known not in traits:
            traits[known] = _traits(tag, m[3])
        label, noise, styled, words = traits[known]
        scope = 2 if tag == "article" or "role=article" in words else max(top.scope, 1) if tag == "main" or "role=main" in words else top.scope
        form = top.form
        if not noise and not top.scope and (tag == "header" or words & HEADER_WORDS and tag not in ("html", "body", "main", "article") and not words & LAYOUT_WORDS):
            noise = True
        if top.noise:
            noise = noise or not (top.form and scope > top.scope)  # a form may wrap a whole page
            form = form and noise
        elif noise:
            form = tag == "form"
        if len(stack) <= DEPTH:
            key = digest(f"{top.key} {label}") - (1 << 63)
            up = (*top.up, key)
            judged = not scope or styled and tag not in ("article", "main")
        else:
            key, up, judged = top.key, top.up, top.judged
        if nodes is not None and not top.noise and not noise and (not top.kids or top.kids[-1] != label):
            top.kids.append(label)
        if tag in RAW:
            found = _RAW_ENDS[tag].search(page, at)
            at = found.start() if found else end
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(_Open(tag, key, label, noise, form, scope, judged, top.removed or key in removed, up))
    close(1)
    flush()
    return blocks


def extracted(page: str, host: int = 0, removed: frozenset = frozenset()) -> str:
    """Main text of one page, its blocks joined by line ends."""
    blocks = walk(page, host, removed)
    scope = max((s for s, gone, _ in blocks if not gone), default=max((s for s, _, _ in blocks), default=0))
    inside = [b for b in blocks if b[0] == scope]
    return "\n".join(t for _, gone, t in inside if not gone) or "\n".join(t for _, _, t in inside)


FEATURES_DDL = "host string, node bigint, kind int, feature bigint, page bigint, up array<bigint>"
FEATURES = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("page", pa.int64()), ("up", pa.list_(pa.int64()))])


def _host_key(host: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(host)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part, rows = batch.slice(start, 500), set()
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                nodes: dict = {}
                walk(page or "", _host_key(host), nodes=nodes)
                same = digest("|".join(sorted(t for n in nodes.values() for t in n[3])))
                for key, (up, judged, orders, texts) in nodes.items():
                    rows.add((host, key, 0 if judged else 1, digest("|".join(sorted(orders))), same, up))
                    rows.update((host, key, 2, digest(t), same, None) for t in texts)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FEATURES)], schema=FEATURES)


def removed_nodes(pages: DataFrame, limit: float = LIMIT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``(host, removed)``: the merged nodes that each host's pages lose, from pages (host, html)."""
    rows = pages.select("host", "html").mapInArrow(_features, FEATURES_DDL)
    spread = rows.groupBy("node", "kind", "feature", "page").agg(F.min("host").alias("host"), F.min("up").alias("up"))
    features = spread.groupBy("node", "kind", "feature").agg(F.count(F.lit(1)).alias("c"), F.min("host").alias("host"), F.min("up").alias("up"))
    style, content = F.col("kind") < 2, F.col("kind") == 2
    weight = F.col("c") * F.ln("c")
    nodes = features.groupBy("node").agg(
        F.min("host").alias("host"), F.min("up").alias("up"), F.max(F.col("kind") == 0).alias("judged"), F.sum(F.when(style, F.col("c"))).alias("m"),
        F.coalesce(F.sum(F.when(style, weight)), F.lit(0.0)).alias("spread_styles"), F.count(F.when(style, True)).alias("styles"), F.count(F.when(content, True)).alias("texts"),
        F.coalesce(F.sum(F.when(content, F.ln("c"))), F.lit(0.0)).alias("spread_texts"))
    base = F.ln("m")
    presentation = F.when(F.col("m") > 1, (base - F.col("spread_styles") / F.col("m")) / base * (1 - F.pow(F.lit(DAMPING), "styles"))).otherwise(1.0)
    content_share = F.when(F.col("texts") == 0, 0.0).when(F.col("m") > 1, 1 - F.col("spread_texts") / (F.col("texts") * base)).otherwise(1.0)
    judged = checkpointed(nodes.select("host", "node", "up", "judged", "m", F.greatest(presentation, content_share).alias("importance")))
    branches = judged.select(F.explode("up").alias("node"), "importance").groupBy("node").agg(F.max("importance").alias("most"))
    low = judged.filter(F.col("judged") & (F.col("m") >= least_pages)).join(branches, "node").filter(F.col("most") < limit)
    return low.groupBy("host").agg(F.collect_set("node").alias("removed"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, limit: float = LIMIT, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The kept columns (all by default) with ``text`` and ``n_chars``; kept columns of these names are replaced."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    plain = with_parts(pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)])).drop("path", "url")
    removed = small_side(checkpointed(removed_nodes(plain, limit, least_pages)))
    source = plain.join(removed, "host", "left").select(*[f"own_{i}" for i in range(len(kept))], "host", "html", "removed")
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                known: dict[str, frozenset] = {}
                texts = []
                for host, page, gone in zip(*(part.column(n + i) for i in range(3))):
                    host = host.as_py()
                    if host not in known:
                        known[host] = frozenset(gone.as_py() or ())
                    texts.append(extracted(page.as_py() or "", _host_key(host), known[host]))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*[f"own_{i}" for i in range(n)], "text", "n_chars"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]
    found = source.mapInArrow(run, ", ".join([*kinds, "text string, n_chars bigint"]))
    return found.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)], "text", "n_chars")


def oracle_sql() -> str:
    """DuckDB SQL for pages whose main text is one ``article`` of headings, paragraphs and inline elements, as in the given table."""
    return r"""
WITH cut AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'),
    '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g'), chr(1)) AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '&#x27;', ''''), '\s+', ' ', 'g'))) AS parts FROM cut),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
