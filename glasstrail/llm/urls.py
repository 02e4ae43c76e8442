"""URL filters: fixed rules first, then a path-template tree per host judged by smoothed labelled purity.

Every run of digits in a path becomes ``{n}``, so pages collapse to (host, three segments) with counts before any
shuffle. Level by level below its host:

* a parent with over ``fanout`` distinct children loses the rare ones to the wildcard ``*``;
* branches whose labelled purity can't be told from their parent's (two standard errors) merge into the branch ``~``.

Labels are the pages that a rule decides. The blocked share of a node is smoothed towards its parent's, the root's towards
one half: (blocked + strength * parent) / (labelled + strength). Pages no rule fits are blocked if their template's
smoothed share is at least ``limit``.

A null url, or one without ``://``, has an empty host and path and is judged by the root. In a path of more than three
segments, the third and all deeper ones form one tail: paths that differ only there get one verdict. Repeated pages count as often as they stand.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed

#: (verdict, host, path), the longest first. Fixed values.
RULES = (("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "org", "/"))
FANOUT, STRENGTH, LIMIT, SALTS = 32, 4.0, 0.5, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, TAIL = "<end>", "<tail>"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``host`` and ``path`` of each page."""
    address = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substr(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    address = F.coalesce(address, F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(address, "^[^/?#]*", 0), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1))


def fixed_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name = verdict = None
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, F.lit(host + path)) if name is None else name.when(fits, F.lit(host + path))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return name, verdict


def with_template(pages: DataFrame) -> DataFrame:
    parts = F.split(F.regexp_replace("path", "[0-9]+", "{n}"), "/")
    third = F.when(F.size(parts) > 4, F.lit(TAIL)).otherwise(F.coalesce(F.get(parts, 3), F.lit(END)))
    return pages.withColumn("s1", F.coalesce(F.get(parts, 1), F.lit(END))).withColumn("s2", F.coalesce(F.get(parts, 2), F.lit(END))).withColumn("s3", third)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]



def _level(templates: DataFrame, parent: list[str], segment: str, branch: str, fanout: int) -> DataFrame:
    """``templates`` with ``branch``, the generalised and merged form of ``segment`` below the columns of ``parent``."""
    children = checkpointed(templates.groupBy(*parent, segment).agg(*_sums()))
    above = children.groupBy(*parent).agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"),
                                          F.sum("blocked").alias("all_blocked"))
    wild = (F.col("kids") > fanout) & (F.col("n") * fanout < F.col("all_n"))
    named = checkpointed(children.join(above, parent).withColumn("form", F.when(wild, F.lit("*")).otherwise(F.col(segment))))
    pool = F.try_divide(F.col("all_blocked"), F.col("all_labelled"))
    near = F.abs(F.try_divide(F.col("blocked"), F.col("labelled")) - pool) <= 2 * F.sqrt(F.try_divide(pool * (1 - pool), F.col("labelled")))
    forms = named.groupBy(*parent, "form").agg(*_sums(), F.max("all_labelled").alias("all_labelled"), F.max("all_blocked").alias("all_blocked"))
    forms = forms.select(*parent, "form", F.when((F.col("labelled") == 0) | near, F.lit("~")).otherwise(F.col("form")).alias(branch))
    mapping = named.select(*parent, segment, "form").join(forms, [*parent, "form"]).drop("form")
    return templates.join(mapping, [*parent, segment])


def template_shares(templates: DataFrame, fanout: int = FANOUT, strength: float = STRENGTH) -> DataFrame:
    """``(host, s1, s2, s3, template, share)``: smoothed blocked share of every template's deepest node."""
    root = templates.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).select(
        ((F.col("b") + strength * 0.5) / (F.col("l") + strength)).alias("share"))
    out = templates
    parent = ["host"]
    hosts = templates.groupBy("host").agg(*_sums()).crossJoin(F.broadcast(root))  # one row
    smooth = (F.col("blocked") + strength * F.col("share")) / (F.col("labelled") + strength)
    shares = checkpointed(hosts.select("host", smooth.alias("share")))
    for i in (1, 2, 3):
        out = checkpointed(_level(out, parent, f"s{i}", f"b{i}", fanout))
        nodes = out.groupBy(*parent, f"b{i}").agg(*_sums()).join(shares, parent)
        parent = [*parent, f"b{i}"]
        shares = checkpointed(nodes.select(*parent, smooth.alias("share")))
    return out.join(shares, parent).select("host", "s1", "s2", "s3", F.concat_ws("/", F.lit(""), "b1", "b2", "b3").alias("template"), "share")


def judged(pages: DataFrame, url: str = "url", rules=RULES, fanout: int = FANOUT, strength: float = STRENGTH, limit: float = LIMIT) -> DataFrame:
    """Pages with ``host``, ``path``, ``rule``, ``template``, ``blocked_share`` and ``verdict``."""
    rule, fixed = fixed_rule(rules)
    parted = with_template(with_parts(pages, url)).withColumn("rule", rule).withColumn("fixed", fixed)
    templates = checkpointed(parted.groupBy("host", "s1", "s2", "s3").agg(
        F.count(F.lit(1)).alias("n"), F.count("fixed").alias("labelled"), F.count(F.when(F.col("fixed") == "block", 1)).alias("blocked")))
    shares = checkpointed(template_shares(templates, fanout, strength))
    salted = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a template may hold a third of all pages
    own = F.pmod(F.xxhash64(f"`{url}`", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    met = parted.withColumn("salt", own).join(salted, ["host", "s1", "s2", "s3", "salt"])
    verdict = F.coalesce("fixed", F.when(F.col("share") >= limit, F.lit("block")).otherwise(F.lit("allow")))
    return met.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "template", "blocked_share", "verdict")], "host", "path", "rule",
                      "template", F.col("share").alias("blocked_share"), verdict.alias("verdict"))


ORACLE_SQL = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(what, h, p) AS (VALUES ('block', 'example.org', '/en/1'), ('block', 'example.org', '/es/'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'), ('allow', 'org', '/')),
hit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(what, length(h || p)) AS fixed
        FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
c AS (SELECT b.*, rule, fixed, string_split(regexp_replace(path, '[0-9]+', '{n}', 'g'), '/') AS seg FROM b LEFT JOIN hit USING (page_id)),
t AS (SELECT page_id, host, path, rule, fixed, coalesce(seg[2], '<end>') AS s1, coalesce(seg[3], '<end>') AS s2,
        CASE WHEN len(seg) > 4 THEN '<tail>' ELSE coalesce(seg[4], '<end>') END AS s3 FROM c),
agg AS (SELECT host, s1, s2, s3, count(*) AS n, count(fixed) AS l, count(*) FILTER (fixed = 'block') AS k FROM t GROUP BY ALL),
root AS (SELECT (coalesce(sum(k), 0) + 2.0::DOUBLE) / (coalesce(sum(l), 0) + 4.0::DOUBLE) AS share FROM agg),
h0 AS (SELECT host, (sum(k) + 4.0::DOUBLE * (SELECT share FROM root)) / (sum(l) + 4.0::DOUBLE) AS p0 FROM agg GROUP BY host),
{levels}
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN p3 >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN l3 USING (host, s1, s2, s3) JOIN h3 USING (host, b1, b2, b3)
"""


def _oracle_level(i: int) -> str:
    """One level of the tree in the SQL counterpart, by windows instead of joins."""
    before = "agg" if i == 1 else f"l{i - 1}"
    parent = ", ".join(["host", *[f"b{j}" for j in range(1, i)]])
    return f"""
k{i} AS (SELECT {parent}, s{i}, sum(n) AS n, sum(l) AS l, sum(k) AS k FROM {before} GROUP BY ALL),
w{i} AS (SELECT *, CASE WHEN count(*) OVER pp > 32 AND n * 32 < sum(n) OVER pp THEN '*' ELSE s{i} END AS form, sum(l) OVER pp AS al, sum(k) OVER pp AS ak
        FROM k{i} WINDOW pp AS (PARTITION BY {parent})),
f{i} AS (SELECT {parent}, form, sum(l)::DOUBLE AS l, sum(k)::DOUBLE AS k, (max(ak) / nullif(max(al), 0)::DOUBLE) AS pool FROM w{i} GROUP BY {parent}, form),
g{i} AS (SELECT {parent}, form, CASE WHEN l = 0 OR abs(k / l - pool) <= 2 * sqrt(pool * (1 - pool) / l) THEN '~' ELSE form END AS b{i} FROM f{i}),
m{i} AS (SELECT {parent}, s{i}, b{i} FROM w{i} JOIN g{i} USING ({parent}, form)),
l{i} AS (SELECT {before}.*, b{i} FROM {before} JOIN m{i} USING ({parent}, s{i})),
h{i} AS (SELECT {parent}, b{i}, (sum(k) + 4.0::DOUBLE * any_value(p{i - 1})) / (sum(l) + 4.0::DOUBLE) AS p{i} FROM l{i} JOIN h{i - 1} USING ({parent}) GROUP BY {parent}, b{i})"""


def oracle_sql() -> str:
    return ORACLE_SQL.replace("{levels}", ",".join(_oracle_level(i) for i in (1, 2, 3)))
