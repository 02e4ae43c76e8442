"""Action fan-out, validation, comparison and the detail view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: type: (specificity, confirmation, sensitivity)
ACTIONS = {
    "OPEN_URL": (100, "NONE", "NORMAL"), "CALL_PHONE": (100, "SENSITIVE", "SENSITIVE"), "OPEN_MAP": (100, "NONE", "NORMAL"),
    "CREATE_CALENDAR_EVENT": (90, "CONFIRM", "NORMAL"), "SAVE_EXPENSE": (90, "CONFIRM", "NORMAL"), "EMAIL": (80, "CONFIRM", "NORMAL"),
    "CREATE_REMINDER": (80, "CONFIRM", "NORMAL"), "COPY_PHONE": (60, "NONE", "NORMAL"), "COPY_TEXT": (60, "NONE", "NORMAL"), "SEARCH_RELATED": (50, "NONE", "NORMAL"),
}


def candidates(facts: DataFrame) -> DataFrame:
    """Action rows per capture, most specific first.

    ``facts``: capture_id, ocr_text and the arrays urls, phones, emails, addresses, dates, prices and the struct receipt.
    Everything happens inside the row: one explode, no join.
    """
    def act(kind: str, title: str, payload: str, order: str) -> str:
        return f"named_struct('type', '{kind}', 'title', {title}, 'payload', {payload}, 'pos', int({order}))"

    amount, currency = "coalesce(receipt.amount, p.amount)", "coalesce(receipt.currency, p.currency)"
    expense = f"concat(coalesce(receipt.merchant, 'Expense'), ' — ', {currency}, ' ', string({amount}))"
    pairs = [
        f"flatten(transform(slice(urls, 1, 3), (u, i) -> array({act('OPEN_URL', chr(39) + 'Open ' + chr(39) + ' || u.host', 'u.url', 'i')}, {act('COPY_TEXT', repr('Copy URL'), 'u.url', 'i')})))",
        f"flatten(transform(slice(phones, 1, 2), (p, i) -> array({act('CALL_PHONE', chr(39) + 'Call ' + chr(39) + ' || p.normalized', 'p.normalized', 'i')}, {act('COPY_PHONE', repr('Copy phone number'), 'p.normalized', 'i')})))",
        f"transform(slice(emails, 1, 2), (e, i) -> {act('EMAIL', chr(39) + 'Email ' + chr(39) + ' || e', 'e', 'i')})",
        f"transform(slice(addresses, 1, 2), (a, i) -> {act('OPEN_MAP', repr('Open in Maps'), 'a', 'i')})",
        f"flatten(transform(slice(dates, 1, 2), (d, i) -> array({act('CREATE_CALENDAR_EVENT', chr(39) + 'Add ' + chr(39) + ' || d.raw || ' + repr(' to Calendar'), 'string(d.epoch_day * 86400000)', 'i')}, "
        f"{act('CREATE_REMINDER', repr('Create reminder'), 'd.raw', 'i')})))",
        f"transform(slice(prices, 1, 2), (p, i) -> {act('SAVE_EXPENSE', repr('Save expense'), expense, 'i')})",
        f"CASE WHEN trim(ocr_text) <> '' THEN array({act('COPY_TEXT', repr('Copy extracted text'), 'ocr_text', '90')}, {act('SEARCH_RELATED', repr('Ask about this screenshot'), 'string(capture_id)', '91')}) "
        "ELSE CAST(array() AS array<struct<type:string,title:string,payload:string,pos:int>>) END",
    ]
    rows = facts.select("capture_id", F.explode(F.expr(f"concat({', '.join(pairs)})")).alias("a")).select("capture_id", "a.*")
    table = F.create_map(*[x for k, (s, c, v) in ACTIONS.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(c).alias("c"), F.lit(v).alias("v")))])
    info = table[F.col("type")]
    return rows.select("*", info["s"].alias("specificity"), info["c"].alias("confirmation"), info["v"].alias("sensitivity"), F.lit("NONE").alias("permission"))


def validate(actions: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``. Needs title, payload, permission, granted, sensitivity, confirmation."""
    t, p = F.col("type"), F.col("payload")
    filled = (F.when(t == "OPEN_URL", p.startswith("http")).when(t.isin("CALL_PHONE", "COPY_PHONE"), p.rlike("[0-9]")).when(t == "EMAIL", F.contains(p, F.lit("@")))
              .when(t == "SAVE_EXPENSE", p.rlike(r" [A-Z]{3} [0-9.E]*[1-9]")).otherwise(F.trim(p) != ""))
    reason = (F.when(F.trim("title") == "", "Action has no title").when(F.col("capture_id").isNull(), "Action is not tied to a screenshot")
              .when(~F.coalesce(filled, F.lit(False)), "Action payload is incomplete")
              .when((F.col("permission") != "NONE") & ~F.col("granted"), F.concat(F.lit("Permission not granted: "), "permission"))
              .when((F.col("sensitivity") == "HIGHLY_SENSITIVE") & (F.col("confirmation") != "SENSITIVE"), "Highly sensitive action must require confirmation"))
    return actions.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def history(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)


def expenses(prices: DataFrame, receipts: DataFrame) -> DataFrame:
    """Expense rows, filled from the receipt where there is one."""
    first = prices.groupBy("capture_id").agg(F.min_by(F.struct("currency", "amount"), "pos").alias("p"))
    joined = first.join(receipts, "capture_id", "left")
    return joined.select("capture_id", F.coalesce("r.merchant", F.lit("Expense")).alias("merchant"), F.coalesce("r.amount", "p.amount").alias("amount"),
                         F.coalesce("r.currency", "p.currency").alias("currency"), F.col("r.category").alias("category"))


def compare_terms(text: str) -> str:
    return f"array_distinct(filter(split(lower({text}), '[^a-z0-9₹.,]+', -1), w -> length(w) >= 3))"


def compare(pairs: DataFrame, max_terms: int = 20) -> DataFrame:
    """What changed between two captures. ``pairs``: first_id, second_id and the structs a, b (ocr_text, prices, hosts)."""
    shown = "CASE WHEN v % 1 = 0 THEN string(bigint(v)) ELSE string(v) END"
    label = f"CASE c WHEN 'INR' THEN concat('₹', {shown}) WHEN 'USD' THEN concat('$', {shown}) ELSE concat({shown}, ' ', c) END"

    def fmt(amount: str) -> str:
        return label.replace("v %", f"{amount} %").replace("bigint(v)", f"bigint({amount})").replace("string(v)", f"string({amount})")

    of = lambda side: f"transform(filter({side}.prices, p -> p.currency = c), p -> p.amount)"
    moved = (f"transform(filter(array_distinct(transform(concat(a.prices, b.prices), p -> p.currency)), c -> size({of('a')}) = 1 AND size({of('b')}) = 1 AND {of('a')}[0] <> {of('b')}[0]), "
             f"c -> concat('Price ', {fmt(of('a') + '[0]')}, ' → ', {fmt(of('b') + '[0]')}))")
    site = "CASE WHEN size(ha) = 1 AND size(hb) = 1 AND ha[0] <> hb[0] THEN array(concat('Website ', ha[0], ' → ', hb[0])) ELSE CAST(array() AS array<string>) END"
    keys = lambda side: f"array_distinct(transform({side}.prices, p -> concat(p.currency, ' ', string(p.amount))))"
    rows = pairs.selectExpr("first_id", "second_id", "a", "b", f"{keys('a')} AS pa", f"{keys('b')} AS pb", "array_distinct(a.hosts) AS ha", "array_distinct(b.hosts) AS hb",
                            f"{compare_terms('a.ocr_text')} AS ta", f"{compare_terms('b.ocr_text')} AS tb")
    return rows.selectExpr(
        "first_id", "second_id", "array_sort(array_except(pa, pb)) AS only_first_prices", "array_sort(array_except(pb, pa)) AS only_second_prices",
        "array_sort(array_except(ha, hb)) AS only_first_hosts", "array_sort(array_except(hb, ha)) AS only_second_hosts",
        f"slice(array_sort(array_except(tb, ta)), 1, {max_terms}) AS added", f"slice(array_sort(array_except(ta, tb)), 1, {max_terms}) AS removed", f"concat({moved}, {site}) AS changes")


def detail(captures: DataFrame, facts: Column) -> DataFrame:
    """One row per capture with all its facts: prices highest first, dates oldest first."""
    rows = captures.select("capture_id", "filename", facts.alias("f"))
    return rows.selectExpr("capture_id", "filename", "array_sort(f.prices, (x, y) -> CASE WHEN x.amount > y.amount THEN -1 WHEN x.amount < y.amount THEN 1 ELSE 0 END) AS prices",
                           "f.urls AS urls", "f.phones AS phones", "f.codes AS codes", "array_sort(f.dates, (x, y) -> CASE WHEN x.epoch_day < y.epoch_day THEN -1 WHEN x.epoch_day > y.epoch_day THEN 1 ELSE 0 END) AS dates",
                           "f.receipt AS receipt")


