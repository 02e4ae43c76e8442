"""Currency lookup and formatting."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..lexicon import CURRENCY_SYMBOLS, CURRENCY_WORDS


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def resolve_currency(marker: Column) -> Column:
    return F.try_element_at(_literal_map(CURRENCY_WORDS), F.lower(F.trim(marker)))


def currency_symbol(currency: Column) -> Column:
    return F.try_element_at(_literal_map(CURRENCY_SYMBOLS), F.coalesce(currency, F.lit("")))


def indian_grouping(digits: Column) -> Column:
    """``1234567`` to ``12,34,567``; a fraction after the dot is kept."""
    whole = F.substring_index(digits, ".", 1)
    fraction = F.when(F.instr(digits, ".") > 0, F.concat(F.lit("."), F.substring_index(digits, ".", -1))).otherwise("")
    head = F.reverse(
        F.regexp_replace(F.reverse(F.left(whole, F.greatest(F.length(whole) - 3, F.lit(0)))), r"(\d{2})(?=\d)", "$1,"))
    return F.when(F.length(whole) <= 3, digits).otherwise(
        F.concat(head, F.lit(","), F.right(whole, F.lit(3)), fraction))


def plain_amount(amount: Column) -> Column:
    """Whole amounts without a fraction, others with two places."""
    cents = F.format_string("%.2f", amount)
    return F.when(amount % 1 == 0, amount.cast("bigint").cast("string")).when(amount.isNotNull(), cents)


def format_money(currency: Column, amount: Column) -> Column:
    return shown_amount(currency, indian_grouping(plain_amount(amount)))


def shown_amount(currency: Column, grouped: Column) -> Column:
    symbol = currency_symbol(currency)
    return (F.when(currency.isNull(), grouped)
            .when(symbol.isNotNull(), F.concat(symbol, grouped))
            .otherwise(F.concat(grouped, F.lit(" "), currency)))
