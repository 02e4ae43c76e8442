"""Markdown markers removed from recognised text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Applied in this order, line by line where anchored.
STEPS = [
    (r"(?m)^ *```.*$\n?", ""),
    (r"(?m)^ *>+ *", "▌ "),
    (r"(?m)^((?:▌ )?) *[-*+] ", "$1• "),
    (r"(?m)^((?:▌ )?(?:• )?)#{1,6}\s+", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"\*\*\*(.+?)\*\*\*", "$1"),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"\[([^\]\n]+)\]\([^)\n]+\)", "$1"),
]


def strip(text: Column) -> Column:
    for pattern, replacement in STEPS:
        text = F.regexp_replace(text, pattern, replacement)
    return text
