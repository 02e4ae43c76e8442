"""Sensitive content: kinds, levels and redaction."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import lexicon as lx
from .base import compact, contains_any, let

PII = [("Email", lx.EMAIL), ("Phone number", lx.PHONE), ("Card number", lx.CARD), ("PAN", lx.PAN),
       ("Aadhaar", lx.NATIONAL_ID), ("UPI ID", lx.UPI), ("OTP/code", lx.SHORT_CODE)]
REDACTIONS = [(lx.EMAIL, "<email redacted>"), (lx.PHONE, "<phone redacted>"), (lx.CARD, "<card redacted>"),
              (lx.PAN, "<PAN redacted>"), (lx.NATIONAL_ID, "<ID redacted>"), (lx.UPI, "<UPI redacted>"), (lx.SHORT_CODE, "••••")]
DESCRIPTIONS = {
    "AUTHENTICATION": "authentication code", "FINANCIAL": "financial information", "IDENTITY": "identity document",
    "PRIVATE_COMMUNICATION": "private message", "SENSITIVE": "sensitive content",
    "HIGHLY_SENSITIVE": "highly sensitive content", "PERSONAL": "personal information", "PUBLIC": "content",
}
HIGH_LEVELS = ["AUTHENTICATION", "FINANCIAL", "IDENTITY", "HIGHLY_SENSITIVE"]


def sensitive_kinds(text: Column) -> Column:
    return compact(*[F.when(text.rlike(p), F.lit(k)) for k, p in lx.KIND_PATTERNS])


def classify(text: Column, has_prices: Column | None = None, has_code: Column | None = None,
             has_receipt: Column | None = None, entities: Column | None = None) -> Column:
    """Level, reasons and confidence. Rules run in order; a later rule may override the level."""
    no = F.lit(False)
    low = F.lower(text)
    financial = (has_prices if has_prices is not None else no) | text.rlike(lx.TRANSACTION_ID)
    # (condition, level, only when still public, reason, confidence, confidence is a minimum)
    rules = [
        ((has_code if has_code is not None else no) | text.rlike(lx.CODE_LABELLED) | text.rlike(lx.SIX_DIGITS), "AUTHENTICATION", False, "OTP/verification code detected", 0.9, False),
        (text.rlike(lx.PASSWORD), "AUTHENTICATION", False, "Password-like content detected", 0.85, False),
        (text.rlike("(?i)" + lx.UPI), "FINANCIAL", False, "UPI ID detected", 0.9, False),
        (text.rlike(lx.CARD), "FINANCIAL", False, "Card number pattern detected", 0.85, False),
        (text.rlike(lx.ACCOUNT_NUMBER) & text.rlike(lx.IFSC), "FINANCIAL", False, "Bank account details detected", 0.9, False),
        (financial, "FINANCIAL", True, "Financial information detected", 0.6, True),
        (has_receipt if has_receipt is not None else no, "FINANCIAL", False, "Receipt/financial document detected", 0.8, False),
        (text.rlike(lx.NATIONAL_ID), "IDENTITY", False, "Aadhaar-like number detected", 0.9, False),
        (text.rlike(lx.PAN), "IDENTITY", False, "PAN-like identifier detected", 0.9, False),
        (text.rlike(lx.EMAIL), "PERSONAL", True, "Email address detected", 0.6, True),
        (text.rlike(lx.PHONE), "PERSONAL", True, "Phone number detected", 0.6, True),
        (contains_any(low, lx.COMMUNICATION_WORDS), "PRIVATE_COMMUNICATION", False, "Private communication detected", 0.7, False),
    ]
    if entities is not None:
        named = F.exists(entities, lambda e: F.lower(e).rlike("otp|password"))
        none_before = ~_any_of([r[0] for r in rules])
        rules.append((none_before & named, "AUTHENTICATION", False, "Sensitive entity detected", 0.7, False))

    def fold(st: Column) -> Column:
        level, confidence, reasons = F.lit("PUBLIC"), F.lit(0.5), []
        for k, (_, to, only_public, reason, c, minimum) in enumerate(rules):
            hit = st[f"r{k}"]
            level = F.when(hit & (level == "PUBLIC"), to).otherwise(level) if only_public else F.when(hit, to).otherwise(level)
            confidence = F.when(hit, F.greatest(confidence, F.lit(c)) if minimum else F.lit(c)).otherwise(confidence)
            reasons.append(F.when(hit, F.lit(reason)))
        return F.struct(level.alias("level"), compact(*reasons).alias("reasons"), confidence.alias("confidence"))

    return let(fold, **{f"r{k}": r[0] for k, r in enumerate(rules)})


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def is_high(level: Column) -> Column:
    return level.isin(HIGH_LEVELS)


def describe(level: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in DESCRIPTIONS.items() for v in kv])[level]


def redact(text: Column) -> Column:
    """Replace sensitive runs, most specific first, in this order."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def pii_types(text: Column) -> Column:
    return compact(*[F.when(text.rlike(p), F.lit(k)) for k, p in PII])


def sensitivity_level(kinds: Column) -> Column:
    high = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ("BANKING", "IDENTITY", "PASSWORD")]))
    return F.when(high, "HIGHLY_SENSITIVE").when(F.size(kinds) > 0, "SENSITIVE").otherwise("NORMAL")
