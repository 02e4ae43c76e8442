"""Tunable weights and limits. Pass another instance to change a ranking."""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RelevanceWeights:
    exact_phrase: int = 100
    all_terms: int = 60
    most_terms: int = 40
    price_exact: int = 50
    price_approximate: int = 30
    url_match: int = 40
    phone_match: int = 50
    code_match: int = 50
    date_match: int = 30
    filename_match: int = 20
    text_match: int = 10
    recency_max: int = 6
    most_terms_ratio: float = 0.6


@dataclass(frozen=True)
class HybridWeights:
    lexical: float = 0.40
    semantic: float = 0.25
    metadata: float = 0.20
    visual: float = 0.10
    entity: float = 0.05
    lexical_ceiling: float = 256.0

    @property
    def total(self) -> float:
        return self.lexical + self.semantic + self.metadata + self.visual + self.entity


@dataclass(frozen=True)
class EvidenceWeights:
    engine: float = 0.5
    entity: float = 0.25
    temporal: float = 0.15
    graph: float = 0.10
