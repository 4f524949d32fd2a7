"""Defaults of the operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantic:
    days: int = 30
    min_support: float = 0.05
    min_confidence: float = 0.3
    max_neighborhoods: int = 15
    tests: bool = True
    docs: bool = False
    configs: bool = False


@dataclass(frozen=True)
class Integration:
    git: float = 0.6
    dependency: float = 0.3
    structural: float = 0.1
    min_combined: float = 0.4
    max_neighborhoods: int = 15


@dataclass(frozen=True)
class Diff:
    similarity: float = 0.7
    rename: float = 0.8
    confidence: float = 0.5


@dataclass(frozen=True)
class Incremental:
    batch: int = 5
    debounce_ms: int = 500


@dataclass(frozen=True)
class Compact:
    strategy: str = "hybrid"
    most: int = 10_000
    adaptive: bool = True
