"""Metrics, limits and search options, with their validation."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from enum import Enum

from .errors import EngineError, invalid

MAX_DIMENSIONS, MAX_EF, MAX_GENERATION_K, MAX_SQ8_CANDIDATES = 4096, 4096, 10_000, 65_536
MAX_METADATA_BYTES, MAX_TEXT_BYTES, MAX_SOURCE_BYTES, MAX_TAG_BYTES, MAX_TAGS = 16 << 10, 6000, 1024, 128, 32
MAX_BATCH_OPS, MAX_CONTEXT_RADIUS, MAX_PAGE = 1024, 3, 256


class Metric(Enum):
    SQUARED_L2 = "squared_l2"
    COSINE = "cosine"
    INNER_PRODUCT = "inner_product"


@dataclass(frozen=True)
class Space:
    """Identity of an embedding space; all of it must agree between a store and what is put in or asked."""

    model: str
    dimensions: int
    metric: Metric

    def __post_init__(self):
        if not self.model or len(self.model.encode()) > 1024 or "\0" in self.model:
            raise invalid("model must have 1 to 1024 bytes without NUL")
        if not 1 <= self.dimensions <= MAX_DIMENSIONS:
            raise invalid(f"dimensions must be 1 to {MAX_DIMENSIONS}")

    def check(self, other: Space) -> None:
        if self != other:
            raise EngineError("EmbeddingMismatch", f"{other} is not {self}")


def check_vector(vector: list[float], dimensions: int | None, metric: Metric) -> list[float]:
    if dimensions is not None and len(vector) != dimensions:
        raise EngineError("DimensionMismatch", f"{len(vector)} coordinates, not {dimensions}")
    if not vector or len(vector) > MAX_DIMENSIONS:
        raise invalid("a vector has 1 to 4096 coordinates")
    if not all(map(math.isfinite, vector)):
        raise invalid("coordinates must be finite")
    if metric is Metric.COSINE and not any(vector):
        raise invalid("cosine needs a vector other than zero")
    return vector


def check_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", name):
        raise invalid(f"bad collection name {name!r}")
    return name


class Strategy(Enum):
    AUTO = "auto"
    EXACT = "exact"
    ANN = "ann"


@dataclass(frozen=True)
class SearchOptions:
    strategy: Strategy = Strategy.AUTO
    ef_search: int = 128
    exact_threshold: int = 256
    filtered_exact_threshold: int = 4096

    def validate(self) -> None:
        if not 1 <= self.ef_search <= MAX_EF:
            raise invalid(f"ef_search must be 1 to {MAX_EF}")


def auto_reason(options: SearchOptions, k: int, eligible: int, active: int) -> str:
    """Why a search is exact or approximate; the first rule that holds decides."""
    if options.strategy is Strategy.EXACT:
        return "ExactRequested"
    if options.strategy is Strategy.ANN:
        return "AnnRequested"
    if eligible <= options.exact_threshold:
        return "SmallEligibleSet"
    if min(k, eligible) > options.ef_search:
        return "LargeK"
    if eligible < active and eligible <= options.filtered_exact_threshold and eligible <= active // 8:
        return "SelectiveFilter"
    return "AnnSelected"


@dataclass(frozen=True)
class HybridOptions:
    candidates: int = 64
    rrf_k: int = 60

    def validate(self, k: int) -> None:
        if self.candidates < 1 or self.rrf_k < 1 or k > self.candidates:
            raise invalid("hybrid search needs 1 <= k <= candidates and rrf_k >= 1")
