"""Parameters of the engine, and presets for the two tasks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    """Thresholds and weights of the scores."""

    semantic_threshold: float = 0.65
    overlap_threshold: float = 0.35
    confidence_threshold: float = 0.65
    max_candidates: int = 40
    top_k: int = 10
    column_count_weight: float = 0.4
    confidence_weight: float = 0.4
    coverage_weight: float = 0.2
    key_bonus: float = 0.2
    match_threshold: float = 0.6
    max_table_columns: int = 50
    assignment_weights: dict = field(default_factory=lambda: {"raw": 0.1, "norm_min": 0.2, "norm_max": 0.2, "jaccard": 0.15, "average": 0.2, "weighted": 0.15})
    l1_top: int = 1000
    l2_names: int = 200
    l2_top: int = 100
    l2_threshold: float = 0.6
    l3_top: int = 10
    early_stop: float = 0.90
    include_self: bool = False


PRESETS = {
    "join": replace(Config(), l1_top=60, l2_top=12, l3_top=3, early_stop=0.88),
    "union": replace(Config(), l1_top=80, l2_top=15, l3_top=3, early_stop=0.92),
    "default": replace(Config(), l1_top=70, l2_top=15, l3_top=4),
}
