"""Thresholds shared by every operator.

The defaults are the fixed values the feedback rules are defined with; pass a
modified copy (``dataclasses.replace``) to change them for one call.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # --- fixed values: sentiment classes and scoring ---
    positive: float = 0.3
    negative: float = -0.3
    instruction_boost: float = 3.0
    continuation: float = 0.1
    # --- fixed values: interaction store housekeeping ---
    max_age_days: int = 90
    max_size_gb: float = 10.0
    cleanup_threshold: float = 0.9
    cleanup_fraction: float = 0.1
    min_weight: float = 0.5
    top_n: int = 1000
    truncate_at: int = 60000
    # --- fixed values: training triggers and gates ---
    sft_trigger: int = 20
    dpo_trigger: int = 5
    dpo_mode: int = 5
    inactivity_hours: float = 8.0
    inactivity_min_new: int = 10
    validation_split: float = 0.1
    min_perplexity: float = 2.0
    perplexity_tolerance: float = 1.05
    rejection_cache_hours: float = 6.0
    max_checkpoints: int = 3
    schedule_enabled: bool = False
    schedule_time: str = "01:00"
    schedule_timezone: str = "America/New_York"
    schedule_window_minutes: int = 60

    @property
    def neutral_band(self) -> float:
        return max(self.positive, abs(self.negative))


DEFAULT = Thresholds()
