"""Parameters of the model. They must equal the published ones for equal results."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ModelConfig:
    half_life_days: float = 14.0
    reference_sample: float = 1000.0
    default_sample: float = 450.0
    default_grade: float = 0.6
    mode_weights: dict[str, float] = field(default_factory=lambda: {"phone": 1.0, "mixed": 0.95, "online-panel": 0.8, "ivr": 0.6, "unknown": 0.7})
    default_mode_weight: float = 0.7
    partial_weight: float = 0.75
    threshold: float = 0.0325
    total_seats: int = 120
    majority: int = 61
    social_cap_pp: float = 0.6
    social_window_days: int = 7
    social_baseline_days: int = 28
    simulations: int = 20000
    national_error_sd: float = 0.006
    bloc_error_sd: float = 0.028
    party_error_sd: float = 0.011
    election_date: str = "2026-10-27"
    time_inflation_per_30_days: float = 0.3
    share_floor: float = 0.0005
    residual_floor: float = 0.005
    unreported_waste: float = 0.035
    below_threshold_waste: float = 0.02
    waste_cap: float = 0.12
    imputed_threshold_share: float = 0.8
    residual_clip: float = 0.03
    shrink: float = 3.0


DEFAULT = ModelConfig()
