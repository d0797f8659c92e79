"""Parameters of the window features, the learning step and the study protocol."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

# Feature names, in model order.
BLINK_FEATURES = ["blink_rate", "blink_count", "mean_blink_duration", "ear_std"]
CLOSURE_FEATURES = ["perclos"]
GEOMETRY_FEATURES = [
    "mouth_open_mean",
    "mouth_open_std",
    "roll_std",
    "pitch_std",
    "yaw_std",
    "motion_mean",
    "motion_std",
]
BRIGHTNESS_FEATURES = ["mean_brightness", "std_brightness"]
QUALITY_FEATURES = ["mean_quality", "valid_frame_ratio"]

BASE_FEATURES = BLINK_FEATURES + CLOSURE_FEATURES + GEOMETRY_FEATURES

# Output columns of one physiological window.
PHYSIO_FEATURES = [
    "hr",
    "rmssd",
    "sdnn",
    "scl",
    "scr_count",
    "scr_amplitude_mean",
    "resp_rate",
    "resp_amplitude_mean",
    "resp_variability",
    "ecg_quality",
]

# Signed weights of the composite stress score.
STRESS_WEIGHTS = {
    "hr": 0.452,
    "sdnn": -0.320,
    "scr_amplitude_mean": 0.405,
    "resp_amplitude_mean": 0.623,
}

# Tasks whose first windows form the personal baseline.
BASELINE_TASKS = ("Relax", "Breathing", "Video1")


@dataclass(frozen=True)
class FeatureConfig:
    """Window, quality and blink parameters; defaults follow the offline configuration."""

    fps: float = 30.0
    length_s: float = 10.0
    step_s: float = 2.5
    max_bad_ratio: float = 0.05
    ear_threshold: float = 0.21
    min_blink_ms: float = 120
    max_blink_ms: float = 400
    max_gap: int = 1
    blinks: bool = True
    perclos: bool = True
    brightness: bool = True
    geometry: bool = True
    # Windows that share one shuffle key. Larger values copy fewer frames, smaller ones spread
    # a single long recording over more tasks.
    windows_per_chunk: int = 64

    @property
    def length(self) -> int:
        return int(self.length_s * self.fps)

    @property
    def step(self) -> int:
        step = int(self.step_s * self.fps)
        if step < 1:
            raise ValueError("step_s * fps must be at least one frame")
        return step

    @property
    def min_blink_frames(self) -> int:
        return int((self.min_blink_ms / 1000.0) * self.fps)

    @property
    def max_blink_frames(self) -> int:
        return int((self.max_blink_ms / 1000.0) * self.fps)

    @property
    def model_features(self) -> list[str]:
        """Model inputs in order; brightness and quality are monitored, never model inputs."""
        names: list[str] = []
        if self.blinks:
            names += BLINK_FEATURES
        if self.perclos:
            names += CLOSURE_FEATURES
        if self.geometry:
            names += GEOMETRY_FEATURES
        return names

    @property
    def monitoring_features(self) -> list[str]:
        return (BRIGHTNESS_FEATURES if self.brightness else []) + QUALITY_FEATURES


@dataclass(frozen=True)
class PhysioConfig:
    """Sampling and peak parameters of the physiological windows."""

    rate: int = 500
    length_s: float = 10.0
    step_s: float = 2.5
    # Half widths (in samples) inside which a peak must be the maximum.
    ecg_half_width: int = 125
    eda_half_width: int = 500
    resp_half_width: int = 500
    # Half width of the moving mean that separates the tonic from the phasic level.
    tonic_half_width: int = 1000
    # Peak heights, in window standard deviations above the window mean.
    ecg_height: float = 1.0
    scr_height: float = 0.1
    resp_height: float = 0.0
    min_std: float = 1e-6
    windows_per_chunk: int = 32

    @property
    def length(self) -> int:
        return int(self.length_s * self.rate)

    @property
    def step(self) -> int:
        return max(1, int(self.step_s * self.rate))


@dataclass(frozen=True)
class StudyPlan:
    """Timing and controller limits of one study session."""

    easy_item_count: int = 12
    hard_item_count: int = 18
    hard_interference_enabled: bool = True
    recognition_choices: int = 4
    max_micro_breaks: int = 2
    cooldown_seconds: int = 120
    decision_window_seconds: int = 5
    smoothing_windows: int = 3
    overload_threshold: float = 0.7
    max_pacing_seconds: int = 2
    delayed_test_days: int = 7
    min_hours_between_sessions: int = 24


@dataclass(frozen=True)
class StudyQuality:
    """Signal-quality limits used by the flags and by the controller."""

    min_valid_ratio: float = 0.95
    max_illumination_std: float = 28.0


@dataclass(frozen=True)
class EngineeredFeatures:
    """Names of the base features, their centred values and the deltas of those."""

    base: list[str] = field(default_factory=lambda: list(BASE_FEATURES))

    @property
    def centered(self) -> list[str]:
        return [f"{name}_centered" for name in self.base]

    @property
    def delta(self) -> list[str]:
        return [f"{name}_delta" for name in self.base]

    @property
    def all(self) -> list[str]:
        return [*self.base, *self.centered, *self.delta]


def decay_span(alpha: float, negligible: float = 1e-40) -> int:
    """Rows after which a weight of (1 - alpha) per row falls below ``negligible``."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    return max(1, math.ceil(math.log(negligible) / math.log(1.0 - alpha)))
