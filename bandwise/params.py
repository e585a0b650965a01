"""Study parameters as plain immutable values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

# Names of allocators, predictors and detectors.
MODES = (
    "full_tx",
    "uniform",
    "flat_variance",
    "legacy_two_stage",
    "true_hierarchical",
    "true_hierarchical_cap",
)
# Modes a configuration may name; registering an allocator adds to it.
KNOWN_MODES = set(MODES)
PREDICTOR_MODES = (
    "slot_median_frozen",
    "slot_median_ewma",
    "slot_median_ewma_periodic_sync",
    "slot_median_ewma_drift",
    "slot_median_ewma_drift_periodic_sync",
)
ORACLE_MODE = "slot_median_ewma_local_oracle"
DETECTORS = ("none", "zscore_consecutive", "cusum")

Interval = tuple[datetime, datetime]


def utc(moment: str | datetime) -> datetime:
    """Text or datetime to an aware UTC datetime; text without offset is taken as UTC."""
    if isinstance(moment, str):
        moment = datetime.fromisoformat(moment)
        if moment.tzinfo is None:
            moment = moment.replace(tzinfo=UTC)
    if moment.tzinfo is None:
        raise ValueError("split timestamps must include a timezone")
    return moment.astimezone(UTC)


def micros(moment: datetime) -> int:
    """Microseconds since the epoch, exactly."""
    delta = moment - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def interval(start: str | datetime, end: str | datetime) -> Interval:
    """Closed UTC interval."""
    bounds = (utc(start), utc(end))
    if bounds[0] > bounds[1]:
        raise ValueError("split start must be <= end")
    return bounds


@dataclass(frozen=True)
class Params:
    """Everything that is shared by all configurations of one study."""

    warmup: Interval
    evaluation: Interval
    validation: Interval | None = None
    slot_seconds: int = 300
    period_seconds: int = 300
    active_seconds: int = 600
    tolerance: float = 1e-9
    top_k: int = 100
    window: int = 1000
    floor_percentile: float = 5.0
    lambda_mean: float = 0.5
    lambda_max: float = 0.4
    lambda_count: float = 0.1
    cap_tolerance: float = 1e-9
    drift_min_scale: float = 1.0
    # digits to which figures that put results in order are compared; none: exactly
    tie_digits: int | None = None
    # rows of one key that a fold works through between two written states
    slice_rows: int = 5_000_000

    def __post_init__(self) -> None:
        spans = [("warmup", self.warmup)]
        if self.validation is not None:
            spans.append(("validation", self.validation))
        spans.append(("evaluation", self.evaluation))
        for (_, left), (name, right) in zip(spans, spans[1:], strict=False):
            if left[1] >= right[0]:
                raise ValueError(f"splits overlap or are unordered before {name}")
        if abs(self.lambda_mean + self.lambda_max + self.lambda_count - 1.0) > 1e-9:
            raise ValueError("household score lambdas must sum to 1")
        if min(self.slot_seconds, self.period_seconds, self.active_seconds, self.window) <= 0:
            raise ValueError("slot, period, active window and rolling window must be positive")

    @property
    def start_us(self) -> int:
        return micros(self.evaluation[0])

    @property
    def period_us(self) -> int:
        return self.period_seconds * 1_000_000

    @property
    def active_us(self) -> int:
        return self.active_seconds * 1_000_000

    def on_validation(self) -> Params:
        """The same study with the validation interval in the role of the evaluated one."""
        if self.validation is None:
            raise ValueError("no validation interval")
        return replace(self, evaluation=self.validation, validation=None)


@dataclass(frozen=True)
class AllocationConfig:
    """One point of an allocation grid."""

    config_id: str
    mode: str
    epsilon: float = 0.01
    alpha_fair: float = 0.2
    beta: float = 0.1
    cap_quantile: float = 0.95
    cap_multiplier: float = 1.0
    cap_fraction: float = 0.25
    cap_min_samples: int = 30

    def __post_init__(self) -> None:
        if self.mode not in KNOWN_MODES:
            raise ValueError(f"unknown mode: {self.mode}")
        if not 0.0 <= self.cap_quantile <= 1.0:
            raise ValueError("cap quantile must be in [0, 1]")


@dataclass(frozen=True)
class AdaptiveConfig:
    """One point of a predictor grid: an allocation plus the predictor's own settings."""

    allocation: AllocationConfig
    predictor_mode: str = "slot_median_frozen"
    alpha: float = 0.1
    bias_from_warmup: bool = False
    detector: str = "none"
    z_threshold: float = 3.0
    z_count: int = 3
    kappa: float = 0.5
    threshold_h: float = 5.0
    cooldown: int = 0
    max_suppressions: int | None = None
    max_silence: int | None = None
    enabled: bool = True
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        if self.predictor_mode not in (*PREDICTOR_MODES, ORACLE_MODE):
            raise ValueError(f"unknown predictor mode: {self.predictor_mode}")
        if self.detector not in DETECTORS:
            raise ValueError(f"unknown detector: {self.detector}")
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must be in [0, 1]")

    @property
    def config_id(self) -> str:
        return self.allocation.config_id

    @property
    def effective_mode(self) -> str:
        return self.predictor_mode if self.enabled else "slot_median_frozen"

    @property
    def adapts(self) -> bool:
        return self.effective_mode != "slot_median_frozen"

    @property
    def drifts(self) -> bool:
        return "drift" in self.effective_mode

    @property
    def syncs(self) -> bool:
        return self.effective_mode.endswith("periodic_sync")

    @property
    def oracle(self) -> bool:
        return self.effective_mode == ORACLE_MODE


def mode_grid(
    modes: Sequence[str] = MODES, epsilons: Sequence[float] = (0.01,), **common: float
) -> list[AllocationConfig]:
    """Every mode at every epsilon, as allocation configurations."""
    grid = [
        AllocationConfig(f"{mode}@{epsilon:g}", mode, epsilon, **common)
        for epsilon in epsilons
        for mode in modes
    ]
    if not grid or len({c.config_id for c in grid}) != len(grid):
        raise ValueError("modes must be non-empty and unique")
    return grid
