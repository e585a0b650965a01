"""Drift detection on standardised residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bandwise.operators.fold import CARRIED, fold_by_key, keys_at, listed, runs_of_keys, with_results
from bandwise.params import DETECTORS


@dataclass(frozen=True)
class Detector:
    """Settings of a detector: consecutive large z-scores, or a two-sided CUSUM."""

    kind: str = "none"
    z_threshold: float = 3.0
    z_count: int = 3
    kappa: float = 0.5
    threshold_h: float = 5.0
    cooldown: int = 0

    def __post_init__(self) -> None:
        if self.kind not in DETECTORS:
            raise ValueError(f"unknown detector: {self.kind}")

    @cached_property
    def limits(self) -> tuple[float, float, float]:
        """Levels at which the run of large scores and the two sums raise an alarm."""
        never = math.inf
        return {
            "zscore_consecutive": (self.z_count, never, never),
            "cusum": (never, self.threshold_h, self.threshold_h),
        }.get(self.kind, (never, never, never))

    def steps(self, z: float) -> tuple[float, float, float]:
        """What one score adds to the three levels; minus infinity empties a level."""
        if self.kind == "zscore_consecutive":
            return (1 if abs(z) >= self.z_threshold else -math.inf), 0, 0
        if self.kind == "cusum":
            return 0, z - self.kappa, -z - self.kappa
        return 0, 0, 0


# levels of the run of large scores, the positive and the negative sum; events of cooldown left
DriftState = tuple[int, float, float, int]
CALM: DriftState = (0, 0.0, 0.0, 0)


def observe(
    state: DriftState, z: float, detector: Detector, enabled: bool
) -> tuple[DriftState, bool, bool]:
    """Next state, whether it triggers, and whether a trigger was held back by the cooldown.

    Every detector is a set of sums reflected at zero, with an alarm when one reaches its limit.  An
    alarm in the cooldown is held back.  Levels move while triggers are disabled, and start anew
    after an alarm that triggered or was held back; only a trigger starts the cooldown, which counts
    the key's own events.
    """
    run, up, down, cooling = state
    by_run, by_up, by_down = detector.steps(z)
    run, up, down = run + by_run, up + by_up, down + by_down
    # the zeros keep their types: a whole number, then two doubles
    run, up, down = run if run > 0 else 0, up if up > 0.0 else 0.0, down if down > 0.0 else 0.0
    most_run, most_up, most_down = detector.limits
    alarm = run >= most_run or up >= most_up or down >= most_down
    held = alarm and cooling > 0
    fires = alarm and enabled and not held
    if held or fires:
        run, up, down = CALM[:3]
    left = detector.cooldown if fires else max(cooling - 1, 0)
    return (run, up, down, left), fires, held and enabled


_STATE = ["z_run", "cusum_up", "cusum_down", "cooldown_left"]


def detect_drift(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    residual: str,
    scale: str,
    detector: Detector,
    *,
    slice_col: str,
    max_rows: int = 5_000_000,
) -> DataFrame:
    """Run a detector over any ordered residual series per key.

    Adds ``standardized`` (absolute), ``drift_detected``, ``held_by_cooldown`` and the detector's
    state after each row.
    """
    kept = df.columns
    result = [
        T.StructField("standardized", T.DoubleType()),
        T.StructField("drift_detected", T.BooleanType()),
        T.StructField("held_by_cooldown", T.BooleanType()),
        T.StructField("z_run", T.LongType()),
        T.StructField("cusum_up", T.DoubleType()),
        T.StructField("cusum_down", T.DoubleType()),
        T.StructField("cooldown_left", T.LongType()),
    ]
    schema = T.StructType([*df.schema.fields, *result])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, CALM
        for batch in batches:
            borders = runs_of_keys(batch, keys)
            values, widths = listed(batch.column(residual)), listed(batch.column(scale))
            before = [listed(batch.column(CARRIED + c)) for c in _STATE]
            out = []
            for found, start, end in zip(keys_at(batch, keys, borders[:-1]), borders, borders[1:], strict=False):
                # a key may go on from the batch before
                if found != key:
                    key = found
                    carried = tuple(c[start] for c in before)
                    state = CALM if carried[0] is None else carried
                for value, width in zip(values[start:end], widths[start:end], strict=True):
                    z, fires, held = None, False, False
                    if value is not None:
                        signed = value / width
                        z = abs(signed)
                        state, fires, held = observe(state, signed, detector, True)
                    out.append((z, fires, held, *state))
            yield with_results(batch, kept, result, out)

    return fold_by_key(
        df, keys, order, walk, schema, _STATE, slice_col=slice_col, max_rows=max_rows
    )
