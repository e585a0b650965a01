"""Small hand-made houses for the tests."""

from __future__ import annotations

import math
import random
from datetime import UTC, datetime, timedelta

from bandwise.params import Params, interval, micros

SCHEMA = (
    "event_id string, timestamp timestamp, value double, property bigint, plug_id bigint, "
    "household_id bigint, house_id bigint, row_id bigint"
)
START = datetime(2013, 9, 1, tzinfo=UTC)


def drifting_house(days: int = 2, seed: int = 7, house: int = 0):
    """Four plugs of two households: a slow wave with noise, a gap, a step, a spike, duplicates."""
    noise = random.Random(seed)
    rows = []
    per_day = 96
    for step in range(days * per_day):
        at = START + timedelta(minutes=15 * step)
        for number, (hh, plug, base) in enumerate(
            ((0, 0, 110.0), (0, 1, 60.0), (1, 0, 20.0), (1, 1, 10.0))
        ):
            late = step >= (days - 1) * per_day
            if late and plug == 1 and hh == 1 and 40 <= step % per_day < 60:
                continue
            value = base + 4 * math.sin(step / 7 + number) + noise.uniform(-2, 2)
            if late and hh == 1 and plug == 0:
                value += 12 * (step % per_day) / per_day
            if late and hh == 0 and plug == 1 and step % per_day > 30:
                value += 9
            if late and step % per_day == 20 and number == 0:
                value += 60
            copies = 2 if late and step % 11 == 0 and number == 2 else 1
            for copy in range(copies):
                rows.append((at, round(max(value + copy, 0.0), 3), plug, hh, house))
    return [
        (f"{house}-{i}", at, value, 1, plug, hh, h, i)
        for i, (at, value, plug, hh, h) in enumerate(rows)
    ]


def house_params(days: int = 2, **changes) -> Params:
    last = START + timedelta(days=days - 1)
    base = dict(
        warmup=interval(START, last - timedelta(microseconds=1)),
        evaluation=interval(last, START + timedelta(days=days) - timedelta(microseconds=1)),
        slot_seconds=3600,
        period_seconds=7200,
        active_seconds=10800,
        window=12,
        drift_min_scale=1.0,
    )
    return Params(**{**base, **changes})


def as_dicts(rows, house=0):
    found = [
        dict(ts=micros(r[1]), hh=r[5], plug=r[4], row=r[7], value=r[2])
        for r in rows
        if r[6] == house
    ]
    return sorted(found, key=lambda e: (e["ts"], e["hh"], e["plug"], e["row"]))
