"""Stateful dead-band decisions on a stream, one state per plug.

Values of one timestamp wait in the state until the watermark has passed it; then the batch is
decided as a whole by the same recurrence as in the batch operators.  A plug has one timer, for its
earliest moment: when it fires, all moments that the watermark has passed are decided one after
another and reported together.  Values wait in bounded lists under their first moment, so only lists
that the watermark has reached are read.  Rows behind the watermark
are reported as late and never change a committed batch.
"""

from __future__ import annotations

import json
import pickle
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bandwise.operators.adaptive import INPUT, KEY, SCHEMA, STATE, PlugWalk
from bandwise.operators.cycles import period_cell
from bandwise.params import AdaptiveConfig, Params
from bandwise.sources.events import PLUG
from bandwise.streaming.batches import watermarked

_WAITING = T.StructType(
    [*[f for f in INPUT.fields if f.name not in KEY], T.StructField("floor", T.DoubleType())]
)
_TIME = _WAITING.names.index("ts_us")
#: Values that are held or decided together, or more if one moment has more.
_AT_ONCE = 1000
#: Lists of waiting values by the millisecond of their first time, the unit of timers.  Only Python
#: reads them, so they are kept packed: converting every field for the store took longer than deciding.
_MOMENT = T.StructType([T.StructField("ms", T.LongType())])
_VALUES = T.StructType([T.StructField("values", T.BinaryType())])
_CARRIED = T.StructType(
    [
        *[f for f in SCHEMA.fields if f.name in STATE],
        T.StructField("last_seen_us", T.LongType()),
        T.StructField("recent", T.ArrayType(T.DoubleType())),
    ]
)
OUTPUT = T.StructType(
    [
        *SCHEMA.fields,
        T.StructField("residual_score", T.DoubleType()),
        T.StructField("late", T.BooleanType()),
    ]
)


class Deadband(StatefulProcessor):
    """State of one (configuration, plug): waiting values, predictor state, last W squares."""

    def __init__(self, configs: list[AdaptiveConfig], params: Params):
        self.params = params
        self.configs = {c.config_id: c for c in configs}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", _MOMENT, _VALUES)
        self.due = handle.getValueState("due", _MOMENT)
        self.carried = handle.getValueState("carried", _CARRIED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N803
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        late, fresh = [], []
        for frame in rows:
            for row in zip(*[frame[n].tolist() for n in _WAITING.names], strict=True):
                row = tuple(None if x is None or x != x else x for x in row)
                if int(row[_TIME]) < behind:
                    late.append(_typed(row))
                else:
                    fresh.append(_typed(row))
        if fresh:
            due = self.due.get()
            fresh.sort(key=_when)
            for i in range(0, len(fresh), _AT_ONCE):
                self._keep(fresh[i : i + _AT_ONCE], due is not None or i > 0)
            self._wait(_moment(fresh[0]), None if due is None else due[0])
        if late:
            yield self._late(key, late)

    def _keep(self, values: list[tuple], others: bool) -> None:
        """Hold sorted values by the first one's moment."""
        first = (_moment(values[0]),)
        if others and self.waiting.containsKey(first):
            values = [*self._held(first), *values]
        self.waiting.updateValue(first, (pickle.dumps(values),))

    def _held(self, first: tuple) -> list[tuple]:
        return pickle.loads(self.waiting.getValue(first)[0])

    def _wait(self, moment: int, due: int | None) -> None:
        """One timer for the earliest moment with values."""
        if due is None or moment < due:
            if due is not None:
                self.handle.deleteTimer(due + 1)
            self.handle.registerTimer(moment + 1)
            self.due.update((moment,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        behind = timerValues.getCurrentWatermarkInMs()
        firsts = sorted(moment for (moment,) in self.waiting.keys())
        ready, open_ = [], []
        for first, following in zip(firsts, [*firsts[1:], behind], strict=True):
            if first >= behind:
                break
            values = self._held((first,))
            self.waiting.removeKey((first,))
            ready += [v for v in values if _moment(v) < behind]
            open_ += [v for v in values if _moment(v) >= behind]
            # later lists hold no value before their first moment
            ready.sort(key=_when)
            safe = bisect_left(ready, min(following, behind), key=_moment)
            for part in _parts(ready[:safe]):
                yield self._decide(key, part)
            ready = ready[safe:]
        self.due.clear()
        left = [first for first in firsts if first >= behind]
        open_.sort(key=_when)
        for i in range(0, len(open_), _AT_ONCE):
            self._keep(open_[i : i + _AT_ONCE], True)
        if left or open_:
            self._wait(min([*left, *map(_moment, open_[:1])]), None)

    def _decide(self, key, ready: list[tuple]) -> pd.DataFrame:
        carried = self.carried.get()
        if carried is not None:
            carried = dict(zip(_CARRIED.names, carried, strict=True))
        state = carried or {"initial_bias": ready[0][_WAITING.names.index("initial_bias")] or 0.0}
        walk = PlugWalk(tuple(key), self.configs[key[0]], self.params.start_us, state)
        fixed = dict(zip(KEY, key, strict=True))
        results = SCHEMA.names[len(INPUT.names) :]
        recent = list((carried or {}).get("recent") or [])
        fresh, now, score, out = [], None, None, []
        seen = carried["last_seen_us"] if carried else None
        for value in ready:
            row = {**dict(zip(_WAITING.names, value, strict=True)), **fixed}
            if row["ts_us"] != now:
                # a new batch: last-seen time, score and predictor are those before it
                seen = now if now is not None else (seen or row["last_seen_us"])
                recent, fresh = (recent + fresh)[-self.params.window :], []
                mean = sum(recent) / len(recent) if recent else 0.0
                score, now = max(mean**0.5, row["floor"]), row["ts_us"]
            row["last_seen_us"] = seen
            row["reactivated"] = seen is None or now - seen > self.params.active_us
            decided = walk.advance(
                now, row["value"], row["baseline"], row["threshold_used"], row["reactivated"],
                row["robust_scale"],
            )
            row.update(zip(results, decided, strict=True), residual_score=score, late=False)
            if row["residual"] is not None:
                fresh.append(row["residual"] ** 2)
            out.append(row)
        recent = (recent + fresh)[-self.params.window :]
        names = [f.name for f in _CARRIED.fields][: len(STATE)]
        self.carried.update((*[out[-1][n] for n in names], now, recent))
        return self._report([tuple(row[n] for n in OUTPUT.names) for row in out])

    def _late(self, key, rows: list[tuple]) -> pd.DataFrame:
        known = [
            {**dict(zip(_WAITING.names, row, strict=True)),
             **dict(zip(KEY, key, strict=True)), "late": True}
            for row in rows
        ]
        return self._report([tuple(r.get(n) for n in OUTPUT.names) for r in known])

    def _report(self, rows: list[tuple]) -> pd.DataFrame:
        return _frame(rows)

    def close(self) -> None:
        pass


#: Fields of a report by their place; a report of one column costs Spark one conversion, not one a field.
_PLACED = T.ArrayType(T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(OUTPUT.fields)]))
_PACKED = T.StructType([T.StructField("report", T.StringType())])


class PackedDeadband(Deadband):
    """Reports as text, for ``unpacked``; values that are no number are null, as in typed columns."""

    def _report(self, rows: list[tuple]) -> pd.DataFrame:
        known = [{f"f{i}": x for i, x in enumerate(row) if x is not None and x == x} for row in rows]
        parts = [json.dumps(known[i : i + _AT_ONCE]) for i in range(0, len(known), _AT_ONCE)]
        return pd.DataFrame({"report": parts}, dtype=object)


def unpacked(reports: DataFrame) -> DataFrame:
    """Rows of packed reports; one that cannot be read is an error."""
    rows = reports.select(F.inline(F.from_json("report", _PLACED, {"mode": "FAILFAST"})))
    return rows.toDF(*OUTPUT.names)


def _when(value: tuple) -> tuple:
    return value[_TIME], value[_TIME + 1]


def _moment(value: tuple) -> int:
    """Millisecond of a value."""
    return value[_TIME] // 1000


def _parts(values: list[tuple]) -> Iterator[list[tuple]]:
    """Sorted values in lists of about ``_AT_ONCE``; those of one moment stay together."""
    start = 0
    while start < len(values):
        end = min(start + _AT_ONCE, len(values))
        while end < len(values) and _moment(values[end]) == _moment(values[end - 1]):
            end += 1
        yield values[start:end]
        start = end


def _typed(row: tuple) -> tuple:
    made = []
    for value, field in zip(row, _WAITING.fields, strict=True):
        if value is not None:
            if isinstance(field.dataType, T.LongType):
                value = int(value)
            elif isinstance(field.dataType, T.DoubleType):
                value = float(value)
            elif isinstance(field.dataType, T.BooleanType):
                value = bool(value)
        made.append(value)
    return tuple(made)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows as they are: Arrow gets the types from the schema, a frame typed by column takes longer than its decisions."""
    return pd.DataFrame(rows, columns=OUTPUT.names, dtype=object)


def decide_stream(
    events: DataFrame,
    thresholds: DataFrame,
    plugs: DataFrame,
    config: AdaptiveConfig,
    params: Params,
    *,
    delay: str,
    floor: float,
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Decisions of a predicted event stream.

    ``thresholds``: plug key and ``threshold`` (a static table; a new query picks up a refreshed
    one); with ``ticks`` also ``cycle``, and an event obeys the newest tick strictly before it (in
    a period without a tick: threshold 0).  ``plugs``: plug key, ``last_us``, ``robust_scale`` and
    ``initial_bias`` from the warm-up, and the house's ``sigma_floor`` if not all have ``floor``.
    """
    own_floor = "sigma_floor" in plugs.columns
    fitted = ["last_us", "robust_scale", "initial_bias", *["sigma_floor"] * own_floor]
    rows = watermarked(events, delay).withColumn("ts_us", F.unix_micros("timestamp"))
    by = list(PLUG)
    if ticks is None:
        rows = rows.withColumn("cycle", F.lit(0))
    else:
        by.append("cycle")
        cells = ticks.select("house_id", "cell", "tick_us", F.col("cycle").alias("_cell_cycle"))
        early = (F.col("ts_us") <= F.col("tick_us")).cast("bigint")
        rows = (
            rows.withColumn("cell", period_cell(params))
            .join(cells, ["house_id", "cell"], "left")
            .withColumn("cycle", F.col("_cell_cycle") - early)
        )
    joined = rows.join(thresholds.select(*by, "threshold"), by, "left").join(
        plugs.select(*PLUG, *fitted), PLUG, "left"
    )
    fixed = {
        "config_id": F.lit(config.config_id),
        "mode": F.lit(config.allocation.mode),
        "baseline": F.col("prediction"),
        "threshold_used": F.coalesce("threshold", F.lit(0.0)),
        "cap": F.lit(None),
        "house_budget": F.lit(None),
        "last_seen_us": F.col("last_us"),
        "reactivated": F.lit(False),
        "robust_scale": F.coalesce("robust_scale", F.lit(float(params.drift_min_scale))),
        "initial_bias": F.coalesce("initial_bias", F.lit(0.0)),
    }
    # without the watermarked column Spark drops nothing itself: late rows reach the state
    rows = joined.select(
        *[fixed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in INPUT.fields],
        (F.coalesce("sigma_floor", F.lit(floor)) if own_floor else F.lit(floor))
        .cast("double")
        .alias("floor"),
    )
    reports = rows.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=PackedDeadband([config], params),
        outputStructType=_PACKED,
        outputMode="Append",
        timeMode="EventTime",
    )
    return unpacked(reports)


def late_counts(decided: DataFrame) -> DataFrame:
    """How many rows arrived behind the watermark, from the written decisions."""
    return decided.groupBy("config_id", "house_id").agg(
        F.count_if("late").alias("late_events"), F.count_if(~F.col("late")).alias("events")
    )
