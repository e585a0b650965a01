"""Dead-band decisions with the adaptive predictor: EWMA bias, drift and periodic resync.

The bias moves only when a value is transmitted, and a value is transmitted depending on the
bias, so this is a true recurrence per plug.  It runs as a keyed fold; everything around it
(thresholds, last-seen times, scales, reports) is plain DataFrame work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bandwise.functions.stats import (
    order_statistics,
    percentile_column,
    position_ranks,
    running_totals,
    tail_mean_column,
    top_share_column,
    top_share_rank,
)
from bandwise.operators.drift import CALM, Detector, observe
from bandwise.operators.fold import CARRIED, Walk, keys_at, listed, runs_of_keys, with_results
from bandwise.operators.metrics import RUN
from bandwise.params import AdaptiveConfig, Params
from bandwise.session import write_through

KEY = ["config_id", "house_id", "household_id", "plug_id"]
ORDER = ["ts_us", "row_id"]
_READ = ["ts_us", "value", "baseline", "threshold_used", "reactivated", "robust_scale"]
# Reasons of the adaptive cascade that count as forced.
ADAPTIVE_REASONS = (
    "invalid_value",
    "full_tx",
    "missing_prediction",
    "inactive_reactivation",
    "drift_detected",
    "periodic_sync_count",
    "periodic_sync_time",
)
SYNC_REASONS = ("periodic_sync_count", "periodic_sync_time")
STATE = [
    "edge_bias",
    "server_bias",
    "warmup_bias",
    "streak",
    "last_tx_us",
    "version",
    "z_run",
    "cusum_up",
    "cusum_down",
    "cooldown_left",
    "episode",
    "trigger_us",
    "episode_events",
]
# columns every input row brings
INPUT = T.StructType(
    [
        T.StructField("config_id", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("house_id", T.LongType()),
        T.StructField("household_id", T.LongType()),
        T.StructField("plug_id", T.LongType()),
        T.StructField("cycle", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("baseline", T.DoubleType()),
        T.StructField("threshold_used", T.DoubleType()),
        T.StructField("cap", T.DoubleType()),
        T.StructField("house_budget", T.DoubleType()),
        T.StructField("last_seen_us", T.LongType()),
        T.StructField("reactivated", T.BooleanType()),
        T.StructField("robust_scale", T.DoubleType()),
        T.StructField("initial_bias", T.DoubleType()),
    ]
)
_RESULT = [
    ("edge_prediction", T.DoubleType()),
    ("prediction", T.DoubleType()),
    ("residual", T.DoubleType()),
    ("transmitted", T.BooleanType()),
    ("forced_reason", T.StringType()),
    ("normal_would_transmit", T.BooleanType()),
    ("standardized_innovation", T.DoubleType()),
    ("held_by_cooldown", T.BooleanType()),
    ("prior_suppressions", T.LongType()),
    ("prior_last_tx_us", T.LongType()),
    ("edge_bias_before", T.DoubleType()),
    ("server_bias_before", T.DoubleType()),
    ("updated", T.BooleanType()),
    # which drift episode observes the row, and the row's number in it
    ("observed_episode", T.LongType()),
    ("observed_number", T.LongType()),
]
_STATE_TYPES = {
    "edge_bias": T.DoubleType(),
    "server_bias": T.DoubleType(),
    "warmup_bias": T.DoubleType(),
    "cusum_up": T.DoubleType(),
    "cusum_down": T.DoubleType(),
}
SCHEMA = T.StructType(
    [
        *INPUT.fields,
        *[T.StructField(name, kind) for name, kind in _RESULT],
        *[T.StructField(name, _STATE_TYPES.get(name, T.LongType())) for name in STATE],
    ]
)


@cache
def detector_of(config: AdaptiveConfig) -> Detector:
    return Detector(
        config.detector,
        config.z_threshold,
        config.z_count,
        config.kappa,
        config.threshold_h,
        config.cooldown,
    )


def moved(bias: float, innovation: float, alpha: float) -> float:
    """One EWMA move of a bias."""
    return bias + alpha * innovation


def adaptive_walk(configs: Sequence[AdaptiveConfig], params: Params) -> Walk:
    """Recurrence of every (configuration, plug) of a partition, for the keyed fold."""
    by_id = {c.config_id: c for c in configs}
    start_us = params.start_us

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plug = None
        for batch in batches:
            borders = runs_of_keys(batch, KEY)
            inputs = list(zip(*[listed(batch.column(c)) for c in _READ], strict=True))
            first = first_states(batch)
            out = []
            for key, start, end in zip(keys_at(batch, KEY, borders[:-1]), borders, borders[1:], strict=False):
                # a plug may go on from the batch before
                if plug is None or plug.key != key:
                    plug = PlugWalk(key, by_id[key[0]], start_us, first(start))
                advance = plug.advance
                out += [advance(*row) for row in inputs[start:end]]
            yield with_results(batch, INPUT.names, SCHEMA.fields[len(INPUT.fields) :], out)

    return walk


def first_states(batch: pa.RecordBatch) -> Callable[[int], dict]:
    """States carried into the slice by the rows of a batch, or their starting biases alone."""
    biases = listed(batch.column("initial_bias"))
    streaks = batch.column(CARRIED + "streak")
    if streaks.null_count == len(streaks):
        return lambda i: {"initial_bias": biases[i] or 0.0}
    carried = {c: listed(batch.column(CARRIED + c)) for c in STATE}

    def state(i: int) -> dict:
        if carried["streak"][i] is None:
            return {"initial_bias": biases[i] or 0.0}
        return {c: values[i] for c, values in carried.items()}

    return state


class PlugWalk:
    """Predictor, detector and synchronisation state of one plug under one configuration.

    Decisions of one timestamp all read the state before it; their effects add up one by one,
    except the detector's, of which the last counts.
    """

    def __init__(self, key: tuple, config: AdaptiveConfig, start_us: int, state: dict):
        self.key, self.start_us = key, start_us
        self.detector = detector_of(config)
        self.always = config.allocation.mode == "full_tx"
        self.adapts, self.drifts = config.adapts, config.drifts
        self.oracle, self.alpha = config.oracle, config.alpha
        self.max_count = config.max_suppressions if config.syncs else None
        silence = config.max_silence if config.syncs else None
        self.max_silence_us = None if silence is None else silence * 1_000_000
        self.now = None
        if "initial_bias" in state:
            bias = state["initial_bias"] if self.adapts else 0.0
            self.edge = self.server = self.initial = bias
            self.streak, self.last_tx, self.version = 0, None, 0
            self.drift, self.episode, self.trigger, self.seen = CALM, 0, None, 0
        else:
            self.edge, self.server, self.initial = (
                state[c] for c in ("edge_bias", "server_bias", "warmup_bias")
            )
            self.streak, self.last_tx, self.version = (
                state[c] for c in ("streak", "last_tx_us", "version")
            )
            self.drift = tuple(
                state[c] for c in ("z_run", "cusum_up", "cusum_down", "cooldown_left")
            )
            self.episode, self.trigger, self.seen = (
                state[c] for c in ("episode", "trigger_us", "episode_events")
            )

    def advance(self, now, value, baseline, threshold, returned, scale) -> tuple:
        """Decide one value; returns the result and state columns of its row."""
        if now != self.now:
            self.now = now
            self.before = (self.edge, self.server, self.streak, self.last_tx, self.drift)
        edge, server, streak, last_tx, drift = self.before
        known = baseline is not None
        sound = math.isfinite(value) and value >= 0.0
        local = remote = innovation = z = None
        would_send = held = fires = False
        if known:
            local = baseline + edge if self.adapts else baseline
            remote = baseline + server if self.adapts else baseline
            innovation = value - local
            would_send = abs(innovation) > threshold
            signed = innovation / scale
            z = abs(signed)
            self.drift, fires, held = observe(drift, signed, self.detector, self.drifts)
        reason = None
        if not sound:
            reason = "invalid_value"
        elif not known:
            reason = "missing_prediction"
        elif returned:
            reason = "inactive_reactivation"
        elif fires:
            reason = "drift_detected"
        elif self.max_count is not None and streak >= self.max_count:
            reason = "periodic_sync_count"
        elif self.max_silence_us is not None and (
            now - (self.start_us if last_tx is None else last_tx) >= self.max_silence_us
        ):
            reason = "periodic_sync_time"
        elif self.always:
            reason = "full_tx"
        elif would_send:
            reason = "normal_deadband"
        sent = reason is not None
        # the running episode sees this row before a new trigger replaces it
        observed = number = None
        if known and sound and self.episode and now > self.trigger:
            self.seen += 1
            observed, number = self.episode, self.seen
        if reason == "drift_detected":
            self.episode, self.trigger, self.seen = self.episode + 1, now, 0
        edge_before, server_before, updated = self.edge, self.server, False
        if known and sound:
            if self.adapts and (sent or self.oracle):
                self.edge = moved(self.edge, innovation, self.alpha)
            if sent:
                if self.adapts:
                    self.server = moved(self.server, innovation, self.alpha)
                    self.version += 1
                    updated = True
                self.last_tx, self.streak = now, 0
            else:
                self.streak += 1
        return (
            local,
            local if self.oracle else remote,
            innovation,
            sent,
            reason,
            would_send,
            z,
            held,
            streak,
            last_tx,
            edge_before,
            server_before,
            updated,
            observed,
            number,
            self.edge,
            self.server,
            self.initial,
            self.streak,
            self.last_tx,
            self.version,
            *self.drift,
            self.episode,
            self.trigger,
            self.seen,
        )


def finish(folded: DataFrame, configs: Sequence[AdaptiveConfig]) -> DataFrame:
    """Decision columns of the folded rows, as the frozen decisions have them."""
    modes = F.create_map(*[F.lit(x) for c in configs for x in (c.config_id, c.effective_mode)])
    keep = F.col("transmitted") | F.col("prediction").isNull()
    return (
        folded.withColumn("predictor_mode", modes[F.col("config_id")])
        .withColumn("timestamp", F.timestamp_micros("ts_us"))
        .withColumn("suppressed", ~F.col("transmitted"))
        .withColumn(
            "reconstructed", F.when(keep, F.col("value")).otherwise(F.col("prediction"))
        )
        .withColumn("reconstruction_error", F.col("value") - F.col("reconstructed"))
        .withColumn("decision", F.when(F.col("transmitted"), "transmit").otherwise("suppress"))
        .withColumn(
            "consecutive_suppression",
            F.when(F.col("transmitted"), F.lit(0)).otherwise(F.col("prior_suppressions") + 1),
        )
        .withColumn("innovation", F.col("residual"))
    )


def observed(decisions: DataFrame) -> DataFrame:
    """Rows that count as predictions: predicted, with a valid value."""
    return decisions.where(_is_observed())


def _is_observed() -> Column:
    valid = ~F.isnan("value") & (F.col("value") >= 0) & (F.col("value") < F.lit(float("inf")))
    return F.col("edge_prediction").isNotNull() & valid


# traces ------------------------------------------------------------------------------------


def update_trace(decisions: DataFrame) -> DataFrame:
    """Every bias move that edge and server share."""
    return decisions.where("updated").select(
        *KEY,
        "timestamp",
        "event_id",
        "predictor_mode",
        F.col("forced_reason").alias("reason"),
        "innovation",
        "edge_bias_before",
        F.col("edge_bias").alias("edge_bias_after"),
        "server_bias_before",
        F.col("server_bias").alias("server_bias_after"),
        F.col("version").alias("predictor_state_version"),
    )


def drift_events(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("forced_reason") == "drift_detected").select(
        *KEY,
        "timestamp",
        "event_id",
        "predictor_mode",
        F.col("prior_suppressions").alias("prior_consecutive_suppressions"),
        "innovation",
        F.abs("innovation").alias("absolute_innovation"),
        "robust_scale",
        "standardized_innovation",
        "normal_would_transmit",
        (~F.col("normal_would_transmit")).alias("additional_transmission"),
    )


def resync_events(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("forced_reason").isin(*SYNC_REASONS)).select(
        *KEY,
        "timestamp",
        "event_id",
        "predictor_mode",
        F.col("forced_reason").alias("reason"),
        F.col("prior_suppressions").alias("prior_consecutive_suppressions"),
        F.timestamp_micros("prior_last_tx_us").alias("prior_last_transmitted_timestamp"),
        "normal_would_transmit",
        (~F.col("normal_would_transmit")).alias("additional_transmission"),
    )


def bias_trace(
    decisions: DataFrame,
    every: int = 100,
    *,
    updates: bool = True,
    drift: bool = True,
    resync: bool = True,
) -> DataFrame:
    """Every n-th event of a house, plus updates, drift and resynchronisation."""
    numbered = running_totals(
        decisions,
        RUN,
        "cycle",
        ["ts_us", "household_id", "plug_id", "row_id"],
        sums={"event_number": F.lit(1)},
    )
    wanted = F.col("event_number") % F.lit(every) == 0
    if updates:
        wanted = wanted | F.col("updated")
    reason = F.coalesce(F.col("forced_reason"), F.lit(""))
    if drift:
        wanted = wanted | (reason == "drift_detected")
    if resync:
        wanted = wanted | reason.isin(*SYNC_REASONS)
    return numbered.where(wanted).select(
        *KEY,
        "event_number",
        "timestamp",
        "event_id",
        "predictor_mode",
        "edge_bias",
        "server_bias",
        F.col("warmup_bias").alias("warmup_initial_bias"),
        F.col("edge_prediction").alias("prediction"),
        "innovation",
        "transmitted",
        F.col("forced_reason").alias("reason"),
        F.col("version").alias("predictor_state_version"),
    )


def silence_durations(decisions: DataFrame, params: Params) -> DataFrame:
    """Seconds of silence that each transmission ends; the evaluation start counts as one."""
    return observed(decisions).where("transmitted").select(
        *KEY, "timestamp", "event_id", _silence(params).alias("silence_seconds")
    )


def _silence(params: Params) -> Column:
    since = F.coalesce(F.col("prior_last_tx_us"), F.lit(params.start_us))
    return F.greatest(F.col("ts_us") - since, F.lit(0)) / F.lit(1e6)


def recovery_episodes(decisions: DataFrame) -> DataFrame:
    """What happened after every drift trigger, until the plug's next one.

    A row can open an episode and be observed in the one before; both are gathered in one pass.
    """
    key = [*KEY, "episode_number"]
    error = F.abs(F.col("innovation"))
    opens = F.when(F.col("forced_reason") == "drift_detected", F.col("episode"))
    roles = F.array(
        F.struct(opens.alias("episode_number"), F.lit(True).alias("_opens")),
        F.struct(F.col("observed_episode").alias("episode_number"), F.lit(False).alias("_opens")),
    )
    rows = decisions.select(
        *KEY, "ts_us", "observed_number", "robust_scale", error.alias("_error"),
        F.inline(F.filter(roles, lambda r: r["episode_number"].isNotNull())),
    )
    seen = ~F.col("_opens")

    def nth(number: int) -> Column:
        return F.max(F.when(seen & (F.col("observed_number") == number), F.col("_error")))

    good = seen & (F.col("_error") <= F.col("robust_scale"))
    joined = rows.groupBy(*key).agg(
        F.max(F.when(F.col("_opens"), F.col("ts_us"))).alias("_trigger_us"),
        F.max(F.when(F.col("_opens"), F.col("_error"))).alias("pre_trigger_absolute_prediction_error"),
        *[nth(n).alias(f"post_trigger_prediction_error_{n}") for n in (1, 5, 10)],
        F.min(F.when(good, F.struct("observed_number", "ts_us"))).alias("_recovered"),
    )
    return joined.where(F.col("_trigger_us").isNotNull()).select(
        *key,
        F.timestamp_micros("_trigger_us").alias("trigger_timestamp"),
        F.timestamp_micros("_recovered.ts_us").alias("recovered_timestamp"),
        ((F.col("_recovered.ts_us") - F.col("_trigger_us")) / F.lit(1e6)).alias(
            "recovery_time_after_drift"
        ),
        F.col("_recovered.observed_number").alias("recovery_events_after_drift"),
        "pre_trigger_absolute_prediction_error",
        "post_trigger_prediction_error_1",
        "post_trigger_prediction_error_5",
        "post_trigger_prediction_error_10",
        F.col("_recovered").isNull().alias("unresolved"),
    )


# metrics -----------------------------------------------------------------------------------


TAILS = {"prediction_cvar95": ("prediction_p95", 0.95), "prediction_cvar99": ("prediction_p99", 0.99)}
SHARES = {"top_1_percent_squared_error_share": 0.01, "top_5_percent_squared_error_share": 0.05}


def _square(value: Column) -> Column:
    return value * value


def figure_columns() -> list[Column]:
    """Central, tail and concentration figures from the order statistics of absolute innovations.

    The largest squares are the squares of the largest absolute values.
    """
    return [
        F.col("n").alias("events"),
        (F.col("total_s") / F.col("n")).alias("prediction_mae"),
        F.sqrt(F.col("total_q") / F.col("n")).alias("prediction_rmse"),
        (F.col("signed") / F.col("n")).alias("prediction_bias"),
        *[percentile_column(n, p).alias(n) for n, p in TAILS.values()],
        *[tail_mean_column(n, p).alias(name) for name, (n, p) in TAILS.items()],
        *[top_share_column(n, f, "q", _square).alias(n) for n, f in SHARES.items()],
    ]


def _figures_of(rows: DataFrame, keys: Sequence[str], value: Column, signed: Column, **more: float) -> DataFrame:
    """One pass for all of them; ``more`` are further percentiles."""
    return order_statistics(
        rows,
        keys,
        value,
        {
            **position_ranks({**dict(TAILS.values()), **more}),
            **{n: top_share_rank(f) for n, f in SHARES.items()},
        },
        powers={"s": lambda v: v, "q": _square},
        sums={"signed": signed},
    )


def prediction_metrics(decisions: DataFrame, keys: Sequence[str] = tuple(RUN)) -> DataFrame:
    """Figures of the innovations per run, or by other keys."""
    rows = _figures_of(observed(decisions), keys, F.abs("innovation"), F.col("innovation"))
    return rows.select(*keys, *figure_columns())


def plug_predictions(decisions: DataFrame) -> DataFrame:
    """Prediction figures and final predictor state per plug."""
    final = F.struct("ts_us", "row_id", "edge_bias", "server_bias", "version", "warmup_bias")
    states = decisions.groupBy(*KEY).agg(
        F.first("predictor_mode").alias("predictor_mode"),
        F.max(final).alias("_final"),
        F.count_if(F.col("forced_reason") == "drift_detected").alias("drift_trigger_count"),
        F.count_if(F.col("forced_reason") == "periodic_sync_count").alias("periodic_sync_count"),
        F.count_if(F.col("forced_reason") == "periodic_sync_time").alias(
            "periodic_sync_time_count"
        ),
    )
    return prediction_metrics(decisions, KEY).join(
        states.select(
            *KEY,
            "predictor_mode",
            F.col("_final.warmup_bias").alias("warmup_initial_bias"),
            F.col("_final.edge_bias").alias("final_edge_bias"),
            F.col("_final.server_bias").alias("final_server_bias"),
            F.col("_final.version").alias("predictor_update_count"),
            "drift_trigger_count",
            "periodic_sync_count",
            "periodic_sync_time_count",
        ),
        KEY,
    )


def triggers_by_plug(decisions: DataFrame) -> DataFrame:
    """Drift triggers per plug: rows, since a house may have any number of plugs."""
    return (
        decisions.where(F.col("forced_reason") == "drift_detected")
        .groupBy(*RUN, F.concat_ws(":", "household_id", "plug_id").alias("plug"))
        .agg(F.count("*").alias("triggers"))
    )


def predictor_summary(
    decisions: DataFrame, configs: Sequence[AdaptiveConfig], params: Params
) -> DataFrame:
    """Prediction quality, updates, drift, synchronisation, silence and recovery per run.

    Three passes over the decisions: counts and final states per plug, episodes, and all measured
    values as one narrow table, of which every percentile, tail and share comes from one aggregate.
    """
    oracles = [c.config_id for c in configs if c.oracle]
    reason = F.coalesce(F.col("forced_reason"), F.lit(""))
    drifted, synced = reason == "drift_detected", reason.isin(*SYNC_REASONS)
    extra = ~F.col("normal_would_transmit")
    apart = F.abs(F.col("edge_bias") - F.col("server_bias")) > F.lit(params.tolerance)
    deployable = ~F.col("config_id").isin(*oracles) if oracles else F.lit(True)
    counted = {
        "predictor_update_count": F.col("updated"),
        "predictor_state_divergence_count": apart & deployable,
        "drift_trigger_count": drifted,
        "redundant_drift_trigger_count": drifted & F.col("normal_would_transmit"),
        "additional_drift_transmission_count": drifted & extra,
        "detector_cooldown_suppression_count": F.col("held_by_cooldown"),
        "periodic_sync_count_trigger_count": reason == "periodic_sync_count",
        "periodic_sync_time_trigger_count": reason == "periodic_sync_time",
        "additional_periodic_transmission_count": synced & extra,
    }
    plugs = decisions.groupBy(*KEY).agg(
        F.first("predictor_mode").alias("predictor_mode"),
        F.count("*").alias("_events"),
        *[F.count_if(c).alias(n) for n, c in counted.items()],
        F.max("streak").alias("maximum_consecutive_suppressions_observed"),
        # bias at the end
        F.abs(F.max(F.struct("ts_us", "row_id", "server_bias"))["server_bias"]).alias("_bias"),
    )
    totals = plugs.groupBy(*RUN).agg(
        F.first("predictor_mode").alias("predictor_mode"),
        *[F.sum(n).alias(n) for n in ("_events", *counted)],
        F.max("maximum_consecutive_suppressions_observed").alias("maximum_consecutive_suppressions_observed"),
        F.avg("_bias").alias("mean_abs_adaptive_bias"),
        F.max("_bias").alias("max_abs_adaptive_bias"),
    )
    episodes = write_through(recovery_episodes(decisions), "episodes")
    recovery = episodes.groupBy(*RUN).agg(
        F.max("recovery_time_after_drift").alias("max_recovery_time_after_drift"),
        F.avg(
            F.col("pre_trigger_absolute_prediction_error")
            - F.col("post_trigger_prediction_error_1")
        ).alias("mean_error_reduction_after_resync"),
        F.count_if("unresolved").alias("number_of_unresolved_drift_episodes"),
    )
    known, signed = _is_observed(), F.col("innovation")
    values = {
        "innovation": F.when(known, F.abs("innovation")),
        "trigger": F.when(drifted, F.col("standardized_innovation")),
        "silence": F.when(known & F.col("transmitted"), _silence(params)),
    }
    listed = F.array(
        *[F.struct(F.lit(n).alias("kind"), v.cast("double").alias("value"), signed.alias("signed")) for n, v in values.items()]
    )
    measured = decisions.select(*RUN, F.inline(F.filter(listed, lambda x: x["value"].isNotNull())))
    recovered = episodes.select(
        *RUN, F.lit("recovery").alias("kind"), F.col("recovery_time_after_drift").alias("value"), F.lit(None).cast("double").alias("signed")
    )
    measured = write_through(measured.unionByName(recovered), "measured")
    found = _figures_of(measured, [*RUN, "kind"], F.col("value"), F.col("signed"), p50=0.5, p95=0.95)

    def of(kind: str, **columns: Column) -> DataFrame:
        return found.where(F.col("kind") == kind).select(*RUN, *[c.alias(n) for n, c in columns.items()])

    joined = found.where(F.col("kind") == "innovation").select(*RUN, *figure_columns()).join(totals, RUN, "right")
    tables = (
        of("trigger", median_standardized_innovation_at_trigger=percentile_column("p50", 0.5),
           max_standardized_innovation_at_trigger=F.col("most")),
        of("silence", mean_silence_seconds=F.col("total_s") / F.col("n"), max_silence_seconds=F.col("most"),
           p95_silence_seconds=percentile_column("p95", 0.95)),
        recovery,
        of("recovery", median_recovery_time_after_drift=percentile_column("p50", 0.5),
           p95_recovery_time_after_drift=percentile_column("p95", 0.95)),
    )
    for table in tables:
        joined = joined.join(table, RUN, "left")
    zeros = [
        f.name
        for f in joined.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in RUN
    ]
    events = F.col("_events")
    return (
        joined.fillna(0, zeros)
        .withColumn("predictor_update_rate", F.col("predictor_update_count") / events)
        .withColumn("drift_trigger_rate", F.col("drift_trigger_count") / events)
        .withColumn(
            "transmission_increase_due_to_synchronization",
            F.col("additional_periodic_transmission_count") / events,
        )
        .withColumn("deployable", deployable)
        .withColumn("oracle_diagnostic", ~deployable)
        .drop("_events")
    )


def prediction_outliers(decisions: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest innovations per run."""
    worst = Window.partitionBy(*RUN).orderBy(
        F.desc(F.abs("innovation")), F.asc("ts_us"), F.asc("row_id")
    )
    return (
        observed(decisions)
        .withColumn("outlier_rank", F.row_number().over(worst))
        .where(F.col("outlier_rank") <= k)
        .select(
            *RUN,
            "outlier_rank",
            "timestamp",
            "event_id",
            "household_id",
            "plug_id",
            F.col("value").alias("actual"),
            F.col("edge_prediction").alias("prediction"),
            "innovation",
            F.abs("innovation").alias("absolute_prediction_error"),
            "threshold_used",
            "transmitted",
            F.col("forced_reason").alias("reason"),
            "predictor_mode",
            F.col("prior_suppressions").alias("prior_consecutive_suppressions"),
            "standardized_innovation",
        )
    )
