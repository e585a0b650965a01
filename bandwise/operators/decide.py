"""Dead-band decisions with the frozen predictor, and their batch roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.operators.cycles import SLICE
from bandwise.params import AllocationConfig, Params

# Reasons of forced transmissions, frozen predictor.
FORCED_REASONS = ("full_tx", "missing_prediction", "inactive_reactivation")
BATCH = ["config_id", "house_id", "cycle", "ts_us"]
STREAK_KEY = ["config_id", "house_id", "household_id", "plug_id"]
STREAK_SLICE = ["config_id", "house_id", "cycle", "household_id", "plug_id"]


def pack_thresholds(trace: DataFrame) -> DataFrame:
    """All configurations' thresholds of a plug in one array, in grid order."""
    packed = F.array_sort(
        F.collect_list(F.struct("config_pos", "threshold", "cap"))  # one entry per configuration
    )
    return trace.groupBy(*SLICE).agg(packed.alias("thresholds"))


def with_thresholds(
    events: DataFrame, trace: DataFrame, configs: Sequence[AllocationConfig]
) -> DataFrame:
    """One row per event and configuration; a plug outside the allocation has threshold 0.

    ``events`` bring ``mean_load`` along.

    Events meet one packed row per plug and cycle in the partitioning they already have and are
    repeated for the grid only after the join.
    """
    none = F.array(
        *[
            F.struct(
                F.lit(i).alias("config_pos"),
                F.lit(0.0).alias("threshold"),
                F.lit(None).cast("double").alias("cap"),
            )
            for i in range(len(configs))
        ]
    )
    joined = events.join(pack_thresholds(trace), SLICE, "left")
    repeated = joined.select(
        "*", F.inline(F.coalesce(F.col("thresholds"), none))
    ).drop("thresholds")

    def of_grid(field: str) -> Column:
        return F.get(
            F.array(*[F.lit(getattr(c, field)) for c in configs]), F.col("config_pos")
        )

    return (
        repeated.withColumn("config_id", of_grid("config_id"))
        .withColumn("mode", of_grid("mode"))
        .withColumn("house_budget", of_grid("epsilon") * F.col("mean_load"))
        .withColumnRenamed("threshold", "threshold_used")
        .drop("mean_load")
    )


def decide(rows: DataFrame) -> DataFrame:
    """Reason, decision and reconstruction of every row that has a threshold.

    A missing prediction is compared as residual 0; equality with the threshold suppresses.
    """
    reason = (
        F.when(F.col("mode") == "full_tx", "full_tx")
        .when(F.col("prediction").isNull(), "missing_prediction")
        .when(F.col("reactivated"), "inactive_reactivation")
    )
    residual = F.coalesce(F.col("residual"), F.lit(0.0))
    decided = rows.withColumn("forced_reason", reason).withColumn(
        "transmitted",
        F.col("forced_reason").isNotNull() | (F.abs(residual) > F.col("threshold_used")),
    )
    keep = F.col("transmitted") | F.col("prediction").isNull()
    return (
        decided.withColumn("suppressed", ~F.col("transmitted"))
        .withColumn(
            "reconstructed", F.when(keep, F.col("value")).otherwise(F.col("prediction"))
        )
        .withColumn("reconstruction_error", F.col("value") - F.col("reconstructed"))
        .withColumn("decision", F.when(F.col("transmitted"), "transmit").otherwise("suppress"))
    )


def roll_up(
    decisions: DataFrame, budgets: DataFrame, params: Params, *, reasons: Sequence[str]
) -> DataFrame:
    """One row per configuration, house and timestamp, with the counts summaries need."""
    violation = F.col("suppressed") & (
        F.abs("residual") > F.col("threshold_used") + F.lit(params.tolerance)
    )
    # a configuration has one mode; as a key it leaves sums of fixed width, which need no sort
    sums = decisions.groupBy(*BATCH, "mode").agg(
        F.first("house_budget").alias("house_budget"),
        *batch_sums(),
        F.count_if(violation).alias("suppression_violations"),
        *[F.count_if(F.col("forced_reason") == r).alias(f"forced_{r}") for r in reasons],
    )
    used = budgets.select(
        "config_id", "house_id", "cycle", F.col("used_budget").alias("allocated_budget")
    )
    joined = sums.join(used, ["config_id", "house_id", "cycle"], "left")
    joined = joined.withColumn("timestamp", F.timestamp_micros("ts_us"))
    return with_batch_figures(joined, params)


def batch_sums() -> list[Column]:
    """What one timestamp of a house sums up from its decided events."""
    return [
        F.sum("value").alias("actual_house"),
        F.sum("reconstructed").alias("reconstructed_house"),
        F.count("*").alias("event_count"),
        F.count_if("transmitted").alias("transmitted_count"),
    ]


def with_batch_figures(batches: DataFrame, params: Params) -> DataFrame:
    """House error and the use of the budget, from the sums of one timestamp."""
    budget = F.col("house_budget")

    def share(part: Column) -> Column:
        return F.when(budget > 0, part / budget).otherwise(F.lit(0.0))

    return (
        batches.withColumn("house_error", F.col("actual_house") - F.col("reconstructed_house"))
        .withColumn("abs_house_error", F.abs("house_error"))
        .withColumn("allocated_budget", F.coalesce("allocated_budget", F.lit(0.0)))
        .withColumn("budget_utilization", share(F.col("allocated_budget")))
        .withColumn("bound_utilization", share(F.col("abs_house_error")))
        .withColumn("bound_violation", F.col("abs_house_error") > budget + F.lit(params.tolerance))
    )


def with_batch_error(decisions: DataFrame) -> DataFrame:
    """Add the house error of the batch to every decision; stays in the (house, cycle) slices."""
    batch = Window.partitionBy(*BATCH)
    error = F.sum("value").over(batch) - F.sum("reconstructed").over(batch)
    return (
        decisions.withColumn("house_error", error)
        .withColumn("abs_house_error", F.abs("house_error"))
        .withColumn(
            "bound_utilization",
            F.when(
                F.col("house_budget") > 0, F.col("abs_house_error") / F.col("house_budget")
            ).otherwise(F.lit(0.0)),
        )
    )


def _local_streaks(decisions: DataFrame) -> DataFrame:
    """Suppressions since the last transmission of the same plug and cycle.

    ``_after_tx`` tells whether there was one; if not, earlier cycles add to the count.
    """
    local = Window.partitionBy(*STREAK_SLICE).orderBy("ts_us", "row_id")
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.row_number().over(local)
    return (
        decisions.withColumn("_number", number)
        .withColumn("_last_tx", F.max(F.when(F.col("transmitted"), F.col("_number"))).over(upto))
        .withColumn("_after_tx", F.col("_last_tx").isNotNull())
        .withColumn("_local", F.col("_number") - F.coalesce("_last_tx", F.lit(0)))
    )


def _carried_streaks(local: DataFrame) -> DataFrame:
    """Per plug and cycle: the streak that reaches it, and its own longest ones."""
    slices = local.groupBy(*STREAK_SLICE).agg(
        F.count("*").alias("_n"),
        F.max("_after_tx").alias("_sent"),
        F.max(F.when(~F.col("_after_tx"), F.col("_local"))).alias("_lead"),
        F.max(F.when(F.col("_after_tx"), F.col("_local"))).alias("_inner"),
        F.max_by("_local", "_number").alias("_end"),
    )
    along = Window.partitionBy(*STREAK_KEY).orderBy("cycle")
    total = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # rows up to the last transmission of any cycle so far
    settled = F.when(F.col("_sent"), F.col("_upto") - F.col("_end"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn("_upto", total).withColumn(
        "_carry",
        F.col("_upto") - F.col("_n") - F.coalesce(F.max(settled).over(earlier), F.lit(0)),
    )


def with_streaks(decisions: DataFrame) -> DataFrame:
    """Add ``consecutive_suppression``: 0 on transmission, else the running count per plug."""
    local = _local_streaks(decisions)
    carried = _carried_streaks(local).select(*STREAK_SLICE, "_carry")
    streak = F.when(F.col("_after_tx"), F.col("_local")).otherwise(
        F.col("_local") + F.col("_carry")
    )
    return (
        local.join(carried, STREAK_SLICE)
        .withColumn("consecutive_suppression", streak)
        .drop("_number", "_last_tx", "_after_tx", "_local", "_carry")
    )


def longest_streaks(decisions: DataFrame) -> DataFrame:
    """Longest run of suppressions per configuration and house, in one pass over the events."""
    carried = _carried_streaks(_local_streaks(decisions))
    longest = F.greatest(F.coalesce("_lead", F.lit(0)) + F.when(
        F.col("_lead").isNotNull(), F.col("_carry")).otherwise(F.lit(0)),
        F.coalesce("_inner", F.lit(0)),
    )
    return carried.groupBy("config_id", "house_id").agg(
        F.max(longest).alias("maximum_consecutive_suppression")
    )


def decision_table(decisions: DataFrame) -> DataFrame:
    """Reported names of the decision columns; optional ones are kept where they exist."""
    wanted = [
        "config_id",
        "event_id",
        "timestamp",
        "house_id",
        "household_id",
        "plug_id",
        F.col("row_id").alias("original_row_index"),
        F.col("value").alias("actual"),
        "prediction",
        "residual",
        "threshold_used",
        "transmitted",
        "suppressed",
        "reconstructed",
        "reconstruction_error",
        "forced_reason",
        F.col("forced_reason").alias("forced_transmit_reason"),
        "decision",
        "cap",
        F.timestamp_micros("last_seen_us").alias("last_seen_timestamp"),
        "mode",
    ]
    optional = [
        c
        for c in (
            "residual_score",
            "consecutive_suppression",
            "house_error",
            "abs_house_error",
            "bound_utilization",
            "predictor_mode",
        )
        if c in decisions.columns
    ]
    return decisions.select(*wanted, *optional)


def fingerprint(decisions: DataFrame) -> DataFrame:
    """Order-free hash of the decisions per configuration and house."""
    return decisions.groupBy("config_id", "house_id").agg(
        F.bit_xor(F.xxhash64("event_id", "row_id", "transmitted")).alias("fingerprint"),
        F.count("*").alias("events"),
        F.count_if("transmitted").alias("transmitted"),
    )
