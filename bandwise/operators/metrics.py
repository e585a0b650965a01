"""Summaries of decisions, batches and allocations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.functions.stats import tail_means, to_digits
from bandwise.operators.allocate import cycle_budgets
from bandwise.operators.decide import FORCED_REASONS

RUN = ["config_id", "house_id"]
BUDGET_TOLERANCE = 1e-9


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def error_tails(batches: DataFrame) -> DataFrame:
    """Quantiles of the absolute house error and the mean beyond them."""
    return tail_means(
        batches,
        RUN,
        F.col("abs_house_error"),
        {"cvar95": ("p95", 0.95), "cvar99": ("p99", 0.99)},
    )


def batch_metrics(batches: DataFrame, *, reasons: Sequence[str] = FORCED_REASONS) -> DataFrame:
    """Counts, central errors and utilisation per run, from the batch table alone."""
    events, sent = F.sum("event_count"), F.sum("transmitted_count")
    return batches.groupBy(*RUN).agg(
        F.first("mode").alias("mode"),
        events.alias("valid_events"),
        F.count("*").alias("timestamp_batches"),
        sent.alias("transmitted"),
        (events - sent).alias("suppressed"),
        _ratio(sent, events).alias("transmission_ratio"),
        (F.lit(1.0) - _ratio(sent, events)).alias("reduction"),
        F.avg("abs_house_error").alias("mae"),
        F.sqrt(F.avg(F.col("house_error") * F.col("house_error"))).alias("rmse"),
        F.max("abs_house_error").alias("max"),
        F.count_if("bound_violation").alias("bound_violation_count"),
        F.sum("suppression_violations").alias("suppression_violation_count"),
        F.max("bound_utilization").alias("max_bound_utilization"),
        F.avg("budget_utilization").alias("mean_budget_utilization"),
        F.first("house_budget").alias("house_budget"),
        F.map_from_arrays(
            F.array(*[F.lit(r) for r in reasons]),
            F.array(*[F.sum(f"forced_{r}") for r in reasons]),
        ).alias("forced_transmit"),
    )


def budget_metrics(trace: DataFrame) -> DataFrame:
    """Unused budget, cap hits, redistribution and budget violations over the allocations."""
    return budgets_over_cycles(cycle_budgets(trace))


def budgets_over_cycles(cycles: DataFrame) -> DataFrame:
    """`budget_metrics` from one row per configuration, house and allocation."""
    return cycles.groupBy(*RUN).agg(
        F.count_if(
            F.col("used_budget") > F.col("house_budget") + F.lit(BUDGET_TOLERANCE)
        ).alias("budget_violation_count"),
        F.max("unused_budget").alias("unused_budget"),
        F.max(_ratio(F.col("unused_budget"), F.col("house_budget"))).alias("unused_budget_ratio"),
        F.count_if(F.col("unused_budget") > F.lit(BUDGET_TOLERANCE)).alias(
            "number_of_cycles_with_unused_budget"
        ),
        F.sum("cap_hit_count").alias("cap_hit_count"),
        (F.sum("cap_hit_count") / F.sum("trace_rows")).alias("cap_hit_rate"),
        F.sum("within_household_redistributed_budget").alias(
            "within_household_redistributed_budget"
        ),
        F.sum("cross_household_spill_budget").alias("cross_household_spill_budget"),
    )


def summarize(
    batches: DataFrame,
    budgets: DataFrame,
    longest: DataFrame | None = None,
    *,
    reasons: Sequence[str] = FORCED_REASONS,
) -> DataFrame:
    """The whole summary row per configuration and house.

    ``budgets``: `cycle_budgets` of the trace.

    ``longest`` (longest streak per run) is optional because it needs one more pass over the
    events; without it that column is left out.
    """
    budget_columns = [
        "budget_violation_count",
        "number_of_cycles_with_unused_budget",
        "cap_hit_count",
    ]
    amount_columns = [
        "unused_budget",
        "unused_budget_ratio",
        "cap_hit_rate",
        "within_household_redistributed_budget",
        "cross_household_spill_budget",
    ]
    summary = (
        batch_metrics(batches, reasons=reasons)
        .join(error_tails(batches), RUN)
        .join(budgets_over_cycles(budgets), RUN, "left")
        .fillna(0, budget_columns)
        .fillna(0.0, amount_columns)
    )
    if longest is not None:
        summary = summary.join(longest, RUN)
    return summary.withColumn("safety_pass", safety_pass())


def safety_pass(divergence: str | None = None) -> Column:
    """True if no bound, suppression or budget violation (and no state divergence) occurred."""
    names = ["bound_violation_count", "suppression_violation_count", "budget_violation_count"]
    verdict = F.lit(True)
    for name in [*names, *([divergence] if divergence else [])]:
        verdict = verdict & (F.col(name) == 0)
    return verdict


def assert_safe(summary: DataFrame) -> None:
    """Raise with the offending configurations if any run violated a safety bound."""
    bad = summary.where(~F.col("safety_pass")).select(*RUN).limit(10).collect()
    if bad:
        raise RuntimeError(f"safety invariant failure: {[tuple(r) for r in bad]}")


def flatten_forced(summary: DataFrame, reasons: Sequence[str] = FORCED_REASONS) -> DataFrame:
    """The forced-transmission map as ``forced_*`` columns, as flat files need it."""
    return summary.select(
        *[c for c in summary.columns if c != "forced_transmit"],
        *[
            F.coalesce(F.col("forced_transmit")[r], F.lit(0)).alias(f"forced_{r}")
            for r in reasons
        ],
    )


def daily_metrics(batches: DataFrame) -> DataFrame:
    return batches.groupBy(*RUN, F.to_date("timestamp").cast("string").alias("date")).agg(
        F.first("mode").alias("mode"),
        F.count("*").alias("batches"),
        F.avg("abs_house_error").alias("mae"),
        F.sqrt(F.avg(F.col("house_error") * F.col("house_error"))).alias("rmse"),
        F.max("abs_house_error").alias("max"),
        F.count_if("bound_violation").alias("bound_violation_count"),
    )


def _event_metrics() -> list[Column]:
    error = F.col("reconstruction_error")
    return [
        F.first("mode").alias("mode"),
        F.count("*").alias("events"),
        (F.count_if("transmitted") / F.count("*")).alias("transmission_ratio"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    ]


def household_metrics(decisions: DataFrame, trace: DataFrame) -> DataFrame:
    """Per household; the mean budget is over trace rows, 0 if the household has none."""
    key = [*RUN, "household_id"]
    budgets = trace.groupBy(*key).agg(F.avg("household_budget").alias("mean_budget"))
    return (
        decisions.groupBy(*key)
        .agg(*_event_metrics())
        .join(budgets, key, "left")
        .fillna(0.0, ["mean_budget"])
    )


def plug_metrics(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(*RUN, "household_id", "plug_id").agg(
        *_event_metrics(),
        F.avg("threshold_used").alias("threshold_mean"),
        F.max("threshold_used").alias("threshold_max"),
    )


def forced_counts(decisions: DataFrame) -> DataFrame:
    """Forced transmissions per reason; the plain dead-band reason is not forced."""
    forced = F.col("forced_reason").isNotNull() & (F.col("forced_reason") != "normal_deadband")
    return decisions.where(forced).groupBy(*RUN, "forced_reason").agg(F.count("*").alias("events"))


def top_batches(batches: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The ``k`` worst timestamps of every run, ranked; errors are compared exactly or to ``digits`` digits."""
    worst = Window.partitionBy(*RUN).orderBy(
        F.desc(to_digits(F.col("abs_house_error"), digits)), F.asc("ts_us")
    )
    ranked = batches.withColumn("batch_rank", F.row_number().over(worst))
    return ranked.where(F.col("batch_rank") <= k)


def top_outliers(
    decisions: DataFrame, batches: DataFrame, k: int, digits: int | None = None
) -> DataFrame:
    """Decisions of the worst timestamps, worst first, the first ``k`` rows per run."""
    worst = top_batches(batches, k, digits).select(
        *RUN, "cycle", "ts_us", "batch_rank", "house_error", "abs_house_error"
    )
    rows = decisions.join(worst, [*RUN, "cycle", "ts_us"])
    order = Window.partitionBy(*RUN).orderBy(
        "batch_rank",
        F.desc(F.abs("reconstruction_error")),
        "household_id",
        "plug_id",
        "row_id",
    )
    return rows.withColumn("outlier_rank", F.row_number().over(order)).where(
        F.col("outlier_rank") <= k
    )
