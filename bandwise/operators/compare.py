"""Comparisons between runs: differences, matches, dominance, selection, root causes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bandwise.functions.stats import spearman, to_digits

CYCLE = ["house_id", "cycle"]
PLUG_CYCLE = ["house_id", "cycle", "household_id", "plug_id"]
# Compared objectives, fields of the tail table, compared metrics.
OBJECTIVES = ("transmission_ratio", "rmse", "cvar99", "max")
TAIL_FIELDS = (
    "mode",
    "p95",
    "p99",
    "max",
    "cvar95",
    "cvar99",
    "rmse",
    "mae",
    "transmission_ratio",
    "max_bound_utilization",
    "mean_budget_utilization",
)
DELTA_METRICS = ("transmission_ratio", "mae", "rmse", "p95", "p99", "max", "cvar95", "cvar99")


def tail_comparison(summary: DataFrame) -> DataFrame:
    return summary.select("config_id", "house_id", *TAIL_FIELDS)


def one_config(table: DataFrame, config_id: str) -> DataFrame:
    return table.where(F.col("config_id") == config_id)


# hierarchy against flat ----------------------------------------------------------------------


def hierarchy_cycles(flat: DataFrame, hierarchical: DataFrame, tolerance: float) -> DataFrame:
    """Distance of two threshold traces per shared allocation with at least two households.

    A plug that only one trace has counts with threshold 0 in the other.
    """
    budget = F.greatest(
        F.coalesce("_budget_left", F.lit(0.0)), F.coalesce("_budget_right", F.lit(0.0))
    )
    shared = (
        flat.select(*CYCLE).distinct().join(hierarchical.select(*CYCLE).distinct(), CYCLE)
    )

    def side(trace: DataFrame, name: str) -> DataFrame:
        return trace.join(shared, CYCLE, "left_semi").select(
            *PLUG_CYCLE,
            F.col("threshold").alias(f"_threshold_{name}"),
            F.col("house_budget").alias(f"_budget_{name}"),
            F.col("allocation_timestamp").alias(f"_at_{name}"),
        )

    zero = F.lit(0.0)
    pairs = side(flat, "left").join(side(hierarchical, "right"), PLUG_CYCLE, "full_outer")
    left = F.coalesce("_threshold_left", zero)
    right = F.coalesce("_threshold_right", zero)
    households = pairs.groupBy(*CYCLE, "household_id").agg(
        F.max(F.coalesce("_at_left", "_at_right")).alias("allocation_timestamp"),
        F.count("*").alias("_plugs"),
        F.sum(F.abs(right - left)).alias("_l1"),
        F.abs(F.sum(right) - F.sum(left)).alias("_household_l1"),
        F.max(budget).alias("_budget"),
    )

    def normal(total: Column) -> Column:
        return F.when(F.max("_budget") > 0, total / F.max("_budget")).otherwise(zero)

    return (
        households.groupBy(*CYCLE)
        .agg(
            F.max("allocation_timestamp").alias("allocation_timestamp"),
            F.count("*").alias("active_households"),
            F.sum("_plugs").alias("active_plugs"),
            normal(F.sum("_l1")).alias("threshold_l1_normalized"),
            normal(F.sum("_household_l1")).alias("household_budget_l1_normalized"),
        )
        .where(F.col("active_households") >= 2)
        .withColumn("hierarchy_changed", F.col("threshold_l1_normalized") > F.lit(tolerance))
    )


def hierarchy_effect(cycles: DataFrame) -> DataFrame:
    changed = F.count_if("hierarchy_changed")
    return cycles.groupBy("house_id").agg(
        F.count("*").alias("eligible_allocation_cycles"),
        changed.alias("hierarchy_changed_cycles"),
        (changed / F.count("*")).alias("hierarchy_effect_rate"),
        F.avg("threshold_l1_normalized").alias("mean_threshold_l1_distance_vs_flat"),
        F.max("threshold_l1_normalized").alias("max_threshold_l1_distance_vs_flat"),
        F.avg("household_budget_l1_normalized").alias(
            "mean_household_budget_l1_distance_vs_flat"
        ),
    )


# equivalence and repeatability -----------------------------------------------------------------


def threshold_equivalence(
    left: DataFrame,
    right: DataFrame,
    left_decisions: DataFrame,
    right_decisions: DataFrame,
    tolerance: float,
) -> DataFrame:
    """Whether two runs have the same thresholds within a tolerance and equal decisions."""
    pairs = left.select(*PLUG_CYCLE, F.col("threshold").alias("_l")).join(
        right.select(*PLUG_CYCLE, F.col("threshold").alias("_r")), PLUG_CYCLE, "full_outer"
    )
    thresholds = pairs.groupBy("house_id").agg(
        F.count("*").alias("threshold_rows"),
        F.max(F.abs(F.col("_l") - F.col("_r"))).alias("max_difference"),
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("_unmatched"),
    )
    event = ["house_id", "event_id", "row_id"]
    decisions = (
        left_decisions.select(*event, F.col("transmitted").alias("_l"))
        .join(right_decisions.select(*event, F.col("transmitted").alias("_r")), event, "full_outer")
        .groupBy("house_id")
        .agg(F.count_if(~F.col("_l").eqNullSafe(F.col("_r"))).alias("decision_mismatches"))
    )
    joined = thresholds.join(decisions, "house_id", "full_outer")
    return joined.select(
        "house_id",
        F.coalesce("threshold_rows", F.lit(0)).alias("threshold_rows"),
        F.coalesce("max_difference", F.lit(0.0)).alias("max_difference"),
        (F.coalesce("decision_mismatches", F.lit(0)) == 0).alias("decisions_equal"),
        (
            (F.coalesce("_unmatched", F.lit(0)) == 0)
            & (F.coalesce("max_difference", F.lit(0.0)) <= F.lit(tolerance))
            & (F.coalesce("decision_mismatches", F.lit(0)) == 0)
        ).alias("equivalent"),
    )


def repeatability(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two result tables that the other does not have; both are 0 for equal runs."""
    missing = left.exceptAll(right).select(F.lit(1).alias("_left"), F.lit(0).alias("_right"))
    extra = right.exceptAll(left).select(F.lit(0).alias("_left"), F.lit(1).alias("_right"))
    counts = missing.unionByName(extra).agg(
        F.coalesce(F.sum("_left"), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum("_right"), F.lit(0)).alias("only_right"),
    )
    return counts.withColumn(
        "identical", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


# exact against proxy ---------------------------------------------------------------------------


def score_pairs(exact: DataFrame, proxy: DataFrame) -> DataFrame:
    """Scores and thresholds of both estimators where both allocated."""
    key = ["config_id", *PLUG_CYCLE]
    left = exact.select(
        *key,
        "allocation_timestamp",
        "house_budget",
        F.col("score").alias("exact_score"),
        F.col("threshold").alias("exact_threshold"),
    )
    right = proxy.select(
        *key, F.col("score").alias("proxy_score"), F.col("threshold").alias("proxy_threshold")
    )
    error = F.abs(F.col("proxy_score") - F.col("exact_score"))
    return left.join(right, key).withColumn(
        "score_relative_error", error / F.greatest(F.abs("exact_score"), F.lit(1e-12))
    )


def exact_proxy_comparison(
    exact_trace: DataFrame,
    proxy_trace: DataFrame,
    exact_decisions: DataFrame,
    proxy_decisions: DataFrame,
    exact_summary: DataFrame,
    proxy_summary: DataFrame,
) -> DataFrame:
    """Agreement of the estimators per configuration and house, with metric deltas."""
    run = ["config_id", "house_id"]
    pairs = score_pairs(exact_trace, proxy_trace)
    errors = pairs.groupBy(*run).agg(
        F.count("*").alias("aligned_score_rows"),
        F.avg("score_relative_error").alias("mean_score_relative_error"),
    )
    ranks = spearman(
        pairs, run, "exact_score", "proxy_score", "spearman_score_rank_correlation"
    )
    moved = F.sum(F.abs(F.col("proxy_threshold") - F.col("exact_threshold")))
    distance = (
        pairs.groupBy(*run, "cycle")
        .agg(
            F.when(F.max("house_budget") > 0, moved / F.max("house_budget"))
            .otherwise(F.lit(0.0))
            .alias("_l1")
        )
        .groupBy(*run)
        .agg(F.avg("_l1").alias("mean_threshold_l1_distance"))
    )
    event = [*run, "event_id", "row_id"]
    both = exact_decisions.select(*event, F.col("transmitted").alias("_e")).join(
        proxy_decisions.select(*event, F.col("transmitted").alias("_p")), event
    )
    disagreement = both.groupBy(*run).agg(
        (F.count_if(F.col("_e") != F.col("_p")) / F.count("*")).alias(
            "decision_disagreement_rate"
        )
    )
    left = exact_summary.select(*run, *[F.col(m).alias(f"_e_{m}") for m in DELTA_METRICS])
    right = proxy_summary.select(*run, *[F.col(m).alias(f"_p_{m}") for m in DELTA_METRICS])
    deltas = left.join(right, run).select(
        *run, *[(F.col(f"_p_{m}") - F.col(f"_e_{m}")).alias(f"delta_{m}") for m in DELTA_METRICS]
    )
    joined = deltas.join(disagreement, run)
    for table in (errors, ranks, distance):
        joined = joined.join(table, run, "left")
    return joined.fillna(
        0.0,
        [
            "mean_score_relative_error",
            "spearman_score_rank_correlation",
            "mean_threshold_l1_distance",
        ],
    ).fillna(0, ["aligned_score_rows"])


# points of a sweep: small tables, one row per configuration and house ----------------------------


def matched_by(
    points: DataFrame, baselines: DataFrame, measure: str, prefix: str, digits: int | None = None
) -> DataFrame:
    """For every point the baseline of its house whose ``measure`` is nearest.

    Gaps are compared exactly, or to ``digits`` digits.  On ties the smallest epsilon counts.  Baselines are collected into one array per house,
    bounded by the sweep's grid, so this is an equi join of per-house rows.
    """
    fields = [c for c in baselines.columns if c != "house_id"]
    choices = baselines.groupBy("house_id").agg(
        F.collect_list(F.struct(*fields)).alias("_choices")
    )
    ranked = F.transform(
        "_choices",
        lambda b: F.struct(
            to_digits(F.abs(b[measure] - F.col(measure)), digits).alias("gap"),
            b["epsilon"].alias("epsilon"),
            b.alias("base"),
        ),
    )
    best = F.array_min(ranked)
    return (
        points.join(choices, "house_id")
        .withColumn("_best", best)
        .select(
            *points.columns,
            *[F.col(f"_best.base.{f}").alias(f"{prefix}{f}") for f in fields],
            F.col("_best.gap").alias(f"{prefix}gap"),
        )
    )


def matched_transmission(
    points: DataFrame, baseline_mode: str = "uniform", digits: int | None = None
) -> DataFrame:
    """Every non-baseline point with the baseline point of the nearest transmission ratio."""
    fields = ["house_id", "epsilon", "transmission_ratio", "rmse", "cvar99"]
    others = points.where(F.col("mode") != baseline_mode).select("mode", *fields)
    base = points.where(F.col("mode") == baseline_mode).select(*fields)
    matched = matched_by(others, base, "transmission_ratio", "matched_", digits)
    return matched.select(
        "house_id",
        "mode",
        F.col("epsilon").alias("mode_epsilon"),
        F.col("transmission_ratio").alias("mode_tr"),
        F.col("rmse").alias("mode_rmse"),
        F.col("cvar99").alias("mode_cvar99"),
        F.col("matched_epsilon").alias("matched_uniform_epsilon"),
        F.col("matched_transmission_ratio").alias("matched_uniform_tr"),
        F.col("matched_rmse").alias("matched_uniform_rmse"),
        F.col("matched_cvar99").alias("matched_uniform_cvar99"),
        F.col("matched_gap").alias("absolute_tr_gap"),
    )


def with_dominance(points: DataFrame, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """Flag points that another point of the house beats: nowhere worse, somewhere better.

    The points of a house are a bounded grid, so they travel as one array.
    """
    rivals = points.groupBy("house_id").agg(
        F.collect_list(F.struct(*objectives)).alias("_rivals")
    )

    def beats(rival: Column) -> Column:
        no_worse, better = F.lit(True), F.lit(False)
        for name in objectives:
            no_worse = no_worse & (rival[name] <= F.col(name))
            better = better | (rival[name] < F.col(name))
        return no_worse & better

    return (
        points.join(rivals, "house_id")
        .withColumn("pareto_dominated", F.exists("_rivals", beats))
        .drop("_rivals")
    )


def predictor_matches(
    points: DataFrame, frozen: str = "slot_median_frozen", digits: int | None = None
) -> DataFrame:
    """Adaptive points against the frozen points nearest in transmission and nearest in CVaR99."""
    fields = ["house_id", "epsilon", "transmission_ratio", "rmse", "cvar99", "max"]
    adaptive = points.where(F.col("predictor_mode") != frozen).select("predictor_mode", *fields)
    base = points.where(F.col("predictor_mode") == frozen).select(*fields)
    by_ratio = matched_by(adaptive, base, "transmission_ratio", "frozen_", digits)
    both = matched_by(
        by_ratio.drop("frozen_gap"),
        base.select("house_id", "epsilon", "transmission_ratio", "cvar99"),
        "cvar99",
        "tail_",
        digits,
    )
    return both.select(
        "house_id",
        "predictor_mode",
        F.col("epsilon").alias("adaptive_epsilon_ratio"),
        F.col("frozen_epsilon").alias("frozen_epsilon_ratio"),
        F.col("transmission_ratio").alias("adaptive_transmission_ratio"),
        "frozen_transmission_ratio",
        (F.col("transmission_ratio") - F.col("frozen_transmission_ratio")).alias(
            "transmission_ratio_gap"
        ),
        F.col("rmse").alias("rmse_at_matched_tr"),
        F.col("frozen_rmse").alias("frozen_rmse_at_matched_tr"),
        F.col("cvar99").alias("cvar99_at_matched_tr"),
        F.col("frozen_cvar99").alias("frozen_cvar99_at_matched_tr"),
        F.col("max").alias("max_at_matched_tr"),
        F.col("frozen_max").alias("frozen_max_at_matched_tr"),
        F.col("transmission_ratio").alias("adaptive_tr_at_matched_cvar99"),
        F.col("tail_transmission_ratio").alias("frozen_tr_at_matched_cvar99"),
        F.col("cvar99").alias("adaptive_cvar99_target"),
        F.col("tail_cvar99").alias("frozen_cvar99_at_matched_cvar99"),
    )


def tradeoff_summary(points: DataFrame, matches: DataFrame, frozen="slot_median_frozen"):
    """Counts of a predictor sweep per house."""
    adaptive = F.when(F.col("predictor_mode") != frozen, F.col("predictor_mode"))
    counted = with_dominance(points).groupBy("house_id").agg(
        F.count("*").alias("point_count"),
        F.count_if("pareto_dominated").alias("pareto_dominated_point_count"),
        F.array_sort(F.collect_set(adaptive)).alias("adaptive_modes"),
    )
    pairs = matches.groupBy("house_id").agg(F.count("*").alias("matched_pair_count"))
    return counted.join(pairs, "house_id", "left").fillna(0, ["matched_pair_count"])


def best_pick(
    candidates: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    digits: int | None = None,
) -> DataFrame:
    """First candidate of every group in a lexicographic order; a bounded grid per group.

    Named figures are compared exactly.  With ``digits`` they are compared to so many digits, so that sums of the same
    numbers in another order are ties.
    """
    kinds = dict(candidates.dtypes)
    steps = [
        to_digits(F.col(c), digits) if isinstance(c, str) and kinds[c] == "double" else c
        for c in order
    ]
    ranked = Window.partitionBy(*keys).orderBy(*steps)
    return (
        candidates.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def against_frozen(rows: DataFrame, frozen: str = "slot_median_frozen") -> DataFrame:
    """Differences of every predictor to the frozen one of the same house and allocator."""
    key = ["house_id", "mode"]
    base = rows.where(F.col("predictor_mode") == frozen).select(
        *key, *[F.col(c).alias(f"_frozen_{c}") for c in OBJECTIVES]
    )
    joined = rows.join(base, key)

    def delta(name: str) -> Column:
        return F.col(name) - F.col(f"_frozen_{name}")

    extra = delta("transmission_ratio")
    return joined.withColumns(
        {
            "additional_TR_vs_frozen": extra,
            "RMSE_delta_vs_frozen": delta("rmse"),
            "CVaR99_delta_vs_frozen": delta("cvar99"),
            "Max_delta_vs_frozen": delta("max"),
            "tail_reduction_per_additional_transmission": F.when(
                extra > 0, -delta("cvar99") / extra
            ).otherwise(F.lit(0.0)),
        }
    ).drop(*[f"_frozen_{c}" for c in OBJECTIVES])


# outlier root causes -----------------------------------------------------------------------------


def outlier_class() -> Column:
    """Most likely cause of a large prediction error; the first rule that applies."""
    # The class names, 20 suppressions in a row, 10 and 5 robust scales.
    z = F.coalesce("standardized_innovation", F.lit(0.0))
    reason = F.coalesce("reason", F.lit(""))
    return (
        F.when(reason == "inactive_reactivation", "reactivation")
        .when(
            F.coalesce("prior_consecutive_suppressions", F.lit(0)) >= 20,
            "long_suppression_streak",
        )
        .when(z >= 10.0, "isolated_spike")
        .when((reason == "drift_detected") & (z >= 5.0), "abrupt_regime_change")
        .when(reason == "drift_detected", "gradual_drift")
        .when(F.coalesce("threshold_used", F.lit(0.0)) <= 0.0, "threshold_concentration")
        .otherwise("persistent_predictor_bias")
    )


def root_causes(frozen: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Top outliers of two predictors side by side, with the class of each."""
    shown = [
        "timestamp",
        "household_id",
        "plug_id",
        "absolute_prediction_error",
        "threshold_used",
        "reason",
        "prior_consecutive_suppressions",
        "standardized_innovation",
    ]

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(
            "house_id", "event_id", F.struct(*shown).alias(name)
        )

    both = side(frozen, "_f").join(side(adaptive, "_a"), ["house_id", "event_id"], "full_outer")
    source = F.coalesce("_a", "_f")
    rows = both.withColumn("_s", source).select("house_id", "event_id", "_f", "_a", "_s.*")
    return rows.select(
        "house_id",
        "event_id",
        "timestamp",
        "household_id",
        "plug_id",
        outlier_class().alias("classification"),
        F.col("_f").isNotNull().alias("in_frozen_top"),
        F.col("_a").isNotNull().alias("in_adaptive_top"),
        F.col("_f.absolute_prediction_error").alias("frozen_absolute_prediction_error"),
        F.col("_a.absolute_prediction_error").alias("adaptive_absolute_prediction_error"),
        (
            F.col("_f.absolute_prediction_error") - F.col("_a.absolute_prediction_error")
        ).alias("error_reduction"),
        F.col("_a.reason").alias("adaptive_reason"),
    )


def root_cause_counts(causes: DataFrame) -> DataFrame:
    return causes.groupBy("house_id", "classification").agg(F.count("*").alias("outliers"))


def outlier_changes(causes: DataFrame, adaptive_summary: DataFrame) -> DataFrame:
    """Overlap, removed and introduced outliers, and how precise the drift triggers were."""
    kept = F.col("in_frozen_top") & F.col("in_adaptive_top")
    counts = causes.groupBy("house_id").agg(
        F.count_if(kept).alias("outlier_overlap_count"),
        F.count_if(F.col("in_frozen_top") & ~F.col("in_adaptive_top")).alias(
            "outlier_removed_by_adaptive_count"
        ),
        F.count_if(~F.col("in_frozen_top") & F.col("in_adaptive_top")).alias(
            "new_outlier_introduced_count"
        ),
        F.sum("frozen_absolute_prediction_error").alias("predictor_error_contribution"),
        F.count_if(F.col("classification") == "threshold_concentration").alias(
            "threshold_concentration_contribution"
        ),
        F.count_if(F.col("classification") == "long_suppression_streak").alias(
            "suppression_streak_contribution"
        ),
    )
    triggers = F.col("drift_trigger_count")
    redundant = F.col("redundant_drift_trigger_count") / triggers
    precision = adaptive_summary.select(
        "house_id",
        F.when(triggers > 0, F.lit(1.0) - redundant)
        .otherwise(F.lit(0.0))
        .alias("trigger_precision_proxy"),
        F.when(triggers > 0, redundant).otherwise(F.lit(0.0)).alias("redundant_trigger_rate"),
        "median_recovery_time_after_drift",
        "p95_recovery_time_after_drift",
        "mean_error_reduction_after_resync",
    )
    return counts.join(precision, "house_id")
